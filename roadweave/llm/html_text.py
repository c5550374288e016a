"""Operator 10: main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words, which score positive, and tags, which score negative; words
of links score by whether they stand in an article. What is boilerplate by its element
(scripts, menus, forms, asides) or by the last word of its class is no part of the
sequence. The weights are log-odds counted on labelled pages: a bounded sample of the
given pages, where the markup of articles is the label, and pages that this module makes
by rules with known content. One linear scan finds the contiguous region of the highest
score, and its text is the main text. No other rule moves the region's ends.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mapped

_NAME = r"[a-zA-Z][a-zA-Z0-9:-]*"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)({_NAME})((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")

#: Elements whose content is no markup, and those that have no content (fixed by HTML).
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements inside a line of text (fixed by HTML); all others end a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no main text whatever their attributes; a form does if it holds most of a page's words.
DROPPED = set("aside audio button canvas datalist dialog fieldset footer head header iframe input label legend map math menu nav noscript object optgroup option output script select style svg template textarea title video".split())
#: Elements that may stand in a head (fixed by HTML); any other one ends it.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Words of class, id and role values that mark boilerplate where they come last.
MARKS = set(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr header legal login masthead menu modal nav navbar navigation navigationbar newsletter notice notices notification notifications pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser teasers toc toolbar topbar widget widgets".split()
)
#: Those of them that mark it wherever they stand.
STRONG = set("ad ads adbox advert adverts advertisement advertising consent cookie cookies disqus gdpr newsletter promo promoted promotion recommended related share sharing social sponsor sponsored subscribe".split())
#: Words for a part's shape; what comes before them counts. After words for having or lacking something nothing is marked.
SHAPES = set("area bar block box body col column container content dialog div group holder inner item items layer left link links list outer panel right row section text wrap wrapper".split())
HAVING = set("has have no not with without".split())
CONTENT = set("article body container content entry layout main page post story text wrapper".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of an article's class or id that name the parts of others beside the text.
READERS = {"comment", "comments", "reply", "replies", "teaser", "teasers"}
#: Elements never left out for their class or id.
KEPT = {"html", "body", "article", "main"}
#: Elements closed by the next one of these (fixed by HTML).
_CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"td", "th", "article", "section", "div", "body"}}


def _marks(value: str) -> bool:
    """Whether a class, id or role says boilerplate."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"\d+", " ", value)) if w]
    if not words or HAVING & set(words):
        return False
    if STRONG & set(words):
        return True
    while len(words) > 1 and words[-1] in SHAPES:
        words.pop()
    return words[-1] in MARKS


def _marked(name: str, attributes: str) -> bool:
    """Whether an element's attributes say that it isn't shown, or is boilerplate; a heading's class never says that."""
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), re.sub(r"([a-z])([A-Z])", r"\1-\2", value.strip("\"'")).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key in ("class", "id", "role", "itemprop") and name not in HEADINGS and any(map(_marks, value.split())):
            return True
    return False


def _reader(attributes: str) -> bool:
    """Whether a class or id says that an article is a comment or a teaser."""
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for one in value.strip("\"'").lower().split():
                parts = set(re.findall(r"[a-z]+", one))
                if parts & READERS and parts <= READERS | CONTENT:
                    return True
    return False


def events(page: str) -> list[tuple]:
    """("tag", name, starts a block) and ("text", decoded text, kind); kinds: inside, plain, inside link, link, dropped.

    inside says that text is in an article or main element, on pages where these hold most of the words that are neither
    dropped nor links; plain is all other text. Articles that are comments or teasers are dropped if they hold fewer words
    than the rest, and each form that doesn't hold most words. Tags of what is dropped are ("tag", name, ...) of the kind None: no part of the sequence.
    """
    found = list(_events(page))
    count = Counter()
    for what, value, kind, form in found:
        if what == "text" and kind != "dropped":
            count[kind] += len(value.split())
            count[form] += len(value.split())
    all_ = sum(count[k] for k in ("inside", "outside", "reader", "link", "inside link"))
    fewer = count["reader"] < count["inside"] + count["outside"]
    most = count["inside"] + (0 if fewer else count["reader"]) >= count["outside"]
    kinds = {"outside": "plain", "inside": "inside" if most else "plain", "inside link": "inside link" if most else "link", "link": "link", "dropped": "dropped"}
    kinds["reader"] = "dropped" if fewer else kinds["inside"]
    out = []
    for what, value, kind, form in found:
        gone = form and 2 * count[form] <= all_
        if what == "text":
            out.append((what, value, "dropped" if gone else kinds[kind]))
        else:
            starts, where = kind
            out.append((what if not gone and kinds[where] != "dropped" else "gone", value, starts))
    return out


def _events(page: str):
    """The events with kinds by place only (inside and outside an article, links of both, reader, dropped), and the number of the form that holds them, or 0."""
    stack: list[tuple[str, bool, bool]] = []
    dropped = links = articles = readers = forms = form = 0
    at = 0

    def where() -> str:
        return "dropped" if dropped else "reader" if readers else ("inside link" if links else "inside") if articles else "link" if links else "outside"

    def close(index: int):
        nonlocal dropped, links, articles, readers, forms
        for name, bad, reader in stack[index:]:
            dropped -= bad
            forms -= name == "form"
            links -= name == "a"
            articles -= name in ("article", "main")
            readers -= reader
        del stack[index:]

    def text(raw: str):
        return ("text", html_lib.unescape(raw), where(), form if forms else 0)

    def tag(name: str, block: bool):
        return ("tag", name, (block, where()), form if forms else 0)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            yield text(page[at:])
            return
        if m.start() > at:
            yield text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            end = tag("/" + name, name not in INLINE)  # stands where its element stood
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            yield end
            continue
        if any(x[0] == "head" for x in stack[:3]) and name not in IN_HEAD:
            close(next(i for i, x in enumerate(stack) if x[0] == "head"))
        if name in _CLOSES_P or name in _CLOSES_OWN:
            own = _CLOSES_OWN.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in own:
                    close(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] in (_SCOPES.get(name, set()) | _SCOPES["p"]):
                    break
        if name in VOID:
            yield tag(name, name not in INLINE)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield ("tag", name, (True, "dropped" if name in DROPPED else where()), form if forms else 0)
            continue
        if m[3].rstrip().endswith("/") and name in ("svg", "path", "iframe"):
            continue
        bad = name in DROPPED or (name not in KEPT and _marked(name, m[3]))
        reader = name == "article" and _reader(m[3])
        stack.append((name, bad, reader))
        dropped += bad
        readers += reader
        links += name == "a"
        form += name == "form" and not forms
        forms += name == "form"
        articles += name in ("article", "main")
        yield tag(name, name not in INLINE)


def made_pages(n: int = 60, seed: int = 5):
    """Pages made by rules, as lists of (event, is content)."""
    rng = random.Random(seed)

    def words(k):
        return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(k))

    for _ in range(n):
        menu = "".join(f'<li><a href="/{i}">{words(rng.randint(1, 3))}</a></li>' for i in range(rng.randint(3, 12)))
        blocks = ["<p>{}</p>", "<p>{}<br>", "<p><b>{}</b></p>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", '<p>{} <a href="#">more of it</a> and on</p>', '<p><a href="#">{}</a></p>']
        rows = ["<ul>{}</ul>", "<ol>{}</ol>", "<table>{}</table>"]
        body = f"<h1>{words(rng.randint(3, 9))}</h1>"
        for _ in range(rng.randint(2, 14)):
            if rng.random() < 0.75:
                body += rng.choice(blocks).format(words(rng.choice([2, 12, 40, 80])))
            else:
                shape = rng.choice(rows)
                body += shape.format("".join((f"<tr><td>{words(2)}</td><td>{words(3)}</td></tr>" if "table" in shape else f"<li>{words(rng.randint(1, 6))}</li>") for _ in range(rng.randint(3, 12))))
        before = rng.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', "<ul>{}</ul>"]).format(menu) + rng.choice(["", f'<div class="ad">{words(8)}</div>', f"<header>{words(4)}</header>", f"<div>{words(3)}</div>"])
        after = rng.choice([f"<footer>{words(9)}</footer>", f'<div class="footer">{words(12)}</div>', f"<div>{words(4)}</div>", f'<aside>{words(6)}</aside><div class="comments"><p>{words(30)}</p></div>'])
        shell = rng.choice(["<article>\0</article>", "<main>\0</main>", '<div class="content">\0</div>', "<div>\0</div>", "\0"])
        opened, closed = shell.split("\0")
        head, tail = f"<html><head><title>{words(5)}</title></head><body>{before}{opened}", f"{closed}{after}</body></html>"
        inside, whole = len(events(head)), events(head + body + tail)
        outside = len(whole) - len(events(tail))
        yield [(e, inside <= i < outside) for i, e in enumerate(whole)]


def labelled(page: str):
    """(event, is content) of a page whose articles hold most of its words: what stands within the first to the last article with a word; none of other pages."""
    found = events(page)
    own = [i for i, (what, value, kind) in enumerate(found) if what == "text" and kind == "inside" and value.split()]
    if not own:
        return []
    first, last = own[0], own[-1]
    while first and not (found[first - 1][0] == "tag" and found[first - 1][1] in ("article", "main")):
        first -= 1
    while last + 1 < len(found) and not (found[last + 1][0] == "tag" and found[last + 1][1] in ("/article", "/main")):
        last += 1
    return [(e, first <= i <= last) for i, e in enumerate(found)]


def counts_of(pages) -> Counter:
    """How often every kind of word and every tag stands in and outside the content of labelled pages."""
    seen = Counter()
    for page in pages:
        for (what, value, kind), content in page:
            if what == "text" and kind != "dropped":
                seen[content, f"#{kind}"] += len(value.split())
            elif what == "tag":
                seen[content, value] += 1
    return seen


@cache
def made_counts() -> Counter:
    return counts_of(made_pages())


def weights(seen: Counter | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of content of words by kind, and of tags by name, from counts (those of the made pages if none are given).

    The scan needs positive words and negative tags: odds are held within 0.5 to 3 for words, -3 to -0.05 for tags; links
    outside articles stay under -0.5.
    """
    seen = made_counts() if seen is None else seen
    total = {c: sum(n for (content, _), n in seen.items() if content == c) for c in (True, False)}

    def odds(key):
        return math.log((seen[True, key] + 0.5) / (seen[False, key] + 0.5)) - math.log((total[True] + 1) / (total[False] + 1))

    words = {k: min(3.0, max(0.5, odds(f"#{k}"))) for k in ("inside", "plain", "inside link")}
    words["link"] = max(-3.0, min(-0.5, odds("#link")))
    return words, {t: max(-3.0, min(-0.05, odds(t))) for _, t in seen if not t.startswith("#")}


def fit_weights(pages: DataFrame, limit: int = 1000) -> tuple[dict[str, float], dict[str, float]]:
    """``weights`` counted on the made pages and on at most ``limit`` of the given ones (html) that have an article or main element.

    The sample has the pages of the smallest hashes of their html, equal ones once, so it doesn't depend on their order.
    """
    some = pages.select(F.col("html").cast("string").alias("html")).where(F.lower("html").rlike("<(article|main)[ >]")).withColumn("h", F.xxhash64("html"))
    sample = some.join(F.broadcast(some.select("h").distinct().orderBy("h").limit(limit)), "h").dropDuplicates(["h"])
    keys = mapped(sample.select("html"), _counted, "content boolean, key string, n long").groupBy("content", "key").agg(F.sum("n").alias("n"))
    seen = Counter(made_counts())
    for r in keys.where(F.length("key") < 40).orderBy(F.desc("n"), "key").limit(2000).collect():  # names of tags, of which HTML has some hundred
        seen[r["content"], r["key"]] += r["n"]
    return weights(seen)


def _counted(batches):
    for batch in batches:
        seen = counts_of(labelled(page.as_py() or "") for page in batch.column("html"))
        columns = [[c for c, _ in seen], [k for _, k in seen], list(seen.values())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.bool_(), pa.string(), pa.int64()), strict=True)], names=["content", "key", "n"])


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end index of the contiguous run of the highest sum (the first of equals); (0, 0) if none is positive."""
    best, region, total, first = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += s
        if total > best:
            best, region = total, (first, i + 1)
    return region


def main_text(page: str, learned: tuple[dict, dict] | None = None) -> str:
    """The main text: blocks of the best region in page order, joined by one space."""
    words, tags = learned or weights()
    found = events(page)
    score = {"text": lambda value, kind: words[kind] * len(value.split()) if kind != "dropped" else 0.0, "tag": lambda value, _: tags.get(value, -0.3), "gone": lambda *_: 0.0}
    first, end = best_region([score[what](value, kind) for what, value, kind in found])
    out = []
    for what, value, kind in found[first:end]:
        if what != "text":
            if kind:
                out.append(" ")
        elif kind != "dropped":
            out.append(value)
    return " ".join("".join(out).split())


def _extract(learned: tuple[dict, dict]):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            pages, lo, held, texts = batch.column("html"), 0, 0, []
            for i in range(len(pages)):
                page = pages[i].as_py() or ""
                texts.append(main_text(page, learned))
                held += len(page)
                if held >= 1 << 22 or i + 1 == len(pages):
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(lo, n), batch.column("url").slice(lo, n), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)
                    lo, held, texts = i + 1, 0, []

    return run


def extract_pages(pages: DataFrame, learned: tuple[dict, dict] | None = None) -> DataFrame:
    """Return one row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    ``learned`` are weights of ``fit_weights``; without them those of the made pages are used.
    Null and empty html, and pages without any positive word, give the empty text. Markup
    that is cut off or not closed is read as far as it goes. Repeated rows repeat; an empty
    table gives none; extra columns are ignored. A page is read as a whole.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return mapped(rows, _extract(learned or weights()), "page_id long, url string, text string, n_chars long")
