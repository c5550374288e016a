"""Operator 7: repeated passages by sparse suffix arrays.

Of all suffixes (word positions) only those at minimiser positions are retained: the
smallest ``gram``-word hash of every ``length``-word window, so two copies of a window
retain the same place. A retained suffix stands for the windows that it is the minimiser
of, and its context is all their words: some before it, the gram, some after it.

* Suffixes whose gram stands nowhere else are left out. Copies of one context (equal in
  128 bits of hash) are one entry with the smallest doc_id that holds it.
* The entries of a gram are sorted by their words from the gram on. Neighbours are
  compared word by word to find how far a match extends to the right, and in the order of
  the words before the gram (nearest first) how far it extends to the left. A window that
  begins ``o`` words before the gram is shared by a run of entries without a shorter
  extension between them, in both orders.
* A gram with more than ``SORTED`` different contexts (a passage's border in very many
  documents) isn't held by one task: its windows are compared by 128 bits of hash instead.

The result is exact: a word is reported when some window around it also occurs in a
document of a smaller id.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, few, fresh, mapped, slices, stored
from .words import U64, Scan, grams, is_long, mix, overlapped, piece_scans

_STEP = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2^64
_SALT = U64(0x5851F42D4C957F2D)
#: A gram with at most so many different contexts is sorted in one task.
SORTED = 1000
#: Entries are compared in blocks of about so many bytes, whole grams each.
COMPARE_BYTES = 4 << 20


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP^i and its inverse for i below n (n a power of two)."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 2**64)):
        p = np.ones(1, U64)
        while len(p) < n:
            p = np.concatenate([p, p * U64(pow(base, len(p), 2**64))])
        out.append(p)
    return out[0], out[1]


class Runs:
    """Hashes of any run of a slice's words from prefix sums."""

    def __init__(self, h: np.ndarray):
        n = 1 << max(1, len(h)).bit_length()
        self.power, self.inverse = _powers(n)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * self.power[: len(h)], dtype=U64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))


def minimisers(h: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of every retained suffix; windows and places are word positions of the slice."""
    n, width = len(h) - length + 1, length - gram + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    g = grams(h, gram)
    bits = 24  # the same for all slices, so that equal words choose the same place; a slice has fewer words
    low = ((g >> U64(bits)) << U64(bits)) | np.arange(len(g), dtype=U64)
    span = 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    place = (low & U64((1 << bits) - 1)).astype(np.int64)
    start = np.arange(n)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row[start] == row[start + length - 1]
    start, place, row = start[inside], place[inside], row[start[inside]]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(row) != 0)) + 1
    begin = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(start)]]) - 1
    return place[begin], start[begin], start[end]


def _bytes_of(scan: Scan) -> tuple[bytes, np.ndarray]:
    """All words of a scan, each followed by a space, and where each begins (one more at the end)."""
    length = scan.ends - scan.starts
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(int(begin[-1]), 32, np.uint8)
    run = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(begin[:-1], length) + run] = scan.data[np.repeat(scan.starts, length) + run]
    return out.tobytes(), begin


def _placed(word: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First word of a context, its windows and the words before its gram as one number."""
    return (word << 24) | (n << 12) | at


_RETAINED = "doc_id long, key long, reach long, reach2 long, place long"


def _retained(length: int, gram: int):
    schema = pa.schema([(f.split()[0], pa.int64()) for f in _RETAINED.split(", ")])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                for before, _, scan in overlapped(data, offs, length - 1):
                    h = scan.hashes()
                    place, begin, end = minimisers(h, scan.first, length, gram)
                    if not len(place):
                        continue
                    runs, other = Runs(h), Runs(mix(h ^ _SALT))
                    row = np.searchsorted(scan.first, begin, "right") - 1
                    key, reach, reach2 = runs.of(place, place + gram), runs.of(begin, end + length), other.of(begin, end + length)
                    where = _placed(begin - scan.first[row] + before, end - begin + 1, place - begin)
                    ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.view(np.int64)) for x in (key, reach, reach2)), pa.array(where)], schema=schema)

    return run


def _wanted(batch: pa.RecordBatch, length: int):
    """Blocks of a batch (doc_id, text, wants) with the wants that stand in each: (scan, its hashes' runs, want columns, first words, rows)."""
    wants = batch.column("wants").to_pylist()
    for lo, hi, data, offs in slices(batch.column("text")):
        for before, own, scan in overlapped(data, offs, length - 1):
            asked = []
            for i in range(hi - lo):
                for w in wants[lo + i]:
                    word, n, at = w["place"] >> 24, w["place"] >> 12 & 4095, w["place"] & 4095
                    begin = int(scan.first[i]) + word - before
                    if (before <= word < before + own if before or own < len(scan.starts) else True) and begin + n + length - 1 <= scan.first[i + 1]:
                        asked.append((w["key"], w["reach"], w["reach2"], begin, n, at, lo + i))
            if not asked:
                continue
            h = scan.hashes()
            runs = Runs(h)
            key, reach, reach2, begin, n, at, row = (np.array(x, np.int64) for x in zip(*asked, strict=True))
            mine = runs.of(begin, begin + n + length - 1).view(np.int64) == reach  # else it is another text under the same doc_id
            yield scan, h, runs, [x[mine] for x in (key, reach, reach2, begin, n, at, row)]


_CONTEXT = "key long, reach long, reach2 long, doc_id long, n int, at int, suffix binary, before binary"


def _contexts(length: int):
    """The words of the contexts asked for: from the gram on, and those before it from last to first (their bytes reversed)."""
    schema = pa.schema([("key", pa.int64()), ("reach", pa.int64()), ("reach2", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("suffix", pa.binary()), ("before", pa.binary())])

    def run(batches):
        for batch in batches:
            for scan, _, _, (key, reach, reach2, begin, n, at, row) in _wanted(batch, length):
                text, where = _bytes_of(scan)
                back, size = text[::-1], len(text)
                first, gram, end = where[begin].tolist(), where[begin + at].tolist(), where[begin + n + length - 1].tolist()
                suffix = [text[a:b] for a, b in zip(gram, end, strict=True)]
                before = [back[size - b + 1 : size - a] + b" " if b > a else b"" for a, b in zip(first, gram, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(reach), pa.array(reach2), batch.column("doc_id").take(pa.array(row)), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(suffix, pa.binary()), pa.array(before, pa.binary())], schema=schema)

    return run


def extensions(texts: list[bytes], new: np.ndarray) -> np.ndarray:
    """Whole words (each ends in a space) that every text begins with like the one before it; -1 where ``new`` says that another group begins."""
    out = np.full(len(texts), -1, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    step = max(1, COMPARE_BYTES // max(1, int(size.max(initial=1))))
    for lo in range(1, len(texts), step):
        hi = min(len(texts), lo + step)
        own = size[lo - 1 : hi]
        rows = np.zeros((hi - lo + 1, int(own.max()) + 1), np.uint8)
        at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        rows[np.repeat(np.arange(len(own)), own), at] = np.frombuffer(b"".join(texts[lo - 1 : hi]), np.uint8)
        differ = rows[1:] != rows[:-1]
        differ[:, -1] = True
        same = np.minimum(np.argmax(differ, 1), np.minimum(own[1:], own[:-1]))
        spaces = np.cumsum(rows[1:] == 32, axis=1, dtype=np.int32)
        out[lo:hi] = np.where(same > 0, spaces[np.arange(hi - lo), np.maximum(same, 1) - 1], 0)
    return np.where(new, -1, out)


def shared_windows(key: np.ndarray, doc: np.ndarray, n: np.ndarray, at: np.ndarray, suffix: list[bytes], before: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, window of its context, smallest doc) where a smaller doc shares a window; entries are sorted by key and suffix."""
    turn = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
    right = extensions(suffix, turn(key))
    order = np.array(sorted(range(len(key)), key=lambda i: (key[i], before[i])), np.int64)
    left = extensions([before[i] for i in order], turn(key[order]))
    found = []
    for o in range(int(at.max(initial=-1)) + 1):
        rows = np.flatnonzero((at >= o) & (at - o < n))  # entries whose context has the window that begins o words before the gram
        if len(rows) < 2:
            continue
        run = np.empty(len(key), np.int64)
        run[order] = np.cumsum(left < o)
        run += np.cumsum(right < length - o) * (len(key) + 1)
        run = run[rows]
        by = np.lexsort((doc[rows], run))
        run, rows = run[by], rows[by]
        begin = np.flatnonzero(turn(run))
        least = np.repeat(doc[rows[begin]], np.diff(np.concatenate([begin, [len(rows)]])))
        later = doc[rows] > least
        found.append((rows[later], at[rows[later]] - o, least[later]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


_EARLIER = "reach long, reach2 long, at int, first_doc_id long"


def _neighbours(length: int):
    """Windows of sorted entries (key, ..., suffix, before) that an entry of a smaller doc_id has, block by block of whole grams."""
    schema = pa.schema([("reach", pa.int64()), ("reach2", pa.int64()), ("at", pa.int32()), ("first_doc_id", pa.int64())])

    def compared(block: pa.Table):
        key, reach, reach2, doc, n, at = (block.column(c).to_numpy().astype(np.int64) for c in ("key", "reach", "reach2", "doc_id", "n", "at"))
        entry, window, first = shared_windows(key, doc, n, at, block.column("suffix").to_pylist(), block.column("before").to_pylist(), length)
        return pa.RecordBatch.from_arrays([pa.array(reach[entry]), pa.array(reach2[entry]), pa.array(window, pa.int32()), pa.array(first)], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < COMPARE_BYTES:
                continue
            block = pa.Table.from_batches(held)
            key = block.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last gram may go on
            if cut:
                yield compared(block.slice(0, cut))
            held, size = pa.Table.from_batches(block.slice(cut).combine_chunks().to_batches()).to_batches(), 0
        if held:
            yield compared(pa.Table.from_batches(held))

    return run


_WINDOW = "reach long, reach2 long, at int, window long, window2 long, doc_id long"


def _windows(length: int):
    """128 bits of hash of every window of the contexts asked for."""
    schema = pa.schema([("reach", pa.int64()), ("reach2", pa.int64()), ("at", pa.int32()), ("window", pa.int64()), ("window2", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        for batch in batches:
            for _, h, runs, (_, reach, reach2, begin, n, _, row) in _wanted(batch, length):
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(begin, n) + at
                both = [pa.array(r.of(begin, begin + length).view(np.int64)) for r in (runs, Runs(mix(h ^ _SALT)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reach, n)), pa.array(np.repeat(reach2, n)), pa.array(at, pa.int32()), *both, batch.column("doc_id").take(pa.array(np.repeat(row, n)))], schema=schema)

    return run


#: Up to so many documents with contexts to compare, or with spans to cut, their ids or spans (some 100 bytes) are broadcast; beyond, joined by shuffle.
BROADCAST_DOCS = 200_000


def _earlier(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(reach, reach2, at, first_doc_id) of the windows of different contexts of one gram that a smaller doc_id has; ``places`` has each context's holder."""
    wanted = F.struct("key", "reach", "reach2", "place")

    def texts(some: DataFrame) -> DataFrame:
        wants = stored(some.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(wanted).alias("wants")), "wants")
        near = docs.join(few(wants.select("_id"), BROADCAST_DOCS), F.col("doc_id") == F.col("_id")).drop("_id")
        return near.join(wants, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "wants")

    entries = mapped(texts(places.where(F.col("contexts") <= SORTED)), _contexts(length), _CONTEXT)
    entries = entries.repartition("key").sortWithinPartitions("key", "suffix")
    out = mapped(entries, _neighbours(length), _EARLIER)
    many = places.where(F.col("contexts") > SORTED)
    if many.limit(1).count():
        windows = stored(mapped(texts(many), _windows(length), _WINDOW).distinct(), "windows")
        firsts = windows.groupBy("window", "window2").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id <> last").drop("last")
        met = windows.join(stored(firsts, "firsts"), ["window", "window2"]).where("first_doc_id < doc_id")
        out = out.unionByName(met.groupBy("reach", "reach2", "at").agg(F.min("first_doc_id").alias("first_doc_id")))
    return out


def repeated_words(docs: DataFrame, length: int = 50, gram: int = 16) -> DataFrame:
    """Return (doc_id, word, n, firsts): the n windows from ``word`` on of doc_id also occur in smaller ids; firsts has the smallest for each of them."""
    if not 0 < gram <= length < 4096:
        raise ValueError("a gram has 1 to length words, a window fewer than 4096")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = stored(mapped(docs, _retained(length, gram), _RETAINED), "suffixes")
    # a gram that stands in one document, always in the same context, is in no repeated window
    of_gram = {"a": F.min("reach"), "b": F.max("reach"), "lo": F.min("doc_id"), "hi": F.max("doc_id")}
    shared = stored(rows.groupBy("key").agg(*(x.alias(k) for k, x in of_gram.items())).where("a <> b or lo <> hi").select("key"), "grams")
    kept = stored(rows.join(shared, "key"), "kept")
    dropped(rows, shared)
    context = ["key", "reach", "reach2"]
    reaches = stored(kept.groupBy(*context).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "reaches")
    mixed = stored(reaches.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1"), "mixed")
    marked = stored(reaches.join(mixed, "key", "left").where("lo <> hi or contexts > 1").drop("hi"), "marked")
    hits = stored(kept.join(marked, context).where("doc_id > lo or contexts > 1"), "hits")
    dropped(kept, reaches, mixed, marked)
    own = hits.where("contexts > 1 and doc_id = lo")
    earlier = stored(_earlier(docs, own.groupBy(*context, "doc_id", "contexts").agg(F.min("place").alias("place")), length), "earlier")
    word, n = F.shiftright("place", 24).cast("int"), (F.shiftright("place", 12).bitwiseAND(4095)).cast("int")
    single = own.join(earlier, context[1:]).select("doc_id", (word + F.col("at")).cast("int").alias("word"), F.lit(1).alias("n"), F.array("first_doc_id").alias("firsts"))
    sooner = stored(earlier.groupBy(*context[1:]).agg(F.collect_set("first_doc_id").alias("ids"), F.count("*").cast("int").alias("c")), "sooner")
    lowest = F.when(F.coalesce("c", F.lit(0)) < n, F.array("lo")).otherwise(F.array().cast("array<long>"))
    again = hits.where("doc_id > lo").join(sooner, context[1:], "left").select("doc_id", word.alias("word"), n.alias("n"), F.concat(F.coalesce("ids", F.array().cast("array<long>")), lowest).alias("firsts"))
    return again.unionByName(single)


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 16) -> DataFrame:
    """Return the maximal repeated word spans of each document: doc_id, first_word, n_words, first_doc_ids.

    A word belongs to a span when a ``length``-word window around it (words of
    ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case) occurs in a document with a smaller doc_id;
    first_doc_ids lists the smallest for each window. So the smallest doc_id keeps each passage. Texts under
    ``length`` words, null and empty ones have no span; rows without doc_id are left out;
    rows of one doc_id are one document and never repeat each other; an empty table gives
    an empty result and extra columns are ignored. A long text is read in pieces.
    """
    hits = repeated_words(docs, length, gram)
    own = Window.partitionBy("doc_id").orderBy("word", "n")
    reach = F.max(F.col("word") + F.col("n") + F.lit(length - 1)).over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", F.when(F.col("word") <= reach, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("doc_id", "span").agg(F.min("word").alias("first_word"), F.max(F.col("word") + F.col("n") + F.lit(length - 1)).alias("end"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("firsts")))).alias("first_doc_ids"))
    return spans.select("doc_id", F.col("first_word").cast("long").alias("first_word"), (F.col("end") - F.col("first_word")).cast("long").alias("n_words"), "first_doc_ids")


def _without(text: bytes, scans, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without spans (first word, word after the last), given its (place, words before, scan) pieces."""
    cuts, todo, begin = [], iter(sorted(spans)), None
    first, end = next(todo)
    for at, words, scan in scans:
        while True:
            if begin is None:
                if first >= words + len(scan.starts):
                    break
                begin = at + int(scan.starts[first - words])
            last = min(end - 1 - words, len(scan.ends) - 1)
            cuts.append((begin, at + int(scan.ends[last])))
            if end - 1 >= words + len(scan.starts):  # goes on in the next piece
                break
            begin = None
            first, end = next(todo, (1 << 62, 1 << 62))
    out, done = [], 0
    for a, b in cuts:
        out.append(text[done : max(done, a)])
        done = max(done, b)
    return b"".join([*out, text[done:]])


def _cut(name: str):
    def run(batches):
        for batch in batches:
            spans = batch.column(name).to_pylist()
            texts = []
            for lo, hi, data, offs in slices(batch.column("text")):
                whole = None if is_long(data, offs) else Scan(data, offs)
                for i in range(hi - lo):
                    own = [(s["first_word"], s["first_word"] + s["n_words"]) for s in spans[lo + i] or ()]
                    text = data[offs[i] : offs[i + 1]]
                    if whole is None:
                        scans = piece_scans(text)
                    else:
                        part = Scan.__new__(Scan)
                        part.data, words = text, slice(whole.first[i], whole.first[i + 1])
                        part.starts, part.ends, part.first = whole.starts[words] - offs[i], whole.ends[words] - offs[i], None
                        scans = [(0, 0, part)]
                    text = text.tobytes()
                    texts.append((_without(text, scans, own) if own else text).decode())
            out = batch.drop_columns([name])
            yield out.set_column(out.schema.get_field_index("text"), pa.field("text", pa.string()), pa.array(texts, pa.string()))

    return run


def without_repeats(docs: DataFrame, length: int = 50, gram: int = 16) -> DataFrame:
    """The documents with their repeated spans cut out; n_chars follows, and a text left without words goes. Columns stay as they are, whatever their names.

    Rows without doc_id, without text or without a repeat stay as they are, and repeated rows
    stay repeated (rows of one doc_id are one document); an empty table gives none.
    """
    ids, name = fresh("_doc_id", docs.columns), fresh("spans", docs.columns)
    spans = repeated_spans(docs, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "n_words")).alias(name))
    spans = stored(spans, "spans").withColumnRenamed("doc_id", ids)
    joined = docs.join(few(spans, BROADCAST_DOCS), docs["doc_id"] == F.col(ids), "left").drop(ids)
    same = joined.where(F.col(name).isNull()).drop(name)
    changed = joined.where(F.col(name).isNotNull())
    cut = mapped(changed, _cut(name), docs.schema).where(r"text rlike '[^\\x20\\x09-\\x0D]'")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(cut)
