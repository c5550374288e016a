"""Hot groups, very long texts, empty tables, clashing columns, and results against plain versions."""

import math
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadweave.llm import audio, chat, decontaminate, html_text, licenses, mixing, ngram_join, suffix_dedup, token_counts, toxicity, words
from roadweave.llm.decontaminate import benchmark_leaks
from roadweave.llm.ngram_join import PartEnum, ngram_jaccard_groups
from roadweave.llm.suffix_dedup import repeated_spans, without_repeats
from roadweave.llm.tables import fresh

from test_ops import ODD, docs, jaccard_groups, spans_of
from test_ops import words as some_words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# long texts


def test_pieces_give_the_same_words(monkeypatch):
    rng = random.Random(1)
    text = " ".join(["é" * rng.randint(1, 9) if rng.random() < 0.2 else "Ab"[: rng.randint(1, 2)] * rng.randint(1, 300) for _ in range(400)]).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = words.Scan(data, offs)
    plain = [w.lower() for w in text.split()]
    assert whole.hashes().tolist() == words.hash_words(plain).tolist() and len(set(whole.hashes().tolist())) == len(set(plain))
    one = words.shingle_sets(data, offs, 3)[0]
    monkeypatch.setattr(words, "PIECE_BYTES", 700)
    assert words.is_long(data, offs) and words.Words(data, offs).h.tolist() == whole.hashes().tolist()
    assert words.shingle_sets(data, offs, 3)[0].tolist() == one.tolist()
    seen = []
    for before, own, scan in words.overlapped(data, offs, 5):
        assert before == len(seen) and scan.hashes().tolist() == whole.hashes()[before : before + own + 5].tolist()
        seen += scan.hashes()[:own].tolist()
    assert seen == whole.hashes().tolist()


def test_pieces_change_no_result(monkeypatch):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(60)]
    passage = some_words(rng, 70)
    texts = [" ".join([*some_words(rng, 2000, pool), *passage, *some_words(rng, 1500, pool), *(passage[5:] if i % 2 else [])]) for i in range(4)] + ["short one", None]
    model = toxicity.Model(np.sort(words.hash_words([b"w3", b"w7"])), np.array([2.0, 3.0]))
    items = [(1, " ".join(passage[20:50]).encode()), (2, b"w1 w2"), (3, b"nowhere at all")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(["s"] * len(texts)), pa.array(texts, pa.string()), pa.array([1] * len(texts), pa.int32())], names=["doc_id", "t", "source", "text", "toxic"])
    spread = lambda value: type("", (), {"value": value})()
    kernels = [
        ngram_join._sets(3, PartEnum(90)), ngram_join._signatures(3, PartEnum(90)), licenses._scan(licenses.PHRASES, {}), mixing._sized, toxicity._presence, toxicity._score(spread(model)),
        decontaminate._search(spread(items), 5, 80, True), suffix_dedup._retained(50, 16),
    ]

    def rows(kernel, size):
        monkeypatch.setattr(words, "PIECE_BYTES", size)
        return [r for i in range(len(texts)) for part in kernel([batch.slice(i, 1)]) for r in part.to_pylist()]

    for kernel in kernels:
        small, large = rows(kernel, 900), rows(kernel, 1 << 19)
        if kernel is kernels[-1]:  # a context may end where a piece does; the windows that all contexts cover are the same
            small, large = (sorted((r["doc_id"], (r["place"] >> 24) + k) for r in x for k in range(r["place"] >> 12 & 4095)) for x in (small, large))
        assert small == large and large


LONG = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from roadweave.llm import chat, decontaminate, licenses, mixing, ngram_join, suffix_dedup, toxicity
rng = np.random.default_rng(1)
pool = np.array([bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)).decode() for _ in range(20000)])
text, size = [], 0
while size < 50_000_000:
    text.append(" ".join(pool[rng.integers(0, 20000, 100000)]))
    size += len(text[-1]) + 1
text = pa.array([" ".join(text)], pa.string())
one = pa.array([1], pa.int64())
batch = lambda **c: [pa.RecordBatch.from_arrays(list(c.values()), names=list(c))]
class Spread:
    def __init__(self, value): self.value = value
model = toxicity.Model(np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64)), np.ones(1000))
runs = dict(
    op1=lambda: ngram_join._sets(3, ngram_join.PartEnum(90))(batch(doc_id=one, t=one, text=text)),
    op5=lambda: toxicity._score(Spread(model))(batch(doc_id=one, text=text)),
    fit5=lambda: toxicity._presence(batch(text=text, toxic=pa.array([1], pa.int32()))),
    op6=lambda: decontaminate._search(Spread([(1, " ".join(pool[:40]).encode()), (2, b"the cat")]), 5, 80, True)(batch(doc_id=one, text=text)),
    op7=lambda: suffix_dedup._retained(50, 16)(batch(doc_id=one, text=text)),
    op8=lambda: chat._digests(chat._format(batch(conv_id=one, role=pa.array(["assistant"]), text=text))),
    op9=lambda: licenses._scan(licenses.PHRASES, licenses.TEMPLATES)(batch(doc_id=one, text=text)),
)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _ in runs[{name!r}](): pass
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("name", ["op1", "op5", "fit5", "op6", "op7", "op8", "op9"])
def test_one_text_of_50_mb(name):
    out = subprocess.run([sys.executable, "-c", LONG.format(root=ROOT, name=name)], capture_output=True, text=True, timeout=200, check=True)
    assert int(out.stdout) < 350


def test_licenses_take_linear_time():
    import time

    def took(n):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["permission is hereby granted free of charge to " * n])], names=["doc_id", "text"])
        began = time.process_time()
        list(licenses._scan(licenses.PHRASES, licenses.TEMPLATES)([batch]))
        return time.process_time() - began

    took(100)
    assert took(25_000) < 30  # 200,000 words


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    encode = token_counts.tokenizer(token_counts.VOCABULARY).encode_ordinary
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "é", " ", "  ", "\n", "7", "'s", ", ", "中文", " the", "\t "]) for _ in range(5000))
    monkeypatch.setattr(token_counts, "ENCODE_CHARS", 50)
    runs = list(token_counts.encoded(encode, text))
    assert len(runs) > 20 and np.concatenate(runs).tolist() == encode(text)


# operator 1


@pytest.mark.parametrize("args", [(90, 1, 2), (80, 0, 1), (90, 1, 3), (60, 2, 4)])
def test_partenum_keeps_contained_pairs(args):
    """A set inside another at exactly the threshold, elements chosen so that the larger spoils as many partitions as it can."""
    scheme, percent = PartEnum(*args), args[0]
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(0, 2**63, 40_000, dtype=np.uint64))
    for b_size in (25, 50, 55, 80, 115, 125):
        a_size = -(-b_size * percent // 100)
        if a_size < scheme.least:
            continue
        for inst in {scheme.band(a_size), scheme.band(b_size)}:
            total, need = scheme.groups(scheme.bands[inst + 1]), scheme.groups(a_size)
            at = ((words.mix(pool ^ ngram_join._ODD[inst % 64]) >> np.uint64(32)) * np.uint64(total * scheme.n2)) >> np.uint64(32)
            outside = pool[at >= need * scheme.n2]
            for inside in range(0, min(need * scheme.n2, a_size) + 1):
                # ``inside`` partitions that both see hold one element of a; b spoils as many of them as it has more elements
                a = np.concatenate([*(pool[at == i][:1] for i in range(inside)), outside[: a_size - inside]])
                more = np.concatenate([*(pool[at == i][1:2] for i in range(min(inside, b_size - a_size))), outside[a_size : a_size + b_size - a_size - min(inside, b_size - a_size)]])
                b = np.concatenate([a, more])
                if len(set(a)) != a_size or len(set(b)) != b_size:
                    continue
                assert set(scheme.signatures(np.sort(a)).tolist()) & set(scheme.signatures(np.sort(b)).tolist()), (args, a_size, b_size, inside)


@pytest.mark.parametrize("size", [100, 170, 330, 396])
def test_unrelated_sets_share_no_signature(size):
    """Sets without a common element don't meet in partitions that are empty in both, however many they are."""
    scheme, rng = PartEnum(80, k2=0, n2=1), np.random.default_rng(3)
    seen = np.concatenate([np.unique(scheme.signatures(np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)))) for _ in range(300)])
    assert np.unique(seen, return_counts=True)[1].max() == 1


def test_rarest_signatures_hold_every_link(spark):
    """Many sets hold the same few elements: links keep a signature, and fewer sets meet in the common ones."""
    scheme, rng = PartEnum(80, k2=0, n2=1), np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    common, links, sets = pool[:40], [], {}
    for i in range(400):
        size = int(rng.integers(60, 200))
        own = np.concatenate([common[rng.random(40) < 0.5], pool[40 + i * 400 : 40 + i * 400 + size]])
        sets[2 * i] = np.unique(own)
        if i < 150:  # as far apart as a link may be
            cut = int(rng.integers(0, len(own) // 9))
            kept, more = rng.permutation(own)[cut:], len(own) // 4 - 2 * cut
            sets[2 * i + 1] = np.unique(np.concatenate([kept, pool[40 + i * 400 + 250 : 40 + i * 400 + 250 + max(0, more)]]))
            both, all_ = len(np.intersect1d(sets[2 * i], sets[2 * i + 1])), len(np.union1d(sets[2 * i], sets[2 * i + 1]))
            if 100 * both >= 80 * all_:
                links.append((2 * i, 2 * i + 1))
    rows = [(int(sig), h1, (slack << 8) + 2 * deal + band % 2) for h1, u in sets.items() for band, deal, sigs, slack in scheme.lists(u) for sig in sigs.view(np.int64)]
    rows = spark.createDataFrame(rows, "sig long, h1 long, list int")
    counts = rows.groupBy("sig").count().where("count > 1")
    left = defaultdict(set)
    for r in ngram_join._rarest(rows.join(counts, "sig")).collect():
        left[r["h1"]].add(r["sig"])
    assert len(links) > 60 and all(left[a] & left[b] for a, b in links)
    most = lambda found: max(Counter(found).values())
    assert most(s for x in left.values() for s in x) < most(r["sig"] for r in rows.select("sig").collect()) / 2


def test_large_cluster_is_dealt_once(spark):
    rows = spark.range(20_000).select(F.lit(0).cast("long").alias("cluster"), F.col("id").alias("h1"))
    blocks = ngram_join._blocks(rows, "cluster", ngram_join.TEXT_BLOCK)
    n = blocks.first()["blocks"]
    dealt = ngram_join._with_pivot(rows, blocks)
    assert n == -(-20_000 // ngram_join.TEXT_BLOCK) and dealt.count() == 20_000 + n - 1
    assert dealt.groupBy("bi").count().agg(F.max("count")).first()[0] < 2 * ngram_join.TEXT_BLOCK


def test_hot_signature_of_unlinked_texts(spark, monkeypatch):
    """Many texts share a signature and most of them no link: what the first class does not join is compared again."""
    monkeypatch.setattr(ngram_join, "SIGNATURE_BLOCK", 5)
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", 4)
    rng = random.Random(12)
    base, texts = some_words(rng, 40), []
    for k in range(12):
        own = [*base[:28], *some_words(rng, 12)]
        for _ in range(rng.randint(1, 5)):
            w = list(own)
            w[-1] = rng.choice("abc")
            texts.append(" ".join(w))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    found = ngram_jaccard_groups(docs(spark, texts, ids)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == jaccard_groups(list(zip(ids, texts, strict=True)), 3, 90)


def test_recall_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    sets = {}
    for d, t in rows:
        w = (t or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))).split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    at = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            at[g].append(d)
    common = Counter((a, b) for ds in at.values() if len(ds) > 1 for i, a in enumerate(ds) for b in ds[i + 1 :])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    found = ngram_jaccard_groups(df, 5, 80, PartEnum(80, k2=0, n2=1))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {d: find(d) for d in sets}


# operator 2


def test_prefixes_as_sorted(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rng, rows = random.Random(4), []
    for s, n in (("a", 700), ("b", 15), (None, 300), ("same", 400)):
        for i in range(n):
            place = (7, 7, rng.randrange(1 << 48)) if s == "same" else (rng.randrange(1 << 48), 0, i)
            rows.append((len(rows), s, rng.randint(0, 30), *place))
    left = {s: 0.37 * sum(r[2] for r in rows if r[1] == s) for s in ("a", "b", None, "same")}
    parts = mixing._prefixes(spark.createDataFrame(rows, "doc_id long, source string, size long, p0 long, p1 long, p2 long"), spark.createDataFrame(list(left.items()), "source string, left double"))
    picked = {r["doc_id"]: r["picked"] for p in parts for r in p.collect()}
    assert len(picked) == len(rows)
    for s, most in left.items():
        order = sorted((r for r in rows if r[1] == s), key=lambda r: r[3:])
        total, k = 0, 0
        while k < len(order) and total + order[k][2] <= most:
            total, k = total + order[k][2], k + 1
        assert all(picked[r[0]] for r in order[:k])
        extra = [r for r in order[k:] if picked[r[0]]]
        assert len(extra) <= 1 and abs(most - total - sum(r[2] for r in extra)) <= most - total


def test_many_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(None, "one two three", "a")] * 90 + [(i, "x y", "b") for i in range(60)], "doc_id long, text string, source string")
    out = mixing.mix_to_targets(df, weights=(1, 2)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("x"), F.count("*").alias("n")).collect()
    assert {r["source"]: r["n"] for r in out} == {"a": 90, "b": 60} and all(abs(r["t"] - r["x"]) <= 3 for r in out)


# operator 3


def test_log_mel_by_hand():
    spec = audio.AudioSpec(tensor_frames=4)
    x = np.random.default_rng(5).integers(0, 256, 1920, dtype=np.uint8)
    tensors, spans, _ = audio.features(x, 16000, spec)
    signal = audio.resampled(x, 0, 1200, 1, 2, spec.taps).astype(float)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(60) + k * (mel(4000) - mel(60)) / (spec.mels + 1)) / 2595) - 1) for k in range(spec.mels + 2)]
    flat = tensors.reshape(-1, spec.mels)
    for i in range(audio.length_of(x, 16000, spec)[1]):
        frame = [signal[i * spec.hop + k] * (0.5 - 0.5 * math.cos(2 * math.pi * k / (spec.frame - 1))) for k in range(spec.frame)]
        power = [abs(sum(v * np.exp(-2j * math.pi * f * k / spec.fft) for k, v in enumerate(frame))) ** 2 for f in range(spec.fft // 2 + 1)]
        for m in range(spec.mels):
            lo, mid, hi = edges[m : m + 3]
            weight = [max(0.0, min((f * 8000 / spec.fft - lo) / (mid - lo), (hi - f * 8000 / spec.fft) / (hi - mid))) for f in range(len(power))]
            assert flat[i, m] == pytest.approx(math.log(sum(w * p for w, p in zip(weight, power, strict=True)) + 1e-6), abs=2e-3)
    assert spans[-1, 1] == 1920 / 16000


# operator 5


def _tokens(text):
    low = (text or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256)))
    return ["".join(map(chr, w)) for w in licenses._WORD.findall(low)]


def test_toxicity_as_plain(spark):
    """Token weights counted, and scores summed, in plain Python."""
    rng = random.Random(8)
    bad, texts = ["zorkonian", "blarg"], []
    for i in range(400):
        w = some_words(rng, rng.randint(5, 40), [f"v{k}" for k in range(200)])
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
    labels = {i: int(i % 5 == 0) for i in range(400)}
    model = toxicity.fit(docs(spark, texts), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), held_out=False)
    first = {t: labels[i] for i, t in enumerate(texts)}
    toxic, rows, counts = sum(first.values()), len(first), defaultdict(lambda: [0, 0])
    pieces = lambda w: [(len(w) + 100, w), *((k, w[:k]) for k in toxicity.PREFIXES if len(w) > k)]
    for t, y in first.items():
        for token in {p for w in _tokens(t) for p in pieces(w)}:
            counts[token][1 - y] += 1
    clean, kept = rows - toxic, {}
    several = {k: v for k, v in counts.items() if sum(v) > 1}
    for token, (t, c) in several.items():
        cell = lambda seen, n, size: seen * math.log(seen / (n * (size / rows))) if seen else 0.0
        n = t + c
        g2 = 2 * (cell(t, n, toxic) + cell(c, n, clean) + cell(toxic - t, rows - n, toxic) + cell(clean - c, rows - n, clean))
        prior = 0.5 + 10 * n / rows
        odds = math.log((t + prior) / (toxic - t + prior)) - math.log((c + prior) / (clean - c + prior))
        if g2 >= toxicity.SIGNIFICANCE * math.log(len(several)) and abs(odds) >= toxicity.EFFECT:
            kept[token] = min(toxicity.HIGHEST, max(toxicity.LOWEST, odds))
    assert np.allclose(sorted(kept.values()), sorted(model.scores)) and kept
    for r in toxicity.score_toxicity(docs(spark, texts[:60]), model).collect():
        own = _tokens(texts[r["doc_id"]])
        score = [next((kept[p] for p in [pieces(w)[0], *pieces(w)[:0:-1]] if p in kept), None) for w in own]
        at = np.array([i for i, s in enumerate(score) if s is not None], int)
        found = toxicity.maximal_segments(at, np.array([score[i] for i in at]))
        evidence = sum(-math.log10(max(-math.expm1(-math.exp(min(50, model.log_k + math.log(len(own)) - model.lam * s))), 1e-30)) for *_, s in found)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.offset + model.slope * math.log1p(evidence)))))


def test_equal_labelled_texts_count_once(spark):
    rows = [(i, "bad zork words here" if i % 2 else f"fine text {i} of words") for i in range(60)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, held_out=False)
    once = toxicity.fit(spark.createDataFrame(rows, df.schema), labels, held_out=False)
    assert model.keys.tolist() == once.keys.tolist() and model.slope == once.slope


# operator 6


def test_short_items_stand_inside_texts(spark):
    items = [(1, "where is the cat"), (2, "Yes"), (3, "no such thing"), (4, "a b"), (5, "a b c d e f g"), (6, None)]
    texts = ["so: where is the cat now ok", "where is the cat", "where is a the cat", "YES indeed it is so", "x a b y a b z", "a\tb", None, "", "a b c d e f g h", "where is the"]
    given = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_common"]) for r in benchmark_leaks(docs(spark, texts), given, short_items=True).collect())
    assert found == [(0, 1, 1, 1), (1, 1, 1, 1), (3, 2, 1, 1), (4, 4, 1, 1), (5, 4, 1, 1), (8, 4, 1, 1), (8, 5, 3, 3)]
    plain = sorted((r["doc_id"], r["item_id"]) for r in benchmark_leaks(docs(spark, texts), given).collect())
    assert plain == [(1, 1), (5, 4), (8, 5)]


# operator 7


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_contexts_by_words_or_by_hash(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "SORTED", most)
    rng = random.Random(20)
    passages, texts = [some_words(rng, n) for n in (14, 18, 30)], list(ODD)
    for _ in range(50):
        parts = []
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 6)
            parts += some_words(rng, rng.randint(0, 9)) + p[a : len(p) - rng.randint(0, 6)]
        texts.append(" ".join(parts))
    found = repeated_spans(docs(spark, texts), 12, 5).collect()
    assert sorted((r["doc_id"], r["first_word"], r["n_words"], tuple(r["first_doc_ids"])) for r in found) == spans_of(list(enumerate(texts)), 12)


def test_extensions():
    rng = random.Random(2)
    texts = sorted("".join(rng.choice(["a ", "ab ", "b\x01 ", "é "]) for _ in range(rng.randint(0, 6))).encode() for _ in range(200))
    new = np.array([i % 37 == 0 for i in range(200)])
    for i, k in enumerate(suffix_dedup.extensions(texts, new)):
        a, b = texts[i - 1].split(b" ")[:-1], texts[i].split(b" ")[:-1]
        same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert k == (-1 if new[i] else same)


def test_cutting_beside_clashing_columns(spark):
    p = " ".join(some_words(random.Random(9), 55))
    df = spark.createDataFrame([(1, f"a {p} b", [1], "x", 9), (2, f"c {p} d", [2], "y", 9), (None, p, None, None, None)], "doc_id long, text string, spans array<int>, _DOC_ID string, n_chars int")
    rows = {r["doc_id"]: r for r in without_repeats(df).collect()}
    assert rows[1]["text"] == f"a {p} b" and rows[2]["text"] == "c  d" and rows[2]["spans"] == [2] and rows[2]["_DOC_ID"] == "y" and rows[2]["n_chars"] == 4 and None in rows
    assert fresh("Spans", ["spans", "_SPANS"]) == "__Spans"


# operator 8


def test_a_long_turn_is_copied_whole():
    roles, texts = pa.array(["user", "assistant"]), pa.array(["é" * 100_000, "x" * 70_000])
    buffer, offsets, at, length = chat.assemble(roles, texts)
    assert buffer.tobytes() == f"<|im_start|>user\n{'é' * 100_000}<|im_end|>\n<|im_start|>assistant\n{'x' * 70_000}<|im_end|>\n".encode()
    assert chat.code_points("aé中😀".encode()) == 4 and buffer[at[1] : at[1] + length[1]].tobytes() == b"x" * 70_000


# operator 10

BODY = "Some words to read in this page, and more of them than of any other part of it."
CASES = [
    (f"<html><head><title>x</title><body><article><p>{BODY}</p></article>", BODY),
    (f"<body><form action=x><input name=a><div><h1>Head</h1><p>{BODY}</p></div><label>Search</label></form></body>", f"Head {BODY}"),
    (f"<body><form><article><p>{BODY}</p></article></form><form><p>Sign up now</p></form>", BODY),
    (f'<body><article><p>{BODY}</p></article><div class="post-comments"><p>no no no no</p></div>', BODY),
    (f'<body><article><p>{BODY}</p><div class="article-footer">no no</div></article><div class="content-sidebar">x y z x y z</div>', BODY),
    (f'<body><article><h1 class="header">Title here</h1><p>{BODY}</p></article>', f"Title here {BODY}"),
    (f'<body><div class="main with-sidebar"><p>{BODY}</p></div><div class="sidebar-content">q q q q</div>', BODY),
    (f'<body><article><p>{BODY}</p><div class="ad">Buy this now or later, it is cheap and good for you all</div><p>End.</p><form><input>Sign up here</form><p>Last.</p></article><div>Copy 2020</div>', f"{BODY} End. Last."),
    (f'<body><div id="cookie-banner">We use cookies</div><main><p>{BODY}</p><p><a href=x>Source link</a></p></main><div class="footer-links">a b c</div>', f"{BODY} Source link"),
    (f"<body><ul><li><a href=1>Home page</a><li><a href=2>About us</a></ul><div><p>{BODY}</p><p>{BODY}</p></div><ul><li><a href=1>Imprint</a></ul>", f"{BODY} {BODY}"),
    (f'<body><article><p>{BODY}</p></article><div class="commentList"><p>{BODY}</p></div>', BODY),
    (f'<body><article><h2>T</h2><p>{BODY}</p><section id="comments"><article><p>reader says {BODY}</p></article></section></article>', f"T {BODY}"),
    (f"<body><article><blockquote>Quote me</blockquote><p>{BODY}</p><pre>a  b\n c</pre><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", f"Quote me {BODY} a b c x y 1 2"),
]


@pytest.mark.parametrize("page, expected", CASES)
def test_the_scan_finds_the_text(spark, page, expected):
    made = [(f"<html><body><nav><a href=/>x y</a></nav><article><p>{BODY} {i}</p></article><footer>f</footer></body></html>",) for i in range(30)]
    learned = _learned(spark, made)
    assert html_text.main_text(page) == expected == html_text.main_text(page, learned)


_KEPT = {}


def _learned(spark, made):
    if not _KEPT:
        _KEPT[0] = html_text.fit_weights(spark.createDataFrame([*made, *made, (None,), ("",)], "html string"), limit=20)
    return _KEPT[0]


def test_weights_are_counted(spark):
    page = "<body><article><p>one two</p></article><p>three</p></body>"
    seen = html_text.counts_of([html_text.labelled(page)])
    assert seen[True, "#inside"] == 2 and seen[True, "p"] == 1 and seen[False, "#plain"] == 1 and seen[False, "p"] == 1 and seen[False, "article"] == 1
    assert html_text.labelled("<p>no article</p>") == []
    total = html_text.Counter(html_text.made_counts())
    for (content, key), n in seen.items():
        total[content, key] += n
    assert html_text.fit_weights(spark.createDataFrame([(page,)] * 3, "html string")) == html_text.weights(total)


# empty tables


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = toxicity.fit(df, labels)
    for out in (
        ngram_jaccard_groups(df), mixing.mix_to_targets(df, labels), audio.audio_digests(audio.with_audio(df)), audio.audio_tensors(audio.with_audio(df)), token_counts.document_token_counts(df), toxicity.score_toxicity(df, model),
        toxicity.without_toxic(df, model), benchmark_leaks(df, items, short_items=True), repeated_spans(df), without_repeats(df), licenses.scan_licenses(df), html_text.extract_pages(pages, html_text.fit_weights(pages)),
    ):
        assert out.count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


# pipeline


def test_pipeline_as_plain(spark, sf_dir):
    """Each stage's rows against a plain version of the stage, over the rows that the stage before it kept."""
    import corpus_pipeline as p
    from test_ops import jaccard_groups

    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(at, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score_toxicity(at, model).collect() if not r["predicted"]}
    before = rows(at)
    at = p.drop_toxic(spark, at, sf_dir)
    now = rows(at)
    assert now == {d: t for d, t in before.items() if d in clean}
    lower = lambda t: (t or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))).decode()
    groups = jaccard_groups([(d, lower(t)) for d, t in now.items()], 5, 80)
    after = rows(p.drop_near_duplicates(spark, at, sf_dir))
    assert after == {d: now[d] for d, _, c in groups if d == c}
    at = spark.createDataFrame([r for r in p.drop_near_duplicates(spark, at, sf_dir).collect()], at.schema)
    spans = defaultdict(list)
    for d, i, n, _ in spans_of([(d, lower(t)) for d, t in after.items()], 50):
        spans[d].append((i, i + n))
    expected = {}
    for d, t in after.items():
        raw = (t or "").encode()
        places = [m.span() for m in licenses.re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        for a, b in reversed(spans[d]):
            raw = raw[: places[a][0]] + raw[places[b - 1][1] :]
        if not spans[d] or raw.split():
            expected[d] = raw.decode() if t is not None else None
    at = p.cut_repeats(spark, at, sf_dir)
    assert rows(at) == expected
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    leaked = {d for d, t in expected.items() for q in items if 100 * len(shingles(q) & shingles(lower(t).split())) >= 80 * len(shingles(q))}
    assert rows(p.drop_leaks(spark, at, sf_dir)) == {d: t for d, t in expected.items() if d not in leaked}
