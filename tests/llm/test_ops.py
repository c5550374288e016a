"""Edge cases, brute-force versions and round trips of the training-data operators on small tables."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadweave.llm import audio, chat, html_text, licenses, mixing, token_counts, toxicity
from roadweave.llm.decontaminate import benchmark_leaks, sketch_size
from roadweave.llm.ngram_join import _ODD, PartEnum, fold, ngram_jaccard_groups
from roadweave.llm.queries import QUERIES
from roadweave.llm.sql import ORACLES
from roadweave.llm.suffix_dedup import repeated_spans, without_repeats
from roadweave.llm.words import Scan, hash_words, mix

import sys, os  # noqa: E401

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, same  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, component_id int"  # a clashing extra column


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, pool=None):
    pool = pool or [f"w{i}" for i in range(3000)]
    return [rng.choice(pool) for _ in range(n)]


ODD = [None, "", " \n\t", "one", "one", "Two words", "x" * 5000, "é ñ ß x", "a\x0bb\x0cc"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_as_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_whole(spark, sf_dir, name):
    table = "pages" if name.startswith("op10") else "documents"
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_scan():
    texts = [b"", b"ab CD\x0bef", b"g", b" ", b"longer-than-eight-bytes x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    scan = Scan(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    found = [bytes(scan.data[a:b]) for a, b in zip(scan.starts, scan.ends, strict=True)]
    assert found == [b"ab", b"cd", b"ef", b"g", b"longer-than-eight-bytes", b"x"]
    assert np.diff(scan.first).tolist() == [0, 3, 1, 0, 2]
    assert scan.hashes().tolist() == hash_words(found).tolist()


# operator 1


def jaccard_groups(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    lowest = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        lowest[find(i)].append(d)
    out = [(d, len(sets[i]), min((x for x in lowest[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=str)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_groups(spark, n, percent):
    rng = random.Random(percent)
    texts = list(ODD)
    for _ in range(6):
        base = words(rng, rng.choice([12, 30, 60, 200]))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice("pqrst")
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3] = None
    ids[10] = ids[11]
    scheme = PartEnum(percent, k2=0, n2=1) if percent == 80 else None
    found = ngram_jaccard_groups(docs(spark, texts, ids), n, percent, scheme).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == jaccard_groups([(ids[i], t) for i, t in enumerate(texts)], n, percent)


@pytest.mark.parametrize("args", [(90, 1, 2), (80, 0, 1), (90, 1, 3), (60, 2, 4)])
def test_partenum_loses_no_pair(args):
    rng, scheme, seen = np.random.default_rng(1), PartEnum(*args), 0
    for _ in range(800):
        a = rng.integers(0, 2**63, int(rng.integers(scheme.least, 300)), dtype=np.uint64)
        cut, more = int(rng.integers(0, len(a) // 4 + 1)), int(rng.integers(0, len(a) // 4 + 1))
        b = np.concatenate([a[cut:], rng.integers(0, 2**63, more, dtype=np.uint64)])
        if 100 * (len(a) - cut) < args[0] * (len(a) + more):
            continue
        seen += 1
        assert set(scheme.signatures(np.sort(a)).tolist()) & set(scheme.signatures(np.sort(b)).tolist()) or set(a) == set(b)
        size = min(len(scheme.sketch(a)), len(scheme.sketch(b)))
        x, y = (int.from_bytes(fold(scheme.sketch(s), size), "big") for s in (a, b))
        assert (x ^ y).bit_count() <= len(set(a) ^ set(b))
    assert seen > 50


def test_partenum_pairs_with_equal_empty_partitions():
    scheme = PartEnum(80, k2=0, n2=1)
    a_size, b_size = 20, 25  # linked at five differences; spare is 3 and 4
    inst = scheme.band(a_size)
    total, need = scheme.groups(scheme.bands[inst + 1]), scheme.groups(a_size)
    pool = np.random.default_rng(4).integers(0, 2**63, 20_000, dtype=np.uint64)
    at = ((mix(pool ^ _ODD[inst]) >> np.uint64(32)) * np.uint64(total)) >> np.uint64(32)
    in_part = lambda i, k: pool[at == i][:k]
    # partitions 0 to 4 are full and get one more element each in b; 5 to 8 are empty in both; the rest is equal
    rest = np.concatenate([in_part(i, 20) for i in range(need, total)])
    full = np.concatenate([in_part(i, 1) for i in range(5)])
    head = np.concatenate([in_part(i, 1) for i in range(need, total)])
    a = np.concatenate([full, np.unique(np.concatenate([head, rest[: a_size - 5 - len(head)]]))])
    spare = [x for x in rest if x not in a]
    a = np.concatenate([a, np.array(spare[: a_size - len(a)], np.uint64)])
    b = np.concatenate([a, *(in_part(i, 2)[1:] for i in range(5))])
    assert (need, len(set(a)), len(set(b))) == (9, a_size, b_size)
    assert set(scheme.signatures(np.sort(a)).tolist()) & set(scheme.signatures(np.sort(b)).tolist())


def test_large_group_meets_in_blocks(spark, monkeypatch):
    from roadweave.llm import ngram_join

    monkeypatch.setattr(ngram_join, "SIGNATURE_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", 5)
    rng = random.Random(4)
    base, texts = words(rng, 80), []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = rng.choice("abcdefgh")
        texts.append(" ".join(w))
    found = ngram_jaccard_groups(docs(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == jaccard_groups(list(enumerate(texts)), 3, 90)


# operator 2


def test_targets_and_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.randint(0, 40))), s) for i, s in enumerate([None, "a", "b", "b", "c", "ä", "Z"] * 60)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = mixing.mix_to_targets(df, quality).collect()
    again = mixing.mix_to_targets(df.repartition(3), quality).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows) + 3
    size = defaultdict(int)
    for _, t, s in rows + rows[:3]:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight, total, capped = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and 3 * size[s] < level * weight[s]}
        if not new:
            break
        capped |= new
    taken = defaultdict(int)
    for r in out:
        target = 3 * size[r["source"]] if r["source"] in capped else level * weight[r["source"]]
        assert r["target"] == pytest.approx(target) and r["source_size"] == size[r["source"]]
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size_of = r["target"]
    for s in order:
        target = 3 * size[s] if s in capped else level * weight[s]
        assert abs(taken[s] - target) <= 40
    assert size_of > 0


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_to_targets(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], empty.schema)
    assert [r["taken"] for r in mixing.mix_to_targets(blank).collect()] == [0, 0]


def test_buckets_do_not_matter_for_the_sum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    out = mixing.mix_to_targets(df, weights=(1, 2)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("x")).collect()
    assert all(abs(r["t"] - r["x"]) <= 9 for r in out)


# operator 3


def test_audio_digest(spark):
    texts = [*ODD, "x" * 192, "same", "same"]
    for r in audio.audio_digests(audio.with_audio(docs(spark, texts))).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        stored = audio.to_wav(padded, 16000)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


@pytest.mark.parametrize("up, down", [(1, 2), (2, 3), (3, 2), (1, 1)])
def test_resampler(up, down):
    x = np.random.default_rng(0).integers(0, 256, 300, dtype=np.uint8)
    taps, half = 6, 6 * max(up, down)
    n, c = np.arange(-half, half + up), 1 / max(up, down)
    h = (up * c * np.sinc(n * c) * (0.5 + 0.5 * np.cos(np.pi * np.clip(n / half, -1, 1))))[: len(n) // up * up]
    length = -(-300 * up // down)
    expected = [sum(((x[i] - 128.0) / 128) * h[k * down - i * up + half] for i in range(300) if 0 <= k * down - i * up + half < len(h)) for k in range(length)]
    assert np.allclose(audio.resampled(x, 0, length, up, down, taps), expected, atol=1e-5)
    assert np.allclose(audio.resampled(x, 5, 40, up, down, taps), expected[5:40], atol=1e-5)


def test_features_do_not_depend_on_blocks(spark):
    x = np.random.default_rng(1).integers(0, 256, 90_000, dtype=np.uint8)
    x[30_000:60_000] = 128
    whole = audio.features(x, 16000, audio.AudioSpec(block=1 << 30))
    parts = audio.features(x, 16000, audio.AudioSpec(block=4000))
    assert np.allclose(whole[0], parts[0], atol=1e-4) and (whole[1] == parts[1]).all() and whole[2].tolist() == parts[2].tolist()
    assert len(whole[2]) == 2 and audio.tensor_array(whole[0]).type.shape == [96, 24]
    media = spark.createDataFrame([(1, audio.to_wav(x.tobytes(), 16000)), (2, None)], "doc_id long, media binary")
    rows = audio.audio_tensors(media).orderBy("part").collect()
    assert len(rows) == len(whole[0]) and np.allclose(rows[0]["log_mel"], whole[0][0].ravel(), atol=1e-4)


@pytest.mark.parametrize("size", [192, 96 * 160, 192 * 700])
def test_digest_is_of_the_tensors(spark, size):
    spec, x = audio.AudioSpec(block=4000), np.random.default_rng(2).integers(0, 256, size, dtype=np.uint8)
    tensors, spans, segments = audio.features(x, 16000, spec)
    half, micro = lambda t: np.rint(t * 2).astype("<i2").tobytes(), lambda t: np.rint(t * 1e6).astype("<i8").tobytes()
    blocks = list(audio.tensor_blocks(x, 16000, spec, []))
    whole = hashlib.sha256(half(tensors) + micro(spans) + micro(segments)).hexdigest()
    text = dict(f.split("=") for f in audio.feature_text(x, 16000, spec).split(";"))
    assert text["sha256"] == whole and int(text["tensors"]) == len(tensors) == len(spans) and (np.concatenate([t for t, _ in blocks]) == tensors).all()
    changed = x.copy()
    changed[-100:] = 128
    assert audio.feature_text(changed, 16000, spec)[-64:] != whole
    column = audio.audio_tensors(spark.createDataFrame([(1, audio.to_wav(x.tobytes(), 16000))], "doc_id long, media binary"), spec)
    assert json.loads(column.schema["log_mel"].metadata["ARROW:extension:metadata"]) == {"shape": [96, 24]}
    assert [r["part"] for r in column.orderBy("part").collect()] == list(range(len(tensors)))


@pytest.mark.parametrize("size", [192, 384, 576, 768, 192 * 51, 192 * 257])
def test_frames_reach_the_end(size):
    spec, x = audio.AudioSpec(), np.full(size, 128, np.uint8)
    x[-2:] = 255
    tensors, spans, _ = audio.features(x, 16000, spec)
    rows = sum(len(m) for m, _ in audio.frames(x, 16000, spec))
    assert (rows - 1) * spec.hop + spec.frame >= size // 2 > (rows - 2) * spec.hop + spec.frame or rows == 1
    assert spans[-1, 1] == size / 16000 and tensors.max() > np.log(2e-6)  # the end is heard
    loud = np.tile(np.array([0, 0, 255, 255], np.uint8), size // 4)
    assert audio.features(loud, 16000, spec)[2][-1, 1] == size / 16000


def test_segments():
    spec = audio.AudioSpec(open_db=-10, close_db=-20)
    energy = np.array([-30, -15, -5, -15, -30, -15, -15, -30, -9.0])
    assert audio.active_segments(energy, spec).tolist() == [[1, 4], [8, 9]]


# operator 4


@pytest.mark.parametrize("block", [1, 7, 64, 100_000])
def test_token_counts(spark, block):
    texts = [*ODD, "<|endoftext|> is text", " ".join(words(random.Random(0), 300))]
    encode = token_counts.tokenizer(token_counts.VOCABULARY).encode_ordinary
    found = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.document_token_counts(docs(spark, texts), block_tokens=block).collect())
    assert found == [(i, len(encode(t or ""))) for i, t in enumerate(texts)]


def test_separators_in_real_files(spark, tmp_path):
    data = np.array([5, 6, 9, 9, 7, 9, 8, 8, 8], "<u2")
    data.tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    np.array([], "<u2").tofile(tmp_path / "c.bin")
    blocks = token_counts.read_files(spark, str(tmp_path), block_tokens=2)
    rows = sorted((r["file"][-5:], r["ordinal"], r["first_token"], r["n_tokens"], r["closed"]) for r in token_counts.token_counts(blocks, 9).collect())
    assert rows == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 1, True), ("a.bin", 3, 6, 3, False), ("b.bin", 0, 0, 0, True)]


# operator 5


def test_maximal_segments():
    rng = np.random.default_rng(0)

    def brute(score, lo, hi):
        sums = np.concatenate([[0], np.cumsum(score[lo:hi])])
        options = [(sums[j] - sums[i], i - j, i, j) for i in range(len(sums)) for j in range(i + 1, len(sums))]
        best = max(options, default=(0,))
        if best[0] <= 1e-12:
            return []
        _, _, i, j = best
        return [*brute(score, lo, lo + i), (lo + i, lo + j - 1), *brute(score, lo + j, hi)]

    for _ in range(150):
        n = int(rng.integers(1, 20))
        score = np.where(rng.random(n) < 0.5, rng.normal(0, 2, n), toxicity.DRIFT)
        at = np.flatnonzero(score != toxicity.DRIFT)
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(at, score[at])] == brute(score, 0, n)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(3)
    bad, texts = ["zork", "blarg", "fnord"], []
    for i in range(600):
        w = words(rng, rng.randint(5, 60))
        if i % 6 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(500)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    df = docs(spark, [*texts, *ODD])
    model = toxicity.fit(df, labels)
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert len(rows) == 609 and all(0 <= r["score"] <= 1 for r in rows.values())
    wrong = [i for i in range(600) if rows[i]["predicted"] != int(i % 6 == 0)]
    assert len(wrong) <= 6
    assert rows[600]["score"] == rows[601]["score"] and rows[600]["predicted"] == 0
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.fit(df, flipped)
    assert (model.keys == other.keys).all() and model.slope == other.slope
    assert toxicity.without_toxic(df, model).count() == sum(1 - r["predicted"] for r in rows.values())


def test_toxicity_without_labels(spark):
    df = docs(spark, ODD)
    for labels in ([], [(3, 0), (4, 0)], [(3, 1)]):
        model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.score_toxicity(df, model).count() == len(ODD)


# operator 6


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([4, 5, 9, 20, 60, 60])] + [(6, None), (7, ""), (8, "one")]
    texts = list(ODD)
    for _ in range(40):
        w = words(rng, rng.randint(0, 120))
        item = items[rng.randrange(6)][1].split()
        for _ in range(rng.randint(0, len(item) // 6)):
            item[rng.randrange(len(item))] = "changed"
        texts.append(" ".join([*w, *item, *words(rng, rng.randint(0, 30))]))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    expected = [(d, i) for d, t in enumerate(texts) for i, q in items if shingles(q) and 100 * len(shingles(q) & shingles(t)) >= 80 * len(shingles(q))]
    found = benchmark_leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == sorted(expected) and expected
    assert benchmark_leaks(docs(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_sketch_is_long_enough():
    for size in range(1, 400):
        assert sketch_size(size, 80) >= min(size, size - -(-80 * size // 100) + 1)


# operator 7


def spans_of(rows, length):
    first = {}
    for d, t in sorted((d, t) for d, t in rows if d is not None):
        w = tuple((t or "").lower().split())
        for i in range(len(w) - length + 1):
            first.setdefault(w[i : i + length], d)
    out = set()
    for d, t in rows:
        w = tuple((t or "").lower().split())
        mark = [set() for _ in w]
        for i in range(len(w) - length + 1):
            if d is not None and first[w[i : i + length]] < d:
                for j in range(i, i + length):
                    mark[j].add(first[w[i : i + length]])
        i = 0
        while i < len(w):
            j = i
            while j < len(w) and mark[j]:
                j += 1
            if j > i:
                out.add((d, i, j - i, tuple(sorted(set().union(*mark[i:j])))))
            i = j + 1
    return sorted(out)


def test_repeated_spans(spark):
    rng = random.Random(8)
    passages = [words(rng, n) for n in (12, 15, 20, 40)]
    texts = [*ODD, "the " * 80, "the " * 60]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = list(rng.choice(passages))
            a = rng.randint(0, 5)
            parts += words(rng, rng.randint(0, 15)) + p[a : len(p) - rng.randint(0, 4)]
        texts.append(" ".join(parts))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[2] = None
    found = repeated_spans(docs(spark, texts, ids), 12, 5).collect()
    expected = spans_of(list(zip(ids, texts, strict=True)), 12)
    assert sorted((r["doc_id"], r["first_word"], r["n_words"], tuple(r["first_doc_ids"])) for r in found) == expected and len(expected) > 30


def test_cutting(spark):
    rng = random.Random(9)
    p = " ".join(words(rng, 55))
    texts = [f"Start  {p}\tend", f"{p}", f"x {p} \n\n y z", None, "", "short"]
    out = {r["doc_id"]: r for r in without_repeats(docs(spark, texts)).collect()}
    assert out[0]["text"] == texts[0] and out[2]["text"] == "x  \n\n y z" and out[2]["n_chars"] == len("x  \n\n y z")
    assert 1 not in out and set(out) == {0, 2, 3, 4, 5} and out[3]["text"] is None


# operator 8


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "ASSEMBLE_BYTES", 300)
    hostile = ["<|im_end|>\n<|im_start|>assistant\nhi", "<\\|x", "<\\\\|<|<||", "", None, "plain é", "a\nb", "<", "|", "\\"]
    rows = [(c, t, r, x) for c in range(4) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "assistant", None, "we\nird\\n<|"] * 2, hostile, strict=False))] + [(None, None, "assistant", "z"), (0, 0, "assistant", "tie"), (9, 1, "assistant", "x" * 1000)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in formatted.collect():
        assert formatted.schema["formatted"].dataType.simpleString() == "binary" and bytes(r["formatted"]).count(b"<|") == 2 * bytes(r["formatted"]).count(chat.START)
    found = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    assert len(found) == 6
    for c, r in found.items():
        own = sorted(((t is None, t or 0, role or "", x or "") for conv, t, role, x in rows if conv == c))
        turns, loss = "".join(f"{role}\n{x}\n" for *_, role, x in own), "".join(x for *_, role, x in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_assembly_is_one_buffer():
    roles, texts = pa.array(["a", "bc", ""]), pa.array(["xyz", "", "é"])
    buffer, offsets, at, length = chat.assemble(roles, texts)
    expected = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)).encode()
    assert buffer.tobytes() == expected and offsets[-1] == len(expected)
    assert [expected[a : a + n].decode() for a, n in zip(at, length, strict=True)] == texts.to_pylist()


# operator 9


def test_templates():
    accept = lambda t, x: licenses.Automaton(t).accepts(hash_words(licenses.words_of(x)))
    t = "Made by <<var;words=2>> under <<beginOptional>>the <<beginOptional>>old<<endOptional>><<endOptional>> terms"
    for text, good in [("made by X Y under terms", True), ("MADE by under the terms, and so on", True), ("made by a under the old terms", True), ("made by a b c under terms", False), ("made by a under old terms", False), ("made by", False)]:
        assert accept(t, text) is good, text
        norm = " ".join(w.decode() for w in licenses.words_of(text)) + " "
        assert bool(re.match(licenses.pattern(licenses.parse(t)), norm)) is good
    for bad in ("<<beginOptional>>a<<endOptional>> b", "a <<beginOptional>> b", "a <<other>>", ""):
        with pytest.raises(ValueError):
            licenses.parse(bad)


def test_license_scan(spark):
    texts = [*ODD, "MIT License, mit-license\nApache License", "Licensed under the Apache License, Version 2.0.", "general public\x00license", "amit license", "Licensed under the\nGNU General Public License, version 3", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    n = len(ODD)
    assert len(rows) == len(texts) and (rows[0]["n_words"], rows[0]["n_base"], rows[0]["first_word"], rows[0]["labels"], rows[0]["score"]) == (0, 0, None, "", 0.0)
    assert tuple(rows[n])[1:7] == (6, 3, 0, 4, "apache,mit", "apache,mit")
    assert (rows[n + 1]["base_labels"], rows[n + 1]["labels"], rows[n + 1]["score"]) == ("apache", "apache,apache-2.0", 1.0)
    assert rows[n + 2]["n_base"] == 1 and rows[n + 3]["n_base"] == 0
    assert rows[n + 4]["labels"] == "gpl,gpl-3.0" and rows[n + 5]["labels"] == "mit-text"


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{}THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
FSF = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def test_whole_license_texts(spark):
    plain = {label: re.sub(r"<<var;words=\d+>>", " X ", re.sub(r"<<(?:begin|end)Optional>>", " ", licenses.TEMPLATES[label])) for label in licenses.WHOLE + licenses.NOTICES}
    texts = [MIT.format(""), MIT.format("The Software shall be used for Good, not Evil. "), MIT.format("")[:-10], FSF, *plain.values()]
    texts += [" ".join(t.split()[:-1]) for t in plain.values()]  # cut before the last word
    texts += [" ".join([*t.split()[: len(t.split()) // 2], "changed " * 20, *t.split()[len(t.split()) // 2 :]]) for t in plain.values()]
    found = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert "mit-full" in found[0] and "mit-full" not in found[1] | found[2] and "gpl-3.0-notice" in found[3]
    n = len(plain)
    for i, label in enumerate(plain):
        assert label in found[4 + i] and label not in found[4 + n + i] | found[4 + 2 * n + i], label
        assert found[4 + i] & set(licenses.WHOLE) <= {label}
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    same(licenses.scan_licenses(docs(spark, texts)), duck, ORACLES["op9_licenses"])


# operator 10

PAGES = [
    ("<html><body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>One &amp; two<br>three <b>bo</b>ld.</p><div class=\"ad\">Buy</div><p>End.</article><footer>&copy; x</footer>", "Title One & two three bold. End."),
    ("<body><header><h1>Site</h1></header><main><p>a b c</p><div class='cookie-notice'>We use cookies</div><form>f<input></form><p>d e</p></main><aside>s</aside>", "a b c d e"),
    ('<body><div class="content"><h2>Head here</h2><p>Some words to read in this page, and more of them.</p><ul><li>item one<li>item two</ul></div><div id="sidebar">x y</div><div class="comments"><p>' + "reader " * 80 + "</p></div>", "Head here Some words to read in this page, and more of them. item one item two"),
    ("<script>if (a < b) { document.write('<p>no</p>') }</script><style>p{}</style><p>text &lt;p&gt; 1 < 2</p><!-- <p>hidden</p> -->", "text <p> 1 < 2"),
    ("plain words", "plain words"), ("", ""), (None, ""), ("<p", ""), ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<article><p>Main text of it.</p><section class=comments><article class=comment><p>" + "no " * 90 + "</p></article></section></article>", "Main text of it."),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "t") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in html_text.extract_pages(df).collect()}
    for i, (_, expected) in enumerate(PAGES):
        assert (rows[i]["text"], rows[i]["n_chars"], rows[i]["url"]) == (expected, len(expected), f"u{i}")


BODY = "Some words to read in this page, and more of them than of any other part of it."
READERS = "".join(f'<article class="{c}"><p>Reader said so.</p></article>' for c in ("comment-body", "teaser", "comment"))
TAGGED = [
    # article and main stand in comments, scripts, attributes and dropped elements only
    (f"<body><!-- <main> --><div><p>{BODY}</p></div></body>", BODY),
    (f"<body><script>var a = '<article>'</script><div title='<main>'><p>{BODY}</p></div></body>", BODY),
    (f"<body><aside><article>x y z</article></aside><div><p>{BODY}</p></div></body>", BODY),
    # readers' parts beside a text in a div, and as all of a page
    (f"<body><div><p>{BODY}</p></div><div>{READERS}</div></body>", BODY),
    (f"<body>{READERS}</body>", "Reader said so. Reader said so. Reader said so."),
    # an unmarked card holds few of the words
    (f"<body><div><p>{BODY}</p></div><nav>n</nav><article class='card'><p>Card</p></article></body>", BODY),
    # text beside an article that holds more words
    (f"<body><div><p>Before it all.</p></div><article><p>{BODY}</p></article><div><p>{BODY[:40]}</p></div></body>", f"Before it all. {BODY} {BODY[:40]}"),
]


@pytest.mark.parametrize("page, expected", TAGGED)
def test_article_tags_hide_no_text(page, expected):
    assert html_text.main_text(page) == " ".join(expected.split())


def test_pages_as_plain_regex(spark, sf_dir):
    import html

    for r in QUERIES["op10_html_text"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())


def test_best_region():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-2, -1, 1, 2]) for _ in range(rng.randint(0, 12))]
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        i, j = html_text.best_region(s)
        assert sum(s[i:j]) == max(0, best)


# pipeline


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    docs0 = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, seen = docs0, [docs0.count()]
    for name, stage in p.STAGES[:-1]:
        stage(spark, at, sf_dir).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.columns == docs0.columns
        seen.append(at.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > seen[0] // 2
    mixed = p.STAGES[-1][1](spark, at, sf_dir)
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in at.collect()}


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate([*ODD, "a b c d e f", "a b c d e f"])] + [(3, "one", "en", "s", 3), (None, "no id", None, None, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in p.STAGES[:-1]:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(df.count())
    assert counts == [13, 10, 10, 9], json.dumps(counts)
    assert p.run(spark, str(tmp_path)).count() > 0
