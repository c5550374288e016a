"""Operator 5: toxicity by maximum-scoring segments of token log-odds.

Tokens are words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (A-Z in lower case) and, for words
that are longer, their first four to eight bytes. Training counts in how many toxic and
other labelled texts each token stands; its score is the log-odds ratio under a Dirichlet
prior, and it is kept where the odds differ by EFFECT at least and a likelihood-ratio test, stricter the more tokens
there are, is significant. A
word scores by the longest of its tokens that is kept, and slightly negative without
one. One linear scan finds all maximal-scoring segments of a text. Segment scores become
p-values by the extreme-value law fitted to clean texts, and a text's summed evidence
becomes a probability by a logistic curve.

The fit uses at most ``FitLimits.rows`` labelled texts and all tokens of a significant effect in them; scoring covers
every whole text, a long one piece by piece.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, mapped, slices, stored
from .words import NON_ALNUM, U64, Scan, is_long, mix, piece_scans

DRIFT = -0.5
#: Bytes of the prefix tokens.
PREFIXES = (4, 5, 6, 7, 8)
#: A token is kept from a likelihood ratio of this times the logarithm of the number of tokens.
SIGNIFICANCE = 1.4
#: Smallest log-odds (either way) of a kept token; over many texts the slightest difference is significant.
EFFECT = 1.0
#: Scores of single tokens are held within these bounds, so that no one rare token decides.
LOWEST, HIGHEST = -3.0, 7.0


@dataclass(frozen=True)
class FitLimits:
    """Bound of the training sample: labelled rows (those with the smallest hashes)."""

    rows: int = 40_000


@dataclass
class Model:
    """A fitted scorer; ``keys`` are sorted token hashes. Without toxic examples it holds no token and scores every text by the prior."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = -4.0

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def look_up(self, tokens: np.ndarray, out: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Write the scores of kept tokens to ``out`` (at ``rows``)."""
        near = np.flatnonzero(self.seen[(tokens & U64(0xFFFF)).astype(np.int64)])
        if not len(near) or not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, tokens[near]), len(self.keys) - 1)
        hit = self.keys[at] == tokens[near]
        near, at = near[hit], at[hit]
        out[near if rows is None else rows[near]] = self.scores[at]

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Summed -log10 p-value of the segments of a text of ``n`` words."""
        return sum(-math.log10(self.p_value(s, n)) for _, _, s in segments)

    def p_value(self, score: float, n: int) -> float:
        expected = math.exp(min(50.0, self.log_k + math.log(max(n, 1)) - self.lam * score))
        return max(-math.expm1(-expected), 1e-30)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.offset + self.slope * math.log1p(evidence)))))


def tokens_of(scan: Scan) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of all words, then (word positions, hashes) of the prefixes, shortest first."""
    whole = scan.hashes()
    lengths = scan.ends - scan.starts
    padded = np.concatenate([scan.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(scan.data) + 1,), "<u8", padded, strides=(1,))
    out = []
    for size in PREFIXES:
        rows = np.flatnonzero(lengths > size)
        out.append((rows, mix((eights[scan.starts[rows]] & U64(2 ** (8 * size) - 1)) ^ mix(np.full(1, size, U64)))))
    return whole, out


def word_scores(scan: Scan, model: Model) -> np.ndarray:
    """Score of every word; NaN where no token of it is kept."""
    whole, prefixes = tokens_of(scan)
    out = np.full(len(whole), np.nan)
    for rows, hashes in prefixes:
        model.look_up(hashes, out, rows)
    model.look_up(whole, out)
    return out


def maximal_segments(places: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score) of a sequence that scores ``scores`` at ``places`` and ``drift`` elsewhere.

    Ruzzo and Tompa's scan: candidates (left sum, right sum) wait on a stack; a new one joins those whose left sum is lower and right sum not higher.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # the last has the nearest candidate below of a lower left sum
    total, last = 0.0, -1
    for place, score in zip(places.tolist(), scores.tolist(), strict=True):
        total += drift * (place - last - 1)
        last = place
        if score <= 0:
            total += score
            continue
        first, left, right = place, total, total + score
        total = right
        while True:
            at = len(stack) - 1
            while at >= 0 and stack[at][2] >= left:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= right:
                stack.append((first, place, left, right, at))
                break
            first, left = stack[at][0], stack[at][2]
            del stack[at:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def _row_segments(data: np.ndarray, offsets: np.ndarray, model: Model):
    """For every row of a slice its number of words and its segments."""
    if is_long(data, offsets):
        places, known, n = [], [], 0
        for _, n, scan in piece_scans(data, NON_ALNUM):
            scores = word_scores(scan, model)
            at = np.flatnonzero(~np.isnan(scores))
            places.append(at + n)
            known.append(scores[at])
            n += len(scores)
        yield n, maximal_segments(np.concatenate(places), np.concatenate(known))
        return
    scan = Scan(data, offsets, NON_ALNUM)
    scores = word_scores(scan, model)
    known = np.flatnonzero(~np.isnan(scores))
    bounds = np.searchsorted(known, scan.first)
    for i in range(len(scan.first) - 1):
        own = known[bounds[i] : bounds[i + 1]]
        n = int(scan.first[i + 1] - scan.first[i])
        yield n, maximal_segments(own - scan.first[i], scores[own]) if len(own) else []


def _distinct_tokens(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, rows) of a scan, sorted by token, every token once a row."""
    whole, prefixes = tokens_of(scan)
    row = np.repeat(np.arange(len(scan.first) - 1), np.diff(scan.first))
    pairs = [(row, whole), *((row[rows], h) for rows, h in prefixes)]
    rows, tokens = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((rows, tokens))
    rows, tokens = rows[order], tokens[order]
    new = np.ones(len(rows), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
    return tokens[new], rows[new]


def _presence(batches):
    """Token counts over distinct labelled texts of a partition: (token, toxic, other)."""
    schema = pa.schema([("token", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())])
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, _, data, offs in slices(batch.column("text")):
            if is_long(data, offs):
                tokens = np.zeros(0, U64)
                for *_, scan in piece_scans(data, NON_ALNUM):
                    tokens = np.union1d(tokens, _distinct_tokens(scan)[0])
                rows = np.zeros(len(tokens), np.int64)
            else:
                tokens, rows = _distinct_tokens(Scan(data, offs, NON_ALNUM))
            if not len(tokens):
                continue
            begin = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1])
            bad = np.add.reduceat((toxic[lo + rows] > 0).astype(np.int64), begin)
            all_ = np.diff(np.concatenate([begin, [len(tokens)]]))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[begin].view(np.int64)), pa.array(bad), pa.array(all_ - bad)], schema=schema)


def _sample_segments(model: Model):
    """Of each training text: label, words, the scores of its segments."""
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for lo, _, data, offs in slices(batch.column("text")):
                found = list(_row_segments(data, offs, model))
                yield pa.RecordBatch.from_arrays([pa.array([int(t > 0) for t in toxic[lo : lo + len(found)]], pa.int32()), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for *_, s in seg] for _, seg in found], pa.list_(pa.float64()))], schema=schema)

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge-regularised logistic curve."""
    X, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ w))
        grad = X.T @ (p - y) + np.array([0.01, 0.001]) * w
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + np.diag([0.01, 0.001]), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, limits: FitLimits | None = None, held_out: bool = True) -> Model:
    """Fit on labelled documents; with ``held_out`` those whose crc32(doc_id as text) mod 4 is 2 are left out.

    Null labels, ids and texts do not count; several labels of a document count by the largest; equal texts count once
    (by the largest label too). Without a labelled text of both kinds the model scores every text by the prior; so it does
    for empty tables. Extra columns are ignored.
    """
    limits = limits or FitLimits()
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if held_out:
        known = known.where("crc32(cast(_id as string)) % 4 <> 2")
    total = known.count()
    if not total:
        return Model()
    if total > limits.rows:
        share = F.shiftrightunsigned(F.xxhash64("_id"), 11) < F.lit(int(limits.rows / total * (1 << 53)))
        known = known.where(share).limit(limits.rows + limits.rows // 10)  # never reached: the share is within a few hundredths
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where("text is not null").withColumn("h", F.xxhash64("text"))
    of_text = texts.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).groupBy("h", "_id").agg(F.count("*").alias("k"), F.max("toxic").alias("toxic"))
    once = stored(of_text.groupBy(F.col("h").alias("_h")).agg(F.min("_id").alias("_id"), F.max("k").alias("k"), F.max("toxic").alias("toxic")), "once")  # at most limits.rows short rows
    train = texts.join(F.broadcast(once), (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h")))
    if once.where("k > 1").limit(1).count():  # rows that are there more than once
        train = train.dropDuplicates(["h"])
    train = stored(train.select("text", "toxic"), "train")
    rows, toxic = train.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == rows:
        return Model(offset=math.log((toxic or 0) + 0.5) - math.log(rows - (toxic or 0) + 0.5) if rows else -4.0)
    clean = rows - toxic
    counts = mapped(train, _presence, "token long, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("t"), F.sum("other").alias("c"))
    counts = stored(counts, "counts")
    vocabulary = counts.where("t + c > 1").count()

    def cell(seen, holding, size):
        return F.when(seen > 0, seen * F.log(seen / (holding * (size / rows)))).otherwise(0.0)

    with_it, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
    without = F.lit(rows) - with_it
    g2 = 2 * (cell(t, with_it, toxic) + cell(c, with_it, clean) + cell(toxic - t, without, toxic) + cell(clean - c, without, clean))
    prior = 0.5 + 10 * with_it / rows
    odds = F.log((t + prior) / (toxic - t + prior)) - F.log((c + prior) / (clean - c + prior))
    kept = counts.where("t + c > 1").withColumns({"g2": g2, "odds": odds})
    kept = kept.where((F.col("g2") >= SIGNIFICANCE * math.log(max(vocabulary, 2))) & (F.abs("odds") >= EFFECT))
    kept = kept.select("token", "c", "odds").toPandas()  # significant tokens of a bounded number of texts
    dropped(counts, once)
    if not len(kept):
        return Model(offset=math.log(toxic / clean))
    c, odds = kept["c"].to_numpy(float), kept["odds"].to_numpy(float)
    keys = kept["token"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    model = Model(keys[order], np.clip(odds, LOWEST, HIGHEST)[order])
    sample = mapped(train, _sample_segments(model), "toxic int, n long, segments array<double>").toPandas()  # at most limits.rows short rows
    dropped(train)
    y, n, segments = sample["toxic"].to_numpy(float), sample["n"].to_numpy(), sample["segments"].tolist()
    best = np.array([max(s, default=0.0) for s in segments])
    negative = (y == 0) & (n > 0)
    # clean words are what the law is about: the rate at which their token scores pay off fixes lambda
    share = np.clip(c / max(1.0, float(n[negative].sum())), 0, 1)
    share, scores = share / max(1.0, share.sum()), np.clip(odds, LOWEST, HIGHEST)
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        value = (share * np.exp(mid * scores)).sum() + (1 - share.sum()) * math.exp(mid * DRIFT)
        lo, hi = (mid, hi) if value < 1 else (lo, mid)
    model.lam = lo
    maxima = negative & (best > 0)
    # an occurrence rate: expected segments at least as good as s in n words are K n exp(-lambda s)
    rate = np.log(maxima.sum() + 0.5) - np.log(max(1.0, float(n[negative].sum())))
    model.log_k = float(rate + model.lam * (np.min(best[maxima]) if maxima.any() else 0.5))
    evidence = np.array([model.evidence([(0, 0, s) for s in seg], int(k)) for seg, k in zip(segments, n, strict=True)])
    model.slope, model.offset = _logistic(np.log1p(evidence), y)
    return model


def _score(spread):
    segment = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("segments", pa.list_(segment))])

    def run(batches):
        model = spread.value
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                scores, passages = [], []
                for n, found in _row_segments(data, offs, model):
                    scores.append(model.probability(model.evidence(found, n)))
                    passages.append([{"first_word": a, "last_word": b, "score": s, "p_value": model.p_value(s, n)} for a, b, s in found])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(segment))], schema=schema)

    return run


def score_toxicity(docs: DataFrame, model: Model, significant: float = 0.05) -> DataFrame:
    """Return one row per row of ``docs`` (doc_id, text): doc_id, score, predicted, passages (significant segments, by word).

    Null and empty texts have no segments and score like a text without evidence. Repeated
    rows repeat; equal texts score equally; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast(model)
    out = mapped(docs, _score(spread), "doc_id long, score double, segments array<struct<first_word: long, last_word: long, score: double, p_value: double>>")
    return out.select("doc_id", "score", F.expr("cast(score >= 0.3 as int)").alias("predicted"), F.filter("segments", lambda s: s["p_value"] <= significant).alias("passages"))


def _keep_clean(spread):
    def run(batches):
        model = spread.value
        for batch in batches:
            mask = []
            for _, _, data, offs in slices(batch.column("text")):
                mask += [model.probability(model.evidence(found, n)) < 0.3 for n, found in _row_segments(data, offs, model)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return run


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` predicts 0, columns as they are, whatever their names.

    Null and empty texts stay if the prior is under 0.3; repeated rows stay or go together; an empty table gives none.
    """
    return mapped(docs, _keep_clean(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
