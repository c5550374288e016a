"""Operator 2: mixing sources to target weights by Efraimidis-Spirakis keys.

Each row gets the key -ln(u) / q, u from a hash of its id and text and q its quality weight;
a source's rows in key order are a weighted sample without replacement. A target takes as
many complete epochs of its source as it holds, then a prefix of that order whose sizes
sum to the rest, and one closing row that comes nearest to what is left. No source is
sorted: a monotone function of the key deals its rows to a few buckets, whose sums say in
which one the prefix ends, and only that one's rows are dealt again, until few are left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import few, mapped, slices, stored
from .words import Scan, is_long, piece_scans

#: Up to so many sources their table (under 100 bytes a row) is broadcast; beyond it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: A source's rows are dealt again until at most so many are left where the prefix ends; the closing row is one of them.
BUCKET_ROWS = 1000
#: Bits of a key's place, and of them those that one dealing looks at.
PLACE_BITS, DEALT_BITS = 48, 6


def _sized(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("t", pa.int64()), ("size", pa.int64())])
    for batch in batches:
        counts = [np.array([sum(len(scan.starts) for *_, scan in piece_scans(data, lower=False))]) if is_long(data, offs) else np.diff(Scan(data, offs, lower=False).first) for _, _, data, offs in slices(batch.column("text"))]
        size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "t")), pa.array(size, pa.int64())], schema=schema)


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``rank``: the place from 0 in code-point order, null last; ranges are numbered apart and shifted."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = stored(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before, shifts = 0, []
    for row in sorted(parts.groupBy("part").count().collect()):  # one row a partition
        shifts.append((row["part"], before))
        before += row["count"]
    shift = parts.sparkSession.createDataFrame(shifts or [(0, 0)], "part int, shift long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("own", rank).join(F.broadcast(shift), "part").withColumn("rank", F.col("own") + F.col("shift")).drop("own", "shift", "part")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """Return (source, source_size, target) of rows (source, size).

    Shares of the total follow the repeated weights; a target above ``ceiling`` times its
    source stops there and the excess is shared again by weight until none is above.
    """
    ranked = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.lit(ceiling) * F.col("source_size") < F.lit(level) * F.col("weight")
        full, free = ranked.agg(F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        now = (total - ceiling * (full or 0)) / free if free else math.inf
        if now <= level:
            break
        level = now
    target = F.least(F.lit(float(ceiling)) * F.col("source_size"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def _prefixes(rows: DataFrame, rest: DataFrame) -> list[DataFrame]:
    """Rows (..., source, size, p0, p1, p2) as parts with ``picked``: for each source of ``rest`` (source, left) a prefix by (p0, p1, p2) whose sizes sum to left, and a closing row.

    A part's rows are those that one dealing decides on; the last has the rows among which a prefix ends.
    """
    columns, parts = rows.columns, []
    for place in ("p0", "p1", "p2"):
        for shift in range(PLACE_BITS - DEALT_BITS, -1, -DEALT_BITS):
            if not rows.groupBy("source").count().where(F.col("count") > BUCKET_ROWS).limit(1).count():
                return [*parts, _closed(rows, rest, columns)]
            rows = rows.withColumn("bucket", F.shiftright(place, shift).bitwiseAND((1 << DEALT_BITS) - 1))
            sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
            below = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            ends = sums.withColumn("below", below).join(few(rest.withColumnRenamed("source", "_s"), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_s"))).where("below <= left and below + s > left")
            ends = stored(ends.groupBy("source").agg(F.min("bucket").alias("cut"), F.min_by(F.col("left") - F.col("below"), "bucket").alias("left")), "cuts")
            met = rows.join(few(ends.select(F.col("source").alias("_s"), "cut"), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_s")), "left")
            parts.append(met.where("cut is null or bucket <> cut").select(*columns, F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).alias("picked")))
            rows, rest = stored(met.where("bucket = cut").select(*columns), "edge"), ends.select("source", "left")
    return [*parts, _closed(rows, rest, columns)]


def _closed(rows: DataFrame, rest: DataFrame, columns: list[str]) -> DataFrame:
    """Few rows of each source with ``picked``: the prefix that fits, then the one of the others (the first of equals) that comes nearest to what is left."""
    order = ["p0", "p1", "p2"]
    met = rows.join(few(rest.withColumnRenamed("source", "_s"), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    met = met.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("fits", F.col("upto") <= F.col("left"))
    gap = F.col("left") - F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(Window.partitionBy("source")), F.lit(0))
    met = met.withColumn("gap", gap).withColumn("off", F.abs(F.col("size") - F.col("gap")))
    best = F.row_number().over(Window.partitionBy("source").orderBy("fits", "off", *order)) == 1
    return met.select(*columns, (F.col("fits") | (best & (F.col("off") < F.col("gap")))).alias("picked"))


def mix_to_targets(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3, seed: int = 11, quality_weights: tuple[float, float, float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Return one row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    size counts words ``[^\\x20\\x09-\\x0D]+`` of the whole text (null or empty: 0); taken is a
    whole multiple of size, 0 to ``ceiling`` times it. ``quality`` (doc_id, quality) sets the
    sampling weight: ``quality_weights`` for 0, unknown and 1; several rows of a document
    count by their largest, null ones not. Null sources are one source, the last. Rows of
    one doc_id with different texts are sampled apart; of equal rows any may be taken
    (they are equal); an empty table gives an empty result. Extra columns are ignored. Reruns agree.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    sized = stored(mapped(docs, _sized, "doc_id long, source string, t long, size long"), "sized")
    targets = stored(source_targets(sized, weights, ceiling), "targets")
    q: Column = F.lit(quality_weights[1])
    keyed = sized
    if quality is not None:
        graded = quality.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
        keyed = keyed.join(graded, "doc_id", "left")
        q = F.when(F.col("quality") >= 1, quality_weights[2]).when(F.col("quality") <= 0, quality_weights[0]).otherwise(quality_weights[1])
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "t", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    place = F.least(F.floor((1 - F.exp(F.log(u) / q * min(quality_weights))) * float(1 << PLACE_BITS)), F.lit((1 << PLACE_BITS) - 1)).cast("long")
    other = lambda *x: F.shiftrightunsigned(F.xxhash64(*x, F.lit(seed + 1)), 64 - PLACE_BITS)
    # equal keys go by another hash; equal rows, which may be many, by any order
    keyed = stored(keyed.select("doc_id", "source", "size", place.alias("p0"), other("doc_id", "t").alias("p1"), other(F.monotonically_increasing_id()).alias("p2")), "keyed")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    parts = _prefixes(keyed, plan.select("source", "left"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    side = few(plan.select(F.col("source").alias("_source"), "source_size", "target", "epochs"), BROADCAST_SOURCES)
    out = out.join(side, F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
