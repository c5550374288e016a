"""Row numbers and running sums over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def ranked(rows: DataFrame, number: str, *order: str | Column, **sums: str) -> DataFrame:
    """Add ``number``, the place in ``order`` from 0, and for each of ``sums`` the sum of a column over all rows before.

    Rows are dealt by ranges of the order and numbered within each; what stands in the ranges before is added. Only one
    short row a range comes to the driver. Rows of equal order stand in any order.
    """
    parts = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = [F.count("*").alias("_n"), *(F.sum(c).alias(f"_{name}") for name, c in sums.items())]
    before, shifts = [0, *(0.0 for _ in sums)], []
    for part, *own in sorted(parts.groupBy("_part").agg(*totals).collect()):
        shifts.append((part, *before))
        before = [a + (b or 0) for a, b in zip(before, own, strict=True)]
    fields = ", ".join(["_part int", "_n long", *(f"_{name} double" for name in sums)])
    shift = rows.sparkSession.createDataFrame(shifts or [(0, *before)], fields)
    own = Window.partitionBy("_part").orderBy(*order)
    above = own.rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({number: (F.row_number().over(own) - 1).cast("long")} | {name: F.coalesce(F.sum(c).over(above), F.lit(0.0)) for name, c in sums.items()})
    out = out.join(F.broadcast(shift), "_part")
    out = out.withColumns({number: F.col(number) + F.col("_n")} | {name: F.col(name) + F.col(f"_{name}") for name in sums})
    return out.drop("_part", "_n", *(f"_{name}" for name in sums))
