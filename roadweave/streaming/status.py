"""A stream of collection reports, joined into the sections before the next plan (an extension of the batch planner)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

UPDATES = "section_id long, collected_at timestamp"


def read_reports(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """JSON reports that arrive in a folder, each section's first one within the watermark."""
    return spark.readStream.schema(UPDATES).json(folder).withWatermark("collected_at", late).dropDuplicatesWithinWatermark(["section_id"])


def apply_reports(sections: DataFrame, reports: DataFrame) -> DataFrame:
    """Sections with those of the reports marked as collected; unknown and null ids change nothing."""
    done = reports.where("section_id is not null").select(F.col("section_id").alias("_id")).distinct()
    joined = sections.join(done, F.col("section_id") == F.col("_id"), "left")
    return joined.withColumn("collected", F.col("collected") | F.col("_id").isNotNull()).select(*sections.columns)


def follow(reports: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame], None]) -> StreamingQuery:
    """Call ``on_batch`` with each batch of new reports, once each after a restart from ``checkpoint``."""
    return reports.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: on_batch(df)).start()
