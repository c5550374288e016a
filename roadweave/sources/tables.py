"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A smaller table is left as its scan gives it.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its scan has fewer tasks than the cluster has cores, as for one small file; larger inputs are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size >= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
