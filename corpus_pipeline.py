"""Corpus pipeline over ``documents``: toxicity, near duplicates, repeated passages, benchmark leaks, source mixture.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, all but the last with the columns of ``docs`` as they
are: columns besides doc_id, text and source may have any names. A null or empty text is kept by all stages but the
mixture, which has no words to take from it. An empty table of documents gives none; without labels no document is
toxic and all weigh the same, without benchmark items none leaks. Very long texts are read in pieces by every operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.decontaminate import benchmark_leaks
from roadweave.llm.mixing import mix_to_targets
from roadweave.llm.ngram_join import PartEnum, ngram_jaccard_groups
from roadweave.llm.suffix_dedup import without_repeats
from roadweave.llm.tables import read, stored
from roadweave.llm.toxicity import fit, without_toxic

#: Up to so many ids of documents that go (under 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone`` (doc_id)."""
    gone = stored(gone.where("doc_id is not null").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that operator 5 predicts 0, those without doc_id too; repeated rows stay or go together."""
    return without_toxic(docs, fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that operator 1 links (five-word shingles, similarity of 0.8) the smallest doc_id stays.

    Rows without doc_id stay; rows that share a doc_id stay or go together, equal rows once.
    """
    groups = ngram_jaccard_groups(docs, 5, 80, PartEnum(80, k2=0, n2=1))
    kept = _without(docs, groups.where("component_id is not null and doc_id <> component_id").select("doc_id"))
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    repeated = kept.join(again, "doc_id", "left_semi").select(*docs.columns).distinct()
    return _without(kept, again).unionByName(repeated) if again.limit(1).count() else kept


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document of a smaller doc_id has (operator 7).

    n_chars follows a cut text, one left without words goes; rows without doc_id stay as they are.
    """
    return without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item (operator 6); rows without doc_id stay, those that share one stay or go together."""
    return _without(docs, benchmark_leaks(docs, read(spark, sf_dir, "benchmark"), short_items=True).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that operator 2 takes, with the words it takes of each (whole copies, up to three); its columns, not those of ``docs``."""
    return mix_to_targets(docs, read(spark, sf_dir, "labels")).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("benchmark_leaks", drop_leaks),
    ("source_mixture", mix_sources),
]

#: Learned scores and similarity groups have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
