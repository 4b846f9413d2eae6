"""From raw documents to a training mixture: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, language, lines, mixing, neardup
from strandline.llm.common import WORD_CHAR, small, stored

#: Ids of documents that a stage drops are broadcast up to so many, after they have been counted.
BROADCAST_ROWS = 500_000


ROW = "__sl_row_key"


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` stored with a number for each row, so that rows without an id or that share one are told apart."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The keyed ``rows`` without those whose key is in ``gone``."""
    keys = stored(gone.select(ROW), "gone")
    return rows.join(small(keys, BROADCAST_ROWS), ROW, "left_anti").select([c for c in rows.columns if c != ROW])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be determined: null texts and texts without a letter. The prediction fills
    in a null ``lang``; languages are learned from the documents that have one."""
    model = language.train(docs)
    found = language.with_language(docs, model).filter(F.col("lang_pred") != language.UNDETERMINED)
    return found.select(*(F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts. A document that loses all its words goes, as they stand elsewhere; the
    number of characters is counted anew."""
    found = lines.dedup_lines(docs)
    found = found.filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD_CHAR))
    return found.select(*(F.coalesce(F.length("text"), F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id (one without an id if no
    other is left): five words, similarity 0.8."""
    rows = _keyed(docs, "near-rows")
    found = stored(neardup.near_duplicates(rows, width=5, percent=80, id_col=ROW), "near-found")
    several = found.filter("not kept").select("component_id").distinct()
    linked = found.join(small(several, BROADCAST_ROWS), "component_id", "left_semi").select(ROW, "component_id")
    linked = stored(rows.select(ROW, "doc_id").join(small(linked, BROADCAST_ROWS), ROW), "near-linked")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    keepers = linked.groupBy("component_id").agg(F.min(place)[ROW].alias(ROW))
    return _without(rows, linked.join(small(keepers.select(ROW), BROADCAST_ROWS), ROW, "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs, "scanned-rows")
    return _without(rows, decontaminate.scan(rows, items, id_col=ROW).filter("contaminated"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of characters by Poisson replication, in a global random order."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
]

#: Models and graph searches can't be put in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
