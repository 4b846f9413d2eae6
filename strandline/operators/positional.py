"""Operators over the ordered rows of an entity: bounded frames, never joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(entity: list[str], order: list[str], lo: int | None = None, hi: int | None = None):
    """The window of an entity's rows in order, from row ``lo`` to ``hi`` about each."""
    w = Window.partitionBy(*entity).orderBy(*order)
    return w if lo is None else w.rowsBetween(lo, hi)


def any_within(cond: Column, w) -> Column:
    """Whether any row of the frame meets ``cond``; false on an empty frame."""
    return F.coalesce(F.max(cond.cast("int")).over(w), F.lit(0)) == 1


def last_defined(value: Column, defines: Column, w) -> Column:
    """The value at the nearest earlier row of the frame that defines it, null if none does."""
    return F.last(F.when(defines, value), ignorenulls=True).over(w)


def nearest_after(value: Column, matches: Column, w) -> Column:
    return F.first(F.when(matches, value), ignorenulls=True).over(w)


def most_frequent(df: DataFrame, entity: list[str], value: str, order: list[str]) -> DataFrame:
    """The value that an entity has most often; of ties the one that it had first."""
    seq = F.row_number().over(over(entity, order))
    counted = df.withColumn("__seq", seq).groupBy(*entity, value).agg(F.count("*").alias("n"), F.min("__seq").alias("first_seen"))
    best = Window.partitionBy(*entity).orderBy(F.desc("n"), "first_seen")
    return counted.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def carry_forward(df: DataFrame, entity: list[str], order: list[str], is_header: Column, header: Column, name: str = "section") -> DataFrame:
    """Each row with the last header at or before it."""
    return df.withColumn(name, F.last(F.when(is_header, header), ignorenulls=True).over(over(entity, order).rowsBetween(Window.unboundedPreceding, 0)))


#: Leading hexadecimal digits of a hash that number its bucket: 4,096 buckets a stratum.
BUCKET_DIGITS = 3


def hash_rank(df: DataFrame, strata: list[str], key: Column, rank: str = "__k", size: str = "__n") -> DataFrame:
    """``rank``: each row's place, from 1, in its stratum by sha256 of the key as text, then by key; ``size``: the rows of
    the stratum. Rows are ranked within buckets of hashes, and buckets start from the sums of those before them, so a
    stratum is spread over many tasks, however large."""
    rows = df.withColumn("__h", F.sha2(key.cast("string"), 256)).withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    sizes = rows.groupBy(*strata, "__b").agg(F.count("*").alias("__m"))
    whole = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("__m").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(c).alias(f"__s_{c}") for c in strata), F.col("__b").alias("__b2"), before.alias("__before"), F.sum("__m").over(whole).alias(size))
    own = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__h", key))
    met = rows.withColumn("__own", own).join(offsets, [F.col("__b") == F.col("__b2"), *(F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in strata)])
    return met.select(*df.columns, (F.col("__before") + F.col("__own")).alias(rank), size)


def proportional_split(df: DataFrame, strata: list[str], key: Column) -> DataFrame:
    """``split`` by the order of sha256 of the key in each stratum: one row is train, two are train and test, else train
    has max(1, 6n div 10) rows and validation max(1, 2n div 10), or n - 2 and 1 where that would leave none for test."""
    df = hash_rank(df, strata, key)
    train, valid = F.greatest(F.lit(1), F.floor(F.col("__n") * 6 / 10)), F.greatest(F.lit(1), F.floor(F.col("__n") * 2 / 10))
    full = train + valid >= F.col("__n")
    train, valid = F.when(full, F.col("__n") - 2).otherwise(train), F.when(full, F.lit(1)).otherwise(valid)
    split = F.when(F.col("__k") <= train, "train").when(F.col("__k") <= train + valid, "validation").otherwise("test")
    split = F.when(F.col("__n") == 1, "train").when((F.col("__n") == 2) & (F.col("__k") == 1), "train").when(F.col("__n") == 2, "test").otherwise(split)
    return df.withColumn("split", split).drop("__n", "__k")
