"""Joins and set operators with the semantics that feature assembly needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.positional import hash_rank


def default_fill(base: DataFrame, features: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """Left join; the named feature columns are filled where the base row has no match or a null."""
    joined = base.join(features, on, "left")
    return joined.select(*(F.coalesce(c, F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in joined.columns))


def range_lookup(points: DataFrame, spans: DataFrame, point: str, lo: str, hi: str, order: str, width: float, also: list[Column] | None = None) -> DataFrame:
    """Points with the first span (by ``order``) of those [lo, hi) that hold them; points in no span are left out. ``also``
    are further equalities of the join.

    Spans are cut to buckets of ``width`` and points are equi-joined on theirs, so both sides can be large.
    """
    bucket = lambda c: F.floor(c / F.lit(float(width)))
    cut = spans.filter(F.col(hi) > F.col(lo)).withColumn("__b2", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi)))))
    met = points.withColumn("__b", bucket(F.col(point))).join(cut, [F.col("__b") == F.col("__b2"), *(also or [])]).filter((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("__b", "__b2")
    own = [c for c in points.columns]
    return met.groupBy(*own).agg(F.min_by(F.struct(*spans.columns), order).alias("__s")).select(*own, "__s.*")


def by_precedence(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several sources of one schema; a key keeps the row of the first source that has it."""
    every = reduce(DataFrame.unionByName, (df.withColumn("precedence", F.lit(k)) for k, df in enumerate(sources)))
    best = Window.partitionBy(*key).orderBy("precedence", *[c for c in sources[0].columns if c not in key])
    return every.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def first_tag(tags: list[DataFrame], key: str, tag: str, order: list[str]) -> DataFrame:
    """One tag a key: the one that stands first in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(tag))
    return reduce(DataFrame.unionByName, tags).groupBy(key).agg(F.min_by(tag, rank).alias(tag))


def staged_union(screen: DataFrame, rules: DataFrame, recall: DataFrame, key: list[str]) -> DataFrame:
    """final = screen + (rules within (recall - screen)), with a column for each membership. Keys of rules outside recall
    are dropped; the sets are one aggregation of tagged keys, so no side is joined with another."""
    sides = [(screen, "in_screen"), (rules, "in_rules"), (recall, "in_recall")]
    tagged = reduce(DataFrame.unionByName, (df.select(*key, *(F.lit(int(n == name)).alias(n) for _, n in sides)) for df, name in sides))
    held = tagged.groupBy(*key).agg(*(F.max(n).alias(n) for _, n in sides))
    gap = (F.col("in_rules") == 1) & (F.col("in_recall") == 1) & (F.col("in_screen") == 0)
    return held.withColumn("recovered", gap.cast("int")).filter((F.col("in_screen") == 1) | gap)


def first_resolved(candidates: DataFrame, known: DataFrame, key: list[str], rank: str = "rank", name: str = "name", by: str = "method") -> DataFrame:
    """Ordered fallback: for each key of ``candidates`` (key, rank, name, method) the name and method of the least rank
    whose name is in ``known`` (name); keys of which none is known stay, with nulls."""
    met = candidates.join(known.select(F.col(name)).distinct().withColumn("__ok", F.lit(True)), name, "left")
    best = F.min_by(F.struct(name, by), F.when(F.col("__ok"), F.struct(F.col(rank), F.col(name))))
    return met.groupBy(*key).agg(best.alias("__best"), F.max("__ok").alias("__ok")).select(*key, F.when(F.col("__ok"), F.col(f"__best.{name}")).alias(name), F.when(F.col("__ok"), F.col(f"__best.{by}")).alias(by))


def resolvable(rows: DataFrame, known: DataFrame, group: str, key: list[str]) -> DataFrame:
    """Rows whose key is known, and all rows of a group of which nothing is known."""
    held = known.select(group, *key).distinct()
    some = held.select(group).distinct().withColumn("__some", F.lit(1))
    met = rows.join(held.withColumn("__ok", F.lit(1)), [group, *key], "left").join(some, group, "left")
    return met.filter("__ok = 1 or __some is null").select(rows.columns)


def present_in_all(base: DataFrame, sources: list[DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key every source has, the rest): what is assembled, and what is counted as skipped."""
    tagged = reduce(DataFrame.unionByName, (df.select(*key).distinct().withColumn("__src", F.lit(k)) for k, df in enumerate(sources)))
    full = tagged.groupBy(*key).agg(F.count("*").alias("__n")).filter(F.col("__n") == len(sources)).select(*key)
    return base.join(full, key, "left_semi"), base.join(full, key, "left_anti")


def gather_labels(concrete: DataFrame, named: DataFrame, extra: DataFrame, effects: DataFrame, known_negative: DataFrame, known_positive: DataFrame, key: list[str]) -> DataFrame:
    """(key, y): positives are concrete + named + (extra within effects); negatives are (known negatives + what was
    positive and no longer is) - positives. One aggregation of tagged keys, no side joined with another."""
    sides = {"concrete": concrete, "named": named, "extra": extra, "effects": effects, "neg": known_negative, "pos": known_positive}
    tagged = reduce(DataFrame.unionByName, (df.select(*key, *(F.lit(int(n == side)).alias(f"__{n}") for n in sides)) for side, df in sides.items()))
    held = tagged.groupBy(*key).agg(*(F.max(f"__{n}").alias(f"__{n}") for n in sides))
    is_ = lambda n: F.col(f"__{n}") == 1
    y = F.when(is_("concrete") | is_("named") | (is_("extra") & is_("effects")), 1).when(is_("neg") | is_("pos"), 0)
    return held.select(*key, y.alias("y")).filter("y is not null")


def resolve_labels(positives: list[DataFrame], negatives: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys with y: 1 if any positive source has them, else 0 (positives win)."""
    every = reduce(DataFrame.unionByName, [*(df.select(*key, F.lit(1).alias("y")) for df in positives), *(df.select(*key, F.lit(0).alias("y")) for df in negatives)])
    return every.groupBy(*key).agg(F.max("y").alias("y"))


def correct_labels(labels: DataFrame, corrections: DataFrame, overrides: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """Labels after overrides, then corrections (which win), for keys that exist; rows of ``extra`` whose key is absent
    are added. ``source`` says where y comes from."""
    o, c = overrides.select(*key, F.col("y").alias("__o")), corrections.select(*key, F.col("y").alias("__c"))
    known = labels.select(*key, "y").join(o, key, "left").join(c, key, "left")
    source = F.when(F.col("__c").isNotNull(), "correction").when(F.col("__o").isNotNull() & (F.col("__o") != F.col("y")), "override").otherwise("label")
    known = known.select(*key, F.coalesce("__c", "__o", "y").alias("y"), source.alias("source"))
    return known.unionByName(extra.select(*key, "y", F.lit("extra").alias("source")).join(labels.select(*key), key, "left_anti"))


def capped_negatives(labels: DataFrame, stratum: str, key: Column, each: int) -> DataFrame:
    """All positives, and of each stratum's negatives the first ``each`` times max(positives, 1) by sha256 of the key."""
    positives = labels.groupBy(F.col(stratum).alias("__s")).agg(F.sum("y").alias("__p"))
    held = hash_rank(labels, [stratum, "y"], key).drop("__n").join(positives, F.col(stratum).eqNullSafe(F.col("__s")))
    return held.filter((F.col("y") == 1) | (F.col("__k") <= each * F.greatest(F.col("__p"), F.lit(1)))).drop("__p", "__k", "__s")
