"""Evaluation of scores against labels by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.positional import hash_rank


def confusion(df: DataFrame, predicted: str = "predicted", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn (bigint) and precision, recall, f1, accuracy to three digits; 0 where a ratio has no ground."""
    hit = lambda p, t: F.count_if((F.col(predicted) == p) & (F.col(y) == t))
    counts = df.groupBy(*(by or [])).agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))
    return with_ratios(counts)


def with_ratios(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 3)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def pr_curve(df: DataFrame, score: str = "score", y: str = "y", buckets: int = 1000) -> DataFrame:
    """(score, tp, fp, precision, recall) at each distinct score (0 to 1) as threshold.

    Counts come first; the running sums are taken within buckets of scores, in parallel, and start from the sums of the
    buckets above, of which there are at most ``buckets`` + 1.
    """
    bucket = F.floor(F.col(score) * buckets)
    at = df.groupBy(score).agg(F.sum(y).alias("p"), F.count("*").alias("n")).withColumn("__b", bucket)
    above = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy("__b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    sums = sums.select("__b", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"))
    down = Window.partitionBy("__b").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    total = df.agg(F.sum(y).alias("t")).first()["t"] or 0
    run = at.join(sums, "__b").select(score, (F.col("p0") + F.sum("p").over(down)).alias("tp"), (F.col("n0") + F.sum("n").over(down)).alias("__n"))
    return run.select(score, "tp", (F.col("__n") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("__n")).alias("precision"), (F.col("tp") / F.lit(float(max(total, 1)))).alias("recall"))


def operating_threshold(curve: DataFrame, score: str = "score") -> DataFrame:
    """The point of the largest min(precision, recall); of ties the lowest threshold."""
    return curve.withColumn("balanced", F.least("precision", "recall")).orderBy(F.desc("balanced"), score).limit(1)


def stratified_folds(df: DataFrame, y: str, key: str, folds: int = 5) -> DataFrame:
    """``fold``: rows of each label dealt in turn in the order of sha256 of the key."""
    ranked = hash_rank(df, [y], F.col(key))
    return ranked.withColumn("fold", ((F.col("__k") - 1) % folds).cast("int")).drop("__k", "__n")


def roc_auc(df: DataFrame, score: str = "score", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc): the share of pairs of a positive and a negative in which the positive scores higher, ties
    counting half; null where there is no pair. Rows are summed up by distinct score first."""
    by = by or []
    at = df.groupBy(*by, score).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    bucket = F.floor(F.col(score) * 1000)
    at = at.withColumn("__b", bucket)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # negatives below: those of the buckets below, of which there are about a thousand, then those within the bucket
    sums = at.groupBy(*by, "__b").agg(F.sum("n").alias("__bn"))
    sums = sums.select(*(F.col(c).alias(f"__s_{c}") for c in by), F.col("__b").alias("__b2"), F.coalesce(F.sum("__bn").over((group if by else Window).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__n0"))
    own = Window.partitionBy(*by, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    met = at.withColumn("__own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(sums, [F.col("__b") == F.col("__b2"), *(F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in by)])
    wins = F.sum(F.col("p") * (F.col("__n0") + F.col("__own") + F.col("n") / 2))
    out = met.groupBy(*by).agg(F.sum("p").cast("bigint").alias("n_pos"), F.sum("n").cast("bigint").alias("n_neg"), wins.alias("__w"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return out.select(*by, "n_pos", "n_neg", F.when(pairs > 0, F.round(F.col("__w") / pairs, 6)).alias("auc"))


def fold_means(df: DataFrame, fold: str, predicted: str = "predicted", y: str = "y") -> DataFrame:
    """(n_folds, precision, recall, f1, accuracy): the means of the measures of each fold."""
    each = confusion(df, predicted, y, [fold])
    return each.agg(F.count("*").alias("n_folds"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def leave_one_group_out(scored: DataFrame, group: str, y: str = "y", score: str = "score") -> DataFrame:
    """Rows with ``score`` 0 where the group has no positive, which such groups keep as they are not scored."""
    some = scored.groupBy(F.col(group).alias("__g")).agg(F.max(y).alias("__some"))
    met = scored.join(some, F.col(group).eqNullSafe(F.col("__g")))
    return met.withColumn(score, F.when(F.col("__some") == 1, F.coalesce(score, F.lit(0.0))).otherwise(0.0)).drop("__g", "__some")


def coverage(final: DataFrame, truth: DataFrame, group: str, key: list[str]) -> DataFrame:
    """(group, n_truth, tp, fn, recovered): how much of the ground truth (group, key) the final set (group, key, recovered)
    holds, and how much of that rules recovered."""
    met = truth.select(group, *key).distinct().join(final.select(group, *key, "recovered", F.lit(1).alias("__in")), [group, *key], "left")
    return met.groupBy(group).agg(F.count("*").alias("n_truth"), F.count("__in").alias("tp"), F.count_if(F.col("__in").isNull()).alias("fn"), F.count_if(F.col("recovered") == 1).alias("recovered"))
