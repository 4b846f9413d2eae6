"""The whole scan of programs: what a model screens, and what rules recover among the functions that it missed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import dimensions as D
from strandline.operators import graph as G
from strandline.operators import kernels
from strandline.operators.measures import KEY
from strandline.operators.relational import staged_union

#: The rules by precedence; a function is an endpoint by the first that finds it.
RULES = ("samefunc", "crossbuf", "fd_arg", "fd_table", "fd_queue")
#: The kernels that these rules come from.
RULE_KERNELS = ("samefunc", "crossbuf", "fd_delegation")


def _among(c: Column, names: str) -> Column:
    return c.isin(*names.split())


def call_edges(insns: DataFrame) -> DataFrame:
    """Distinct (target_id, src, dst) of calls between functions of one target that are no direct reads."""
    known = insns.select("target_id", F.col("function").alias("dst")).distinct()
    calls = insns.filter(F.col("callee").isNotNull() & ~_among(F.col("callee"), D.READ_ACCESS)).select("target_id", F.col("function").alias("src"), F.col("callee").alias("dst")).distinct()
    return calls.join(known, ["target_id", "dst"], "left_semi").select("target_id", "src", "dst")


def recall(insns: DataFrame, hops: int = D.RECALL_HOPS) -> DataFrame:
    """(target_id, function, dist): functions that reach a direct file access by at most ``hops`` calls."""
    node = lambda c: F.to_json(F.struct("target_id", F.col(c).alias("function")))
    seeds = insns.filter(_among(F.col("callee"), D.READ_ACCESS)).select(node("function").alias("node"), F.lit(0).alias("label")).distinct()
    found = G.reach(call_edges(insns).select(node("src").alias("src"), node("dst").alias("dst")), seeds, most=hops)
    return found.select(F.from_json("node", "target_id string, function string").alias("k"), "dist").select("k.*", "dist")


def endpoints(insns: DataFrame) -> DataFrame:
    """(target_id, function, tag): functions that a rule finds, by the rule of the highest precedence."""
    found = kernels.run_kernels(insns, RULE_KERNELS).filter(F.col("tag").isin(*RULES))
    rank = F.array_position(F.array(*map(F.lit, RULES)), F.col("tag"))
    return found.groupBy(*KEY).agg(F.min_by("tag", rank).alias("tag"))


def integrated(insns: DataFrame, screened: DataFrame) -> DataFrame:
    """(target_id, function, in_screen, in_rules, in_recall, recovered, tag) of the final set: what the model screened
    (target_id, function), and the endpoints of rules within recall that it did not. Programs without screened rows keep
    their endpoints; endpoints outside recall are dropped."""
    rules = endpoints(insns)
    final = staged_union(screened.select(*KEY).distinct(), rules, recall(insns), KEY)
    tags = rules.select(*KEY, "tag")
    return final.join(tags, KEY, "left").withColumn("tag", F.when(F.col("recovered") == 1, F.col("tag")))


def stage_counts(insns: DataFrame, screened: DataFrame, final: DataFrame, truth: DataFrame) -> DataFrame:
    """(target_id, n_screen, n_recall, n_candidates, n_rules, n_final, n_truth, tp, fn, recovered_truth) for each program
    that has instructions."""
    inside, outside = recall(insns).select(*KEY), screened.select(*KEY).distinct()
    count = lambda df, name: df.groupBy("target_id").agg(F.count("*").alias(name))
    met = truth.select(*KEY).distinct().join(final.select(*KEY, "recovered", F.lit(1).alias("hit")), KEY, "left")
    covered = met.groupBy("target_id").agg(F.count("*").alias("n_truth"), F.count("hit").alias("tp"), F.count_if(F.col("hit").isNull()).alias("fn"), F.count_if(F.col("recovered") == 1).alias("recovered_truth"))
    parts = [count(outside, "n_screen"), count(inside, "n_recall"), count(inside.join(outside, KEY, "left_anti"), "n_candidates"), count(final.filter("recovered = 1"), "n_rules"), count(final, "n_final"), covered]
    wide = reduce(lambda a, b: a.join(b, "target_id", "left"), parts, insns.select("target_id").distinct())
    return wide.select("target_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in wide.columns if c != "target_id"))
