"""Queries over label algebra, splits and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import dimensions as D
from strandline.operators import evaluate as E
from strandline.operators import positional as P
from strandline.operators import relational as R
from strandline.plans.carriers import INSN_SQL, LABEL_SQL, insn, labelled
from strandline.plans.registry import query
from strandline.session import table

SETS_SQL = f"""{INSN_SQL}, c as (select fn, count(*) filter (op = 'purchase') as p, count(*) filter (op = 'error') as e, count(*) as n from insn group by fn),
  s as (select fn from c where p >= 10), r as (select fn from c where e >= 9), b as (select fn from c where n >= 60)"""


def _sets(spark, sf_dir):
    c = insn(spark, sf_dir).groupBy("fn").agg(F.count_if(F.col("op") == "purchase").alias("p"), F.count_if(F.col("op") == "error").alias("e"), F.count("*").alias("n"))
    return (c.filter(x).select("fn") for x in ("p >= 10", "e >= 9", "n >= 60"))


@query(
    "staged_union",
    f"""with {SETS_SQL}, f as (select fn from s union select fn from r where fn in (select fn from b) and fn not in (select fn from s))
    select fn, cast(fn in (select fn from s) as integer) as in_screen, cast(fn in (select fn from r) as integer) as in_rules, cast(fn in (select fn from b) as integer) as in_recall, cast(fn not in (select fn from s) as integer) as recovered from f""",
)
def staged_union(spark, sf_dir):
    """The screen, and what rules recover within recall beyond it."""
    screen, rules, recall = _sets(spark, sf_dir)
    return R.staged_union(screen, rules, recall, ["fn"])


@query("intersect_sets", f"with {SETS_SQL} select fn from r intersect select fn from b")
def intersect_sets(spark, sf_dir):
    """Nodes in both of two sets."""
    _, rules, recall = _sets(spark, sf_dir)
    return rules.intersect(recall)


@query("tag_priority_merge", f"with {SETS_SQL}, t as (select fn, 'samefunc' as tag, 0 as k from s union all select fn, 'crossbuf', 1 from r union all select fn, 'fd_arg', 2 from b) select fn, arg_min(tag, k) as tag from t group by fn")
def tag_priority_merge(spark, sf_dir):
    """One tag a function: the first in precedence."""
    tags = [df.withColumn("tag", F.lit(t)) for df, t in zip(_sets(spark, sf_dir), ("samefunc", "crossbuf", "fd_arg"), strict=True)]
    return R.first_tag(tags, "fn", "tag", ["samefunc", "crossbuf", "fd_arg", "fd_table", "fd_queue"])


@query("hash_split_60_20_20", f"""with {LABEL_SQL}, k as (select fn, prog, y, row_number() over (partition by prog, y order by sha256(cast(fn as varchar)), fn) as k, count(*) over (partition by prog, y) as n from lab),
    q as (select *, greatest(1, n * 6 // 10) as a, greatest(1, n * 2 // 10) as b from k), z as (select *, case when a + b >= n then n - 2 else a end as tr, case when a + b >= n then 1 else b end as va from q)
    select fn, prog, y, case when n = 1 then 'train' when n = 2 then (case when k = 1 then 'train' else 'test' end) when k <= tr then 'train' when k <= tr + va then 'validation' else 'test' end as split from z""")
def hash_split_60_20_20(spark, sf_dir):
    """A deterministic split in each program and label, by hash order."""
    return P.proportional_split(labelled(spark, sf_dir).select("fn", "prog", "y"), ["prog", "y"], F.col("fn"))


@query("label_union_pos_wins", f"with {LABEL_SQL}, a as (select fn, 1 as y from lab where y = 1 union all select fn, 1 from lab where h < 500 union all select fn, 0 from lab where quality = 0 union all select fn, 0 from lab where h % 3 = 0) select fn, cast(max(y) as integer) as y from a group by fn")
def label_union_pos_wins(spark, sf_dir):
    """Positive and negative sources united; positives win."""
    lab = labelled(spark, sf_dir)
    return R.resolve_labels([lab.filter("y = 1"), lab.filter("h < 500")], [lab.filter("quality = 0"), lab.filter("h % 3 = 0")], ["fn"])


@query(
    "label_corrections",
    f"""with {LABEL_SQL}, c as (select fn, case when h % 2 = 0 then 1 else 0 end as cy from lab where h % 10 = 4 or h % 10 = 5), o as (select fn, 1 as oy from lab where h % 10 = 3 or h % 10 = 4), x as (select doc_id as fn, 1 as y from documents where doc_id % 50 = 7)
    select lab.fn, cast(coalesce(cy, oy, y) as integer) as y, case when cy is not null then 'correction' when oy is not null and oy <> y then 'override' else 'label' end as source from lab left join c on c.fn = lab.fn left join o on o.fn = lab.fn
    union all select fn, y, 'extra' from x where fn not in (select fn from lab)""",
)
def label_corrections(spark, sf_dir):
    """Corrections over overrides over labels, and rows for keys that were absent."""
    lab = labelled(spark, sf_dir)
    corrections = lab.filter("h % 10 in (4, 5)").select("fn", F.when(F.col("h") % 2 == 0, 1).otherwise(0).alias("y"))
    overrides = lab.filter("h % 10 in (3, 4)").select("fn", F.lit(1).alias("y"))
    extra = table(spark, sf_dir, "documents").filter("doc_id % 50 = 7").select(F.col("doc_id").alias("fn"), F.lit(1).alias("y"))
    return R.correct_labels(lab, corrections, overrides, extra, ["fn"])


@query("negative_sample_4x", f"with {LABEL_SQL}, k as (select fn, prog, y, row_number() over (partition by prog, y order by sha256(cast(fn as varchar)), fn) as k, sum(y) over (partition by prog) as p from lab) select fn, prog, y from k where y = 1 or k <= 4 * greatest(p, 1)")
def negative_sample_4x(spark, sf_dir):
    """At most four negatives for each positive of a program, in hash order."""
    return R.capped_negatives(labelled(spark, sf_dir).select("fn", "prog", "y"), "prog", F.col("fn"), D.NEGATIVES_EACH)


CURVE_SQL = f"""{LABEL_SQL}, g as (select score, sum(y) as p, count(*) as n from lab group by score),
  cur as (select score, sum(p) over w as tp, sum(n) over w - sum(p) over w as fp from g window w as (order by score desc)), cv as (select score, tp, fp, tp / (tp + fp) as precision, tp / (select greatest(sum(y), 1) from lab) as recall from cur)"""


@query("pr_curve", f"with {CURVE_SQL} select score, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(precision, 6) as precision, round(recall, 6) as recall from cv")
def pr_curve(spark, sf_dir):
    """Precision and recall at every distinct score."""
    return E.pr_curve(labelled(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("pr_curve_threshold", f"with {CURVE_SQL} select score, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(precision, 6) as precision, round(recall, 6) as recall, round(least(precision, recall), 6) as balanced from cv order by least(precision, recall) desc, score limit 1")
def pr_curve_threshold(spark, sf_dir):
    """The operating point of the largest min(precision, recall)."""
    return E.operating_threshold(E.pr_curve(labelled(spark, sf_dir))).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "balanced")})


RATIOS = "round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 3) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 3) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 3) as f1, round(case when tp + fp + fn + tn > 0 then (tp + tn) / (tp + fp + fn + tn) else 0.0 end, 3) as accuracy"
COUNTS = "count(*) filter (predicted = 1 and y = 1) as tp, count(*) filter (predicted = 1 and y = 0) as fp, count(*) filter (predicted = 0 and y = 1) as fn, count(*) filter (predicted = 0 and y = 0) as tn"


@query("confusion_metrics", f"with {LABEL_SQL}, p as (select y, cast(score >= 0.5 as integer) as predicted from lab), c as (select {COUNTS} from p) select *, {RATIOS} from c")
def confusion_metrics(spark, sf_dir):
    """The confusion matrix at a threshold and its ratios."""
    return E.confusion(labelled(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


@query(
    "lopo_rollup",
    f"""with {LABEL_SQL}, p as (select prog, y, cast(score >= 0.5 and sum(y) over (partition by prog) > 0 as integer) as predicted from lab),
    c as (select prog, {COUNTS} from p group by prog union all select null, {COUNTS} from p) select *, {RATIOS} from c""",
)
def lopo_rollup(spark, sf_dir):
    """Confusion by held-out program and pooled; programs without a positive are skipped and keep score 0, which still
    counts in the pool."""
    lab = labelled(spark, sf_dir).select("prog", "y", "score")
    some = lab.groupBy("prog").agg(F.max("y").alias("some"))
    scored = lab.join(some, "prog").withColumn("predicted", ((F.col("score") >= 0.5) & (F.col("some") > 0)).cast("int"))
    each = E.confusion(scored, by=["prog"])
    pooled = E.with_ratios(each.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))).withColumn("prog", F.lit(None).cast("string"))
    return each.unionByName(pooled)


@query("stratified_folds", f"with {LABEL_SQL} select fn, y, cast((row_number() over (partition by y order by sha256(cast(fn as varchar)), fn) - 1) % 5 as integer) as fold from lab")
def stratified_folds(spark, sf_dir):
    """Five folds with equal shares of each label."""
    return E.stratified_folds(labelled(spark, sf_dir).select("fn", "y"), "y", "fn")


@query("base_rates", f"with {LABEL_SQL} select prog, cast(count(*) as bigint) as n, cast(sum(y) as bigint) as n_pos, round(avg(y), 6) as rate, round(avg(case when y = 1 then score end), 6) as pos_score from lab group by prog")
def base_rates(spark, sf_dir):
    """Prevalence by program."""
    return labelled(spark, sf_dir).groupBy("prog").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("n_pos"), F.round(F.avg("y"), 6).alias("rate"), F.round(F.avg(F.when(F.col("y") == 1, F.col("score"))), 6).alias("pos_score"))


@query(
    "anti_fp_flags",
    f"""with {INSN_SQL}, c as (select fn, count(*) filter (op = 'signup') as limit_, count(*) filter (op in ('purchase', 'error', 'click')) as real, count(distinct op) as kinds, count(*) filter (imm > 50) as ptr from insn group by fn)
    select fn, cast(limit_ > 0 and real = 0 as integer) as only_limit, cast(kinds >= 5 as integer) as dispatcher, cast(real > 0 and ptr = 0 as integer) as effect_no_ptr from c""",
)
def anti_fp_flags(spark, sf_dir):
    """Derived flags over counts."""
    c = insn(spark, sf_dir).groupBy("fn").agg(F.count_if(F.col("op") == "signup").alias("lim"), F.count_if(F.col("op").isin("purchase", "error", "click")).alias("real"), F.countDistinct("op").alias("kinds"), F.count_if(F.col("imm") > 50).alias("ptr"))
    return c.select("fn", ((F.col("lim") > 0) & (F.col("real") == 0)).cast("int").alias("only_limit"), (F.col("kinds") >= 5).cast("int").alias("dispatcher"), ((F.col("real") > 0) & (F.col("ptr") == 0)).cast("int").alias("effect_no_ptr"))


@query("label_counts", f"with {LABEL_SQL} select prog, cast(y as integer) as y, cast(count(*) as bigint) as n from lab group by grouping sets ((prog), (y), (prog, y), ())")
def label_counts(spark, sf_dir):
    """Counts by program, by label, by both and over all, in one pass."""
    return labelled(spark, sf_dir).cube("prog", "y").agg(F.count("*").alias("n"))
