"""Queries over ordered streams: counts, classes and bounded windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import dimensions as D
from strandline.functions import scalars as S
from strandline.operators import positional as P
from strandline.plans.carriers import INSN_SQL, insn
from strandline.plans.registry import query
from strandline.session import table

ORDER = ["ts", "event_id"]
KINDS = ("view", "signup", "error", "click", "purchase")
#: The stream's symbols as effect categories; click and purchase also read.
CATEGORY = {"signup": "identity", "error": "fault", "click": "act", "purchase": "exec"}
READS = ("click", "purchase", "view")


@query(
    "effect_category_counts",
    f"""with {INSN_SQL}, dim(op, cat) as (values ('signup', 'identity'), ('error', 'fault'), ('click', 'act'), ('purchase', 'exec'))
    select fn, {", ".join(f"cast(count(*) filter (cat = '{c}') as bigint) as eff_{c}" for c in CATEGORY.values())},
      cast(count(*) as bigint) as eff_total, cast(count(distinct cat) as bigint) as eff_ncats
    from insn join dim on insn.op = dim.op group by fn""",
)
def effect_category_counts(spark, sf_dir):
    """Conditional counts by category through a dimension join, their total and how many are not zero."""
    dim = F.broadcast(spark.createDataFrame(list(CATEGORY.items()), "op string, cat string"))
    counts = [F.count_if(F.col("cat") == c).alias(f"eff_{c}") for c in CATEGORY.values()]
    one = insn(spark, sf_dir).select("fn", "op").join(dim, "op").groupBy("fn").agg(*counts, F.count("*").alias("eff_total"))
    return one.withColumn("eff_ncats", sum(((F.col(f"eff_{c}") > 0).cast("bigint") for c in CATEGORY.values()), F.lit(0).cast("bigint")))


@query(
    "dual_category_flag",
    f"""with {INSN_SQL} select fn, cast(count(*) filter (op in ('signup', 'error', 'click', 'purchase')) as bigint) as exclusive,
      cast(count(*) filter (op in {READS}) as bigint) as reads, cast(count(*) filter (op in ('click', 'purchase')) as bigint) as dual,
      cast(max(case when op in {READS} then 1 else 0 end) as integer) as any_read from insn group by fn""",
)
def dual_category_flag(spark, sf_dir):
    """A separate set that overlaps the exclusive categories: a symbol may count in both."""
    one, two = F.col("op").isin(*CATEGORY), F.col("op").isin(*READS)
    return insn(spark, sf_dir).groupBy("fn").agg(F.count_if(one).alias("exclusive"), F.count_if(two).alias("reads"), F.count_if(one & two).alias("dual"), F.max(two.cast("int")).alias("any_read"))


@query("keyword_flags_30", "select doc_id, " + ", ".join(f"cast(contains(lower(coalesce(text, '')), '{k}') as integer) as name_{k}" for k in D.NAME_KEYWORDS) + " from documents")
def keyword_flags_30(spark, sf_dir):
    """Thirty substring flags over lower-cased text, one projection."""
    return table(spark, sf_dir, "documents").select("doc_id", *S.keyword_flags(F.col("text"), D.NAME_KEYWORDS, "name_"))


@query(
    "literal_class_flags",
    """select source, cast(least(count(text), 50) as bigint) as s_count, cast(max(case when contains(text, '/') then 1 else 0 end) as integer) as s_path,
      cast(max(case when regexp_matches(text, '^/(etc|var|tmp|usr|bin|sbin|dev|proc|lib|root)\\b|^/[a-z]+/') then 1 else 0 end) as integer) as s_syspath,
      cast(max(case when regexp_matches(text, '/bin/sh|/bin/bash|(^|/)(sh|bash|dash)$') then 1 else 0 end) as integer) as s_shell,
      cast(max(case when regexp_matches(text, '(?i)uid|gid|user|passwd|shadow|root|group|privile|cred|login|setuid') then 1 else 0 end) as integer) as s_cred,
      cast(max(case when regexp_matches(text, '(?i)cap_|chroot|capab|keepcap') then 1 else 0 end) as integer) as s_cap,
      cast(max(case when contains(text, '%s') or contains(text, '%d') then 1 else 0 end) as integer) as s_fmt from documents group by source""",
)
def literal_class_flags(spark, sf_dir):
    """Existential flags of literal classes and a capped count, for each owner."""
    flags = [F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in S.literal_flags(F.col("text")).items()]
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.least(F.count("text"), F.lit(D.LITERAL_CAP)).cast("bigint").alias("s_count"), *flags)


@query("token_document", "select doc_id, array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z_]{3,}'), 1, 200), ' ') as tokens from documents")
def token_document(spark, sf_dir):
    """The ordered token document of a text, capped at 200 tokens as the feature is."""
    return table(spark, sf_dir, "documents").select("doc_id", S.token_document(F.col("text")).alias("tokens"))


@query(
    "name_shape_hash_buckets",
    """with t as (select p_partkey, p_name, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') as toks from part)
    select p_partkey, cast(length(p_name) as integer) as name_length, cast(len(toks) as integer) as n_tokens,
      cast(length(p_name) - length(replace(p_name, '_', '')) as integer) as n_underscores, cast(regexp_matches(p_name, '[0-9]') as integer) as has_digit,
      list_sort(list_distinct(list_transform(toks, lambda x: cast(cast('0x' || substr(sha256(x), 1, 4) as integer) % 64 as integer)))) as buckets from t""",
)
def name_shape_hash_buckets(spark, sf_dir):
    """Name shape and the hash buckets of its tokens."""
    name = F.col("p_name")
    tokens = F.array_remove(F.split(F.lower(name), "[^a-z0-9]+"), "")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.length(name).alias("name_length"), F.size(tokens).alias("n_tokens"), (F.length(name) - F.length(F.replace(name, F.lit("_"), F.lit("")))).alias("n_underscores"),
        name.rlike("[0-9]").cast("int").alias("has_digit"), F.array_sort(F.array_distinct(F.transform(tokens, lambda t: S.hash_bucket(t)))).alias("buckets"),
    )


@query(
    "immediates_small_pow2",
    f"""with {INSN_SQL} select fn, cast(count(*) filter (imm between -16 and 16) as bigint) as n_small,
      cast(count(*) filter (abs(imm) > 0 and (abs(imm) & (abs(imm) - 1)) = 0) as bigint) as n_pow2, cast(max(case when imm = -1 then 1 else 0 end) as integer) as has_negative_one from insn group by fn""",
)
def immediates_small_pow2(spark, sf_dir):
    """Counts of small and power-of-two constants."""
    imm = F.col("imm")
    return insn(spark, sf_dir).groupBy("fn").agg(F.count_if(S.is_small(imm)).alias("n_small"), F.count_if(S.is_power_of_two(imm)).alias("n_pow2"), F.max(F.coalesce((imm == -1).cast("int"), F.lit(0))).alias("has_negative_one"))


REGION = {"n": "count(*)", "n_calls": "count(*) filter (op = 'click')", "n_jumps": "count(*) filter (op = 'error')", "n_small": "count(*) filter (imm between -16 and 16)", "has_write": "max(case when op = 'purchase' then 1 else 0 end)"}


@query(
    "region_max_two_level",
    f"""with {INSN_SQL}, r as (select fn, cast(ts as date) as region, {", ".join(f"{e} as {n}" for n, e in REGION.items())} from insn group by 1, 2)
    select fn, cast(count(*) as bigint) as num_regions, {", ".join(f"cast(max({n}) as bigint) as region_max_{n}" for n in REGION)} from r group by fn""",
)
def region_max_two_level(spark, sf_dir):
    """Measures of each region, then the maximum of each column by itself over an entity's regions."""
    op, imm = F.col("op"), F.col("imm")
    regions = insn(spark, sf_dir).groupBy("fn", F.col("ts").cast("date").alias("region")).agg(
        F.count("*").alias("n"), F.count_if(op == "click").alias("n_calls"), F.count_if(op == "error").alias("n_jumps"), F.count_if(S.is_small(imm)).alias("n_small"), F.max((op == "purchase").cast("bigint")).alias("has_write")
    )
    return regions.groupBy("fn").agg(F.count("*").alias("num_regions"), *(F.max(n).cast("bigint").alias(f"region_max_{n}") for n in REGION))


@query(
    "mode_first_seen",
    f"""with {INSN_SQL}, c as (select fn, op, count(*) as n, min(seq) as first_seen from insn group by 1, 2)
    select fn, op, cast(n as bigint) as n, cast(first_seen as integer) as first_seen from c qualify row_number() over (partition by fn order by n desc, first_seen) = 1""",
)
def mode_first_seen(spark, sf_dir):
    """The most frequent operation; of ties the one seen first."""
    return P.most_frequent(insn(spark, sf_dir).select("fn", "op", *ORDER), ["fn"], "op", ORDER)


@query(
    "distinct_callers_gate",
    f"""with {INSN_SQL}, g as (select *, max(case when op = 'view' then 1 else 0 end) over w as t, max(case when op = 'error' then 1 else 0 end) over w as j
      from insn window w as (partition by fn order by ts, event_id rows between 1 following and 3 following))
    select prog, imm as callee, cast(count(*) as bigint) as n_calls, cast(count(distinct fn) as bigint) as n_callers,
      cast(max(case when t = 1 and j = 1 then 1 else 0 end) as integer) as gated, cast(count(distinct case when t = 1 and j = 1 then fn end) as bigint) as n_gating
    from g where op = 'click' group by 1, 2""",
)
def distinct_callers_gate(spark, sf_dir):
    """A call is gated if a test and a jump are among the next three rows; by callee, distinct callers and gating ones."""
    ahead = P.over(["fn"], ORDER, 1, 3)
    gate = P.any_within(F.col("op") == "view", ahead) & P.any_within(F.col("op") == "error", ahead)
    calls = insn(spark, sf_dir).select("prog", "fn", "op", "imm", gate.alias("gate")).filter("op = 'click'")
    return calls.groupBy("prog", F.col("imm").alias("callee")).agg(F.count("*").alias("n_calls"), F.countDistinct("fn").alias("n_callers"), F.max(F.col("gate").cast("int")).alias("gated"), F.countDistinct(F.when(F.col("gate"), F.col("fn"))).alias("n_gating"))


@query(
    "spill_then_branch",
    f"""with {INSN_SQL}, s as (select *, lead(imm) over (partition by fn order by seq) as slot, lead(op) over (partition by fn order by seq) as next_op from insn),
    j as (select a.fn, a.seq, a.slot, min(b.seq) as jump from s a join insn b on a.fn = b.fn and b.seq between a.seq + 2 and a.seq + 49 and b.op = 'error'
      where a.op = 'click' and a.next_op = 'view' group by 1, 2, 3)
    select j.fn, cast(count(*) as bigint) as n_spills, cast(count(*) filter (exists (select 1 from insn c where c.fn = j.fn and c.imm = j.slot and c.seq between greatest(j.jump - 3, j.seq + 2) and j.jump)) as bigint) as n_gated
    from j group by j.fn""",
)
def spill_then_branch(spark, sf_dir):
    """A call whose result is kept in a slot (next row), then the first jump 2 to 49 rows on: gated if the jump or up to
    three rows before it, but after the spill, mention the slot. One frame, no join."""
    rows = insn(spark, sf_dir).withColumn("seq", F.row_number().over(P.over(["fn"], ORDER)))
    line = P.over(["fn"], ["seq"])
    frame = F.collect_list(F.struct("seq", "op", "imm")).over(P.over(["fn"], ["seq"], 2, 49))
    spills = rows.select("fn", "seq", "op", F.lead("op").over(line).alias("next_op"), F.lead("imm").over(line).alias("slot"), frame.alias("ahead")).filter("op = 'click' and next_op = 'view'")
    jump = F.array_min(F.transform(F.filter("ahead", lambda r: r["op"] == "error"), lambda r: r["seq"]))
    found = spills.withColumn("jump", jump).filter("jump is not null")
    gated = F.exists("ahead", lambda r: (r["seq"] <= F.col("jump")) & (r["seq"] >= F.col("jump") - 3) & (r["imm"] == F.col("slot")))
    return found.groupBy("fn").agg(F.count("*").alias("n_spills"), F.count_if(gated).alias("n_gated"))


@query(
    "touch_then_call_25",
    f"""with {INSN_SQL}, t as (select *, max(case when op in ('click', 'purchase') then 1 else 0 end) over (partition by fn order by ts, event_id rows between current row and 24 following) as hit from insn)
    select fn, cast(count(*) as bigint) as n_touches, cast(sum(hit) as bigint) as n_written from t where imm = 42 group by fn""",
)
def touch_then_call_25(spark, sf_dir):
    """Touches of an offset that a writing call follows within 25 rows, the touch's own row included."""
    hit = P.any_within(F.col("op").isin("click", "purchase"), P.over(["fn"], ORDER, 0, D.TOUCH_AHEAD - 1))
    return insn(spark, sf_dir).withColumn("hit", hit).filter("imm = 42").groupBy("fn").agg(F.count("*").alias("n_touches"), F.count_if("hit").alias("n_written"))


@query(
    "backward_last_def",
    f"""with {INSN_SQL}, b as (select event_id, fn, op, last_value(case when op = 'view' then imm end ignore nulls) over (partition by fn order by ts, event_id rows between 11 preceding and 1 preceding) as last_def,
      last_value(case when op = 'signup' then imm end ignore nulls) over (partition by fn order by ts, event_id rows between 7 preceding and 1 preceding) as near_def from insn)
    select event_id, last_def, near_def from b where op = 'purchase'""",
)
def backward_last_def(spark, sf_dir):
    """The value of the nearest definition among the rows before, in frames of 11 and 7."""
    far = P.last_defined(F.col("imm"), F.col("op") == "view", P.over(["fn"], ORDER, -D.CONSTANT_BACK, -1))
    near = P.last_defined(F.col("imm"), F.col("op") == "signup", P.over(["fn"], ORDER, -D.SLOT_CALL_BACK, -1))
    return insn(spark, sf_dir).select("event_id", "op", far.alias("last_def"), near.alias("near_def")).filter("op = 'purchase'").drop("op")


@query(
    "first_consumer_6",
    f"""with {INSN_SQL}, f as (select event_id, op, min(case when op = 'view' then seq end) over w - seq as use_at, min(case when op = 'click' then seq end) over w - seq as call_at
      from insn window w as (partition by fn order by seq rows between 1 following and 6 following))
    select event_id, cast(case when call_at is null or use_at < call_at then use_at end as integer) as consumer_at from f where op = 'click'""",
)
def first_consumer_6(spark, sf_dir):
    """How many rows on a call's result is first consumed, within six; null if another call comes first or none does."""
    rows = insn(spark, sf_dir).withColumn("seq", F.row_number().over(P.over(["fn"], ORDER)))
    ahead = P.over(["fn"], ["seq"], 1, 6)
    use, call = (P.nearest_after(F.col("seq"), F.col("op") == k, ahead) - F.col("seq") for k in ("view", "click"))
    found = rows.select("event_id", "op", use.alias("use"), call.alias("call")).filter("op = 'click'")
    return found.select("event_id", F.when(F.col("call").isNull() | (F.col("use") < F.col("call")), F.col("use")).alias("consumer_at"))


@query(
    "last_n_markers",
    f"""with {INSN_SQL}, r as (select *, cast(ts as date) as block, row_number() over (partition by fn, cast(ts as date) order by ts desc, event_id desc) as back from insn)
    select fn, cast(max(case when back <= 8 and imm = 0 then 1 else 0 end) as integer) as has_zero, cast(max(case when back <= 8 and op = 'error' then 1 else 0 end) as integer) as has_error,
      cast(count(*) filter (back <= 8) as bigint) as n_tail from r group by fn""",
)
def last_n_markers(spark, sf_dir):
    """Markers among the last eight rows of each block."""
    back = F.row_number().over(P.over(["fn", "block"], [F.desc("ts"), F.desc("event_id")]))
    rows = insn(spark, sf_dir).withColumn("block", F.col("ts").cast("date")).withColumn("tail", back <= 8)
    return rows.groupBy("fn").agg(F.max((F.col("tail") & (F.coalesce("imm", F.lit(-9)) == 0)).cast("int")).alias("has_zero"), F.max((F.col("tail") & (F.col("op") == "error")).cast("int")).alias("has_error"), F.count_if("tail").alias("n_tail"))


@query(
    "carry_forward_section",
    f"""with {INSN_SQL}, s as (select *, last_value(case when op = 'signup' then event_id end ignore nulls) over (partition by prog order by ts, event_id rows between unbounded preceding and current row) as section from insn)
    select event_id, prog, section, cast(row_number() over (partition by prog, section order by ts, event_id) as integer) as idx from s where op <> 'signup' and section is not null""",
)
def carry_forward_section(spark, sf_dir):
    """Rows with the header that they stand under and their running number there."""
    rows = P.carry_forward(insn(spark, sf_dir).select("prog", "event_id", "ts", "op"), ["prog"], ORDER, F.col("op") == "signup", F.col("event_id"))
    rows = rows.filter("op <> 'signup' and section is not null")
    return rows.select("event_id", "prog", "section", F.row_number().over(P.over(["prog", "section"], ORDER)).alias("idx"))


@query("json_map_explode", f"with {INSN_SQL} select prog, 'k' as feature, cast(count(*) as bigint) as n, cast(sum(imm) as bigint) as total from insn where imm is not null group by 1")
def json_map_explode(spark, sf_dir):
    """A JSON map of features, read as a map, exploded and summed by name."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("prog"), F.explode(F.from_json("props", "map<string,int>")).alias("feature", "v"))
    return rows.filter("v is not null").groupBy("prog", "feature").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
