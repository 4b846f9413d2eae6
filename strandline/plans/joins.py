"""Queries over joins: defaults, semi and anti, ranges, scored matches, precedence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import relational as R
from strandline.plans.carriers import EDGE_SQL, INSN_SQL, LABEL_SQL, edges, insn, labelled
from strandline.plans.registry import query
from strandline.session import table


@query(
    "default_fill_join",
    """select c_custkey, cast(coalesce(n_orders, 0) as bigint) as n_orders, coalesce(total, 0.0) as total, cast(coalesce(last_status, 99) as integer) as last_status
    from customer left join (select o_custkey, count(*) as n_orders, round(sum(o_totalprice), 2) as total, max(case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end) as last_status from orders group by 1) on o_custkey = c_custkey""",
)
def default_fill_join(spark, sf_dir):
    """Features joined onto a base; missing ones get their default, which is 0 but for a distance-like column."""
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    feats = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max(status).alias("last_status"))
    return R.default_fill(table(spark, sf_dir, "customer").select("c_custkey"), feats, ["c_custkey"], {"n_orders": 0, "total": 0.0, "last_status": 99})


@query("intra_edge_semi", f"with {EDGE_SQL} select src, dst from edge where dst in (select s_suppkey from supplier where s_acctbal > 0)")
def intra_edge_semi(spark, sf_dir):
    """Edges into known nodes only."""
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"))
    return edges(spark, sf_dir).join(known, "dst", "left_semi").select("src", "dst")


@query("negatives_anti", f"with {LABEL_SQL} select fn, prog from lab where y = 0 and fn not in (select fn from lab where quality = 1)")
def negatives_anti(spark, sf_dir):
    """Negatives without those that a positive source claims."""
    lab = labelled(spark, sf_dir)
    return lab.filter("y = 0").select("fn", "prog").join(lab.filter("quality = 1").select("fn"), "fn", "left_anti")


@query("resolvable_filter", f"with {LABEL_SQL} select fn, prog from lab where fn in (select fn from lab where quality = 1 and prog <> 'es') or prog not in (select prog from lab where quality = 1 and prog <> 'es')")
def resolvable_filter(spark, sf_dir):
    """Names are kept if they resolve; a program without any resolvable name keeps all of its names."""
    lab = labelled(spark, sf_dir)
    return R.resolvable(lab.select("fn", "prog"), lab.filter("quality = 1 and prog <> 'es'").select("fn", "prog"), "prog", ["fn"])


BANDS = [(0, "low", 0.0, 20000.0), (1, "mid", 15000.0, 45000.0), (2, "high", 45000.0, 70000.0), (3, "void", 80000.0, 80000.0)]


@query(
    "section_range_join",
    f"""with band(ord, name, lo, hi) as (values {", ".join(map(str, BANDS))}), p as (select distinct l_extendedprice as price from lineitem),
    m as (select price, ord, name, row_number() over (partition by price order by ord) as r from p join band on price >= lo and price < hi)
    select cast(ord as integer) as ord, name, cast(count(*) as bigint) as n, cast(sum(cast(round(price * 100) as bigint)) as bigint) as cents from m where r = 1 group by 1, 2""",
)
def section_range_join(spark, sf_dir):
    """Addresses in half-open sections; of overlapping sections the first counts, empty ones hold nothing."""
    bands = spark.createDataFrame(BANDS, "ord int, name string, lo double, hi double")
    points = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price")).distinct()
    met = R.range_lookup(points, F.broadcast(bands), "price", "lo", "hi", "ord", width=10000)
    return met.groupBy("ord", "name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("cents"))


#: Struct members: (struct, member, offset, size, type); ``conn`` holds ``buf`` at 16, ``srv`` holds ``conn`` at 32.
MEMBERS = [("buf", "data", 0, 16, None), ("buf", "len", 16, 8, None), ("conn", "fd", 0, 8, None), ("conn", "io", 16, 24, "buf"), ("srv", "id", 0, 8, None), ("srv", "c", 32, 40, "conn")]


@query(
    "nested_offset_resolution",
    f"""with recursive m(s, name, off, size, type) as (values {", ".join(str(x).replace("None", "null") for x in MEMBERS)}),
    flat(root, s, path, off, size, type, depth) as (select s, s, name, off, size, type, 0 from m union all select f.root, m.s, f.path || '.' || m.name, f.off + m.off, m.size, m.type, depth + 1 from flat f join m on f.type = m.s where depth < 4),
    probe as (select distinct l_linenumber * 8 as pos from lineitem where l_linenumber < 9)
    select cast(pos as integer) as pos, root, path, cast(off as integer) as off from flat join probe on pos >= off and pos < off + size where type is null""",
)
def nested_offset_resolution(spark, sf_dir):
    """Byte offsets resolved to leaf members through embedded structs: the tree is flattened by bounded self-joins, then
    one range condition."""
    m = F.broadcast(spark.createDataFrame(MEMBERS, "s string, name string, off int, size int, type string"))
    level = m.select(F.col("s").alias("root"), F.col("name").alias("path"), "off", "size", "type")
    flat = level
    for _ in range(4):
        inner = m.select(F.col("s").alias("type"), F.col("name").alias("n2"), F.col("off").alias("o2"), F.col("size").alias("s2"), F.col("type").alias("t2"))
        level = level.join(inner, "type").select("root", F.concat("path", F.lit("."), "n2").alias("path"), (F.col("off") + F.col("o2")).alias("off"), F.col("s2").alias("size"), F.col("t2").alias("type"))
        flat = flat.unionByName(level)
    probes = table(spark, sf_dir, "lineitem").filter("l_linenumber < 9").select((F.col("l_linenumber") * 8).alias("pos")).distinct()
    leaves = flat.filter("type is null")
    return probes.join(F.broadcast(leaves), (F.col("pos") >= F.col("off")) & (F.col("pos") < F.col("off") + F.col("size"))).select("pos", "root", "path", "off")


@query(
    "scored_match_top8",
    """with s as (select n_nationkey as cand, c_custkey as goal, (case when c_acctbal > 5000 then 5 else 0 end) + (case when c_mktsegment = 'BUILDING' then 3 else 0 end) + (case when c_custkey % 7 = n_nationkey % 7 then 4 else 0 end) as score
      from nation join customer on c_nationkey = n_nationkey),
    r as (select *, row_number() over (partition by cand order by score desc, cast(goal as varchar)) as k, max(score) over (partition by cand) as best from s where score > 0)
    select cand, goal, cast(score as integer) as score, cast(k as integer) as k, case when best >= 7 then 'strong' when best >= 4 then 'fair' else 'weak' end as status from r where k <= 8""",
)
def scored_match_top8(spark, sf_dir):
    """Candidates scored against the goals of their program, the eight best each, and a status by the best."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cand"))
    goals = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cand"), F.col("c_custkey").alias("goal"), "c_acctbal", "c_mktsegment")
    gain = lambda c, n: F.when(c, n).otherwise(0)
    score = gain(F.col("c_acctbal") > 5000, 5) + gain(F.col("c_mktsegment") == "BUILDING", 3) + gain(F.col("goal") % 7 == F.col("cand") % 7, 4)
    met = goals.join(nation, "cand").withColumn("score", score).filter("score > 0")
    k = F.row_number().over(Window.partitionBy("cand").orderBy(F.desc("score"), F.col("goal").cast("string")))
    best = F.max("score").over(Window.partitionBy("cand"))
    status = F.when(best >= 7, "strong").when(best >= 4, "fair").otherwise("weak")
    return met.select("cand", "goal", "score", k.alias("k"), status.alias("status")).filter("k <= 8")


@query(
    "precedence_resolution",
    """with u as (select s_nationkey as key, s_suppkey as id, 0 as precedence from supplier where s_acctbal > 5000 union all select s_nationkey, s_suppkey, 1 from supplier where s_acctbal <= 5000)
    select key, id, cast(precedence as integer) as precedence from u qualify row_number() over (partition by key order by precedence, id) = 1""",
)
def precedence_resolution(spark, sf_dir):
    """Primary before auxiliary source; a key keeps the first row."""
    s = table(spark, sf_dir, "supplier")
    side = lambda cond: s.filter(cond).select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id"))
    return R.by_precedence([side("s_acctbal > 5000"), side("s_acctbal <= 5000")], ["key"])


@query(
    "point_join_mode",
    f"""with {INSN_SQL}, a as (select distinct imm as pc, first_value(op) over (partition by imm order by event_id desc) as file from insn where op <> 'view'),
    c as (select i.fn, a.file, count(*) as n, min(i.seq) as first_seen from insn i join a on a.pc = i.imm group by 1, 2)
    select fn, file, cast(n as bigint) as n from c qualify row_number() over (partition by fn order by n desc, first_seen) = 1""",
)
def point_join_mode(spark, sf_dir):
    """Addresses joined to files (the last line written for an address wins), then each function's most common file."""
    rows = insn(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("fn").orderBy("ts", "event_id")))
    files = rows.filter("op <> 'view'").groupBy("imm").agg(F.max_by("op", "event_id").alias("file"))
    counted = rows.join(files, "imm").groupBy("fn", "file").agg(F.count("*").alias("n"), F.min("seq").alias("first_seen"))
    best = F.row_number().over(Window.partitionBy("fn").orderBy(F.desc("n"), "first_seen"))
    return counted.withColumn("r", best).filter("r = 1").select("fn", "file", "n")


@query(
    "computed_key_join",
    f"""with {INSN_SQL}, reg as (select distinct fn, imm as g, cast(value as integer) % 4 as off from insn where op = 'signup'), res as (select distinct fn, imm as g, cast(value as integer) % 4 as off from insn where op = 'error')
    select g, off, cast(count(distinct reg.fn) as bigint) as n_registrars, cast(count(distinct res.fn) as bigint) as n_resolvers from reg join res using (g, off) where g < 50 group by 1, 2""".replace("cast(value as integer)", "cast(floor(value) as integer)"),
)
def computed_key_join(spark, sf_dir):
    """Registrars and resolvers that meet on (global, offset): each side counted by key first, so a hot key pairs once."""
    rows = insn(spark, sf_dir).filter("imm < 50").select("fn", "op", F.col("imm").alias("g"), (F.floor("value").cast("int") % 4).alias("off"))
    side = lambda op, name: rows.filter(F.col("op") == op).groupBy("g", "off").agg(F.countDistinct("fn").alias(name))
    return side("signup", "n_registrars").join(side("error", "n_resolvers"), ["g", "off"])


KINDS = {"view": ["open_like"], "click": ["call_like", "open_like"], "purchase": ["modify_like", "call_like"], "error": ["output_like"]}


@query(
    "category_one_hot",
    f"""with {INSN_SQL}, k(op, cat) as (values {", ".join(f"('{o}', '{c}')" for o, cs in KINDS.items() for c in cs)})
    select fn, {", ".join(f"cast(max(case when cat = '{c}' then 1 else 0 end) as integer) as {c}" for c in ("open_like", "call_like", "modify_like", "output_like"))} from insn join k using (op) group by fn""",
)
def category_one_hot(spark, sf_dir):
    """Kinds expanded to categories, then one column for each category."""
    dim = F.broadcast(spark.createDataFrame([(o, cs) for o, cs in KINDS.items()], "op string, cats array<string>"))
    hot = [F.max(F.array_contains("cats", c).cast("int")).alias(c) for c in ("open_like", "call_like", "modify_like", "output_like")]
    return insn(spark, sf_dir).join(dim, "op").groupBy("fn").agg(*hot)


@query(
    "path_and_slug",
    """select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_')[1:48] as slug, ends_with(replace(replace(p_type, chr(92), '/'), '/./', '/'), 'STEEL') as suffix from part""",
)
def path_and_slug(spark, sf_dir):
    """Slugs of names and a path-suffix test."""
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"), S.ends_with_path(F.col("p_type"), F.lit("STEEL")).alias("suffix"))
