"""Queries over names, hints, types, literals, features and labels: how artifacts are resolved to one row a function."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import dimensions as D
from strandline.functions import scalars as S
from strandline.operators import evaluate as E
from strandline.operators import features as X
from strandline.operators import graph as G
from strandline.operators import measures as M
from strandline.operators import relational as R
from strandline.plans.carriers import INSN_SQL, LABEL_SQL, insn, labelled
from strandline.plans.registry import query
from strandline.session import table

# --- hints and names -------------------------------------------------------------------------------------------------


@query(
    "place_hints",
    r"""with t as (select s_suppkey, unnest(string_split('`src/m' || s_suppkey || '.c:' || s_suppkey || '-' || (s_suppkey + 5) || '`, stage 2,inc/x.h, a.c:' || s_nationkey || ',external libc/glibc', ',')) as item from supplier),
    i as (select s_suppkey, regexp_replace(trim(item), '^`+|`+$', '', 'g') as x from t)
    select s_suppkey, case when regexp_matches(x, '^[^:]+:\d+(-\d+)?$') then string_split(x, ':')[1] else x end as file_hint,
      try_cast(regexp_extract(x, '^[^:]+:(\d+)(-\d+)?$', 1) as integer) as line_start,
      coalesce(try_cast(regexp_extract(x, '^[^:]+:\d+-(\d+)$', 1) as integer), try_cast(regexp_extract(x, '^[^:]+:(\d+)$', 1) as integer)) as line_end
    from i where x <> '' and x <> 'external libc/glibc' and not starts_with(x, 'stage ')""",
)
def place_hints(spark, sf_dir):
    """A comma list of places as rows of file and lines."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(F.lit("`src/m"), key, F.lit(".c:"), key, F.lit("-"), (F.col("s_suppkey") + 5).cast("string"), F.lit("`, stage 2,inc/x.h, a.c:"), nation, F.lit(",external libc/glibc"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(S.place_hints(text)).alias("p")).select("s_suppkey", "p.*")


HINTED = "'see `fn_' || s_suppkey || '(x) -> run_' || s_nationkey || '`, `SITE`, `a/b` and `\"q' || s_nationkey || '\"` or ngx_h' || s_suppkey || ' but not ngx'"


@query(
    "symbol_hints",
    f"""with t as (select s_suppkey, s_nationkey, {HINTED} as text from supplier)
    select s_suppkey, list_sort(list_distinct(['SITE', 'a/b', 'fn_' || s_suppkey, 'fn_' || s_suppkey || '(x)', 'run_' || s_nationkey, 'ngx_h' || s_suppkey])) as hints,
      ['fn_' || s_suppkey, 'q' || s_nationkey] as quoted from t where contains(text, 'ngx_')""",
)
def symbol_hints(spark, sf_dir):
    """Symbols that a text hints at, and those that stand in backticks."""
    text = F.expr(HINTED)
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.symbol_hints(text).alias("hints"), S.quoted_symbols(text).alias("quoted"))


@query(
    "name_tokens",
    r"""with t as (select p_partkey, 'get' || upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '_') || 'ID' || p_size as name from part)
    select p_partkey, list_filter(string_split_regex(lower(trim(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' +'), lambda x: x <> '') as tokens from t""",
)
def name_tokens(spark, sf_dir):
    """Words of mixed camel- and snake-case names."""
    name = F.concat(F.lit("get"), F.upper(F.substring("p_name", 1, 1)), F.replace(F.expr("substring(p_name, 2)"), F.lit(" "), F.lit("_")), F.lit("ID"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", S.name_tokens(name).alias("tokens"))


NAMES = ("check_auth", "auth_log", "verify_pass", "access_free", "principal_of", "loop", "passwd_cache", "unlink_cleanup")


@query(
    "name_pattern_gate",
    f"""with {INSN_SQL}, s as (select ({list(NAMES)})[fn % {len(NAMES)} + 1] || '_' || fn as function, cast(fn % 7 as varchar) as target_id, count(*) as n from insn group by fn)
    select target_id, function from s where n >= 8 and regexp_matches(function, '{D.AUTHZ}') and not regexp_matches(function, '{D.BOOKKEEPING}')""",
)
def name_pattern_gate(spark, sf_dir):
    """Functions of at least eight rows whose name is of a decision and not of its bookkeeping."""
    name = F.concat(F.get(F.array(*map(F.lit, NAMES)), (F.col("fn") % len(NAMES)).cast("int")), F.lit("_"), F.col("fn"))
    sizes = insn(spark, sf_dir).groupBy("fn").agg(F.count("*").alias("n_instructions"))
    return X.named_deciders(sizes.select((F.col("fn") % 7).cast("string").alias("target_id"), name.alias("function"), "n_instructions"))


@query(
    "ordered_fallback",
    """with c as (select p_partkey, unnest(string_split(p_name, ' ')) as name, generate_subscripts(string_split(p_name, ' '), 1) as rank from part),
    k as (select distinct string_split(p_name, ' ')[1] as name from part where p_partkey % 10 = 0),
    m as (select c.*, row_number() over (partition by p_partkey order by rank, c.name) as r from c join k on c.name = k.name)
    select p.p_partkey, m.name, case when m.name is not null then 'word_' || m.rank end as method from part p left join m on p.p_partkey = m.p_partkey and m.r = 1""",
)
def ordered_fallback(spark, sf_dir):
    """The first of several candidate names that is known, with how it was found; unresolved keys stay."""
    words = F.split("p_name", " ")
    parts = table(spark, sf_dir, "part")
    candidates = parts.select("p_partkey", F.posexplode(words).alias("k", "name")).select("p_partkey", "name", (F.col("k") + 1).alias("rank"), F.concat(F.lit("word_"), F.col("k") + 1).alias("method"))
    known = parts.filter("p_partkey % 10 = 0").select(F.get(words, F.lit(0)).alias("name"))
    return R.first_resolved(candidates, known, ["p_partkey"])


@query(
    "type_chain_10",
    """with recursive t as (select p_partkey as id, (p_partkey * 7 + 3) % 199 + 1 as nxt, case when p_size % 9 = 0 then p_name end as own from part),
    w(type_id, here, step, own) as (select id, id, 1, own from t where id % 5 = 0 union all select w.type_id, b.id, step + 1, b.own from w join t a on a.id = w.here join t b on b.id = a.nxt where w.own is null and step < 10)
    select type_id, own as type_name from w where own is not null""",
)
def type_chain_10(spark, sf_dir):
    """The first name along a chain of references, within ten steps."""
    tag = F.when(F.col("p_size") % 9 == 0, "typedef").otherwise("pointer")
    tree = table(spark, sf_dir, "part").select(F.lit("p").alias("target_id"), F.col("p_partkey").alias("id"), tag.alias("tag"), F.col("p_name").alias("name"), ((F.col("p_partkey") * 7 + 3) % 199 + 1).alias("type_id"))
    return X.type_names(tree, tree.filter("id % 5 = 0").select("target_id", F.col("id").alias("type_id"))).select("type_id", "type_name")


# --- bytes and numbers -----------------------------------------------------------------------------------------------


@query("literal_of_immediate", "select p_partkey, substr(p_name, 1, 7) as literal from part where regexp_full_match(substr(p_name, 1, 7), '[\\x20-\\x7e]{3,}')")
def literal_of_immediate(spark, sf_dir):
    """Text that stands in an instruction as a little-endian number."""
    digits = F.lower(F.hex(F.reverse(F.substring("p_name", 1, 7))))
    code = table(spark, sf_dir, "part").select(F.lit("p").alias("target_id"), F.col("p_partkey").cast("string").alias("function"), F.col("p_partkey").alias("seq"), F.concat(F.lit("movabs rax,0x"), digits).alias("instruction"))
    return X.literals_by_immediate(code).select(F.col("seq").alias("p_partkey"), "literal")


@query("terminated_read", "select p_partkey, case when length(p_name) >= 3 and regexp_full_match(p_name, '[\\x20-\\x7e]+') and p_size % 3 <> 0 then p_name end as literal from part")
def terminated_read(spark, sf_dir):
    """The printable text before the first NUL; none without a NUL."""
    raw = F.when(F.col("p_size") % 3 != 0, F.concat(F.col("p_name").cast("binary"), F.lit(b"\0rest"))).otherwise(F.col("p_name").cast("binary"))
    return table(spark, sf_dir, "part").select("p_partkey", X.terminated(raw).alias("literal"))


@query(
    "signed_immediates",
    f"""with {INSN_SQL} select event_id, list_filter([cast(imm as decimal(20, 0)), cast(-imm as decimal(20, 0)), cast(imm + 16 as decimal(20, 0))], lambda x: x is not null) as found from insn where imm is not null""",
)
def signed_immediates(spark, sf_dir):
    """Decimal, negative and hexadecimal numbers of an operand text, registers left out."""
    imm = F.col("imm")
    text = F.concat(F.lit("mov r12,"), imm, F.lit(" -"), imm, F.lit(" 0x"), F.lower(F.hex(imm + 16)))
    return insn(spark, sf_dir).filter("imm is not null").select("event_id", S.immediates(text).alias("found"))


#: What each event stands for as an instruction: opcode, operands, and its memory reads and writes, stack writes,
#: rip-relative, argument-based and scaled accesses, calls, indirect calls, power-of-two constants.
CODE = {
    "view": ("lea", ["rsi", "[rdx+rcx*4]"], (0, 0, 0, 0, 1, 1, 0, 0, 1)),
    "signup": ("call", ["rax"], (0, 0, 0, 0, 0, 0, 1, 1, 0)),
    "error": ("mov", ["QWORD PTR [rip+0x10]", "rax"], (0, 1, 0, 1, 0, 0, 0, 0, 1)),
    "click": ("add", ["DWORD PTR [rbp-0x18]", "0x10"], (1, 1, 1, 0, 0, 0, 0, 0, 1)),
    "purchase": ("push", ["QWORD PTR [rdi+0xfff]"], (1, 0, 0, 0, 1, 0, 0, 0, 0)),
}
COUNTED = ("mem_reads", "mem_writes", "stack_writes", "rip_relative_accesses", "arg_based_mem_accesses", "scaled_index_memory_accesses", "calls", "indirect_calls", "power2_constants")


@query(
    "function_measures",
    f"with {INSN_SQL} select fn, cast(count(*) as bigint) as num_instructions, "
    + ", ".join(f"cast(sum(case op {' '.join(f"when '{op}' then {v[2][k]}" for op, v in CODE.items())} end) as bigint) as num_{c}" for k, c in enumerate(COUNTED))
    + ", cast(max(case when op = 'purchase' then 1 else 0 end) as bigint) as has_page_constant_0xfff from insn group by fn",
)
def function_measures(spark, sf_dir):
    """Sums of operand and opcode tests over a function's instructions, in one aggregation."""
    op = F.col("op")
    text = lambda k: F.create_map(*(F.lit(x) for o, v in CODE.items() for x in (o, k(v))))[op]
    code = insn(spark, sf_dir).select("fn", text(lambda v: v[0]).alias("opcode"), F.split(text(lambda v: "|".join(v[1])), r"\|").alias("operands"), text(lambda v: f"{v[0]} {','.join(v[1])}").alias("asm"), F.lit("").alias("kind"), F.lit(None).cast("string").alias("target"))
    sums = [F.sum(c).cast("bigint").alias(f"num_{c}") for c in COUNTED]
    return M.measured(code).groupBy("fn").agg(F.count("*").alias("num_instructions"), *sums, F.max("page_constant_0xfff").cast("bigint").alias("has_page_constant_0xfff"))


# --- feature groups --------------------------------------------------------------------------------------------------

SYMBOLS = ("setuid", "open", "read", "execve", "mount", "chroot", "getpid", "fread", "unlink", "setrlimit", "openat", "strcmp")
_IN = lambda names: ", ".join(f"'{s}'" for s in SYMBOLS if s in names.split())


@query(
    "effect_symbols",
    f"with {INSN_SQL}, s as (select fn, ({list(SYMBOLS)})[imm % {len(SYMBOLS)} + 1] as sym from insn where op = 'click' and imm is not null), c as (select fn, "
    + ", ".join(f"cast(count(*) filter (sym in ({_IN(D.EFFECTS[c]) or 'null'})) as bigint) as eff_{c}" for c in X.CATEGORIES)
    + f", cast(count(*) filter (sym in ({_IN(D.FILE_READ)})) as bigint) as eff_file_read from s group by fn) select *, "
    + " + ".join(f"eff_{c}" for c in X.CATEGORIES)
    + " as eff_total, cast("
    + " + ".join(f"(case when eff_{c} > 0 then 1 else 0 end)" for c in X.CATEGORIES)
    + " as bigint) as eff_ncats from c where "
    + " + ".join(f"eff_{c}" for c in (*X.CATEGORIES, "file_read"))
    + " > 0",
)
def effect_symbols(spark, sf_dir):
    """Calls of real symbols counted by effect, file reads apart, as a symbol may be in both."""
    callee = F.get(F.array(*map(F.lit, SYMBOLS)), (F.col("imm") % len(SYMBOLS)).cast("int"))
    calls = insn(spark, sf_dir).filter("op = 'click' and imm is not null").select(F.lit("p").alias("target_id"), F.col("fn").alias("function"), callee.alias("callee"))
    return X.effect_features(calls).drop("target_id").withColumnRenamed("function", "fn")


@query(
    "reach_effects",
    f"""with recursive i as (select s_suppkey as fn, ({list(SYMBOLS)})[s_suppkey % {len(SYMBOLS)} + 1] as sym from supplier where s_acctbal > 7000),
    dim as ({" union all ".join(f"select '{s}' as sym, '{c}' as cat" for c, names in ((*((c, D.EFFECTS[c]) for c in X.CATEGORIES), ("file_read", D.FILE_READ))) for s in names.split() if s in SYMBOLS)}),
    seed as (select distinct fn, cat from i join dim on i.sym = dim.sym),
    edge as (select distinct s_suppkey as src, (s_suppkey * 13 + 5) % 97 + 1 as dst from supplier where s_suppkey % 3 <> 0),
    r(fn, cat, dist) as (select fn, cat, 0 from seed union select edge.src, r.cat, r.dist + 1 from r join edge on edge.dst = r.fn where r.dist < 60),
    best as (select fn, cat, min(dist) as dist from r group by 1, 2)
    select fn, {", ".join(f"cast(max(case when cat = '{c}' then 1 else 0 end) as bigint) as reach_{c}" for c in (*X.CATEGORIES, "file_read"))},
      cast(count(*) as bigint) as reach_ncats, cast(min(dist) as bigint) as reach_dist,
      cast((select count(*) from edge e where e.src = best.fn and e.dst in (select fn from best)) as bigint) as reach_neff_callees, cast(1 as bigint) as reach_any from best group by fn""",
)
def reach_effects(spark, sf_dir):
    """Which effects calls lead to, how far the nearest is, and how many callees reach one."""
    s = table(spark, sf_dir, "supplier")
    name = lambda c: c.cast("string")
    callee = F.get(F.array(*map(F.lit, SYMBOLS)), (F.col("s_suppkey") % len(SYMBOLS)).cast("int"))
    code = s.filter("s_acctbal > 7000").select(F.lit("p").alias("target_id"), name(F.col("s_suppkey")).alias("function"), callee.alias("callee"))
    edges = s.filter("s_suppkey % 3 <> 0").select(F.lit("p").alias("target_id"), name(F.col("s_suppkey")).alias("src"), name((F.col("s_suppkey") * 13 + 5) % 97 + 1).alias("dst"))
    found = X.reach_features(code, edges)
    return found.select(F.col("function").cast(s.schema["s_suppkey"].dataType).alias("fn"), *(c for c in found.columns if c.startswith("reach_")))


def _keyword(words: list[str], key: str) -> str:
    return f"({list(words)})[{key} % {len(words)} + 1]"


@query(
    "debug_keyword_flags",
    f"""with t as (select p_partkey, lower('src/' || {_keyword(D.FILE_KEYWORDS, "p_partkey")} || '.c') as file, lower({_keyword(D.PARAM_KEYWORDS, "p_size")} || '_a ' || {_keyword(D.PARAM_KEYWORDS, "p_partkey")}) as pn,
      lower('char * ' || {_keyword(D.PARAM_TYPE_KEYWORDS, "p_size")}) as pt from part)
    select cast(p_partkey as varchar) as function, {", ".join(f"cast(contains(file, '{k}') as integer) as file_{k}" for k in D.FILE_KEYWORDS)}, {", ".join(f"cast(contains(pn, '{k}') as integer) as pname_{k}" for k in D.PARAM_KEYWORDS)},
      {", ".join(f"cast(contains(pt, '{k}') as integer) as ptype_{k}" for k in D.PARAM_TYPE_KEYWORDS)}, 1 as n_str_param from t""",
)
def debug_keyword_flags(spark, sf_dir):
    """Substring flags of source files, parameter names and types, and string parameters."""
    word = lambda words, key: F.get(F.array(*map(F.lit, words)), (F.col(key) % len(words)).cast("int"))
    kind = "array<struct<name:string,type:string,is_pointer:boolean>>"
    first = F.struct(F.concat(word(D.PARAM_KEYWORDS, "p_size"), F.lit("_a")).alias("name"), F.lit("char *").alias("type"), F.lit(True).alias("is_pointer"))
    second = F.struct(word(D.PARAM_KEYWORDS, "p_partkey").alias("name"), word(D.PARAM_TYPE_KEYWORDS, "p_size").alias("type"), F.lit(False).alias("is_pointer"))
    parts = table(spark, sf_dir, "part").withColumns({"target_id": F.lit("p"), "function": F.col("p_partkey").cast("string")})
    params = parts.select("target_id", "function", F.array(first, second).cast(kind).alias("params"))
    files = parts.select("target_id", "function", F.concat(F.lit("src/"), word(D.FILE_KEYWORDS, "p_partkey"), F.lit(".c")).alias("file"))
    return X.debug_features(params, files).drop("target_id")


@query(
    "local_type_flags",
    f"""with t as (select p_brand, lower({_keyword(D.LOCAL_KEYWORDS, "p_partkey")} || '_x') as name, lower({_keyword(D.TYPE_KEYWORDS, "p_size")}) as type from part where p_partkey % 4 = 0)
    select p_brand as function, {", ".join(f"cast(max(case when contains(name, '{k}') then 1 else 0 end) as integer) as lv_{k}" for k in D.LOCAL_KEYWORDS)}, {", ".join(f"cast(max(case when contains(type, '{k}') then 1 else 0 end) as integer) as ty_{k}" for k in D.TYPE_KEYWORDS)}
    from t group by p_brand""",
)
def local_type_flags(spark, sf_dir):
    """Substring flags of a function's variables and of the types that their references lead to."""
    word = lambda words, key: F.get(F.array(*map(F.lit, words)), (F.col(key) % len(words)).cast("int"))
    parts = table(spark, sf_dir, "part").filter("p_partkey % 4 = 0").withColumn("target_id", F.lit("p"))
    row = lambda i, parent, tag, name, to: parts.select("target_id", i.alias("id"), parent.alias("parent"), F.lit(tag).alias("tag"), name.alias("name"), to.alias("type_id"))
    none, text = F.lit(None).cast("string"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = row(text("f", "p_brand"), none, "subprogram", F.col("p_brand"), none).distinct()
    tree = tree.unionByName(row(text("v", "p_partkey"), text("f", "p_brand"), "variable", F.concat(F.upper(word(D.LOCAL_KEYWORDS, "p_partkey")), F.lit("_x")), text("q", "p_size")))
    tree = tree.unionByName(row(text("q", "p_size"), none, "pointer", none, text("t", "p_size")).distinct()).unionByName(row(text("t", "p_size"), none, "structure", word(D.TYPE_KEYWORDS, "p_size"), none).distinct())
    return X.local_features(tree).drop("target_id")


@query("feature_key_union", "select 'k' as feature, cast(count(*) as bigint) as n from events where json_extract(props, '$.k') is not null")
def feature_key_union(spark, sf_dir):
    """The sorted union of the names in JSON maps, with how many rows have each."""
    keys = table(spark, sf_dir, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("feature"))
    return keys.groupBy("feature").agg(F.count("*").alias("n")).orderBy("feature")


@query("shortest_of_copies", "select l_suppkey, l_linenumber, cast(min(l_partkey) as bigint) as least, cast(count(*) as bigint) as n from lineitem group by 1, 2")
def shortest_of_copies(spark, sf_dir):
    """The least value among the copies of a key."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.min("l_partkey").cast("bigint").alias("least"), F.count("*").alias("n"))


# --- labels, evaluation, order ---------------------------------------------------------------------------------------


@query(
    "label_gather_sets",
    f"""with {LABEL_SQL} select fn, case when (quality = 1 and h % 3 = 0) or y = 1 or (h % 5 = 0 and h % 2 = 0) then 1 else 0 end as y from lab
    where (quality = 1 and h % 3 = 0) or y = 1 or (h % 5 = 0 and h % 2 = 0) or quality = 0 or h % 7 = 0""",
)
def label_gather_sets(spark, sf_dir):
    """Positives: concrete, named, and extra ones that have an effect; negatives: known ones and former positives."""
    lab = labelled(spark, sf_dir)
    part = lambda cond: lab.filter(cond).select("fn")
    return R.gather_labels(part("quality = 1 and h % 3 = 0"), part("y = 1"), part("h % 5 = 0"), part("h % 2 = 0"), part("quality = 0"), part("h % 7 = 0"), ["fn"])


@query(
    "skipped_rows",
    """with a as (select distinct l_suppkey as k from lineitem where l_quantity >= 50 and l_returnflag = 'R'), b as (select distinct l_suppkey as k from lineitem where l_quantity <= 2 and l_returnflag = 'A')
    select s_suppkey, case when s_suppkey in (select k from a) and s_suppkey in (select k from b) then 'kept' else 'skipped' end as what from supplier""",
)
def skipped_rows(spark, sf_dir):
    """Rows that every source knows are kept, the others counted as skipped."""
    lines = table(spark, sf_dir, "lineitem")
    sources = [lines.filter(c).select(F.col("l_suppkey").alias("s_suppkey")) for c in ("l_quantity >= 50 and l_returnflag = 'R'", "l_quantity <= 2 and l_returnflag = 'A'")]
    kept, rest = R.present_in_all(table(spark, sf_dir, "supplier").select("s_suppkey"), sources, ["s_suppkey"])
    return kept.withColumn("what", F.lit("kept")).unionByName(rest.withColumn("what", F.lit("skipped")))


@query(
    "roc_auc_by_program",
    f"""with {LABEL_SQL}, g as (select prog, round(score, 2) as score, y from lab),
    w as (select p.prog, sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end) as w from g p join g n on p.prog is not distinct from n.prog where p.y = 1 and n.y = 0 group by 1),
    c as (select prog, cast(sum(y) as bigint) as n_pos, cast(sum(1 - y) as bigint) as n_neg from g group by 1)
    select c.prog, n_pos, n_neg, case when n_pos * n_neg > 0 then round(coalesce(w, 0) / (n_pos * n_neg), 6) end as auc from c left join w on c.prog is not distinct from w.prog""",
)
def roc_auc_by_program(spark, sf_dir):
    """The area under the ROC curve of each program, ties by halves."""
    rows = labelled(spark, sf_dir).select("prog", F.round("score", 2).alias("score"), "y")
    return E.roc_auc(rows, by=["prog"])


@query(
    "fold_means",
    f"""with {LABEL_SQL}, p as (select fn % 5 as fold, y, case when score >= 0.5 then 1 else 0 end as predicted from lab),
    c as (select fold, sum(y * predicted) as tp, sum((1 - y) * predicted) as fp, sum(y * (1 - predicted)) as fn_, sum((1 - y) * (1 - predicted)) as tn from p group by 1),
    m as (select fold, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 3) as precision, round(case when tp + fn_ > 0 then tp / (tp + fn_) else 0 end, 3) as recall,
      round(case when 2 * tp + fp + fn_ > 0 then 2 * tp / (2 * tp + fp + fn_) else 0 end, 3) as f1, round((tp + tn) / (tp + fp + fn_ + tn), 3) as accuracy from c)
    select cast(count(*) as bigint) as n_folds, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1, round(avg(accuracy), 6) as accuracy from m""",
)
def fold_means(spark, sf_dir):
    """The means of the measures of each fold."""
    rows = labelled(spark, sf_dir).select((F.col("fn") % 5).alias("fold"), "y", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    return E.fold_means(rows, "fold")


@query(
    "lopo_scores",
    f"""with {LABEL_SQL}, g as (select fn, h % 50 as grp, y, score from lab) select fn, grp, y, case when max(y) over (partition by grp) = 1 then score else 0.0 end as score from g""",
)
def lopo_scores(spark, sf_dir):
    """Groups without a positive are not scored: their rows keep 0 and still count."""
    return E.leave_one_group_out(labelled(spark, sf_dir).select("fn", (F.col("h") % 50).alias("grp"), "y", "score"), "grp")


@query(
    "coverage_report",
    f"""with {LABEL_SQL}, t as (select prog, fn from lab where y = 1), f as (select prog, fn, case when h % 2 = 0 then 1 else 0 end as recovered from lab where score >= 0.4)
    select t.prog, cast(count(*) as bigint) as n_truth, cast(count(f.fn) as bigint) as tp, cast(count(*) - count(f.fn) as bigint) as fn, cast(count(*) filter (f.recovered = 1) as bigint) as recovered
    from t left join f on t.prog = f.prog and t.fn = f.fn group by 1""",
)
def coverage_report(spark, sf_dir):
    """How much of the ground truth the final set holds, and how much of that the rules recovered."""
    lab = labelled(spark, sf_dir)
    final = lab.filter("score >= 0.4").select("prog", "fn", (F.col("h") % 2 == 0).cast("int").alias("recovered"))
    return E.coverage(final, lab.filter("y = 1"), "prog", ["fn"])


@query("ordered_rows", f"with {LABEL_SQL} select fn, prog, y, cast(row_number() over (order by prog, y, fn) as bigint) as place from lab where prog is not null")
def ordered_rows(spark, sf_dir):
    """Rows in the order of program, label and id, numbered by ranges in parallel."""
    rows = labelled(spark, sf_dir).filter("prog is not null").select("fn", "prog", "y", F.struct("prog", "y", "fn").alias("order"))
    return G.numbered(rows, "order", "place").drop("order").orderBy("place")


@query("tiered_order", f"with {LABEL_SQL} select prog, fn, cast(h % 3 as bigint) as tier, cast(row_number() over (partition by prog order by h % 3, fn) as integer) as place from lab")
def tiered_order(spark, sf_dir):
    """Within a program by tier, then by id."""
    rows = labelled(spark, sf_dir).select("prog", "fn", (F.col("h") % 3).cast("bigint").alias("tier"))
    return rows.withColumn("place", F.row_number().over(R.Window.partitionBy("prog").orderBy("tier", "fn"))).orderBy("prog", "tier", "fn")
