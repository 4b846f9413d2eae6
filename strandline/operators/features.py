"""Feature groups of functions from artifact tables, and their assembly in one fixed order.

Each group is a DataFrame keyed by (target_id, function). Instructions are (target_id, function, seq, pc, size,
instruction, callee), call edges (target_id, src, dst), debug facts as the readers in ``sources`` give them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import dimensions as D
from strandline.functions import scalars as S
from strandline.operators import graph as G
from strandline.operators.measures import KEY, measure_names
from strandline.operators.relational import range_lookup

CATEGORIES = ("privilege_identity", "capability", "exec", "file_mutation", "mount", "rlimit")
#: Sections whose bytes are string literals, and the most bytes that one may have.
LITERAL_SECTIONS, LITERAL_BYTES = (".rodata", ".data.rel.ro"), 200
#: Steps that a type is followed to a name.
TYPE_STEPS = 10
NAMED_TYPES = ("structure", "union", "typedef", "base", "enumeration")


def _symbols(spark) -> DataFrame:
    """(callee, category): a few hundred constants of this repository; a symbol may be in file_read and another."""
    rows = [(s, c) for c in CATEGORIES for s in D.EFFECTS[c].split()] + [(s, "file_read") for s in D.FILE_READ.split()]
    return F.broadcast(spark.createDataFrame(rows, "callee string, category string"))


def effect_features(insns: DataFrame) -> DataFrame:
    """eff_ counts of calls by category, their total and how many categories, and eff_file_read, which counts apart.
    Functions without such a call have no row."""
    calls = insns.filter("callee is not null").select(*KEY, "callee").join(_symbols(insns.sparkSession), "callee")
    counts = [F.count_if(F.col("category") == c).alias(f"eff_{c}") for c in CATEGORIES]
    one = calls.groupBy(*KEY).agg(*counts, F.count_if(F.col("category") != "file_read").alias("eff_total"), F.count_if(F.col("category") == "file_read").alias("eff_file_read"))
    kinds = reduce(lambda a, b: a + b, ((F.col(f"eff_{c}") > 0).cast("bigint") for c in CATEGORIES))
    return one.withColumn("eff_ncats", kinds)


def reach_features(insns: DataFrame, edges: DataFrame) -> DataFrame:
    """reach_ flags of the categories that calls lead to, how many, the fewest calls to any effect (99: none), and how many
    callees reach one. Functions that reach nothing have no row. A call of an effect symbol is not followed."""
    spark = insns.sparkSession
    node = lambda c: F.to_json(F.struct("target_id", F.col(c).alias("function")))
    symbols = _symbols(spark)
    seeds = insns.filter("callee is not null").select(*KEY, "callee").join(symbols, "callee").select(node("function").alias("node"), F.col("category").alias("label")).distinct()
    internal = edges.join(symbols.select(F.col("callee").alias("dst")).distinct(), "dst", "left_anti").select(node("src").alias("src"), node("dst").alias("dst"))
    found = G.reach(internal, seeds)
    flags = [F.max((F.col("label") == c).cast("bigint")).alias(f"reach_{c}") for c in (*CATEGORIES, "file_read")]
    rows = found.groupBy("node").agg(*flags, F.countDistinct("label").alias("reach_ncats"), F.min("dist").cast("bigint").alias("reach_dist"))
    reaching = internal.distinct().join(found.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("reach_neff_callees"))
    rows = rows.join(reaching, "node", "left").withColumn("reach_neff_callees", F.coalesce("reach_neff_callees", F.lit(0))).withColumn("reach_any", F.lit(1).cast("bigint"))
    return rows.withColumn("k", F.from_json("node", "target_id string, function string")).select("k.*", *(c for c in rows.columns if c != "node"))


def literals_by_reference(insns: DataFrame, sections: DataFrame, images: DataFrame) -> DataFrame:
    """(target_id, function, seq, literal): NUL-terminated printable strings that rip-relative operands point at.

    ``sections`` (target_id, name, vma, size, file_off, ord), ``images`` (target_id, content). The address is that of the
    next instruction plus the displacement; the first section that holds it counts, if it is one of literals.
    """
    place = F.regexp_extract("instruction", r"\[rip([+-]0x[0-9a-fA-F]+)\]", 1)
    size = F.conv(F.substring(place, 4, 16), 16, 10).cast("bigint")
    at = F.col("pc") + F.coalesce("size", F.lit(0)) + F.when(F.startswith(place, F.lit("-")), -size).otherwise(size)
    points = insns.withColumn("address", F.when(place != "", at)).filter("address is not null").select(*KEY, "seq", "address")
    literal = reduce(lambda a, b: a | b, (F.startswith("name", F.lit(p)) for p in LITERAL_SECTIONS))
    spans = sections.filter(literal).select(F.col("target_id").alias("t"), "name", F.col("vma").alias("lo"), (F.col("vma") + F.col("size")).alias("hi"), "file_off", "ord")
    met = range_lookup(points, spans, "address", "lo", "hi", "ord", 1 << 16, [F.col("target_id") == F.col("t")])
    read = met.join(images.select("target_id", "content"), "target_id").select(*KEY, "seq", F.substring("content", (F.col("file_off") + F.col("address") - F.col("lo") + 1).cast("int"), F.lit(LITERAL_BYTES)).alias("raw"))
    return read.select(*KEY, "seq", terminated(F.col("raw")).alias("literal")).filter("literal is not null")


def terminated(raw: Column) -> Column:
    """The printable text of at least 3 characters before the first NUL of some bytes; null without one."""
    text = F.decode(raw, "ISO-8859-1")
    cut = F.regexp_extract(text, r"^([\x20-\x7e]{3,})\x00", 1)
    return F.nullif(cut, F.lit(""))


def literals_by_immediate(insns: DataFrame) -> DataFrame:
    """(target_id, function, seq, literal): text that a mov stores as a hexadecimal immediate of 7 to 16 digits."""
    digits = F.regexp_extract("instruction", r",\s*0x([0-9a-fA-F]{7,16})\b", 1)
    found = insns.filter(F.startswith("instruction", F.lit("mov"))).select(*KEY, "seq", F.when(digits != "", S.literal_of_immediate(digits)).alias("literal"))
    return found.filter("literal is not null")


def string_features(literals: DataFrame) -> DataFrame:
    """s_ flags of the literals of each function, and how many there are, up to the cap that the feature has."""
    flags = [F.max(c.cast("bigint")).alias(n) for n, c in S.literal_flags(F.col("literal")).items()]
    return literals.groupBy(*KEY).agg(F.least(F.count("*"), F.lit(D.LITERAL_CAP)).cast("bigint").alias("s_count"), *flags)


def source_file(insns: DataFrame, lines: DataFrame) -> DataFrame:
    """(target_id, function, file): the source file that most addresses of a function come from; of ties the one seen
    first. ``lines`` (target_id, pc, file)."""
    met = insns.select(*KEY, "seq", "pc").join(lines, ["target_id", "pc"]).groupBy(*KEY, F.lower("file").alias("file")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return met.groupBy(*KEY).agg(F.min_by("file", F.struct(-F.col("n"), F.col("first"))).alias("file"))


def debug_features(params: DataFrame, files: DataFrame) -> DataFrame:
    """Substring flags of a function's source file, parameter names and parameter types, and its string parameters.
    ``params`` (target_id, function, params array of name, type, is_pointer); either side may lack a function."""
    joined = params.join(files, KEY, "full")
    words = lambda field: F.lower(F.array_join(F.transform("params", lambda p: F.coalesce(p[field], F.lit(""))), " "))
    strings = F.size(F.filter("params", lambda p: F.coalesce(p["is_pointer"], F.lit(False)) & F.contains(F.lower(F.coalesce(p["type"], F.lit(""))), F.lit("char"))))
    flags = [*S.keyword_flags(F.col("file"), D.FILE_KEYWORDS, "file_"), *S.keyword_flags(words("name"), D.PARAM_KEYWORDS, "pname_"), *S.keyword_flags(words("type"), D.PARAM_TYPE_KEYWORDS, "ptype_")]
    return joined.select(*KEY, *flags, F.when(F.col("params").isNull(), 0).otherwise(strings).alias("n_str_param"))


def pointer_features(params: DataFrame) -> DataFrame:
    """p_nparam and p_nptr: how many parameters and how many of them are pointers."""
    return params.select(*KEY, F.coalesce(F.size("params"), F.lit(0)).alias("p_nparam"), F.coalesce(F.size(F.filter("params", lambda p: F.coalesce(p["is_pointer"], F.lit(False)))), F.lit(0)).alias("p_nptr"))


def subprogram_facts(tree: DataFrame) -> DataFrame:
    """(target_id, function, kind, name, type_id) of the variables and parameters right below named subprograms.
    ``tree`` (target_id, id, parent, tag, name, type_id): debug information as rows, extracted beforehand."""
    functions = tree.filter("tag = 'subprogram' and name is not null").select("target_id", F.col("id").alias("parent"), F.col("name").alias("function"))
    children = tree.filter("tag in ('variable', 'formal_parameter')").select("target_id", "parent", F.col("tag").alias("kind"), "name", "type_id")
    return children.join(functions, ["target_id", "parent"]).select(*KEY, "kind", "name", "type_id")


def type_names(tree: DataFrame, wanted: DataFrame, steps: int = TYPE_STEPS) -> DataFrame:
    """(target_id, type_id, type_name): the first name along each chain of types, which is followed for ``steps`` steps:
    through pointers, qualifiers and unnamed types to a named structure, union, typedef, base or enumeration type."""
    types = tree.select("target_id", F.col("id").alias("at"), F.when(F.col("tag").isin(*NAMED_TYPES), F.col("name")).alias("own"), F.col("type_id").alias("next"))
    open_ = wanted.select("target_id", "type_id").filter("type_id is not null").distinct().withColumn("at", F.col("type_id"))
    found = []
    for _ in range(steps):
        met = G.cut(open_.join(types, ["target_id", "at"]))
        found.append(met.filter("own is not null").select("target_id", "type_id", F.col("own").alias("type_name")))
        open_ = met.filter("own is null and next is not null").select("target_id", "type_id", F.col("next").alias("at"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def local_features(tree: DataFrame) -> DataFrame:
    """Substring flags of the names of a function's variables and parameters, and of the names of their types."""
    facts = subprogram_facts(tree)
    named = facts.join(type_names(tree, facts), ["target_id", "type_id"], "left")
    words = lambda c: F.array_join(F.array_sort(F.collect_set(F.lower(c))), " ")
    held = named.groupBy(*KEY).agg(words("name").alias("names"), words("type_name").alias("types"))
    return held.select(*KEY, *S.keyword_flags(F.col("names"), D.LOCAL_KEYWORDS, "lv_"), *S.keyword_flags(F.col("types"), D.TYPE_KEYWORDS, "ty_"))


def name_features(functions: DataFrame) -> DataFrame:
    return functions.select(*KEY, *S.keyword_flags(F.col("function"), D.NAME_KEYWORDS, "name_"))


def rule_features(findings: DataFrame) -> DataFrame:
    """fr_computed_path and writes_send_buffer from the findings of kernels (target_id, function, tag, evidence)."""
    computed = (F.col("tag") == "path_provenance") & F.contains("evidence", F.lit("computed"))
    return findings.groupBy(*KEY).agg(F.max(computed.cast("int")).alias("fr_computed_path"), F.max((F.col("tag") == "writes_send_buffer").cast("int")).alias("writes_send_buffer"))


def feature_order() -> list[str]:
    """The 283 features in their order: measures, effects, reach, strings, parameters, rules, names, debug facts, locals."""
    effects = [*(f"eff_{c}" for c in CATEGORIES), "eff_total", "eff_ncats"]
    reach = [*(f"reach_{c}" for c in CATEGORIES), "reach_any", "reach_ncats", "reach_dist", "reach_neff_callees"]
    strings = ["s_count", "s_path", "s_syspath", "s_shell", "s_cred", "s_cap", "s_fmt"]
    later = ["p_nparam", "p_nptr", "eff_file_read", "reach_file_read", "fr_computed_path", "writes_send_buffer"]
    names = [f"name_{k}" for k in D.NAME_KEYWORDS]
    debug = sorted([*(f"file_{k}" for k in D.FILE_KEYWORDS), "n_str_param", *(f"pname_{k}" for k in D.PARAM_KEYWORDS), *(f"ptype_{k}" for k in D.PARAM_TYPE_KEYWORDS)])
    local = sorted([*(f"lv_{k}" for k in D.LOCAL_KEYWORDS), *(f"ty_{k}" for k in D.TYPE_KEYWORDS)])
    return [*measure_names(), *effects, *reach, *strings, *later, *names, *debug, *local]


def assemble(base: DataFrame, groups: list[DataFrame]) -> DataFrame:
    """(target_id, function, 283 doubles): ``base`` with every group, missing features 0 (reach_dist 99)."""
    wide = reduce(lambda a, b: a.join(b, KEY, "left"), groups, base.select(*KEY).distinct())
    missing = lambda c: F.lit(float(D.UNREACHABLE if c == "reach_dist" else 0))
    return wide.select(*KEY, *(F.coalesce(F.col(c).cast("double"), missing(c)).alias(c) if c in wide.columns else missing(c).alias(c) for c in feature_order()))


def concrete_issuers(effects: DataFrame, sizes: DataFrame, least: int = 8) -> DataFrame:
    """(target_id, function): functions with a direct exec, identity, capability or file effect, of at least ``least``
    instructions, whose name is not of clean-up code."""
    real = reduce(lambda a, b: a | b, (F.col(f"eff_{c}") > 0 for c in ("exec", "privilege_identity", "capability", "file_mutation")))
    return effects.filter(real & ~F.col("function").rlike(D.CLEANUP)).join(sizes.filter(F.col("n_instructions") >= least), KEY, "left_semi").select(*KEY)


def named_deciders(sizes: DataFrame, least: int = 8) -> DataFrame:
    """(target_id, function): functions of at least ``least`` instructions whose name is of a decision on authority and
    not of its bookkeeping."""
    return sizes.filter((F.col("n_instructions") >= least) & F.col("function").rlike(D.AUTHZ) & ~F.col("function").rlike(D.BOOKKEEPING)).select(*KEY)
