"""Queries over instruction kernels and boosted trees. They have no SQL; tests hold them against hand-made fixtures."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strandline.functions import dimensions as D
from strandline.functions import scalars as S
from strandline.operators import boost, kernels, scan
from strandline.operators import evaluate as E
from strandline.plans.carriers import insn
from strandline.plans.example import CALLS, ENDPOINTS, PROGRAM
from strandline.plans.registry import query
from strandline.session import table

#: What each event of the carrier stands for as an instruction.
TEXTS = {"view": "lea rsi,[rbp-0x40]", "signup": "call 2000 <open@plt>", "error": "mov QWORD PTR [rip+0x10],rax", "click": "call 2004 <read@plt>", "purchase": "call 2010 <send@plt>"}


def _program(spark, sf_dir):
    text = F.create_map(*(F.lit(x) for kv in TEXTS.items() for x in kv))[F.col("op")]
    return insn(spark, sf_dir).select(
        F.col("prog").cast("string").alias("target_id"), F.concat(F.lit("f"), F.col("fn")).alias("function"), F.col("event_id").alias("seq"), (F.col("event_id") * 4).alias("pc"), F.lit(4).alias("size"), text.alias("instruction")
    )


@query("taint_kernels")
def taint_kernels(spark, sf_dir):
    """Every kernel over the carrier stream as instructions: findings by function."""
    return kernels.run_kernels(_program(spark, sf_dir))


_VALUES = lambda rows: ", ".join(f"({', '.join(repr(x) if x is not None else 'null' for x in r)})" for r in rows)


@query(
    "endpoint_scan",
    f"""with recursive f(function, idx, tag) as (values {_VALUES([(f, k, ENDPOINTS.get(f)) for k, f in enumerate(PROGRAM)])}),
    call(src, dst) as (values {_VALUES([c for c in CALLS if c[1] in PROGRAM])}), seed(function) as (values {_VALUES(sorted({(f,) for f, name in CALLS if name in D.READ_ACCESS.split()}))}),
    r(function, dist) as (select function, 0 from seed union select call.src, r.dist + 1 from r join call on call.dst = r.function where r.dist < 3),
    a as (select n_name as target_id, f.function, cast((n_nationkey + idx) % 5 = 0 as integer) as in_screen, cast(tag is not null as integer) as in_rules,
      cast(f.function in (select function from r) as integer) as in_recall, tag from nation, f)
    select target_id, function, in_screen, in_rules, in_recall, cast(in_rules = 1 and in_recall = 1 and in_screen = 0 as integer) as recovered, case when in_rules = 1 and in_recall = 1 and in_screen = 0 then tag end as tag
    from a where in_screen = 1 or (in_rules = 1 and in_recall = 1)""",
)
def endpoint_scan(spark, sf_dir):
    """The whole scan of a program for each nation: recall, every rule with its precedence, what a screen has found, and
    the final set. The endpoints that the SQL has were found by hand."""
    lines = [{"function": f, "idx": n, "seq": k, "pc": 8 * k, "size": 8, "instruction": t, "callee": next((c for g, c in CALLS if g == f and f"<{c}" in t), None)} for n, (f, text) in enumerate(PROGRAM.items()) for k, t in enumerate(text.splitlines())]
    code = F.from_json(F.lit(json.dumps(lines)), "array<struct<function:string,idx:int,seq:bigint,pc:bigint,size:int,instruction:string,callee:string>>")
    insns = table(spark, sf_dir, "nation").select(F.col("n_name").alias("target_id"), "n_nationkey", F.explode(code).alias("i")).select("target_id", "n_nationkey", "i.*")
    screened = insns.filter((F.col("n_nationkey") + F.col("idx")) % 5 == 0).select("target_id", "function").distinct()
    return scan.integrated(insns, screened)


FEATURES = [f"name_{k}" for k in D.NAME_KEYWORDS] + ["n_words", "n_lines", "n_digits", "n_marks"]


@query("gbt_train_score")
def gbt_train_score(spark, sf_dir):
    """Boosted trees (300 rounds, depth 5) on all keyword flags and text measures, scored out of five folds and summed up as a confusion matrix."""
    text = F.coalesce("text", F.lit(""))
    measures = [F.size(F.split(text, " ")).alias("n_words"), F.size(F.split(text, "\n")).alias("n_lines"), F.length(F.regexp_replace(text, "[^0-9]", "")).alias("n_digits"), F.length(F.regexp_replace(text, "[^!?.,]", "")).alias("n_marks")]
    docs = table(spark, sf_dir, "documents").select("doc_id", *S.keyword_flags(text, D.NAME_KEYWORDS, "name_"), *measures)
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    scored = boost.out_of_fold(E.stratified_folds(rows, "y", "doc_id"), FEATURES, "fold")
    return E.confusion(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
