"""The driver's tables seen as instruction streams, call graphs and labels, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import table

#: An instruction stream: the events of a user in order; the program is user_id modulo 7.
INSN_SQL = """insn as (select user_id as fn, user_id % 7 as prog, event_id, ts, event_type as op, value,
  cast(json_extract(props, '$.k') as integer) as imm, row_number() over (partition by user_id order by ts, event_id) as seq from events)"""

#: A call graph: suppliers of consecutive line numbers of an order, of large returned lines.
EDGE_SQL = """edge as (select distinct a.l_suppkey as src, b.l_suppkey as dst from lineitem a join lineitem b
  on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_quantity >= 50 and a.l_returnflag = 'R')"""

#: Labelled functions: documents that have labels; y is toxic, the program the language, the score a hash of the id.
LABEL_SQL = """lab as (select d.doc_id as fn, d.lang as prog, l.toxic as y, l.quality as quality, (d.doc_id * 7919 + 13) % 10007 as h,
  round(((d.doc_id * 7919 + 13) % 10007) / 10007.0, 6) as score from documents d join labels l on d.doc_id = l.doc_id)"""


def insn(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("fn"), (F.col("user_id") % 7).alias("prog"), "event_id", "ts", F.col("event_type").alias("op"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("imm"),
    )


def edges(spark, sf_dir) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    first = a.filter("l_quantity >= 50 and l_returnflag = 'R'").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("src"))
    return first.join(a.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("dst")), ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def labelled(spark, sf_dir) -> DataFrame:
    h = (F.col("doc_id") * 7919 + 13) % 10007
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("fn"), F.col("lang").alias("prog"), F.col("toxic").alias("y"), "quality", h.alias("h"), F.round(h / 10007.0, 6).alias("score")
    )
