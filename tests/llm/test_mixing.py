import duckdb
from pyspark.sql import functions as F

from strandline.llm import mixing as M


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute("select doc_id, copy_no, shuffle_key from (" + M.mix_sql() + ")").fetchall()
    got = M.mix(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "copy_no", "shuffle_key").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


def test_shares_and_poisson(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 30 == 1, None).otherwise("small").alias("source"))
    out = M.mix(docs, {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()
    by = {r.source: r["count"] for r in out}
    assert None not in by and abs(by["small"] / by["big"] - 3) < 0.15
    assert abs(sum(by.values()) - 20000) < 600
    drawn = M.mix(docs.withColumn("source", F.lit("one")), epochs=2.0).groupBy("doc_id").count()
    counts = {r["count"]: r.n for r in drawn.groupBy("count").agg(F.count("*").alias("n")).collect()}
    assert abs(counts[2] / 20000 - 0.2707) < 0.02 and abs(sum(k * n for k, n in counts.items()) / 20000 - 2) < 0.06


def test_odd_rows(spark, odd, none):
    out = M.mix(odd, epochs=3.0)
    assert set(odd.columns) <= set(out.columns) and out.columns.count("copy_no") == 1
    assert M.mix(none).count() == 0


def test_tiny_source_is_not_cut(spark):
    docs = spark.range(40_200).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 200, "tiny").otherwise("big").alias("source"))
    assert abs({r.source: r.rate for r in M.rates(docs).collect()}["tiny"] - 100.5) < 1e-9
    out = M.mix(docs, ordered=False).filter("source = 'tiny'").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("m"))
    got = out.collect()
    assert len(got) == 200 and all(r.n == r.d == r.m for r in got)
    mean = sum(r.n for r in got) / 200
    assert abs(mean - 100.5) < 3 and 60 < sum((r.n - mean) ** 2 for r in got) / 199 < 150
