"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

Every source s gets the rate  target share x total characters / its own characters  (times ``epochs``). Each document
draws its number of copies by inverting the Poisson distribution of that rate at a uniform number hashed from its id and
the seed, is exploded by that number, and the copies are dealt out in the order of a second hash. Rates beyond MAX_RATE are
drawn in equal parts of at most that, each at a number of its own: the sum of Poisson draws is one of the summed rate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import scoped, stored_and

SEED = 20
#: The largest rate that is drawn at once.
MAX_RATE = 16.0
#: Beyond this count the Poisson tail of MAX_RATE is below 2**-53, the grain of the uniform numbers.
MAX_COPIES = 80
#: Sources (a name and MAX_COPIES numbers each) up to so many are broadcast, after they have been counted; more of them are
#: met by shuffle, each on so many salts, as one source may hold a third of all documents.
BROADCAST_ROWS, SALTS = 10_000, 64


def _uniform(key):
    """A number in [0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies of a document of each source. Without ``weights`` all sources that
    occur get the same share. A null source is the source ''. Sources without a weight or without characters: rate 0
    and 1."""
    size = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        size = size.withColumn("weight", F.lit(1.0))
    else:
        each = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))] or [F.lit(""), F.lit(0.0)]
        size = size.withColumn("weight", F.coalesce(F.create_map(*each)[F.col("source")], F.lit(0.0)))
    all_chars, all_weight = size.agg(F.sum("chars"), F.sum("weight")).first()
    if not all_weight or all_weight <= 0:
        return size.select("source", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(float(all_weight)) * F.lit(float(all_chars)) / F.col("chars") * F.lit(float(epochs))
    rate = F.when(F.col("chars") > 0, rate).otherwise(F.when(F.col("weight") > 0, 1.0).otherwise(0.0))
    return size.select("source", rate.alias("rate"))


def _ladder(rate):
    """The cumulative Poisson probabilities of 0, 1, ... MAX_COPIES - 1 as an array."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    step = lambda acc, k: F.struct(
        (acc["p"] * rate / k).alias("p"),
        F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c"),
    )
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(MAX_COPIES - 1)), lambda k: k.cast("double")), start, step, lambda acc: acc["c"])


@scoped
def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, ordered: bool = True) -> DataFrame:
    """The documents replicated to the target mixture, in a global random order.

    Returns the columns of ``docs`` and copy_no (1 to the count) and shuffle_key (bigint), sorted by shuffle_key, id and
    copy. Columns of those two names in the input are replaced. A null doc_id draws as the id ''; repeated rows draw
    alike; null and empty texts count no characters but are drawn like others; an empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    parts = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    steps = rates(docs, weights, epochs).withColumn("parts", parts)
    steps, n_sources = stored_and(steps.select(F.col("source").alias("__sl_source"), _ladder(F.col("rate") / F.col("parts")).alias("__sl_steps"), F.col("parts").alias("__sl_parts")), "rates", keep=True)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held = docs.select(*own, F.coalesce(F.col("source"), F.lit("")).alias("__sl_source"), _uniform(F.concat(key, F.lit(f":{seed}:copies"))).alias("__sl_u"))
    count = lambda u: F.size(F.filter("__sl_steps", lambda c: c <= u))
    further = F.transform(F.sequence(F.lit(1), F.col("__sl_parts") - 1), lambda k: count(_uniform(F.concat(key, F.lit(f":{seed}:copies:"), k.cast("string")))))
    n = count(F.col("__sl_u")) + F.when(F.col("__sl_parts") > 1, F.aggregate(further, F.lit(0), lambda a, x: a + x)).otherwise(0)
    if n_sources <= BROADCAST_ROWS:
        met = held.join(F.broadcast(steps), "__sl_source")
    else:
        salted = steps.withColumn("__sl_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = held.withColumn("__sl_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["__sl_source", "__sl_salt"])
    dealt = met.withColumn("__sl_n", n).filter("__sl_n > 0")
    dealt = dealt.select(*own, F.explode(F.sequence(F.lit(1), F.col("__sl_n"))).alias("copy_no"))
    place = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}:"), F.col("copy_no").cast("string"))), 1, 13), 16, 10).cast("bigint")
    dealt = dealt.withColumn("shuffle_key", place)
    return dealt.orderBy("shuffle_key", "doc_id", "copy_no") if ordered else dealt


def mix_sql(docs: str = "documents", seed: int = SEED, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """DuckDB SQL for mix() with equal weights."""
    logs = " ".join(f"when {k} then {math.lgamma(k + 1)!r}" for k in range(MAX_COPIES))
    return f"""
    with size as (select coalesce(source, '') as s, cast(sum(coalesce(length(text), 0)) as double) as chars from {docs} group by 1),
    rated as (select s, case when chars <= 0 then 1.0 else 1.0 / (select count(*) from size) * (select sum(chars) from size) / chars end as whole from size),
    parted as (select s, whole, greatest(cast(ceil(whole / {MAX_RATE}) as bigint), 1) as parts, whole / greatest(ceil(whole / {MAX_RATE}), 1) as rate from rated),
    steps as (select s, k, sum(exp(-rate + k * ln(rate) - case k {logs} end)) over (partition by s order by k) as c
      from parted, (select unnest(range({MAX_COPIES})) as k)),
    numbered as (select *, row_number() over () as r, coalesce(source, '') as s from {docs}),
    drawn as (select r, n.s, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':{seed}:copies' || case j when 0 then '' else ':' || cast(j as varchar) end), 1, 13) as bigint) / cast({2**52} as double) as u
      from (select r, numbered.s, doc_id, unnest(range(parts)) as j from numbered join parted on numbered.s = parted.s) n),
    summed as (select r, sum(copies) as n from (select r, (select count(*) from steps where steps.s = drawn.s and c <= u) as copies from drawn) group by r),
    counted as (select numbered.*, cast(summed.n as bigint) as n from numbered join summed on numbered.r = summed.r)
    select {columns}, cast(k as integer) as copy_no,
      cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':{seed}:' || cast(k as varchar)), 1, 13) as bigint) as shuffle_key
    from (select *, unnest(range(1, n + 1)) as k from counted where n > 0)
    """
