"""Every relational query by name, with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query(
    "scan_rank_threshold",
    """
    select user_id, cast(count(*) as bigint) as n_events,
      cast(count(distinct event_type) as bigint) as n_kinds,
      cast(sum(case event_type when 'purchase' then 5 when 'error' then 3 when 'click' then 2 else 1 end) as bigint) as score
    from events group by user_id
    having sum(case event_type when 'purchase' then 5 when 'error' then 3 when 'click' then 2 else 1 end) >= 150
    """,
)
def scan_rank_threshold(spark, sf_dir):
    """Score each entity by a transparent weighted sum, keep those at the threshold, rank by score and id."""
    weight = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "error", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_kinds"), F.sum(weight).cast("bigint").alias("score"))
        .filter(F.col("score") >= 150)
        .orderBy(F.desc("score"), F.desc("user_id"))
    )


def _load() -> None:
    """The modules that register queries."""
    from strandline.plans import graphs, joins, kernels, labels, resolution, streams  # noqa: F401

_load()
