"""Incremental scoring: files of features that arrive are scored once each and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import boost


def score_stream(spark: SparkSession, model, order: list[str], source: str, schema: str, sink: str, checkpoint: str):
    """A running query from a folder of Parquet features to a folder of scores. Restarted from its checkpoint it goes on
    where it stopped; a batch that was cut off is written again under the same number."""

    def one(batch: DataFrame, number: int) -> None:
        boost.score(model, batch, order).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
