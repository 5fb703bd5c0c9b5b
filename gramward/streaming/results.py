"""Incremental load of result files: new rows are added by key, loaded files are never read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def load_stream(spark: SparkSession, source: str, store: str, checkpoint: str, schema: str, key: str) -> StreamingQuery:
    """Append to the Parquet ``store`` those JSON rows of ``source`` whose key it lacks; stops when all is read."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            old = batch.sparkSession.read.parquet(store)
        except Exception as why:
            if "PATH_NOT_FOUND" not in str(why):
                raise
        else:
            fresh = fresh.join(old, key, "left_anti")
        fresh.write.mode("append").parquet(store)

    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
