"""Append-only logs as streams: ingest, idempotent appends and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def tail(spark: SparkSession, folder: str, schema: T.StructType | str, max_files: int = 1000) -> DataFrame:
    """A stream of JSON lines from files that appear in a folder; torn lines are left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", max_files).json(folder)


def append_new(stream: DataFrame, table: str, checkpoint: str, key: str = "record_id") -> StreamingQuery:
    """Append to a Parquet table the rows whose key it lacks, the first of each key in a batch; then stop.

    A batch that is repeated after a failure appends nothing twice.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(table).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(stream: DataFrame, key: str = "generator") -> DataFrame:
    """Calls, tokens and cost by generator, over all that has come; for complete or update mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"))


def distinct_records(stream: DataFrame, key: str = "record_id") -> DataFrame:
    """The first row of each key, kept in the stream's state."""
    return stream.dropDuplicates([key])
