"""The newest record per location, kept up to date from an append-only log (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.latest import latest


def follow(spark: SparkSession, log: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, files: int = 100) -> StreamingQuery:
    """Call `each` with every batch of new log rows, once, and stop when the log is read; call again for more."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(log)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def keep_latest(spark: SparkSession, log: str, schema: str, target: str, by: list[str], newest: str, tie: str, checkpoint: str) -> StreamingQuery:
    """Maintain the newest row per `by` as Parquet in `target`: a folder per batch, the last one counts.

    A batch run again writes the same folder again, so the result is exactly once.
    """

    def merge(rows: DataFrame, number: int) -> None:
        found = latest(rows, by, newest, tie)
        if number:
            found = latest(spark.read.parquet(f"{target}/{number - 1}").unionByName(found), by, newest, tie)
        found.write.mode("overwrite").parquet(f"{target}/{number}")

    return follow(spark, log, schema, merge, checkpoint)


def publish_latest(spark: SparkSession, log: str, schema: str, target: str, by: list[str], newest: str, tie: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Write the locations whose newest row a batch changed to `target`, as Parquet, a folder per batch; `published` reads them.

    The newest row per `by` is the state of a streaming aggregation: it is combined before
    the shuffle, lies by location in RocksDB beside the checkpoint, and survives lost
    executors and restarts. A batch costs what it changes, not what is known. There is no
    watermark: a late row may still be the newest of its location, and an old one loses by
    itself. Nulls are old; null keys are a key of their own. A batch run again writes the
    same folder again.
    """
    apart = spark.newSession()  # the state's provider is a setting of a session
    apart.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = apart.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(log)
    rest = [c for c in stream.columns if c not in by]
    state = stream.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(newest, tie)).alias("__row")).select(*by, "__row.*")

    def write(changed: DataFrame, number: int) -> None:
        changed.select(*stream.columns).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def published(spark: SparkSession, target: str, by: list[str], newest: str, tie: str) -> DataFrame:
    """The newest row per `by` of what `publish_latest` wrote."""
    return latest(spark.read.parquet(target).drop("batch"), by, newest, tie)
