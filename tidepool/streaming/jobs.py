"""Incremental jobs: windowed events, and turns taken up after a mark, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_windows(spark: SparkSession, source: str, schema, target: str, checkpoint: str, window: str = "1 hour", late: str = "10 minutes", name: str = "*"):
    """Counts by window and type from a folder's event files of a name, appended when the watermark passes a window."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    counted = events.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    rows = counted.select("window.start", "event_type", "n", "total")
    return rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def extract_history(spark: SparkSession, source: str, schema, engine, checkpoint: str, files: int = 32):
    """Gives new history rows (project, entry_type, payload, actor) to the engine, a bounded number of files at a time.

    The stream's checkpoint says which files were taken up, and its number is kept with the rows of a batch, in one commit. A
    batch that is run again, wherever the first run stopped, adds what is missing and nothing twice: rows and chunks by that
    number, facts because each project's extraction has a mark of its own. All that waits is extracted with the batch.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        engine.append_history_rows(batch, {f"history_stream {checkpoint}": epoch})
        for project in [r.project for r in batch.select("project").distinct().orderBy("project").collect()]:
            engine.flush(project)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due(pending: DataFrame, count: int, seconds: int) -> DataFrame:
    """Keys (pending, waited, since_last) whose extraction should run: enough rows or enough time, and not just before."""
    return pending.where(((F.col("pending") >= count) | (F.col("waited") >= seconds)) & (F.col("since_last") >= seconds))
