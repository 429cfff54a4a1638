"""Usage of models over a stream of trace rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed_usage(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", model: str = "event_type", cost: str = "value") -> DataFrame:
    """(window_start, model, calls, cost): per model and window of event time; rows later than the watermark are left out. The same
    expression serves a bounded table and a stream, whose state is a row per open window and model."""
    rows = events.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", window), F.col(model).alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum(cost), 4).alias("cost"))
    return out.select(F.col("window.start").alias("window_start"), "model", "calls", "cost")


def follow(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """The roll-up of all files of a folder by a stream that stops once it has read them; the result is the stream's memory table."""
    stream = spark.readStream.schema(EVENTS).parquet(folder)
    query = windowed_usage(stream, **options).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


#: A batch's sums per model.
SUMS = "model string, calls long, cost_usd double"


def append_traces(rows: DataFrame, path: str, checkpoint: str):
    """A stream of trace rows (``model``, ``cost_usd`` and others) appended to JSON lines under ``path``/rows, and each batch's calls and cost per model under ``path``/ledger, both by
    the stream's id and the batch's number. A batch that is run again after a failure takes the place of what it wrote before, so each row and each sum
    is there once."""

    def write(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        place = f"stream={stream}/batch={number}"
        batch.persist()
        try:
            batch.write.mode("overwrite").json(f"{path}/rows/{place}")
            sums = batch.groupBy("model").agg(F.count("*").alias("calls"), F.sum("cost_usd").cast("double").alias("cost_usd"))
            sums.coalesce(1).write.mode("overwrite").json(f"{path}/ledger/{place}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_totals(spark: SparkSession, path: str) -> DataFrame:
    """(model, calls, cost_usd) over all batches of all streams, from their sums alone."""
    sums = spark.read.schema(SUMS).option("recursiveFileLookup", "true").json(f"{path}/ledger")
    return sums.groupBy("model").agg(F.sum("calls").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def as_folder(spark: SparkSession, table: str, work: str) -> str:
    """A table's path if it is a folder, as a stream's source must be; a single file's rows are written to a folder under ``work``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return table
    spark.read.schema(EVENTS).parquet(table).write.parquet(f"{work}/source")
    return f"{work}/source"
