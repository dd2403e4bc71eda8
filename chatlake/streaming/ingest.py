"""Structured Streaming: event envelopes to tables, with duplicates, late and broken events set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.folds import TASKS, insert_new

ENVELOPE = T.StructType(
    [
        T.StructField("team_id", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("event_time", T.TimestampType()),
        T.StructField("event", T.StructType([T.StructField("type", T.StringType()), T.StructField("message_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("user", T.StringType()), T.StructField("text", T.StringType())])),
    ]
)
#: Events older than this behind the newest are late, as queued events expire after a day.
KEEP = "24 hours"


def read_envelopes(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of JSON lines; a line that does not parse keeps its text in `raw` with null fields."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(F.col("value").alias("raw"), F.from_json("value", ENVELOPE).alias("e")).select("raw", "e.*", "e.event.*").drop("event")


def good(df: DataFrame):
    return F.col("event_id").isNotNull() & F.col("event_time").isNotNull() & F.col("type").isNotNull()


def new_messages(events: DataFrame) -> DataFrame:
    """Each message once, whatever the number of deliveries inside the watermark."""
    rows = events.where(good(events) & (F.col("type") == "message") & F.col("message_id").isNotNull())
    return rows.withWatermark("event_time", KEEP).dropDuplicatesWithinWatermark(["message_id"]).select("message_id", "user", "text", "event_time")


def counts_per_minute(events: DataFrame) -> DataFrame:
    return events.where(good(events)).withWatermark("event_time", KEEP).groupBy(F.window("event_time", "1 minute"), "type").count()


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def day_of(message_id):
    """The day in a message's id, which starts with its seconds; -1 for ids of another form."""
    return F.coalesce(F.floor(F.try_element_at(F.split(message_id, r"\."), F.lit(1)).try_cast("double") / 86400).cast("int"), F.lit(-1))


def write_tables(events: DataFrame, out: str, checkpoint: str):
    """One query that writes messages, follow-up tasks and dead letters. Each micro-batch replaces its own
    partition, so that a batch that runs twice is written once. A message that an earlier batch has, or that stands twice
    in one, is written once: the first by time and event. Messages lie by the day in their ids, and of earlier
    batches only the ids of the days of a batch are read."""

    def stored(spark: SparkSession, batch: DataFrame, batch_id: int) -> DataFrame:
        schema = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("day", T.IntegerType()), T.StructField("batch_id", T.IntegerType())])
        if not exists(spark, f"{out}/messages"):
            return spark.createDataFrame([], schema)
        days = [r.day for r in batch.select("day").distinct().collect()]  # as many as a batch has days
        return spark.read.schema(schema).parquet(f"{out}/messages").where(F.col("day").isin(days) & (F.col("batch_id") < batch_id))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id)).persist()
        said = batch.where(good(batch) & (F.col("type") == "message")).withColumn("day", day_of(F.col("message_id")))
        old = stored(batch.sparkSession, said, batch_id)
        known = F.col("type").isin(*TASKS, "reaction_added", "reaction_removed", "message_changed", "message_deleted")
        tasks = F.create_map(*(F.lit(x) for p in TASKS.items() for x in p))
        reason = F.when(~good(batch), "undecodable").when(~known, "unknown type")
        parts = {
            "messages": insert_new(old, said, "message_id", F.col("event_time"), F.col("event_id")).select("message_id", "user", "text", "event_time", "day", "batch_id"),
            "tasks": batch.where(good(batch)).select(tasks[F.col("type")].alias("task_type"), F.col("message_id").alias("key"), "batch_id").where("task_type IS NOT NULL"),
            "dead": batch.withColumn("reason", F.coalesce(reason, F.lit(None))).where("reason IS NOT NULL").select("raw", "reason", "batch_id"),
        }
        for name, rows in parts.items():
            by = ("day", "batch_id") if name == "messages" else ("batch_id",)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")
        batch.unpersist()

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
