"""Stream folds, each run to the end of what its source has now. All are built-in operators: no Python sees an event.

A fold's rows are written with the number of their micro-batch; of a key the row of the last batch counts (latest())."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import edit_columns, merged_counts, merged_summary, reaction_summary, thread_columns
from .ingest import KEEP, exists, good


def to_end(stream: DataFrame, save, checkpoint: str, mode: str = "append") -> None:
    """Run `save` (of a micro-batch and its number) on all that the source has and the checkpoint hasn't seen."""
    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replacing(out: str):
    """A sink that writes each micro-batch into a partition of its own, so that one that runs twice is written once."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    return save


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key, without batch_id."""
    others = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("x")).select(*keys, "x.*")


#: What a segment of a counter covers.
SEGMENT = "1 hour"


def reaction_segments(events: DataFrame) -> DataFrame:
    """(key, name, since, total, low, adds): the counter's summary over each SEGMENT, of any order of arrival up to KEEP.
    The state holds the events of segments that can still change. Update mode. events: key, name, delta, event_time, event_id."""
    of = events.withWatermark("event_time", KEEP).groupBy("key", "name", F.window("event_time", SEGMENT).alias("w"))
    steps = of.agg(F.sort_array(F.collect_list(F.struct("event_time", "event_id", "delta"))).alias("steps"))
    return steps.select("key", "name", F.col("w.start").alias("since"), reaction_summary(F.col("steps")).alias("s")).select("key", "name", "since", "s.*")


def _in_order(segments: DataFrame) -> DataFrame:
    rows = latest(segments, "key", "name", "since")
    return rows.groupBy("key", "name").agg(F.sort_array(F.collect_list(F.struct("since", "total", "low", "adds"))).alias("parts"))


def reaction_counts(segments: DataFrame) -> DataFrame:
    """(key, name, n, adds): the counts after all segments in their order. segments: written rows of reaction_segments()."""
    return _in_order(segments).select("key", "name", merged_counts(F.col("parts")).alias("x")).select("key", "name", "x.*")


def compacted(segments: DataFrame, before: Column) -> DataFrame:
    """The rows to keep in place of `segments`: those since `before`, and one row for all earlier ones of a counter, which
    no event can change once they are KEEP behind the newest. So what readers merge does not grow with time."""
    earlier = _in_order(segments.where(F.col("since") < before))
    base = earlier.select("key", "name", F.col("parts")[0]["since"].alias("since"), merged_summary(F.col("parts")).alias("s")).select("key", "name", "since", "s.*", F.lit(0).alias("batch_id"))
    return base.unionByName(segments.where(F.col("since") >= before).select(base.columns))


def edited(events: DataFrame) -> DataFrame:
    """(message_id, text, text_processed, edited_at, n_edits, history) of each message that was edited, as soon as the
    message itself is known; edits may come in any order and before it. Update mode. events: message_id, kind (message or
    edit), event_time, event_id, text."""
    is_edit, at = F.col("kind") == "edit", F.struct("event_time", "event_id", "text")
    per = events.groupBy("message_id").agg(F.min(F.when(~is_edit, at)).alias("first"), F.sort_array(F.collect_list(F.when(is_edit, at))).alias("steps"))
    return per.where("first IS NOT NULL AND size(steps) > 0").select("message_id", *edit_columns(F.col("first.text"), F.col("steps")))


def threads(messages: DataFrame) -> DataFrame:
    """Threads with reply_count, participants and last_reply_at, fed by parents, which make a thread, and replies, which
    may come before it. Update mode. messages: each once, as new_messages() gives them, with thread_ts, channel_id, user_id, ts, importance_score."""
    is_parent = F.col("thread_ts") == F.col("message_id")
    parent = F.first(F.when(is_parent, F.struct("channel_id", F.col("user_id").alias("parent_user"), F.col("ts").alias("started_at"), "importance_score")), ignorenulls=True)
    reply = lambda c: F.when(~is_parent, F.col(c))
    per = messages.where("thread_ts IS NOT NULL").groupBy("thread_ts").agg(parent.alias("p"), F.count(reply("message_id")).alias("n"), F.max(reply("ts")).alias("last"), F.collect_set(reply("user_id")).alias("who"))
    return per.where("p IS NOT NULL").select("thread_ts", "p.*", "n", "last", "who").select("thread_ts", *thread_columns())


def expired_conversations(turns: DataFrame, idle: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """(conv_id, started_at, last_at, turns) of conversations without a turn for `idle`, each once when that time is over;
    then its state is dropped. Turns may come `late`. Append mode. turns: conv_id, at."""
    of = turns.withWatermark("at", late).groupBy("conv_id", F.session_window("at", idle).alias("w"))
    return of.agg(F.min("at").alias("started_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("turns")).drop("w")


def timely(batch: DataFrame, newest: Column) -> DataFrame:
    """A micro-batch with `late`: whether an event is older than KEEP behind `newest`, the newest before this batch."""
    return batch.withColumn("late", F.coalesce(F.col("event_time") < newest - F.expr(f"INTERVAL {KEEP}"), F.lit(False)))


_NEWEST = "newest timestamp"


def _newest(spark: SparkSession, ledger: str, number: int) -> DataFrame:
    """One row: the newest event time of all batches before `number`."""
    path = f"{ledger}/batch={number - 1}"
    if exists(spark, path):
        return spark.read.schema(_NEWEST).parquet(path)
    return spark.createDataFrame([(None,)], _NEWEST)


def expiring(out: str):
    """A sink of decodable events with `late` set, and of counts of the late ones. It reads no event again: the newest
    event time after each batch is a row in `ledger`, and only the row of the batch before is read. A batch that
    runs twice reads the same row and writes the same rows."""
    put, put_late = replacing(f"{out}/events"), replacing(f"{out}/late")

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _newest(spark, f"{out}/ledger", number)
        kept = batch.where(good(batch)).select("event_id", "event_time", "type").persist()
        marked = timely(kept.crossJoin(F.broadcast(before)), F.col("newest")).drop("newest")  # one row
        put(marked.where("NOT late").drop("late"), number)
        put_late(marked.where("late").groupBy("type").agg(F.count(F.lit(1)).alias("n")), number)
        after = kept.agg(F.max("event_time").alias("newest")).unionByName(before).agg(F.max("newest").alias("newest"))
        after.write.mode("overwrite").parquet(f"{out}/ledger/batch={number}")
        kept.unpersist()

    return save
