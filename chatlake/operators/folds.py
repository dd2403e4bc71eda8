"""Event folds in batch form, dimension upserts and ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by `order`; needs no more than one row of a key from each task."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def insert_new(existing: DataFrame, arriving: DataFrame, key: str, *order: Column) -> DataFrame:
    """The rows to append: the first of each key that is not there yet."""
    return first_by(arriving, [key], *order).join(existing.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, insert_only: tuple[str, ...] = (), update_only: tuple[str, ...] = ()) -> DataFrame:
    """Slowly changing dimension of type 1, as a full outer join. Columns in insert_only keep the old value,
    those in update_only are set on updates only."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    for c in old.columns:
        if c == key:
            continue
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in insert_only:
            value = F.coalesce(was, now)
        elif c in update_only:
            value = F.when(F.col(f"o.{key}").isNotNull(), F.coalesce(now, was))
        else:
            value = F.coalesce(now, was)
        cols.append(value.alias(c))
    return both.select(*cols)


def edit_columns(original: Column, steps: Column) -> list[Column]:
    """The columns of an edited message: text, text_processed, edited_at, n_edits and history, the earlier texts in order, each with
    the time of the edit that replaced it. steps: edits in order, structs of event_time, event_id and text."""
    texts = F.concat(F.array(original), F.transform(steps, lambda s: s["text"]))
    history = F.transform(steps, lambda s, i: F.struct(s["event_time"].alias("timestamp"), F.get(texts, i).alias("old_text")))
    last = F.element_at(steps, -1)
    return [last["text"].alias("text"), ft.clean(last["text"]).alias("text_processed"), last["event_time"].alias("edited_at"), F.size(steps).alias("n_edits"), history.alias("history")]


def edits(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """(message_id, text, text_processed, edited_at, n_edits, history) of edited messages; flags, links and importance
    stay as they were. changes: (message_id, event_time, event_id, text); edits of unknown messages are ignored."""
    steps = changes.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("event_time", "event_id", "text"))).alias("steps"))
    joined = messages.select("message_id", F.col("text").alias("original")).join(steps, "message_id")
    return joined.select("message_id", *edit_columns(F.col("original"), F.col("steps")))


def deleted(messages: DataFrame, deletes: DataFrame, key: str = "message_id") -> DataFrame:
    return messages.join(deletes.select(key), key, "left_anti")


def reactions(messages: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per message and reaction, floored at 0 after each event: the running sum minus its least value
    below 0. events: keys, name, delta (1 or -1), event_time, event_id. Unknown messages are ignored."""
    order = Window.partitionBy(*keys, "name").orderBy("event_time", "event_id")
    run = events.withColumn("s", F.sum("delta").over(order))
    totals = run.groupBy(*keys, "name").agg(F.max_by("s", F.struct("event_time", "event_id")).alias("last"), F.min("s").alias("low"), F.sum(F.when(F.col("delta") > 0, 1).otherwise(0)).alias("adds"))
    counts = totals.select(*keys, "name", "adds", (F.col("last") - F.least(F.col("low"), F.lit(0))).alias("n"))
    per = counts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("name", "n")))).alias("reactions"), F.sum("n").alias("reaction_count"), F.round(F.sum("adds") * 0.5, 2).alias("importance_gain")
    )
    return messages.select(*keys, "message_id").join(per, keys).select("message_id", "reactions", "reaction_count", "importance_gain")


def reaction_summary(steps: Column) -> Column:
    """What steps do to a counter that is never below 0, as a struct that can be merged: total, their sum, low, the least
    sum of a prefix (0 for none), and adds. steps: in order, structs with delta."""
    kind = "struct<total:bigint,low:bigint,adds:bigint>"

    def step(acc, s):
        total = acc["total"] + s["delta"]
        return F.struct(total.alias("total"), F.least(acc["low"], total).alias("low"), (acc["adds"] + (s["delta"] > 0).cast("bigint")).alias("adds")).cast(kind)

    zero = F.lit(0)
    return F.aggregate(steps, F.struct(zero.alias("total"), zero.alias("low"), zero.alias("adds")).cast(kind), step)


def merged_summary(parts: Column) -> Column:
    """The summary of what the summaries `parts`, in order, do one after another."""
    kind = "struct<total:bigint,low:bigint,adds:bigint>"

    def step(acc, s):
        return F.struct((acc["total"] + s["total"]).alias("total"), F.least(acc["low"], acc["total"] + s["low"]).alias("low"), (acc["adds"] + s["adds"]).alias("adds")).cast(kind)

    zero = F.lit(0)
    return F.aggregate(parts, F.struct(zero.alias("total"), zero.alias("low"), zero.alias("adds")).cast(kind), step)


def merged_counts(parts: Column) -> Column:
    """Struct (n, adds): the counter, from 0, after the summaries `parts`, in order."""
    s = merged_summary(parts)
    return F.struct((s["total"] - s["low"]).alias("n"), s["adds"].alias("adds"))


def thread_columns() -> list[Column]:
    """The columns of a thread, of its parent's (channel_id, parent_user, started_at, importance_score) and those of its
    replies: n, last, who."""
    people = F.array_sort(F.array_union(F.array("parent_user"), F.coalesce("who", F.array().cast("array<string>"))))
    return [F.col(c) for c in ("channel_id", "started_at")] + [F.coalesce("n", F.lit(0)).alias("reply_count"), F.col("last").alias("last_reply_at"), people.alias("participants"), F.size(people).alias("participant_count"), F.col("importance_score")]


def thread_rollup(messages: DataFrame) -> DataFrame:
    """Threads of parent messages, with their importance, reply_count, participants and last_reply_at. messages: message_id,
    thread_ts, channel_id, user_id, ts, importance_score."""
    parent = messages.where(F.col("thread_ts") == F.col("message_id")).select("thread_ts", "channel_id", F.col("user_id").alias("parent_user"), F.col("ts").alias("started_at"), "importance_score")
    replies = messages.where(F.col("thread_ts") != F.col("message_id")).groupBy("thread_ts").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.collect_set("user_id").alias("who"))
    return parent.join(replies, "thread_ts", "left").select("thread_ts", *thread_columns())


def members(events: DataFrame) -> DataFrame:
    """Members of each channel after all joined and left events."""
    last = events.groupBy("channel_id", "user_id").agg(F.max_by("action", F.struct("event_time", "event_id")).alias("action"))
    return last.where("action = 'joined'").groupBy("channel_id").agg(F.count(F.lit(1)).alias("member_count"), F.sort_array(F.collect_list("user_id")).alias("member_ids"))


# Follow-up tasks by event type.
TASKS = {"file_shared": "process_file", "channel_created": "sync_channel", "channel_rename": "sync_channel", "member_joined": "sync_members", "member_left": "sync_members", "message": "embed_message"}


def task_fanout(events: DataFrame) -> DataFrame:
    """(task_type, key) of each event with a follow-up; events: (event_type, key)."""
    table = F.create_map(*(F.lit(x) for pair in TASKS.items() for x in pair))
    return events.select(table[F.col("event_type")].alias("task_type"), "key").where("task_type IS NOT NULL")


def histogram(df: DataFrame, value: Column, edges: list[float], *by: str) -> DataFrame:
    """Cumulative counts of value <= le, for each edge and infinity."""
    # one row per group first, so that nothing is multiplied by the number of edges
    sums = [F.sum(F.when(value <= e, 1).otherwise(0)).alias(f"e{i}") for i, e in enumerate([*edges, float("inf")])]
    wide = df.groupBy(*by).agg(*sums)
    pairs = F.explode(F.array(*(F.struct(F.lit(float(e)).alias("le"), F.col(f"e{i}").alias("n")) for i, e in enumerate([*edges, float("inf")]))))
    return wide.select(*by, pairs.alias("x")).select(*by, "x.le", "x.n")


#: Messages that a backfill takes of a channel.
PER_CHANNEL = 1000


def latest_per_channel(messages: DataFrame, limit: int, oldest: Column | None = None) -> DataFrame:
    """The newest `limit` messages of each channel that are not older than `oldest`."""
    rows = messages if oldest is None else messages.where(F.col("ts") >= oldest)
    order = Window.partitionBy("channel_id").orderBy(F.desc("ts"), "message_id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def lag_seconds(event_time: Column, ingested: Column) -> Column:
    return (F.unix_micros(ingested) - F.unix_micros(event_time)) / F.lit(1e6)


def filled(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """messages with channel_name and team_id taken from the channel table where they are null."""
    c = channels.select("channel_id", F.col("channel_name").alias("__name"), F.col("team_id").alias("__team"))
    met = messages.join(c, "channel_id", "left")
    return met.withColumns({"channel_name": F.coalesce("channel_name", "__name"), "team_id": F.coalesce("team_id", "__team")}).drop("__name", "__team").select(messages.columns)


def quota(requests: DataFrame, per_hour: int, per_minute: int) -> DataFrame:
    """Admission of each request under fixed windows; a denied request does not count. requests: (event_id, user_id, epoch_s)."""
    minute, hour = F.floor(F.col("epoch_s") / 60), F.floor(F.col("epoch_s") / 3600)
    rows = requests.withColumn("minute", minute).withColumn("hour", hour)
    in_minute = Window.partitionBy("user_id", "minute").orderBy("epoch_s", "event_id")
    in_hour = Window.partitionBy("user_id", "hour").orderBy("epoch_s", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("burst_ok", F.row_number().over(in_minute) <= per_minute)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.col("burst_ok").cast("int")).over(in_hour), F.lit(0)))
    verdict = F.when(F.col("before") >= per_hour, "hour").when(~F.col("burst_ok"), "minute").otherwise("admitted")
    return rows.select("event_id", "user_id", verdict.alias("outcome"))
