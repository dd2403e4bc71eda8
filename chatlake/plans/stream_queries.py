"""Streams over files that Spark writes from the given tables, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, ready
from ..sources.views import oracle, view
from ..streaming import folds, ingest
from .fold_queries import THREADS_SQL, scored_messages, thread_rows
from .registry import query


def _folder(spark, name: str) -> str:
    ready(spark)
    return new_path(spark, f"stream-{name}")


def _put(rows: DataFrame, folder: str) -> None:
    """Envelopes as lines of JSON. rows: event_id, event_time, type, message_id, name, user, text."""
    event = F.struct("type", "message_id", "name", "user", "text")
    rows.select(F.to_json(F.struct(F.lit("T1").alias("team_id"), F.col("event_id").cast("string").alias("event_id"), "event_time", event.alias("event"))).alias("value")).write.mode("append").text(folder)


def _message_events(spark, sf_dir) -> DataFrame:
    m = view(spark, sf_dir, "chat_messages")
    return m.select(F.col("message_id").alias("event_id"), F.col("ts").alias("event_time"), F.lit("message").alias("type"), "message_id", F.lit(None).cast("string").alias("name"), F.col("user_id").alias("user"), "text", "turn")


@query("stream_ingest", oracle("SELECT message_id, user_id AS \"user\", sha256(text) AS text_sha256 FROM chat_messages", "chat_messages"))
def stream_ingest(spark, sf_dir):
    """Every third message is delivered twice, in the same micro-batch or a later one."""
    folder, out = _folder(spark, "in"), _folder(spark, "messages")
    events = _message_events(spark, sf_dir)
    _put(events.unionByName(events.where("turn % 3 = 0")), folder)
    folds.to_end(ingest.new_messages(ingest.read_envelopes(spark, folder)), folds.replacing(out), _folder(spark, "checkpoint"))
    return spark.read.schema("message_id string, user string, text string, event_time timestamp, batch_id int").parquet(out).select("message_id", "user", F.sha2("text", 256).alias("text_sha256"))


@query("stream_reactions", oracle("""
WITH r AS (SELECT conv_id, turn, name, delta, event_time, event_id, sum(delta) OVER (PARTITION BY conv_id, turn, name ORDER BY event_time, event_id) AS s FROM reaction_events)
SELECT conv_id || '/' || turn AS key, name, CAST(arg_max(s, (event_time, event_id)) - least(min(s), 0) AS BIGINT) AS n, count(*) FILTER (delta > 0) AS adds FROM r GROUP BY 1, 2""", "reaction_events"))
def stream_reactions(spark, sf_dir):
    """Two runs of one stream: the older half of the events but for some of its last twelve hours, then the others, which
    come after newer ones."""
    folder, out, checkpoint = _folder(spark, "in"), _folder(spark, "reactions"), _folder(spark, "checkpoint")
    events = view(spark, sf_dir, "reaction_events").select("event_id", F.col("event_time").cast("timestamp").alias("event_time"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "name", "delta")
    half = F.lit(events.agg(F.percentile_approx("event_time", 0.5)).first()[0])
    first = (F.col("event_time") <= half) & ~((F.col("event_id") % 5 == 0) & (F.col("event_time") > half - F.expr("INTERVAL 12 HOURS")))
    for part in (first, ~first):
        events.where(part).write.mode("append").parquet(folder)
        folds.to_end(folds.reaction_segments(spark.readStream.schema(events.schema).parquet(folder)), folds.replacing(out), checkpoint, "update")
    return folds.reaction_counts(spark.read.schema("key string, name string, since timestamp, total long, low long, adds long, batch_id int").parquet(out))


_EDITED = "SELECT message_id, epoch_off, event_id, text || ' (edit ' || event_id || ')' AS text FROM (SELECT message_id, text, turn, unnest([1, 2]) AS event_id, unnest([20, 10]) AS epoch_off FROM chat_messages) WHERE turn % 3 = 0"


@query("stream_edits", oracle(f"""
WITH c AS ({_EDITED}) SELECT m.message_id, arg_max(c.text, c.epoch_off) AS text, epoch(max(m.ts + to_seconds(c.epoch_off))) AS edited_s, count(*) AS n_edits,
  CAST(epoch(min(m.ts + to_seconds(c.epoch_off))) AS BIGINT) || '=' || any_value(m.text) || '|' || CAST(epoch(max(m.ts + to_seconds(c.epoch_off))) AS BIGINT) || '=' || arg_min(c.text, c.epoch_off) AS history
FROM chat_messages m JOIN c USING (message_id) GROUP BY 1""", "chat_messages"))
def stream_edits(spark, sf_dir):
    """Edits of odd conversations come in a run before their messages, and the later edit of each before the earlier."""
    folder, out, checkpoint = _folder(spark, "in"), _folder(spark, "edits"), _folder(spark, "checkpoint")
    m = view(spark, sf_dir, "chat_messages")
    odd = F.col("conv_id") % 2 == 1
    said = m.select(F.when(odd, 1).otherwise(0).alias("run"), "message_id", F.lit("message").alias("kind"), F.col("ts").alias("event_time"), F.lit(0).alias("event_id"), "text")
    steps = F.explode(F.array(F.struct(F.lit(1).alias("event_id"), F.lit(20).alias("off")), F.struct(F.lit(2).alias("event_id"), F.lit(10).alias("off"))))
    edits = m.where("turn % 3 = 0").select("*", steps.alias("e")).select(
        F.when(odd & (F.col("e.event_id") == 1), 0).otherwise(1).alias("run"), "message_id", F.lit("edit").alias("kind"), (F.col("ts") + F.make_dt_interval(secs=F.col("e.off"))).alias("event_time"), F.col("e.event_id"),
        F.concat("text", F.lit(" (edit "), F.col("e.event_id").cast("string"), F.lit(")")).alias("text"),
    )
    events = said.unionByName(edits)
    for run in (0, 1):
        events.where(F.col("run") == run).drop("run").write.mode("append").parquet(folder)
        folds.to_end(folds.edited(spark.readStream.schema(events.drop("run").schema).parquet(folder)), folds.replacing(out), checkpoint, "update")
    kept = folds.latest(spark.read.schema("message_id string, text string, text_processed string, edited_at timestamp, n_edits int, history array<struct<timestamp:timestamp,old_text:string>>, batch_id int").parquet(out), "message_id")
    seconds = lambda c: F.unix_timestamp(c).cast("double")
    history = F.array_join(F.transform("history", lambda h: F.concat(F.unix_timestamp(h["timestamp"]).cast("string"), F.lit("="), h["old_text"])), "|")
    return kept.select("message_id", "text", seconds("edited_at").alias("edited_s"), F.col("n_edits").cast("long").alias("n_edits"), history.alias("history"))


@query("stream_threads", THREADS_SQL)
def stream_threads(spark, sf_dir):
    """Replies of every other thread come in a run before the message that starts it."""
    folder, out, checkpoint = _folder(spark, "in"), _folder(spark, "threads"), _folder(spark, "checkpoint")
    m = scored_messages(spark, sf_dir).select("message_id", "thread_ts", "channel_id", "user_id", "ts", "importance_score", "conv_id")
    early = (F.col("thread_ts") != F.col("message_id")) & (F.col("conv_id") % 2 == 0)
    for part in (F.coalesce(early, F.lit(False)), F.coalesce(~early, F.lit(True))):
        m.where(part).write.mode("append").parquet(folder)
        folds.to_end(folds.threads(spark.readStream.schema(m.schema).parquet(folder)), folds.replacing(out), checkpoint, "update")
    kept = spark.read.schema("thread_ts string, channel_id string, started_at timestamp, reply_count long, last_reply_at timestamp, participants array<string>, participant_count int, importance_score double, batch_id int").parquet(out)
    return thread_rows(folds.latest(kept, "thread_ts"))


@query("stream_resume", oracle("SELECT CAST(turn % 2 AS INT) AS run, count(*) AS n FROM chat_messages GROUP BY 1", "chat_messages"))
def stream_resume(spark, sf_dir):
    """Two runs with one checkpoint: the second takes only the files that the first did not see."""
    folder, checkpoint = _folder(spark, "in"), _folder(spark, "checkpoint")
    events, runs = _message_events(spark, sf_dir), None
    for run in (0, 1):
        out = _folder(spark, f"run{run}")
        _put(events.where(F.col("turn") % 2 == run), folder)
        folds.to_end(ingest.read_envelopes(spark, folder).select("event_id"), folds.replacing(out), checkpoint)
        rows = spark.read.schema("event_id string, batch_id int").parquet(out).select(F.lit(run).alias("run"))
        runs = rows if runs is None else runs.unionByName(rows)
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("stream_expiry", "SELECT event_type AS type, late, count(*) AS n FROM (SELECT event_type, event_id % 2 = 1 AND ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 24 HOUR AS late FROM events) GROUP BY 1, 2")
def stream_expiry(spark, sf_dir):
    """Events with an odd id come after all the others: those a day behind the newest by then are late."""
    folder, out, checkpoint = _folder(spark, "in"), _folder(spark, "kept"), _folder(spark, "checkpoint")
    e = view(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    events = e.select("event_id", F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("type"), none.alias("message_id"), none.alias("name"), F.col("user_id").cast("string").alias("user"), none.alias("text"))
    for run in (0, 1):
        _put(events.where(F.col("event_id") % 2 == run), folder)
        folds.to_end(ingest.read_envelopes(spark, folder), folds.expiring(out), checkpoint)
    kept = spark.read.schema("event_id string, event_time timestamp, type string, batch_id int").parquet(f"{out}/events")
    late = spark.read.schema("type string, n long, batch_id int").parquet(f"{out}/late").groupBy("type").agg(F.sum("n").alias("n")).select("type", F.lit(True).alias("late"), "n")
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", F.lit(False).alias("late"), "n").unionByName(late)


@query("stream_convo_expire", """
WITH t AS (SELECT conv_id, 1704067200 + conv_id * 3600 + turn * 60 AS at_s FROM conversations), c AS (SELECT conv_id, min(at_s) AS first_s, max(at_s) AS last_s, count(*) AS turns FROM t GROUP BY 1)
SELECT * FROM c WHERE last_s + 86400 <= (SELECT max(at_s) FROM t) - 3600""")
def stream_convo_expire(spark, sf_dir):
    """Two runs, of the earlier and the later half of the time; the state of an expired conversation is gone."""
    folder, out, checkpoint = _folder(spark, "in"), _folder(spark, "expired"), _folder(spark, "checkpoint")
    turns = view(spark, sf_dir, "conversations").select("conv_id", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("at"))
    half = F.lit(turns.agg(F.percentile_approx("at", 0.5)).first()[0])
    for part in (F.col("at") <= half, F.col("at") > half):
        turns.where(part).write.mode("append").parquet(folder)
        folds.to_end(folds.expired_conversations(spark.readStream.schema(turns.schema).parquet(folder)), folds.replacing(out), checkpoint)
    gone = spark.read.schema(f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, started_at timestamp, last_at timestamp, turns long, batch_id int").parquet(out)
    return gone.select("conv_id", F.unix_timestamp("started_at").alias("first_s"), F.unix_timestamp("last_at").alias("last_s"), "turns")
