"""Event folds, ingestion, dimension upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import folds
from ..sources.views import oracle, view
from .message_queries import _IMPORTANCE_SQL
from .registry import query


def _m(spark, sf_dir):
    return view(spark, sf_dir, "chat_messages")


@query("ingest_dedup", oracle("SELECT message_id, user_id FROM chat_messages WHERE turn % 2 = 1", "chat_messages"))
def ingest_dedup(spark, sf_dir):
    m = _m(spark, sf_dir)
    arriving = m.unionByName(m.where("turn % 3 = 0")).withColumn("arrival", F.col("turn"))
    return folds.insert_new(m.where("turn % 2 = 0"), arriving, "message_id", F.col("arrival"), F.col("user_id")).select("message_id", "user_id")


_CHANGES = "SELECT message_id, epoch_off, event_id, text || ' (edit ' || event_id || ')' AS text FROM (SELECT message_id, text, turn, unnest([1, 2]) AS event_id, unnest([20, 10]) AS epoch_off FROM chat_messages) WHERE turn % 3 = 0"


@query("edit_fold", oracle(f"""
WITH c AS ({_CHANGES}) SELECT m.message_id, arg_max(c.text, c.epoch_off) AS text, trim(regexp_replace(regexp_replace(arg_max(c.text, c.epoch_off), '<#[A-Z0-9]+\\|([^>]+)>', '#\\1', 'g'), '\\s+', ' ', 'g')) AS text_processed, max(c.epoch_off) AS edited_at, count(*) AS n_edits,
  string_agg(c.epoch_off || '=' || CASE WHEN c.epoch_off = 10 THEN m.text ELSE m.text || ' (edit 2)' END, '|' ORDER BY c.epoch_off) AS history
FROM chat_messages m JOIN c USING (message_id) GROUP BY 1""", "chat_messages"))  # fmt: skip
def edit_fold(spark, sf_dir):
    m = _m(spark, sf_dir)
    steps = F.explode(F.array(F.struct(F.lit(1).alias("event_id"), F.lit(20).alias("event_time")), F.struct(F.lit(2).alias("event_id"), F.lit(10).alias("event_time"))))
    changes = m.where("turn % 3 = 0").select("message_id", "text", steps.alias("e")).select("message_id", "e.event_id", "e.event_time", F.concat("text", F.lit(" (edit "), F.col("e.event_id").cast("string"), F.lit(")")).alias("text"))
    out = folds.edits(m, changes)
    history = F.array_join(F.transform("history", lambda h: F.concat(h["timestamp"].cast("string"), F.lit("="), h["old_text"])), "|")
    return out.select("message_id", "text", "text_processed", "edited_at", F.col("n_edits").cast("long").alias("n_edits"), history.alias("history"))


@query("delete_fold", oracle("SELECT message_id FROM chat_messages WHERE (conv_id + turn) % 5 <> 0", "chat_messages"))
def delete_fold(spark, sf_dir):
    m = _m(spark, sf_dir)
    return folds.deleted(m, m.where("(conv_id + turn) % 5 = 0")).select("message_id")


@query("reaction_fold", oracle("""
WITH r AS (SELECT conv_id, turn, name, delta, event_time, event_id, sum(delta) OVER (PARTITION BY conv_id, turn, name ORDER BY event_time, event_id) AS s FROM reaction_events),
t AS (SELECT conv_id, turn, name, CAST(arg_max(s, (event_time, event_id)) - least(min(s), 0) AS BIGINT) AS n, count(*) FILTER (delta > 0) AS adds FROM r GROUP BY 1, 2, 3)
SELECT m.message_id, coalesce(string_agg(name || '=' || n, ',' ORDER BY name) FILTER (n > 0), '') AS reactions, CAST(sum(n) AS BIGINT) AS reaction_count, round(sum(adds) * 0.5E0, 2) AS importance_gain
FROM chat_messages m JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn GROUP BY 1""", "chat_messages", "reaction_events"))
def reaction_fold(spark, sf_dir):
    out = folds.reactions(_m(spark, sf_dir), view(spark, sf_dir, "reaction_events"), ["conv_id", "turn"])
    return out.withColumn("reactions", F.array_join(F.transform("reactions", lambda r: F.concat_ws("=", r["name"], r["n"].cast("string"))), ","))


THREADS_SQL = oracle(f"""
SELECT p.thread_ts, p.channel_id, epoch(any_value(p.ts)) AS started_s, count(r.message_id) AS reply_count, epoch(max(r.ts)) AS last_reply_s, array_to_string(list_sort(list_distinct(list_append(coalesce(list(r.user_id) FILTER (r.user_id IS NOT NULL), []), any_value(p.user_id)))), ',') AS participants,
  len(list_distinct(list_append(coalesce(list(r.user_id) FILTER (r.user_id IS NOT NULL), []), any_value(p.user_id)))) AS participant_count, any_value(p.importance_score) AS importance_score
FROM (SELECT *, {_IMPORTANCE_SQL} AS importance_score FROM chat_messages) p LEFT JOIN chat_messages r ON r.thread_ts = p.thread_ts AND r.message_id <> r.thread_ts WHERE p.thread_ts = p.message_id GROUP BY 1, 2""", "chat_messages")


def scored_messages(spark, sf_dir):
    return _m(spark, sf_dir).withColumn("importance_score", ft.importance(F.col("text"), F.col("reaction_total"), F.col("event_reply_count"), F.col("has_file")))


def thread_rows(rollup):
    return rollup.select("thread_ts", "channel_id", F.unix_timestamp("started_at").cast("double").alias("started_s"), "reply_count", F.unix_timestamp("last_reply_at").cast("double").alias("last_reply_s"), F.array_join("participants", ",").alias("participants"), F.col("participant_count").cast("long").alias("participant_count"), "importance_score")


@query("thread_rollup", THREADS_SQL)
def thread_rollup(spark, sf_dir):
    return thread_rows(folds.thread_rollup(scored_messages(spark, sf_dir)))


@query("member_fold", oracle("""
WITH l AS (SELECT channel_id, user_id, arg_max(action, (event_time, event_id)) AS action FROM member_events GROUP BY 1, 2)
SELECT channel_id, count(*) AS member_count, string_agg(user_id, ',' ORDER BY user_id) AS members FROM l WHERE action = 'joined' GROUP BY 1""", "member_events"))
def member_fold(spark, sf_dir):
    return folds.members(view(spark, sf_dir, "member_events")).select("channel_id", "member_count", F.array_join("member_ids", ",").alias("members"))


_KINDS = {"signup": "member_joined", "click": "message", "view": "file_shared", "error": "member_left", "purchase": "unknown_kind"}


@query("task_fanout", "SELECT CASE event_type WHEN 'click' THEN 'embed_message' WHEN 'view' THEN 'process_file' ELSE 'sync_members' END AS task_type, count(*) AS n, count(DISTINCT user_id) AS n_keys FROM events WHERE event_type IN ('signup', 'click', 'view', 'error') GROUP BY 1")
def task_fanout(spark, sf_dir):
    kinds = F.create_map(*(F.lit(x) for p in _KINDS.items() for x in p))
    e = view(spark, sf_dir, "events").select(kinds[F.col("event_type")].alias("event_type"), F.col("user_id").alias("key"))
    return folds.task_fanout(e).groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))


_LAGS = [0.1, 0.5, 1, 2, 5, 10, 30, 60]


@query("lag_histogram", "SELECT le, count(*) FILTER ((epoch_us(ts + to_microseconds(CAST(round(abs(value) * 1000000) AS BIGINT))) - epoch_us(ts)) / 1000000 <= le) AS n FROM events, (SELECT unnest([0.1, 0.5, 1, 2, 5, 10, 30, 60, 'inf'::DOUBLE]) AS le) GROUP BY 1")
def lag_histogram(spark, sf_dir):
    """An event arrives as many seconds after it happened as its value says."""
    e = view(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrived = F.timestamp_micros(F.unix_micros("ts") + F.round(F.abs("value") * 1000000).cast("long"))
    return folds.histogram(e.withColumn("lag", folds.lag_seconds(F.col("ts"), arrived)), F.col("lag"), _LAGS)


@query("event_counts", "SELECT epoch(date_trunc('minute', ts)) AS minute_s, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts(spark, sf_dir):
    e = view(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.unix_timestamp(F.window("ts", "1 minute")["start"]).cast("double").alias("minute_s"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("backfill_latest_n", oracle("SELECT channel_id, message_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC, message_id) AS n FROM chat_messages WHERE ts >= make_timestamp(1704103200000000) QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC, message_id) <= 1000", "chat_messages"))
def backfill_latest_n(spark, sf_dir):
    return folds.latest_per_channel(_m(spark, sf_dir), folds.PER_CHANNEL, F.timestamp_seconds(F.lit(1704067200 + 36000))).select("channel_id", "message_id", "n")


@query("backfill_counts", oracle("SELECT channel_id, least(count(*), 1000) AS n_added, 100 + least(count(*), 1000) AS total_messages FROM chat_messages WHERE channel_id NOT IN ('C003') GROUP BY 1", "chat_messages"))
def backfill_counts(spark, sf_dir):
    m = _m(spark, sf_dir)
    channels = m.select("channel_id").distinct().select("channel_id", (F.col("channel_id") == "C003").alias("is_archived"), F.lit(100).cast("long").alias("total_messages"))
    taken = folds.latest_per_channel(m.join(channels.where("NOT is_archived"), "channel_id", "left_semi"), folds.PER_CHANNEL)
    added = taken.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n_added"))
    return channels.join(added, "channel_id").select("channel_id", "n_added", (F.col("total_messages") + F.col("n_added")).alias("total_messages"))


@query("thread_backfill", oracle("SELECT message_id, 'chan-x' AS channel_name FROM chat_messages WHERE thread_ts IN (SELECT thread_ts FROM chat_messages WHERE turn = 0 AND conv_id % 6 = 0 AND thread_ts IS NOT NULL)", "chat_messages"))
def thread_backfill(spark, sf_dir):
    m = _m(spark, sf_dir)
    wanted = m.where("turn = 0 AND conv_id % 6 = 0").select("thread_ts")
    return m.join(wanted, "thread_ts", "left_semi").select("message_id", F.lit("chan-x").alias("channel_name"))


@query("dlq_split", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'undecodable' WHEN event_type = 'error' THEN 'unknown type' ELSE 'ok' END AS reason FROM events) GROUP BY 1")
def dlq_split(spark, sf_dir):
    raw = view(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props")).alias("body"))
    reason = F.when(F.from_json("body", "k int", {"mode": "PERMISSIVE"})["k"].isNull(), "undecodable").when(F.col("event_type") == "error", "unknown type").otherwise("ok")
    return raw.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_OLD = "SELECT channel_id, max(channel_name) AS name, count(*) AS topic, 'old' AS created_by, 'never' AS last_seen FROM chat_messages WHERE conv_id % 8 < 6 GROUP BY 1"
_NEW = "SELECT channel_id, max(channel_name) || '-new' AS name, CASE WHEN channel_id = 'C004' THEN NULL ELSE count(*) + 1000 END AS topic, 'new' AS created_by, 'now' AS last_seen FROM chat_messages WHERE conv_id % 8 >= 3 GROUP BY 1"
_UPSERT = f"SELECT coalesce(n.channel_id, o.channel_id) AS channel_id, coalesce(n.name, o.name) AS name, coalesce(n.topic, o.topic) AS topic, coalesce({{first}}) AS created_by, {{last}} AS last_seen FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.channel_id = n.channel_id"


def _upserted(spark, sf_dir, **kinds):
    m = _m(spark, sf_dir)
    agg = lambda df, name, topic, by, seen: df.groupBy("channel_id").agg(name.alias("name"), topic.alias("topic")).withColumns({"created_by": F.lit(by), "last_seen": F.lit(seen)})
    old = agg(m.where("conv_id % 8 < 6"), F.max("channel_name"), F.count(F.lit(1)), "old", "never")
    new = agg(m.where("conv_id % 8 >= 3"), F.concat(F.max("channel_name"), F.lit("-new")), F.count(F.lit(1)) + 1000, "new", "now")
    new = new.withColumn("topic", F.when(F.col("channel_id") != "C004", F.col("topic")))
    return folds.upsert(old, new, "channel_id", **kinds)


@query("channel_upsert", oracle(_UPSERT.format(first="n.created_by, o.created_by", last="coalesce(n.last_seen, o.last_seen)"), "chat_messages"))
def channel_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)


_SEEN = """SELECT user_id, max(user_name) || '{mark}' AS user_name, count(*) % 2 = 0 AS is_bot, 'T{mark}' AS team_id, CAST(min(epoch(ts)) AS BIGINT) AS created_s, CAST(max(epoch(ts)) AS BIGINT) AS last_active_s FROM chat_messages WHERE user_id IS NOT NULL AND conv_id % 8 {part} GROUP BY 1"""
_OLD_USERS, _NEW_USERS = _SEEN.format(mark="-old", part="< 3"), _SEEN.format(mark="-new", part=">= 2")


@query("user_upsert", oracle(f"SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.user_name, o.user_name) AS user_name, coalesce(o.is_bot, n.is_bot) AS is_bot, coalesce(o.team_id, n.team_id) AS team_id, coalesce(o.created_s, n.created_s) AS created_s, CASE WHEN o.user_id IS NOT NULL THEN coalesce(n.last_active_s, o.last_active_s) END AS last_active_s FROM ({_OLD_USERS}) o FULL JOIN ({_NEW_USERS}) n ON o.user_id = n.user_id", "chat_messages"))
def user_upsert(spark, sf_dir):
    """Users seen in messages, into a table of users: is_bot, team and creation stay as inserted, activity is set on updates."""

    def seen(mark, part):
        m = _m(spark, sf_dir).where(f"user_id IS NOT NULL AND conv_id % 8 {part}")
        at = lambda f: f(F.unix_timestamp("ts")).cast("long")
        return m.groupBy("user_id").agg(F.concat(F.max("user_name"), F.lit(mark)).alias("user_name"), (F.count(F.lit(1)) % 2 == 0).alias("is_bot"), F.lit(f"T{mark}").alias("team_id"), at(F.min).alias("created_s"), at(F.max).alias("last_active_s"))

    return folds.upsert(seen("-old", "< 3"), seen("-new", ">= 2"), "user_id", insert_only=("is_bot", "team_id", "created_s"), update_only=("last_active_s",))


@query("backfill_fill", oracle("SELECT message_id, channel_id, CASE WHEN turn % 2 = 0 AND channel_id = 'C005' THEN NULL ELSE channel_name END AS channel_name, CASE WHEN turn % 3 = 0 THEN 'own' WHEN channel_id <> 'C005' THEN 'T-' || channel_id END AS team_id FROM chat_messages", "chat_messages"))
def backfill_fill(spark, sf_dir):
    """Exported messages without channel names or teams get them from the channel table, where it knows the channel."""
    m = _m(spark, sf_dir)
    channels = m.where("channel_id <> 'C005'").select("channel_id", "channel_name").distinct().withColumn("team_id", F.concat(F.lit("T-"), "channel_id"))
    bare = m.select("message_id", "channel_id", F.when(F.col("turn") % 2 == 1, F.col("channel_name")).alias("channel_name"), F.when(F.col("turn") % 3 == 0, "own").alias("team_id"))
    return folds.filled(bare, channels)


@query("distinct_users", oracle("SELECT DISTINCT user_id FROM chat_messages WHERE user_id IS NOT NULL", "chat_messages"))
def distinct_users(spark, sf_dir):
    return _m(spark, sf_dir).where("user_id IS NOT NULL").select("user_id").distinct()


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, sf_dir):
    v = view(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(0).alias("version"))
    new = v.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("version"))
    return folds.first_by(v.unionByName(new), ["vec_id"], F.desc("version")).select("vec_id", "label")


@query("vector_delete", "SELECT vec_id, label FROM embeddings WHERE label <> 3")
def vector_delete(spark, sf_dir):
    v = view(spark, sf_dir, "embeddings").select("vec_id", "label")
    return folds.deleted(v, v.where("label = 3"), "vec_id")


@query("feedback_update", "WITH f AS (SELECT user_id % 40 AS query_id, arg_max(event_id % 5 + 1, (ts, event_id)) AS rating, arg_max(event_id, (ts, event_id)) AS e FROM events WHERE event_type = 'click' GROUP BY 1) SELECT CAST(b.item_id AS BIGINT) AS query_id, CAST(rating AS BIGINT) AS rating, 'm' || e || '|m' || (e + 1) AS clicked, coalesce(rating > 3, false) AS copied FROM benchmark b LEFT JOIN f ON f.query_id = b.item_id")
def feedback_update(spark, sf_dir):
    """The last feedback of each query: its rating, and the two results that were clicked."""
    log = view(spark, sf_dir, "search_queries").select("query_id")
    given = view(spark, sf_dir, "events").where("event_type = 'click'")
    clicked = F.concat(F.lit("m"), F.col("event_id").cast("string"), F.lit("|m"), (F.col("event_id") + 1).cast("string"))
    latest = given.groupBy((F.col("user_id") % 40).alias("query_id")).agg(F.max_by(F.struct((F.col("event_id") % 5 + 1).alias("rating"), clicked.alias("clicked")), F.struct("ts", "event_id")).alias("x"))
    return log.join(latest, "query_id", "left").select("query_id", F.col("x.rating").cast("long").alias("rating"), "x.clicked", F.coalesce(F.col("x.rating") > 3, F.lit(False)).alias("copied"))


@query("quota", oracle("""
WITH r AS (SELECT *, floor(epoch_s / 60) AS mi, floor(epoch_s / 3600) AS ho FROM request_log), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, mi ORDER BY epoch_s, event_id) <= 3 AS ok FROM r),
c AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, ho ORDER BY epoch_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT event_id, user_id, CASE WHEN before >= 100 THEN 'hour' WHEN NOT ok THEN 'minute' ELSE 'admitted' END AS outcome FROM c""", "request_log"))
def quota(spark, sf_dir):
    return folds.quota(view(spark, sf_dir, "request_log"), 100, 3)
