"""Analytics over logs and messages, and the entity graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators.folds import histogram
from ..operators.graph import co_occurrences, entity_counts, weighed_pairs
from ..operators.quantiles import exact_quantile
from ..sources.shared import written
from ..sources.views import oracle, view
from .message_queries import _INTENT_SQL
from .registry import query


def _m(spark, sf_dir):
    return view(spark, sf_dir, "chat_messages")


@query("table_counts", oracle("SELECT 'messages' AS name, count(*) AS n FROM chat_messages UNION ALL SELECT 'channels', count(DISTINCT channel_id) FROM chat_messages UNION ALL SELECT 'users', count(DISTINCT user_id) FROM chat_messages UNION ALL SELECT 'vectors', count(*) FROM embeddings", "chat_messages"))
def table_counts(spark, sf_dir):
    one = _m(spark, sf_dir).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("channel_id").alias("channels"), F.count_distinct("user_id").alias("users"))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in one.columns))).alias("x")).select("x.*")
    return rows.unionByName(view(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n")).select(F.lit("vectors").alias("name"), "n"))


_TOP = f"(SELECT string_agg(intent || ':' || n, '|' ORDER BY n DESC, intent) FROM (SELECT * FROM (SELECT unnest(string_split(intents, '|')) AS intent, count(*) AS n FROM (SELECT CASE WHEN len({_INTENT_SQL}) = 0 THEN 'factual' ELSE array_to_string({_INTENT_SQL}, '|') END AS intents FROM search_queries) GROUP BY 1) ORDER BY n DESC, intent LIMIT 5))"


@query("search_stats", oracle(f"SELECT count(*) AS total_queries, round(avg(value), 6) AS avg_latency, round(avg(CASE WHEN event_id % 4 = 0 THEN 1E0 ELSE 0E0 END), 6) AS cache_hit_rate, {_TOP} AS top_intents FROM events", "search_queries"))
def search_stats(spark, sf_dir):
    """Over the request log, with the five intents that queries have most often (a report)."""
    one = view(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("total_queries"), F.round(F.avg("value"), 6).alias("avg_latency"), F.round(F.avg((F.col("event_id") % 4 == 0).cast("double")), 6).alias("cache_hit_rate"))
    found = view(spark, sf_dir, "search_queries").select(F.explode(ft.intents(F.col("query_text"))).alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    # one row of each intent, and there are seven
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "intent", "n")))
    return one.crossJoin(F.broadcast(found.agg(F.array_join(F.transform(F.slice(ranked, 1, 5), lambda x: F.concat_ws(":", x["intent"], x["n"].cast("string"))), "|").alias("top_intents"))))


_EDGES = [0.1, 0.5, 1, 2, 3, 5, 10]


@query("latency_hist", "SELECT event_type AS stage, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([0.1, 0.5, 1, 2, 3, 5, 10, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2")
def latency_hist(spark, sf_dir):
    return histogram(view(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), F.col("value"), _EDGES, "stage")


@query("latency_p95", "SELECT event_type AS stage, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_p95(spark, sf_dir):
    return exact_quantile(view(spark, sf_dir, "events"), F.col("value"), 0.95, "event_type").select(F.col("event_type").alias("stage"), F.col("quantile").alias("p95"))


@query("rating_counts", "SELECT event_id % 5 + 1 AS rating, count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1E0 ELSE 0E0 END), 6) AS click_rate, CASE WHEN event_id % 5 + 1 > 3 THEN 1E0 ELSE 0E0 END AS copy_rate FROM events GROUP BY 1, 4")
def rating_counts(spark, sf_dir):
    return view(spark, sf_dir, "events").groupBy((F.col("event_id") % 5 + 1).alias("rating")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("event_type") == "click").cast("double")), 6).alias("click_rate"), F.avg((F.col("event_id") % 5 + 1 > 3).cast("double")).alias("copy_rate"))


@query("channel_activity", oracle("SELECT channel_id, count(*) AS total_messages, count(DISTINCT user_id) AS active_users, epoch(max(ts)) AS last_s, round(count(*) / greatest(1, floor((epoch(max(ts)) - epoch(min(ts))) / 86400) + 1), 6) AS messages_per_day FROM chat_messages GROUP BY 1", "chat_messages"))
def channel_activity(spark, sf_dir):
    span = F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400) + 1
    return _m(spark, sf_dir).groupBy("channel_id").agg(F.count(F.lit(1)).alias("total_messages"), F.count_distinct("user_id").alias("active_users"), F.unix_timestamp(F.max("ts")).cast("double").alias("last_s"), F.round(F.count(F.lit(1)) / F.greatest(F.lit(1), span), 6).alias("messages_per_day"))


@query("user_activity", oracle("SELECT user_id, count(*) AS total_messages, count(DISTINCT channel_id) AS active_channels_count, array_to_string(list_sort(list_distinct(list(channel_id))), ',') AS channels, epoch(max(ts)) AS last_s FROM chat_messages GROUP BY 1", "chat_messages"))
def user_activity(spark, sf_dir):
    return _m(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("total_messages"), F.count_distinct("channel_id").alias("active_channels_count"), F.array_join(F.array_sort(F.collect_set("channel_id")), ",").alias("channels"), F.unix_timestamp(F.max("ts")).cast("double").alias("last_s"))


@query("user_terms", oracle(r"""
WITH t AS (SELECT user_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM chat_messages), c AS (SELECT user_id, term, count(*) AS n FROM t WHERE length(term) > 3 GROUP BY 1, 2)
SELECT user_id, term, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, term) <= 5""", "chat_messages"))
def user_terms(spark, sf_dir):
    terms = _m(spark, sf_dir).select("user_id", F.explode(ft.all_of(F.lower("text"), ft.WORD)).alias("term")).where(F.length("term") > 3)
    counts = terms.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "term"))).where("r <= 5").drop("r")


@query("thread_totals", oracle("SELECT thread_ts, CAST(sum(reaction_total) AS BIGINT) AS total_reactions, epoch(max(ts)) >= 1704067200 + 40 * 3600 AS is_active FROM chat_messages WHERE thread_ts IS NOT NULL GROUP BY 1", "chat_messages"))
def thread_totals(spark, sf_dir):
    return _m(spark, sf_dir).where("thread_ts IS NOT NULL").groupBy("thread_ts").agg(F.sum("reaction_total").alias("total_reactions"), (F.unix_timestamp(F.max("ts")) >= 1704067200 + 40 * 3600).alias("is_active"))


_KINDS = [("quoted", r"""regexp_extract_all(text, '"([^"]+)"', 1)"""), ("technical", r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9]+'))"), ("ticket", r"regexp_extract_all(text, '\b[A-Z]+-[0-9]+\b')"), ("url", r"regexp_extract_all(text, 'https?://\S+')")]
_TEXTS = "(SELECT message_id, channel_id, ts, text FROM chat_messages UNION ALL SELECT message_id, channel_id, ts, text FROM doc_messages)"
_TYPED = " UNION ".join(f"SELECT message_id, channel_id, ts, '{k}' AS type, trim(lower(unnest({x}))) AS entity FROM {_TEXTS}" for k, x in _KINDS)
_ENT = f"SELECT DISTINCT message_id, channel_id, ts, entity FROM ({_TYPED})"
_KG = ("chat_messages", "doc_messages")


def _entities(spark, sf_dir):
    """Each message and document, with an expression for the entities in its text, which may repeat: their names in lower case and kinds."""
    parts = [view(spark, sf_dir, n).select("message_id", "channel_id", "ts", "text") for n in _KG]
    return parts[0].unionByName(parts[1]), F.transform(ft.entities(F.col("text")), lambda e: F.struct(F.trim(F.lower(e["text"])).alias("name"), e["type"].alias("type")))


@query("kg_entities", oracle(f"WITH e AS ({_TYPED}), k AS (SELECT entity, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM e GROUP BY 1), n AS (SELECT entity, count(*) AS occurrence_count, count(DISTINCT channel_id) AS channel_count, array_to_string(list_sort(list_distinct(list(channel_id))), ',') AS related_channels, epoch(min(ts)) AS first_s, epoch(max(ts)) AS last_s FROM (SELECT DISTINCT message_id, channel_id, ts, entity FROM e) GROUP BY 1) SELECT n.*, types FROM n JOIN k USING (entity)", *_KG))
def kg_entities(spark, sf_dir):
    """related_channels has each channel once, so it is bounded by the number of channels."""
    texts, found = _entities(spark, sf_dir)
    seen = texts.select("channel_id", "ts", F.array_distinct(found).alias("found")).withColumn("names", F.array_distinct(F.transform("found", lambda e: e["name"])))
    rows = seen.select("channel_id", "ts", F.explode(F.transform("names", lambda n: F.struct(n.alias("entity"), F.transform(F.filter("found", lambda f: f["name"] == n), lambda f: f["type"]).alias("types")))).alias("x")).select("channel_id", "ts", "x.*")
    is_a = [F.max(F.array_contains("types", k).cast("int")).alias(k) for k, _ in _KINDS]
    out = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("occurrence_count"), F.collect_set("channel_id").alias("c"), F.unix_timestamp(F.min("ts")).cast("double").alias("first_s"), F.unix_timestamp(F.max("ts")).cast("double").alias("last_s"), *is_a)
    types = F.array_join(F.array_compact(F.array(*(F.when(F.col(k) == 1, k) for k, _ in _KINDS))), ",")
    return out.select("entity", "occurrence_count", F.size("c").cast("long").alias("channel_count"), F.array_join(F.array_sort("c"), ",").alias("related_channels"), "first_s", "last_s", types.alias("types"))


_PAIRS = f"WITH e AS ({_ENT}), o AS (SELECT entity, count(*) AS n FROM e GROUP BY 1), p AS (SELECT a.entity AS entity_1, b.entity AS entity_2, count(*) AS n, count(DISTINCT a.channel_id) AS channels, epoch(min(a.ts)) AS first_s, epoch(max(a.ts)) AS last_s FROM e a JOIN e b ON a.message_id = b.message_id AND a.entity < b.entity GROUP BY 1, 2)"


def _mentions(spark, sf_dir):
    """The names of each message, each once, written, as they are read for counts and for pairs, and the counts of each name.
    Rows of one message are put together."""
    texts, found = _entities(spark, sf_dir)
    names = texts.select("message_id", "channel_id", "ts", F.array_distinct(F.transform(found, lambda e: e["name"])).alias("names"))
    rows = written(names.groupBy("message_id", "channel_id", "ts").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")), "kg-mentions")
    return rows, written(entity_counts(rows), "kg-counts")


@query("kg_edges", oracle(f"{_PAIRS} SELECT entity_1, entity_2, p.n AS co_occurrence_count, channels, first_s, last_s, round(p.n / least(x.n, y.n), 6) AS confidence FROM p JOIN o x ON x.entity = entity_1 JOIN o y ON y.entity = entity_2", *_KG))
def kg_edges(spark, sf_dir):
    seconds = lambda c: F.unix_timestamp(f"{c}_ts").cast("double").alias(f"{c}_s")
    met = weighed_pairs(*_mentions(spark, sf_dir))
    return met.select("entity_1", "entity_2", F.col("n").alias("co_occurrence_count"), "channels", seconds("first"), seconds("last"), F.round(F.col("n") / F.col("fewer"), 6).alias("confidence"))


@query("kg_related", oracle(f"{_PAIRS}, b AS (SELECT entity_1 AS entity, entity_2 AS other, n FROM p UNION ALL SELECT entity_2, entity_1, n FROM p) SELECT entity, other, n FROM b", *_KG))
def kg_related(spark, sf_dir):
    e = co_occurrences(*_mentions(spark, sf_dir))
    return e.select(F.explode(F.array(F.struct(F.col("entity_1").alias("entity"), F.col("entity_2").alias("other"), "n"), F.struct(F.col("entity_2").alias("entity"), F.col("entity_1").alias("other"), "n"))).alias("x")).select("x.*")
