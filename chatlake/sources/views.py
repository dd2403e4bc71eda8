"""Chat-shaped views of the given tables. One SQL text serves Spark and the oracle; see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VIEWS = {
    "chat_messages": """
SELECT conv_id, turn,
  concat(CAST(1704067200 + conv_id * 3600 + turn * 60 AS STRING), '.', lpad(CAST(conv_id AS STRING), 6, '0')) AS message_id,
  CASE WHEN conv_id % 4 = 3 THEN NULL
       ELSE concat(CAST(1704067200 + conv_id * 3600 AS STRING), '.', lpad(CAST(conv_id AS STRING), 6, '0')) END AS thread_ts,
  concat('C', lpad(CAST(conv_id % 8 AS STRING), 3, '0')) AS channel_id,
  concat('chan-', CAST(conv_id % 8 AS STRING)) AS channel_name,
  concat('U', lpad(CAST((conv_id * 7 + turn * 3) % 50 AS STRING), 4, '0')) AS user_id,
  concat('user', CAST((conv_id * 7 + turn * 3) % 50 AS STRING)) AS user_name,
  {TS:1704067200 + conv_id * 3600 + turn * 60} AS ts,
  CAST((conv_id * 5 + turn) % 13 AS BIGINT) AS reaction_total,
  CAST(CASE WHEN turn = 0 THEN conv_id % 12 ELSE 0 END AS BIGINT) AS event_reply_count,
  (conv_id + turn) % 9 = 0 AS has_file,
  concat(text,
    CASE WHEN (conv_id + turn) % 10 = 0 THEN concat(chr(10), '```', chr(10), 'select 1', chr(10), '```')
         WHEN (conv_id + turn) % 5 = 0 THEN concat(chr(10), '```py', chr(10), 'x = 1', chr(10), '```') ELSE '' END,
    CASE WHEN (conv_id + turn) % 3 = 0 THEN ' <https://example.com/a|doc> https://example.org/b?x=1' ELSE '' END,
    CASE WHEN (conv_id + turn) % 4 = 0 THEN ' <@U0001> <@U0002> <@U0001>' ELSE '' END,
    CASE WHEN (conv_id + turn) % 6 = 0 THEN ' <#C001|chan-1>' ELSE '' END,
    CASE WHEN (conv_id + turn) % 7 = 0 THEN ' "release plan" ABC-12 Kafka' ELSE '' END) AS text
FROM conversations""",
    "doc_messages": """
SELECT
  concat('D', lpad(CAST(doc_id AS STRING), 8, '0')) AS message_id,
  concat('D', lpad(CAST(CAST(floor(doc_id / 16) AS BIGINT) * 16 AS STRING), 8, '0')) AS thread_ts,
  concat('C', lpad(CAST(CAST(floor(doc_id / 16) AS BIGINT) % 20 AS STRING), 3, '0')) AS channel_id,
  concat('chan-', CAST(CAST(floor(doc_id / 16) AS BIGINT) % 20 AS STRING)) AS channel_name,
  concat('U', lpad(CAST(doc_id % 37 AS STRING), 4, '0')) AS user_id,
  concat('user', CAST(doc_id % 37 AS STRING)) AS user_name,
  {TS:1704067200 + doc_id * 600} AS ts,
  CAST(1 + doc_id % 11 AS DOUBLE) + CASE WHEN n_chars > 500 THEN 1.0E0 ELSE 0.0E0 END AS importance_score,
  CAST(doc_id % 15 AS BIGINT) AS reaction_count,
  CAST(floor((doc_id % 15) / 3) AS BIGINT) AS eyes,
  CASE WHEN doc_id % 6 = 0 THEN concat('F', CAST(doc_id AS STRING)) END AS file_id,
  doc_id % 5 = 0 AS has_code,
  doc_id, lang, text
FROM documents""",
    "search_queries": """
SELECT CAST(item_id AS BIGINT) AS query_id, text AS query_text,
  CASE WHEN item_id % 4 = 1 THEN concat('chan-', CAST(item_id % 20 AS STRING)) END AS channel_filter,
  item_id % 5 = 2 AS has_code_intent
FROM benchmark""",
    "reaction_events": """
SELECT event_id, ts AS event_time, user_id % 16 AS conv_id, event_id % 2 AS turn,
  concat('r', CAST(event_id % 3 AS STRING)) AS name,
  CASE WHEN event_type IN ('click', 'signup') THEN 1 ELSE -1 END AS delta
FROM events WHERE event_type IN ('click', 'signup', 'view')""",
    "member_events": """
SELECT event_id, ts AS event_time, concat('C', lpad(CAST(event_id % 8 AS STRING), 3, '0')) AS channel_id,
  concat('U', lpad(CAST(user_id AS STRING), 4, '0')) AS user_id,
  CASE WHEN event_type = 'error' THEN 'left' ELSE 'joined' END AS action
FROM events""",
    "request_log": """
SELECT event_id, user_id % 5 AS user_id, CAST(floor(CAST(s AS DOUBLE) / 60) AS BIGINT) AS epoch_s
FROM (SELECT event_id, user_id, {EPOCH:ts} AS s FROM events) e""",
    "answers": """
SELECT CAST(item_id AS BIGINT) AS answer_id,
  concat('What about ', substr(text, 1, 40), '?') AS query_text,
  concat(text,
    CASE WHEN item_id % 2 = 0 THEN ' Decided so [#chan-1, @user10, 2024-01-01] and again [#chan-1, @user10, 2024-01-01].' ELSE '' END,
    CASE WHEN item_id % 3 = 0 THEN ' Also [chan-2, user14, 2024-01-01T02].' ELSE '' END,
    CASE WHEN item_id % 5 = 0 THEN concat(' The job certainly runs at 10:30', CASE WHEN item_id % 10 = 0 THEN 'Am' ELSE 'am' END, ' and never stops.') ELSE '' END,
    CASE WHEN item_id % 7 = 0 THEN ' Many say some of it, several a few, most of it.' ELSE '' END,
    CASE WHEN item_id % 11 = 0 THEN ' However I could not tell; it might possibly be unclear.' ELSE '' END) AS answer_text
FROM benchmark""",
}
_BASE = {"chat_messages": "conversations", "doc_messages": "documents", "search_queries": "benchmark", "reaction_events": "events", "member_events": "events", "request_log": "events", "answers": "benchmark"}


def _fill(sql: str, ts: str, epoch: str) -> str:
    for kind, form in (("TS", ts), ("EPOCH", epoch)):
        while (at := sql.find("{" + kind + ":")) >= 0:
            end = sql.index("}", at)
            sql = sql[:at] + form.replace("%s", sql[at + len(kind) + 2 : end]) + sql[end + 1 :]
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or one of the given tables."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _fill(_VIEWS[name], "timestamp_seconds(%s)", "unix_timestamp(CAST(%s AS TIMESTAMP))")
    head, base = sql.rsplit(f"FROM {_BASE[name]}", 1) if name != "request_log" else sql.split("FROM events", 1)
    return spark.sql(f"{head}FROM {{base}}{base}", base=spark.read.parquet(f"{sf_dir}/{_BASE[name]}.parquet"))


def oracle(sql: str, *names: str) -> str:
    """sql with the named views in front of it, for the oracle."""
    parts = [f"{n} AS ({_fill(_VIEWS[n], 'make_timestamp((%s) * 1000000)', 'CAST(floor(epoch(%s)) AS BIGINT)')})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
