"""Enrichment of messages and analysis of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import messages, search
from ..sources.files import FILE_TYPES, TASKS_PER_CORE, scan
from ..sources.shared import new_path, ready
from ..sources.views import oracle, view
from .registry import query

AS_OF = "2024-02-01 12:34:56"
_W = "[\\p{L}\\p{N}_]+"
# The oracle's engine has no look-behind, so whole words are tested with blanks around every word.
_PAD = "(' ' || regexp_replace(lower(query_text), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' ')"


def join_list(c):
    return F.array_join(c, "|")


@query("enrich_code", oracle(r"""
SELECT message_id, contains(text, '```') AS has_fence,
  array_to_string(list_transform(regexp_extract_all(text, '(?s)```([0-9A-Za-z_]+)?\n(.*?)```', 1), lambda x: CASE WHEN x IS NULL OR x = '' THEN 'unknown' ELSE x END), '|') AS languages,
  CAST(len(regexp_extract_all(text, '(?s)```([0-9A-Za-z_]+)?\n(.*?)```', 2)) AS BIGINT) AS n_blocks,
  array_to_string(regexp_extract_all(text, '(?s)```([0-9A-Za-z_]+)?\n(.*?)```', 2), '|') AS bodies
FROM chat_messages""", "chat_messages"))  # fmt: skip
def enrich_code(spark, sf_dir):
    m = view(spark, sf_dir, "chat_messages")
    return m.select("message_id", F.col("text").contains("```").alias("has_fence"), join_list(ft.code_languages(F.col("text"))).alias("languages"), F.size(ft.code_bodies(F.col("text"))).cast("long").alias("n_blocks"), join_list(ft.code_bodies(F.col("text"))).alias("bodies"))


_LINKS_SQL = r"""list_sort(list_distinct(list_concat(regexp_extract_all(text, '<(https?://[^|>]+)', 1), regexp_extract_all(text, 'https?://[^\s<>"{}|\\^`\[\]]+'))))"""


@query("enrich_links", oracle(f"SELECT message_id, array_to_string({_LINKS_SQL}, '|') AS links, CAST(len({_LINKS_SQL}) AS BIGINT) AS n_links FROM chat_messages", "chat_messages"))
def enrich_links(spark, sf_dir):
    return view(spark, sf_dir, "chat_messages").select("message_id", join_list(ft.links(F.col("text"))).alias("links"), F.size(ft.links(F.col("text"))).cast("long").alias("n_links"))


@query("enrich_mentions", oracle("SELECT message_id, array_to_string(regexp_extract_all(text, '<@([A-Z0-9]+)>', 1), '|') AS mentions FROM chat_messages", "chat_messages"))
def enrich_mentions(spark, sf_dir):
    return view(spark, sf_dir, "chat_messages").select("message_id", join_list(ft.mentions(F.col("text"))).alias("mentions"))


@query("enrich_text", oracle(r"SELECT message_id, trim(regexp_replace(regexp_replace(text, '<#[A-Z0-9]+\|([^>]+)>', '#\1', 'g'), '\s+', ' ', 'g')) AS text_processed FROM chat_messages", "chat_messages"))
def enrich_text(spark, sf_dir):
    return view(spark, sf_dir, "chat_messages").select("message_id", ft.clean(F.col("text")).alias("text_processed"))


_IMPORTANCE_SQL = r"""round(1 + least(0.5E0 * reaction_total, 5) + least(0.3E0 * event_reply_count, 3) + CASE WHEN has_file THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(text, 'https?://[^\s<>"{}|\\^`\[\]]+') THEN 1 ELSE 0 END + CASE WHEN contains(text, '```') THEN 1.5E0 ELSE 0 END + CASE WHEN length(text) > 500 THEN 1 ELSE 0 END, 2)"""


def _importance():
    return ft.importance(F.col("text"), F.col("reaction_total"), F.col("event_reply_count"), F.col("has_file"))


@query("importance", oracle(f"SELECT message_id, {_IMPORTANCE_SQL} AS importance FROM chat_messages", "chat_messages"))
def importance(spark, sf_dir):
    return view(spark, sf_dir, "chat_messages").select("message_id", _importance().alias("importance"))


# Raw events: in a ninth of the messages a bot speaks, in another ninth nobody; every fourth has event_ts only.
_EVENTS = """SELECT message_id, CASE WHEN (conv_id + turn) % 4 = 1 THEN NULL ELSE message_id END AS ts, message_id AS event_ts, CASE WHEN (conv_id * 3 + turn) % 9 < 2 THEN NULL ELSE user_id END AS "user",
  CASE WHEN (conv_id * 3 + turn) % 9 < 2 THEN NULL ELSE user_name END AS username, CASE WHEN (conv_id * 3 + turn) % 9 = 1 THEN 'B' || (conv_id % 5) END AS bot_id, channel_id, channel_name, thread_ts, text, reaction_total, event_reply_count, has_file, conv_id FROM chat_messages"""
_SEEN = r"""regexp_extract_all(text, '(?s)```([0-9A-Za-z_]+)?\n(.*?)```', 1)"""
_LANGS = f"list_sort(list_distinct(list_transform({_SEEN}, lambda x: CASE WHEN x IS NULL OR x = '' THEN 'unknown' ELSE x END)))"


def _events(spark, sf_dir):
    m = view(spark, sf_dir, "chat_messages")
    who = (F.col("conv_id") * 3 + F.col("turn")) % 9
    return m.select(
        F.when((F.col("conv_id") + F.col("turn")) % 4 != 1, F.col("message_id")).alias("ts"), F.col("message_id").alias("event_ts"), F.when(who >= 2, F.col("user_id")).alias("user"), F.when(who >= 2, F.col("user_name")).alias("username"),
        F.when(who == 1, F.concat(F.lit("B"), (F.col("conv_id") % 5).cast("string"))).alias("bot_id"), F.col("channel_id").alias("channel"), "channel_name", "thread_ts", "text", F.lit("message").alias("type"), F.lit(None).cast("string").alias("subtype"),
        F.when(F.col("has_file"), F.array(F.struct(F.concat(F.lit("F"), F.col("conv_id").cast("string")).alias("id")), F.struct(F.lit(None).cast("string").alias("id")))).alias("files"), "reaction_total", "event_reply_count",
    )


_LIST = lambda c: f"CASE WHEN len({c}) > 0 THEN array_to_string({c}, '|') END"
_ROWS_SQL = f"""SELECT message_id, channel_id, channel_name, coalesce("user", 'BOT:' || bot_id) AS user_id, CASE WHEN "user" IS NULL THEN coalesce(username, 'bot') ELSE username END AS user_name, 'T1' AS team_id, thread_ts,
  coalesce(thread_ts = message_id, false) AS is_thread_parent, text, trim(regexp_replace(regexp_replace(text, '<#[A-Z0-9]+\\|([^>]+)>', '#\\1', 'g'), '\\s+', ' ', 'g')) AS text_processed, 'message' AS message_type, CAST(NULL AS VARCHAR) AS subtype,
  CAST(split_part(message_id, '.', 1) AS DOUBLE) AS timestamp_s, len({_SEEN}) > 0 AS has_code, {_LIST(_LANGS)} AS code_languages, has_file AS has_files, CASE WHEN has_file THEN 'F' || conv_id END AS file_ids, len({_LINKS_SQL}) > 0 AS has_links, {_LIST(_LINKS_SQL)} AS links,
  CAST(0 AS BIGINT) AS reaction_count, {_LIST("regexp_extract_all(text, '<@([A-Z0-9]+)>', 1)")} AS mentioned_users, {_IMPORTANCE_SQL} AS importance_score
FROM ({_EVENTS}) WHERE "user" IS NOT NULL OR bot_id IS NOT NULL"""


@query("message_rows", oracle(_ROWS_SQL, "chat_messages"))
def message_rows(spark, sf_dir):
    rows = messages.message_rows(_events(spark, sf_dir), F.lit("T1"))
    lists = {c: join_list(F.col(c)) for c in ("code_languages", "file_ids", "links", "mentioned_users")}
    return rows.withColumns(lists | {"timestamp_s": F.floor(F.unix_micros("timestamp") / 1e6).cast("double")}).drop("timestamp", "reactions", "raw_json")


_META_KEYS = ["message_id", "channel_id", "channel_name", "user_id", "user_name", "thread_ts", "is_thread_parent", "has_code", "reaction_count", "importance_score", "has_files"]


@query("vector_metadata", oracle(f"SELECT message_id, channel_id, channel_name, user_id, user_name, strftime(make_timestamp(CAST(timestamp_s * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS timestamp, coalesce(thread_ts, '') AS thread_ts, is_thread_parent, substr(text, 1, 1000) AS text, has_code, coalesce(code_languages, '') AS code_languages, coalesce(mentioned_users, '') AS mentioned_users, reaction_count, CAST(0 AS BIGINT) AS reply_count, importance_score, has_files FROM ({_ROWS_SQL})", "chat_messages"))
def vector_metadata(spark, sf_dir):
    rows = messages.message_rows(_events(spark, sf_dir), F.lit("T1")).withColumns({"reply_count": F.lit(0).cast("long"), "timestamp": F.timestamp_seconds(F.floor(F.unix_micros("timestamp") / 1e6))})
    out = rows.select(messages.vector_metadata(rows).alias("m")).select("m.*")
    return out.withColumns({c: join_list(F.col(c)) for c in ("code_languages", "mentioned_users")})


_DIM = 16


@query("embed_hash", oracle(f"""
WITH t AS (SELECT message_id, md5(unnest(regexp_extract_all(lower(text), '{_W}'))) AS h FROM chat_messages),
s AS (SELECT message_id, CAST('0x' || substr(h, 1, 4) AS INT) % {_DIM} AS slot, sum(CASE WHEN CAST('0x' || substr(h, 5, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM t GROUP BY 1, 2)
SELECT message_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY message_id)), 6) AS value FROM s QUALIFY v <> 0""", "chat_messages"))
def embed_hash(spark, sf_dir):
    m = view(spark, sf_dir, "chat_messages").select("message_id", "text")
    made = messages.embed(m, "text", messages.hashing_model(_DIM))
    return made.select("message_id", F.posexplode("embedding").alias("slot", "value")).where("value <> 0").select("message_id", "slot", F.round("value", 6).alias("value"))


_CLEAN_SQL = r"trim(regexp_replace(regexp_replace(m.text, '<#[A-Z0-9]+\|([^>]+)>', '#\1', 'g'), '\s+', ' ', 'g'))"


@query("embed_text", oracle(rf"""
WITH c AS (SELECT *, {_LANGS} AS langs FROM chat_messages)
SELECT m.message_id, concat_ws(chr(10), 'Channel: ' || CASE WHEN m.conv_id % 8 = 5 THEN m.channel_id ELSE m.channel_name END, CASE WHEN m.thread_ts <> m.message_id THEN 'Thread Topic: ' || substr(p.text, 1, 200) END,
  'Message: ' || CASE WHEN {_CLEAN_SQL} = '' THEN m.text ELSE {_CLEAN_SQL} END, CASE WHEN len(m.langs) > 0 THEN 'Contains code: ' || array_to_string(m.langs, ', ') END) AS embed_text
FROM c m LEFT JOIN c p ON m.thread_ts = p.message_id""", "chat_messages"))  # fmt: skip
def embed_text(spark, sf_dir):
    """Messages of one channel come without its name."""
    m = view(spark, sf_dir, "chat_messages")
    code = F.array_sort(F.array_distinct(ft.code_languages(F.col("text"))))
    rows = m.withColumns({"channel_name": F.when(F.col("conv_id") % 8 != 5, F.col("channel_name")), "text_processed": ft.clean(F.col("text")), "code_languages": F.when(F.size(code) > 0, code)})
    return messages.embed_texts(rows)


@query("file_embed_text", """
SELECT doc_id AS file_id, 'File: f' || doc_id || '.txt' || chr(10) || 'Title: ' || source || chr(10) || 'Content: ' || substr(text, 1, 10000) AS embed_text
FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL AND text <> ''""")
def file_embed_text(spark, sf_dir):
    files = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "source", "text", F.when(F.col("doc_id") % 3 == 0, "png").otherwise("text").alias("filetype"))
    kept = files.where(F.col("filetype").isin(FILE_TYPES) & (F.col("text") != ""))
    return kept.select("file_id", F.concat_ws("\n", F.concat(F.lit("File: f"), F.col("file_id").cast("string"), F.lit(".txt")), F.concat(F.lit("Title: "), "source"), F.concat(F.lit("Content: "), F.substring("text", 1, 10000))).alias("embed_text"))


_FILE_ENDINGS = ["txt", "py", "png", "MD", "log"]


@query("file_scan", f"""
WITH f AS (SELECT conv_id, 'c' || conv_id || '.' || (ARRAY{_FILE_ENDINGS})[conv_id % 5 + 1] AS file_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) AS body FROM conversations GROUP BY 1)
SELECT file_id, (ARRAY['text', 'python', 'png', 'markdown', 'log'])[conv_id % 5 + 1] AS filetype, CASE WHEN conv_id % 5 IN (0, 1, 3) THEN substr(body, 1, 10000) END AS extracted_text, epoch(TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY) AS expires_s FROM f WHERE conv_id % 3 <> 0""")
def file_scan(spark, sf_dir):
    """Conversations as files; a third of them have been processed before."""
    turns = view(ready(spark), sf_dir, "conversations")
    ending = F.element_at(F.array(*map(F.lit, _FILE_ENDINGS)), (F.col("conv_id") % 5 + 1).cast("int"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t")))), lambda x: x["t"]), "\n").alias("value")
    files = turns.groupBy("conv_id").agg(body).select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), ending).alias("name"), "value", "conv_id")
    folder = new_path(spark, "files")
    # a file takes much longer than its bytes, so that tasks are even by their number
    files.select("name", "value").repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "name").write.partitionBy("name").text(folder)
    done = files.where("conv_id % 3 = 0").select(F.col("name").alias("file_id"))
    found = scan(spark, folder, done, F.lit(AS_OF).cast("timestamp"), F.regexp_extract("path", "/name=([^/]+)/", 1))
    return found.select("file_id", "filetype", "extracted_text", F.unix_timestamp("expires_at").cast("double").alias("expires_s"))


def _queries(spark, sf_dir):
    return view(spark, sf_dir, "search_queries").withColumn("as_of", F.lit(AS_OF).cast("timestamp"))


_INTENT_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_PAD}, ' ({'|'.join(w)}) ') THEN '{k}' END" for k, w in ft.INTENTS.items()) + "], lambda x: x IS NOT NULL)"


@query("q_intents", oracle(f"SELECT query_id, CASE WHEN len({_INTENT_SQL}) = 0 THEN 'factual' ELSE array_to_string({_INTENT_SQL}, '|') END AS intents FROM search_queries", "search_queries"))
def q_intents(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", join_list(ft.intents(F.col("query_text"))).alias("intents"))


_CAPS_SQL = f"list_filter(regexp_extract_all(query_text, '{_W}'), lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9]+'))"
_ENT_SQL = f"""list_concat(list_concat(list_concat(list_transform(regexp_extract_all(query_text, '"([^"]+)"', 1), lambda x: 'quoted:' || x), list_transform({_CAPS_SQL}, lambda x: 'technical:' || x)), list_transform(regexp_extract_all(query_text, '\\b[A-Z]+-[0-9]+\\b'), lambda x: 'ticket:' || x)), list_transform(regexp_extract_all(query_text, 'https?://\\S+'), lambda x: 'url:' || x))"""


_NAMES_SQL = f"""list_concat(list_concat(list_concat(regexp_extract_all(query_text, '"([^"]+)"', 1), {_CAPS_SQL}), regexp_extract_all(query_text, '\\b[A-Z]+-[0-9]+\\b')), regexp_extract_all(query_text, 'https?://\\S+'))"""


@query("q_entities", oracle(f"SELECT query_id, array_to_string({_ENT_SQL}, '|') AS entities FROM search_queries", "search_queries"))
def q_entities(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", join_list(F.transform(ft.entities(F.col("query_text")), lambda e: F.concat_ws(":", e["type"], e["text"]))).alias("entities"))


_DAYS_SQL = "CASE " + " ".join(f"WHEN contains(lower(q), '{p}') THEN {{'phrase': '{p}', 's': {'date_trunc' + chr(40) + chr(39) + 'day' + chr(39) + ', t' + chr(41) if d < 2 else 't'} - INTERVAL {d} DAY, 'e': t}}" for p, d in ft.PHRASE_DAYS.items()) + " END"


@query("q_temporal", oracle(f"""
WITH x AS (SELECT query_id, query_text || CASE CAST(query_id % 5 AS INT) WHEN 0 THEN ' last week' WHEN 1 THEN ' yesterday' WHEN 2 THEN ' on 2024-01-15' WHEN 3 THEN ' on 2024-13-45 after march 3' ELSE '' END AS q, TIMESTAMP '{AS_OF}' AS t FROM search_queries),
y AS (SELECT query_id, {_DAYS_SQL} AS a, regexp_extract(q, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS d, regexp_extract(lower(q), '((after|before) [0-9A-Za-z_]+ [0-9]+)', 1) AS r FROM x)
SELECT query_id, CASE WHEN a IS NOT NULL THEN a.phrase WHEN try_strptime(d, '%Y-%m-%d') IS NOT NULL THEN d WHEN r <> '' THEN r END AS phrase,
  CASE WHEN a IS NOT NULL THEN epoch(a.s) ELSE epoch(try_strptime(d, '%Y-%m-%d')) END AS start_s, CASE WHEN a IS NOT NULL THEN epoch(a.e) ELSE epoch(try_strptime(d, '%Y-%m-%d') + INTERVAL 1 DAY) END AS end_s FROM y""", "search_queries"))  # fmt: skip
def q_temporal(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, [" last week", " yesterday", " on 2024-01-15", " on 2024-13-45 after march 3", ""])), (F.col("query_id") % 5 + 1).cast("int"))
    rows = _queries(spark, sf_dir).withColumn("query_text", F.concat("query_text", ending)).select("query_id", ft.temporal(F.col("query_text"), F.col("as_of")).alias("x"))
    return rows.select("query_id", "x.phrase", F.unix_timestamp("x.start").cast("double").alias("start_s"), F.unix_timestamp("x.end").cast("double").alias("end_s"))


_PLACES = "' in #Eng-Core by alice @Bob.c  in  the ops channel'"
_CHANNELS_SQL = "list_sort(list_distinct(list_concat(list_concat(" + "), ".join(", ".join(f"regexp_extract_all(lower({{q}}), '{p}', 1)" for p in part) for part in (ft.CHANNEL_PATTERNS[:2], ft.CHANNEL_PATTERNS[2:])) + ")))"
_USERS_SQL = f"list_sort(list_distinct(list_concat(regexp_extract_all({{q}}, '{ft.USER_PATTERN}', 1), regexp_extract_all(lower({{q}}), '{ft.BY_PATTERN}', 1))))"


@query("q_channels_users", oracle(f"""
WITH x AS (SELECT query_id, query_text || {_PLACES} AS q FROM search_queries)
SELECT query_id, array_to_string({_CHANNELS_SQL.format(q='q')}, '|') AS channels, array_to_string({_USERS_SQL.format(q='q')}, '|') AS users FROM x""", "search_queries"))  # fmt: skip
def q_channels_users(spark, sf_dir):
    rows = _queries(spark, sf_dir).withColumn("query_text", F.concat("query_text", F.expr(_PLACES)))
    return rows.select("query_id", join_list(F.array_sort(ft.channels(F.col("query_text")))).alias("channels"), join_list(F.array_sort(ft.users(F.col("query_text")))).alias("users"))


def _normal_sql(text: str) -> str:
    out = f"lower({text})"
    for short, long in ft.ABBREVIATIONS.items():
        for _ in range(2):  # neighbours share the character between them
            out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_]){short}([^\\p{{L}}\\p{{N}}_]|$)', '\\1{long}\\2', 'g')"
    return out


@query("q_normalize", oracle(f"SELECT query_id, {_normal_sql(chr(39) + 'db k8s ai, ' + chr(39) + ' || query_text')} AS normalized FROM search_queries", "search_queries"))
def q_normalize(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", ft.normalized(F.concat(F.lit("db k8s ai, "), F.col("query_text"))).alias("normalized"))


@query("q_type", oracle("SELECT query_id, CASE " + " ".join(f"WHEN starts_with(trim(lower(query_text)), '{w}') THEN '{w}'" for w in ft.QUESTION_WORDS) + " WHEN contains(query_text, '?') THEN 'question' ELSE 'statement' END AS question_type, " + " OR ".join(f"contains(lower(query_text), '{p}')" for p in ft.CODE_PARTS) + " AS code_intent FROM search_queries", "search_queries"))
def q_type(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", ft.question_type(F.col("query_text")).alias("question_type"), ft.code_intent(F.col("query_text")).alias("code_intent"))


def _expand_sql(t: str) -> str:
    """A word of the list goes, and the blanks behind it."""
    parts, words = f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')", "[" + ", ".join(f"'{w}'" for w in ft.REMOVED_WORDS) + "]"
    gone = lambda i: f"list_contains({words}, {parts}[{i}])"
    bare = f"trim(array_to_string(list_transform(range(1, len({parts}) + 1), lambda i: CASE WHEN {gone('i')} THEN '' WHEN i > 1 AND {gone('i - 1')} THEN regexp_replace({parts}[i], '^\\s+', '') ELSE {parts}[i] END), ''))"
    return f"list_filter([{t}, CASE WHEN {_normal_sql(t)} <> lower({t}) THEN {_normal_sql(t)} END, CASE WHEN {bare} <> '' AND {bare} <> lower({t}) THEN {bare} END], lambda x: x IS NOT NULL)"


_WH = "'What is the db about ' || query_text"


@query("q_expand", oracle(f"SELECT query_id, CAST(i - 1 AS INTEGER) AS n, v[i] AS variant FROM (SELECT query_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT query_id, {_expand_sql('q')} AS v FROM (SELECT query_id, {_WH} AS q FROM search_queries)))", "search_queries"))
def q_expand(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", F.posexplode(ft.expansions(F.concat(F.lit("What is the db about "), F.col("query_text")))).alias("n", "variant"))


_ANALYSIS_SQL = f"""
SELECT query_id, query_text, {_normal_sql('query_text')} AS normalized_query, CASE WHEN len({_INTENT_SQL}) = 0 THEN 'factual' ELSE array_to_string({_INTENT_SQL}, '|') END AS intents, array_to_string({_ENT_SQL}, '|') AS entities,
  CASE WHEN a IS NOT NULL THEN a.phrase WHEN day IS NOT NULL THEN regexp_extract(q, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) ELSE nullif(regexp_extract(lower(q), '((after|before) [0-9A-Za-z_]+ [0-9]+)', 1), '') END AS phrase,
  CASE WHEN a IS NOT NULL THEN epoch(a.s) ELSE epoch(day) END AS start_s, CASE WHEN a IS NOT NULL THEN epoch(a.e) ELSE epoch(day + INTERVAL 1 DAY) END AS end_s, array_to_string({_CHANNELS_SQL.format(q='query_text')}, '|') AS channels, array_to_string({_USERS_SQL.format(q='query_text')}, '|') AS users,
  {" OR ".join(f"contains(lower(query_text), '{p}')" for p in ft.CODE_PARTS)} AS has_code_intent, CASE {" ".join(f"WHEN starts_with(trim(lower(query_text)), '{w}') THEN '{w}'" for w in ft.QUESTION_WORDS)} WHEN contains(query_text, '?') THEN 'question' ELSE 'statement' END AS question_type
FROM (SELECT *, {_DAYS_SQL} AS a, try_strptime(regexp_extract(q, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '%Y-%m-%d') AS day FROM (SELECT *, query_text AS q, TIMESTAMP '{AS_OF}' AS t FROM search_queries))"""


@query("q_analysis", oracle(_ANALYSIS_SQL, "search_queries"))
def q_analysis(spark, sf_dir):
    a = _queries(spark, sf_dir).select("query_id", ft.analysis(F.col("query_text"), F.col("as_of")).alias("a")).select("query_id", "a.*")
    seconds = lambda c: F.unix_timestamp(f"temporal.{c}").cast("double").alias(f"{c}_s")
    return a.select(
        "query_id", F.col("original_query").alias("query_text"), "normalized_query", join_list(F.col("intents")).alias("intents"), join_list(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["text"]))).alias("entities"), "temporal.phrase", seconds("start"), seconds("end"),
        join_list(F.array_sort("channels")).alias("channels"), join_list(F.array_sort("users")).alias("users"), "has_code_intent", "question_type",
    )


@query("intent_counts", oracle(f"WITH x AS (SELECT CASE WHEN len({_INTENT_SQL}) = 0 THEN ['factual'] ELSE {_INTENT_SQL} END AS i FROM search_queries) SELECT unnest(i) AS intent, count(*) AS n FROM x GROUP BY 1", "search_queries"))
def intent_counts(spark, sf_dir):
    return _queries(spark, sf_dir).select(F.explode(ft.intents(F.col("query_text"))).alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
