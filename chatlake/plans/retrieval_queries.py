"""Hybrid retrieval, its parts, and the thread context around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as cx
from ..operators import messages
from ..operators import search
from ..operators.folds import thread_rollup
from ..sources.shared import written
from ..sources.views import oracle, view
from .message_queries import _ANALYSIS_SQL, _CHANNELS_SQL, _LINKS_SQL, _NAMES_SQL, AS_OF, join_list
from .message_queries import _DAYS_SQL as DAYS_SQL
from .registry import query

_VIEWS = ("search_queries", "doc_messages")


def _sources(spark, sf_dir):
    return view(spark, sf_dir, "search_queries"), view(spark, sf_dir, "doc_messages"), view(spark, sf_dir, "embeddings")


def _lists(spark, sf_dir):
    q, m, v = _sources(spark, sf_dir)
    return m, search.fuse(semantic=search.semantic(q, m, v, filtered=True), keyword=search.keyword(q, m), entity=search.entity(q, m))


# Queries with the users and the time range of their texts.
_Q = rf"""(SELECT query_id, query_text, channel_filter, has_code_intent, {_CHANNELS_SQL.format(q='q')} AS channels, list_concat(regexp_extract_all(q, '@([A-Za-z0-9_.-]+)', 1), regexp_extract_all(lower(q), 'by ([a-z0-9_.-]+)', 1)) AS users, CASE WHEN a IS NOT NULL THEN a.s ELSE day END AS start_at, CASE WHEN a IS NOT NULL THEN a.e ELSE day + INTERVAL 1 DAY END AS end_at
  FROM (SELECT *, {DAYS_SQL} AS a, try_strptime(regexp_extract(q, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '%Y-%m-%d') AS day FROM (SELECT *, query_text AS q, TIMESTAMP '{search.AS_OF}' AS t FROM search_queries)))"""


def _semantic_sql(where: str) -> str:
    return f"""SELECT query_id, message_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, message_id) AS rank FROM (
  SELECT q.query_id, m.message_id, round(list_inner_product(CAST(qv.embedding AS DOUBLE[]), CAST(mv.embedding AS DOUBLE[]))
    / (sqrt(list_inner_product(CAST(qv.embedding AS DOUBLE[]), CAST(qv.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(mv.embedding AS DOUBLE[]), CAST(mv.embedding AS DOUBLE[])))), 9) AS score
  FROM {_Q} q JOIN embeddings qv ON qv.vec_id = q.query_id, doc_messages m JOIN embeddings mv ON mv.vec_id = m.doc_id WHERE {where})
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, message_id) <= 100"""


_FILTER = "(q.channel_filter IS NULL OR q.channel_filter = m.channel_name) AND (NOT q.has_code_intent OR m.has_code) AND (q.start_at IS NULL OR m.ts >= q.start_at) AND (q.end_at IS NULL OR m.ts <= q.end_at)"
_IN = "coalesce(len(list_intersect(q.channels, (SELECT list(DISTINCT channel_name) FROM doc_messages))) = 0 OR list_contains(q.channels, m.channel_name), false)"
_BY_USER = "(len(q.channels) = 0 OR coalesce(list_contains(q.channels, m.channel_name), false)) AND (len(q.users) = 0 OR coalesce(list_contains(q.users, m.user_name), false) OR list_has_any(q.users, regexp_extract_all(m.text, '<@([A-Z0-9]+)>', 1)))"
_KEYWORD = f"""SELECT query_id, message_id, round((50 - (rank - 1)) / 50 * 0.5E0 + importance_score / 10 * 0.5E0, 9) AS score, rank FROM (
  SELECT q.query_id, m.message_id, m.importance_score, row_number() OVER (PARTITION BY q.query_id ORDER BY m.importance_score DESC, m.message_id) AS rank
  FROM {_Q} q, doc_messages m WHERE {_FILTER} AND {_BY_USER} AND contains(lower(m.text), lower(q.query_text))) WHERE rank <= 50"""
_NEEDLES = r"""SELECT query_id, list_transform(list_concat(list_concat(list_concat(regexp_extract_all(query_text, '"([^"]+)"', 1), list_filter(regexp_extract_all(query_text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9]+'))),
  regexp_extract_all(query_text, '\b[A-Z]+-[0-9]+\b')), regexp_extract_all(query_text, 'https?://\S+')), lambda x: lower(x)) AS needles FROM search_queries"""
_ENTITY = f"""SELECT query_id, message_id, round(len(list_filter(needles, lambda x: contains(lower(text), x))) / len(needles) * 0.7E0 + importance_score / 10 * 0.3E0, 9) AS score, rank FROM (
  SELECT q.query_id, m.message_id, m.importance_score, m.text, q.needles, row_number() OVER (PARTITION BY q.query_id ORDER BY m.importance_score DESC, m.message_id) AS rank
  FROM ({_NEEDLES}) q, doc_messages m WHERE len(list_filter(q.needles, lambda x: contains(lower(m.text), x))) > 0) WHERE rank <= 30"""
_FUSED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, message_id) AS rank FROM (
  SELECT query_id, message_id, round(sum(1.0E0 / (60 + rank)), 12) AS rrf, count(*) AS n_sources, min(source * 1000 + rank) AS first FROM (
    SELECT query_id, message_id, rank, 0 AS source FROM ({_semantic_sql(_FILTER + ' AND ' + _IN)}) UNION ALL SELECT query_id, message_id, rank, 1 FROM ({_KEYWORD}) UNION ALL SELECT query_id, message_id, rank, 2 FROM ({_ENTITY})) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, message_id) <= 200"""
_FULL = f"""SELECT query_id, message_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, fused_rank) AS rank, channel_id, text FROM (
  SELECT f.query_id, f.message_id, f.rank AS fused_rank, m.channel_id, substr(m.text, 1, 500) AS text, CASE WHEN count(*) OVER (PARTITION BY f.query_id) > 10 THEN round(0.4E0 * rrf + 0.2E0 * importance_score / 10
    + 0.15E0 * exp(-floor((epoch_us(TIMESTAMP '{search.AS_OF}') - epoch_us(ts)) / 86400000000) / 30.0E0) + 0.1E0 * CASE WHEN first < 1000 THEN least(reaction_count / 10, 1.0E0) ELSE 0 END
    + 0.1E0 * CASE WHEN first < 1000 AND has_code THEN 1 ELSE 0 END + 0.05E0 * n_sources / 3, 9) ELSE rrf END AS relevance
  FROM ({_FUSED}) f JOIN doc_messages m USING (message_id))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, fused_rank) <= 10"""


@query("vector_topk", oracle(_semantic_sql("true"), *_VIEWS))
def vector_topk(spark, sf_dir):
    return search.semantic(*_sources(spark, sf_dir))


@query("vector_topk_filtered", oracle(_semantic_sql(_FILTER + ' AND ' + _IN), *_VIEWS))
def vector_topk_filtered(spark, sf_dir):
    return search.semantic(*_sources(spark, sf_dir), filtered=True)


@query("keyword_topk", oracle(_KEYWORD, *_VIEWS))
def keyword_topk(spark, sf_dir):
    q, m, _ = _sources(spark, sf_dir)
    return search.keyword(q, m)


@query("entity_topk", oracle(_ENTITY, *_VIEWS))
def entity_topk(spark, sf_dir):
    q, m, _ = _sources(spark, sf_dir)
    return search.entity(q, m)


@query("hybrid_rrf", oracle(f"SELECT query_id, message_id, rrf, n_sources, rank FROM ({_FUSED})", *_VIEWS))
def hybrid_rrf(spark, sf_dir):
    return _lists(spark, sf_dir)[1].select("query_id", "message_id", "rrf", "n_sources", "rank")


def _results(spark, sf_dir):
    """The messages, and the ten results of each query: written, as every part of the context reads them."""
    m, fused = _lists(spark, sf_dir)
    return m, written(search.rerank(fused, m), "results")


@query("hybrid_full", oracle(f"SELECT query_id, message_id, round(relevance, 8) AS relevance, rank, text, concat('https://chat.example/archives/', channel_id, '/p', replace(message_id, '.', '')) AS permalink FROM ({_FULL})", *_VIEWS))
def hybrid_full(spark, sf_dir):
    _, r = _results(spark, sf_dir)
    # rounded as the oracle's engine does, by a product: relevance has 9 places, so ties at 8 are common
    return r.select("query_id", "message_id", (F.round(F.col("relevance") * 1e8) / 1e8).alias("relevance"), "rank", "text", search.permalink(F.col("channel_id"), F.col("message_id")).alias("permalink"))


@query("query_log", oracle(f"SELECT query_id, query_text, split_part(intents, '|', 1) AS intent_type, entities, start_s, end_s, channels, coalesce(n, 0) AS results_count FROM ({_ANALYSIS_SQL}) LEFT JOIN (SELECT query_id, count(*) AS n FROM ({_FULL}) GROUP BY 1) USING (query_id)", *_VIEWS))
def query_log(spark, sf_dir):
    log = messages.query_log(view(spark, sf_dir, "search_queries"), _results(spark, sf_dir)[1], F.lit(AS_OF).cast("timestamp"))
    seconds = lambda c: F.unix_timestamp(f"date_range_{c}").cast("double").alias(f"{c}_s")
    return log.select("query_id", "query_text", "intent_type", join_list(F.transform("entities_extracted", lambda e: F.concat_ws(":", e["type"], e["text"]))).alias("entities"), seconds("start"), seconds("end"), join_list(F.array_sort("channel_filters")).alias("channels"), "results_count")


@query("precision_at_k", oracle(f"""
WITH good AS (SELECT DISTINCT 'D' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS message_id FROM labels WHERE quality = 1), h AS (SELECT r.query_id, r.rank, CASE WHEN g.message_id IS NULL THEN 0E0 ELSE 1E0 END AS good FROM ({_FULL}) r LEFT JOIN good g USING (message_id)),
p AS (SELECT query_id, k, avg(good) AS p FROM h, (VALUES (1), (5), (10)) t(k) WHERE rank <= k GROUP BY 1, 2)
SELECT k, round(avg(p), 6) AS precision, count(*) AS n_queries FROM p GROUP BY 1""", *_VIEWS))
def precision_at_k(spark, sf_dir):
    good = view(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("message_id"))
    return search.precision_at(_results(spark, sf_dir)[1], good)


# Thread context around the reranked results of the three lists. The threads' own rows come first: who takes part in a thread is
# known there, whatever is kept of its messages.
_HITS = f"SELECT query_id, message_id, relevance AS score FROM ({_FULL})"
_THREADS = """SELECT p.message_id AS thread, list_sort(list_distinct(list_append(coalesce(list(r.user_id) FILTER (r.user_id IS NOT NULL), []), any_value(p.user_id)))) AS people, count(r.message_id) AS replies, any_value(p.importance_score) AS importance
FROM doc_messages p LEFT JOIN doc_messages r ON r.thread_ts = p.message_id AND r.message_id <> p.message_id WHERE p.thread_ts = p.message_id GROUP BY 1"""
_ROWS = f"""SELECT w.query_id, b.thread_ts AS thread, b.message_id, b.ts, b.user_id, b.user_name, b.channel_id, b.channel_name, row_number() OVER (PARTITION BY w.query_id, b.thread_ts ORDER BY b.ts, b.message_id) - 1 AS pos,
  count(*) OVER (PARTITION BY w.query_id, b.thread_ts) AS thread_size, h.score IS NOT NULL AS relevant, coalesce(h.score, 0) AS score
FROM (SELECT DISTINCT query_id, thread_ts FROM hits JOIN doc_messages USING (message_id)) w JOIN doc_messages b ON b.thread_ts = w.thread_ts LEFT JOIN hits h ON h.query_id = w.query_id AND h.message_id = b.message_id"""
_KEPT = """SELECT *, sum(CASE WHEN keep THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, thread) AS left_out FROM (SELECT *, thread_size <= 10 OR pos = 0 OR relevant OR coalesce(lag(relevant) OVER w AND lag(pos) OVER w >= 1, false) OR coalesce(lead(relevant) OVER w AND pos >= 1, false) AS keep
  FROM r WINDOW w AS (PARTITION BY query_id, thread ORDER BY pos)) QUALIFY true"""
_WITH = f"WITH hits AS MATERIALIZED ({_HITS}), t AS ({_THREADS}), r AS ({_ROWS}), k0 AS ({_KEPT}), k1 AS (SELECT * EXCLUDE (keep) FROM k0 WHERE keep), k AS (SELECT * FROM k1 UNION ALL SELECT query_id, thread, '{cx.SUMMARY}', NULL, NULL, NULL, channel_id, channel_name, thread_size, thread_size, false, 0, left_out FROM k1 WHERE pos = 0 AND left_out > 0)"
_SCORED = f"""SELECT query_id, thread, round(sum(k.score) + coalesce(any_value(t.importance) / 10, 0), 6) AS score, count(*) FILTER (message_id <> '{cx.SUMMARY}') AS n_messages, count(*) AS n_rows, max(left_out) AS left_out, arg_min(channel_name, pos) AS channel, arg_min(channel_id, pos) AS channel_id,
  any_value(thread_size) AS total_messages, coalesce(any_value(t.people), []) AS people, coalesce(any_value(t.replies), 0) AS replies, coalesce(any_value(t.importance), 0) AS importance FROM k LEFT JOIN t USING (thread) GROUP BY 1, 2"""
# Contexts are added in turn while their messages fit; the first that does not is cut, and nothing comes after it.
_BUDGET = """SELECT * EXCLUDE (upto), CASE WHEN upto <= 50 THEN n_rows ELSE n_messages - (upto - 50) END AS taken FROM (SELECT *, sum(n_messages) OVER (PARTITION BY query_id ORDER BY score DESC, thread) AS upto FROM s) WHERE upto - n_messages < 50"""
_SEL = "SELECT k.* FROM k JOIN b USING (query_id, thread) QUALIFY row_number() OVER (PARTITION BY k.query_id, k.thread ORDER BY pos) <= b.taken"
_ALL = f"{_WITH}, s AS ({_SCORED}), b AS ({_BUDGET}), sel AS ({_SEL})"


def _thread_rows(m):
    return thread_rollup(m.select("message_id", "thread_ts", "channel_id", "user_id", "ts", "importance_score"))


def _context(spark, sf_dir):
    m, r = _results(spark, sf_dir)
    rows = written(cx.threads(r.select("query_id", "message_id", F.col("relevance").alias("score")), m), "threads")
    kept = cx.compress(rows)
    # only the rows of the threads that a query found
    found = m.join(rows.select(F.col("thread").alias("thread_ts")).distinct(), "thread_ts", "left_semi")
    return rows, kept, cx.scored(kept, _thread_rows(found))


@query("thread_context", oracle(f"{_WITH} SELECT query_id, thread, message_id, pos, thread_size, relevant, round(score, 6) AS score FROM r", *_VIEWS))
def thread_context(spark, sf_dir):
    rows, _, _ = _context(spark, sf_dir)
    return rows.select("query_id", "thread", "message_id", "pos", "thread_size", "relevant", F.round("score", 6).alias("score"))


@query("thread_compress", oracle(f"{_WITH} SELECT query_id, thread, message_id, pos, CAST(left_out AS BIGINT) AS left_out FROM k", *_VIEWS))
def thread_compress(spark, sf_dir):
    return _context(spark, sf_dir)[1].select("query_id", "thread", "message_id", "pos", "left_out")


@query("context_score", oracle(f"{_WITH}, s AS ({_SCORED}) SELECT query_id, thread, score, n_messages, total_messages, array_to_string(people, ',') AS participants, replies AS reply_count, importance AS importance_score FROM s", *_VIEWS))
def context_score(spark, sf_dir):
    return _context(spark, sf_dir)[2].select("query_id", "thread", "score", "n_messages", "total_messages", F.array_join("participants", ",").alias("participants"), "reply_count", "importance_score")


@query("context_budget", oracle(f"{_ALL} SELECT query_id, thread, score, CAST(taken AS BIGINT) AS taken FROM b", *_VIEWS))
def context_budget(spark, sf_dir):
    return cx.budget(_context(spark, sf_dir)[2]).select("query_id", "thread", "score", "taken")


def _selected(spark, sf_dir):
    """The messages of the selected contexts, and these: written, as every part of a prompt reads them."""
    _, kept, scores = _context(spark, sf_dir)
    contexts = written(cx.budget(scores), "contexts")
    return written(cx.selected(kept, contexts), "selected"), contexts


_PEOPLE = "p AS (SELECT query_id, list_sort(list_distinct(flatten(list(people)))) AS pe, count(*) AS nt, list_sort(list_distinct(list(channel) FILTER (channel IS NOT NULL))) AS ch FROM b GROUP BY 1)"


@query("context_meta", oracle(f"{_ALL}, {_PEOPLE} SELECT query_id, any_value(nt) AS n_threads, count(*) AS n_messages, array_to_string(any_value(ch), ',') AS channels, len(any_value(pe)) AS n_participants, array_to_string(any_value(pe), ',') AS participants, epoch(min(ts)) AS first_s, epoch(max(ts)) AS last_s FROM sel JOIN p USING (query_id) GROUP BY 1", *_VIEWS))
def context_meta(spark, sf_dir):
    rows = cx.meta(*_selected(spark, sf_dir))
    return rows.select("query_id", "n_threads", "n_messages", "channels", F.size("participants").cast("long").alias("n_participants"), F.array_join("participants", ",").alias("participants"), F.unix_timestamp("first_ts").cast("double").alias("first_s"), F.unix_timestamp("last_ts").cast("double").alias("last_s"))


_LINKED = "e AS (SELECT query_id, 'user' AS kind, unnest(people) AS name FROM b UNION ALL SELECT query_id, 'channel', channel FROM b), cn AS (SELECT query_id, kind, name, count(*) AS n_threads FROM e GROUP BY 1, 2, 3 HAVING count(*) > 1)"


@query("context_connections", oracle(f"{_ALL}, {_LINKED} SELECT * FROM cn", *_VIEWS))
def context_connections(spark, sf_dir):
    return cx.connections(_selected(spark, sf_dir)[1])


def _fields(spark, sf_dir):
    m = view(spark, sf_dir, "doc_messages")
    one = lambda name, n: F.when(n > 0, F.struct(F.lit(name).alias("name"), n.alias("count")))
    reactions = F.array_compact(F.array(one("eyes", F.col("eyes")), one("thumbsup", F.col("reaction_count") - F.col("eyes"))))
    return cx.message_fields(m.withColumns({"reactions": F.when(F.size(reactions) > 0, reactions), "file_ids": F.when(F.col("file_id").isNotNull(), F.array("file_id"))}))


# The messages of the selected threads as one document for each of them.
_REACTED = "CASE WHEN m.reaction_count > 0 THEN concat_ws(', ', CASE WHEN m.eyes > 0 THEN ':eyes: ' || m.eyes END, CASE WHEN m.reaction_count > m.eyes THEN ':thumbsup: ' || (m.reaction_count - m.eyes) END) END"
_MESSAGES = f"""{_ALL}, l AS (SELECT query_id, thread, pos, s.message_id, s.left_out, CASE WHEN s.message_id = '{cx.SUMMARY}' THEN '_[' || CAST(s.left_out AS BIGINT) || ' additional messages in thread]_' || chr(10)
  ELSE concat_ws(chr(10), '**' || coalesce(m.user_name, 'Unknown') || '** (' || coalesce(strftime(s.ts, '%Y-%m-%d %H:%M'), '') || '):', coalesce(m.text, '') || chr(10), '_Reactions: ' || {_REACTED} || '_' || chr(10)) END AS line
  FROM sel s LEFT JOIN doc_messages m USING (message_id))"""
_SYSTEM_SQL = "'" + cx.SYSTEM["base"].replace("'", "''") + "' || chr(10) || chr(10) || CASE intent " + " ".join("WHEN '" + k + "' THEN '" + v.replace("'", "''") + "'" for k, v in cx.SYSTEM.items() if k != "base") + " END"
_PROMPTS = f"""{_MESSAGES}, {_PEOPLE}, o AS (SELECT query_id, thread, channel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, thread) AS r FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, thread) <= 10),
d AS (SELECT query_id, r, '### Discussion ' || r || chr(10) || '**Channel**: #' || coalesce(min(channel), 'unknown') || chr(10) || '**Messages** (' || count(*) || '):' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) AS t FROM l JOIN o USING (query_id, thread) GROUP BY 1, 2),
e AS (SELECT query_id, string_agg(t, chr(10) ORDER BY r) AS threads FROM d GROUP BY 1),
g AS (SELECT query_id, any_value(nt) AS nt, count(*) AS nm, any_value(ch) AS ch, any_value(pe) AS pe, min(ts) AS a, max(ts) AS z FROM sel JOIN p USING (query_id) GROUP BY 1),
v AS (SELECT query_id, concat_ws(chr(10), '## Context Overview', '- Found ' || nt || ' relevant discussions', '- Total messages: ' || nm, CASE WHEN len(ch) > 0 THEN '- Channels: ' || array_to_string(ch, ', ') END, CASE WHEN len(pe) > 0 THEN '- Participants: ' || array_to_string(pe[1:10], ', ') END,
  CASE WHEN len(pe) > 10 THEN '  (and ' || (len(pe) - 10) || ' more)' END, '- Time period: ' || strftime(a, '%Y-%m-%dT%H:%M:%S') || ' to ' || strftime(z, '%Y-%m-%dT%H:%M:%S'), '') AS overview FROM g),
x AS (SELECT y.query_id, split_part(y.intents, '|', 1) AS intent, q.has_code_intent AS code, y.* EXCLUDE (query_id, has_code_intent) FROM (ANALYSIS) y JOIN search_queries q ON q.query_id = y.query_id)
SELECT x.query_id, intent, {_SYSTEM_SQL} AS system, concat_ws(chr(10), overview, CASE WHEN threads IS NOT NULL THEN '## Relevant Discussions' || chr(10) END, threads, '## User Question', query_text || chr(10), '## Instructions',
  CASE WHEN code THEN '- The user is looking for code. Include complete code snippets with syntax highlighting.' END, '- Pay special attention to the time period: ' || phrase,
  CASE WHEN entities <> '' THEN '- Focus on information related to: ' || array_to_string(list_transform(names, lambda y: y), ', ') END,
  '- Provide citations with [Channel, @User, timestamp] format for all factual claims.', '- If information is not found in the context, explicitly state that.', '- Be concise but comprehensive.') AS prompt
FROM x LEFT JOIN (SELECT * FROM v JOIN e USING (query_id)) w USING (query_id)"""


_NAMED = r"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(m.text, ''), '(?s)```([0-9A-Za-z_]+)?\n(.*?)```', 1), lambda x: CASE WHEN x IS NULL OR x = '' THEN 'unknown' ELSE x END))), ',')"
_FIELDS = f"""concat_ws('|', s.message_id, m.user_id, m.user_name, strftime(m.ts, '%Y-%m-%dT%H:%M:%S'), sha256(m.text), CAST(m.has_code AS VARCHAR), {_NAMED}, {_REACTED}, CAST(m.reaction_count AS VARCHAR), array_to_string({_LINKS_SQL.replace('(text', '(m.text')}, ','), m.file_id, array_to_string(regexp_extract_all(m.text, '<@([A-Z0-9]+)>', 1), ','), printf('%.2f', m.importance_score))"""


@query("context_assembly", oracle(f"""{_ALL}, {_PEOPLE}, {_LINKED}, f AS (SELECT query_id, thread, pos, CASE WHEN s.message_id = '{cx.SUMMARY}' THEN '[' || CAST(s.left_out AS BIGINT) || ' additional messages in thread]' ELSE {_FIELDS} END AS line FROM sel s LEFT JOIN doc_messages m USING (message_id)),
d AS (SELECT query_id, thread, string_agg(line, chr(10) ORDER BY pos) AS messages FROM f GROUP BY 1, 2), h AS (SELECT query_id, string_agg(kind || ':' || name || '=' || n_threads, ',' ORDER BY kind, name) AS connections FROM cn GROUP BY 1)
SELECT b.query_id, row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.thread) - 1 AS place, b.thread, b.channel_id, b.channel AS channel_name, d.messages, b.total_messages, array_to_string(b.people, ',') AS participants, b.replies AS reply_count, b.score, len(pe) AS n_participants, coalesce(connections, '') AS connections
FROM b JOIN d USING (query_id, thread) JOIN p USING (query_id) LEFT JOIN h USING (query_id)""", *_VIEWS))
def context_assembly(spark, sf_dir):
    """The nested context of each query, laid out again with a row for each thread and a line for each message."""
    rows, contexts = _selected(spark, sf_dir)
    nested = cx.assembled(rows, contexts, _fields(spark, sf_dir))
    listed = lambda a: F.coalesce(F.array_join(a, ","), F.lit(""))

    def line(x):
        m = x["m"]
        reactions = F.array_join(F.transform(m["reactions"], lambda r: F.concat(F.lit(":"), r["name"], F.lit(": "), r["count"].cast("string"))), ", ")
        fields = [m["message_id"], m["user_id"], m["user_name"], m["timestamp"], F.sha2(m["text"], 256), m["has_code"].cast("string"), listed(m["code_languages"]), reactions, m["reaction_count"].cast("string"), listed(m["links"]), F.element_at(m["file_ids"], 1), listed(m["mentioned_users"]), F.format_string("%.2f", m["importance_score"])]
        return F.when(x["is_summary"], x["summary_text"]).otherwise(F.concat_ws("|", *fields))

    each = nested.select("query_id", "meta", "connections", F.posexplode("contexts").alias("place", "c"))
    links = F.array_join(F.transform("connections", lambda x: F.concat(x["kind"], F.lit(":"), x["name"], F.lit("="), x["n_threads"].cast("string"))), ",")
    return each.select(
        "query_id", F.col("place").cast("long").alias("place"), "c.thread", "c.channel_id", "c.channel_name", F.array_join(F.transform("c.messages", line), "\n").alias("messages"), "c.metadata.total_messages", listed(F.col("c.metadata.participants")).alias("participants"),
        "c.metadata.reply_count", "c.score", F.size("meta.participants").cast("long").alias("n_participants"), F.coalesce(links, F.lit("")).alias("connections"),
    )


@query("prompt_rows", oracle(_PROMPTS.replace("ANALYSIS", _ANALYSIS_SQL.replace(AS_OF, search.AS_OF).replace('SELECT query_id, query_text,', f'SELECT query_id, query_text, {_NAMES_SQL} AS names,', 1)), *_VIEWS))
def prompt_rows(spark, sf_dir):
    rows, contexts = _selected(spark, sf_dir)
    q, _, _ = _sources(spark, sf_dir)
    return cx.prompt_rows(rows, contexts, q, _fields(spark, sf_dir), F.lit(search.AS_OF).cast("timestamp"))
