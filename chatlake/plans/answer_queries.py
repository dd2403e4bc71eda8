"""Citations, answer quality and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answers as an
from ..operators import context as cx
from ..operators.folds import deleted
from ..sources.views import oracle, view
from . import retrieval_queries as rt
from .registry import query

_C = an.CITATION
_CITES = rf"""SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY min(pos)) AS number, channel, "user", cited_at FROM (
  SELECT answer_id, unnest(range(len(a))) AS pos, trim(unnest(a)) AS channel, trim(unnest(b)) AS "user", trim(unnest(c)) AS cited_at FROM (
    SELECT answer_id, regexp_extract_all(answer_text, '{_C}', 1) AS a, regexp_extract_all(answer_text, '{_C}', 2) AS b, regexp_extract_all(answer_text, '{_C}', 3) AS c FROM answers)) GROUP BY answer_id, channel, "user", cited_at"""


@query("citations", oracle(_CITES, "answers"))
def citations(spark, sf_dir):
    return an.citations(view(spark, sf_dir, "answers"))


def _rewritten(source: str) -> str:
    """SQL of `source` with the column t: the text with numbered citations."""
    return f"""SELECT * EXCLUDE (gaps, ks), list_aggregate(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce('[' || CAST(len(list_distinct(ks[1 : list_position(ks, ks[i])])) AS VARCHAR) || ']', '')), 'string_agg', '') AS t FROM (
  SELECT *, regexp_split_to_array(answer_text, '{_C}') AS gaps, list_transform(range(1, len(regexp_extract_all(answer_text, '{_C}', 1)) + 1), lambda i: concat_ws(chr(1), trim(regexp_extract_all(answer_text, '{_C}', 1)[i]), trim(regexp_extract_all(answer_text, '{_C}', 2)[i]), trim(regexp_extract_all(answer_text, '{_C}', 3)[i]))) AS ks FROM {source})"""


@query("citation_rewrite", oracle(f"SELECT answer_id, t AS text FROM ({_rewritten('answers')})", "answers"))
def citation_rewrite(spark, sf_dir):
    return an.rewritten(view(spark, sf_dir, "answers"))


# Answers that also cite the results in their contexts, by the hour.
_CITED = f"""{rt._ALL}, told AS (SELECT query_id AS answer_id, string_agg(' Said in [#' || channel_name || ', @' || user_name || ', ' || strftime(ts, '%Y-%m-%dT%H') || '].', '' ORDER BY message_id) AS more FROM sel WHERE relevant GROUP BY 1),
cited AS (SELECT a.answer_id, a.query_text, a.answer_text || coalesce(more, '') AS answer_text FROM answers a LEFT JOIN told USING (answer_id)), c AS ({_CITES.replace('FROM answers', 'FROM cited')}),
known AS (SELECT s.query_id AS answer_id, row_number() OVER (PARTITION BY s.query_id ORDER BY b.score DESC, s.thread, s.pos) AS place, b.channel_id, b.channel, s.user_name, strftime(s.ts, '%Y-%m-%dT%H:%M:%S') AS iso, s.message_id FROM sel s JOIN b USING (query_id, thread) WHERE s.message_id <> '{cx.SUMMARY}')"""


def _cited(spark, sf_dir):
    """Answers with citations of their contexts' results, and the contexts' messages."""
    rows, contexts = rt._selected(spark, sf_dir)
    said = F.concat(F.lit(" Said in [#"), "channel_name", F.lit(", @"), "user_name", F.lit(", "), F.date_format("ts", "yyyy-MM-dd'T'HH"), F.lit("]."))
    more = rows.where("relevant").groupBy(F.col("query_id").alias("answer_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("message_id", said.alias("t")))), lambda x: x["t"]), "").alias("more"))
    a = view(spark, sf_dir, "answers").join(more, "answer_id", "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "thread")).alias("place")
    of = contexts.select("query_id", "thread", place, "channel_id", "channel_name")
    context = rows.where(F.col("message_id") != cx.SUMMARY).select("query_id", "thread", "pos", "user_name", "ts", "message_id").join(of, ["query_id", "thread"]).withColumnRenamed("query_id", "answer_id")
    return a.select("answer_id", "query_text", F.concat("answer_text", F.coalesce("more", F.lit(""))).alias("answer_text")), context


@query("citation_links", oracle(f"""{_CITED}, l AS (SELECT c.answer_id, c.number, arg_min(k.message_id, k.place) AS message_id, arg_min(k.channel_id, k.place) AS channel_id FROM c JOIN known k ON k.answer_id = c.answer_id AND ltrim(c.channel, '#') = k.channel AND ltrim(c."user", '@') = k.user_name AND contains(k.iso, c.cited_at) GROUP BY 1, 2)
SELECT c.answer_id, c.number, l.message_id, CASE WHEN l.message_id IS NULL THEN 'https://chat.example/app_redirect?channel=' || ltrim(c.channel, '#') ELSE 'https://chat.example/archives/' || l.channel_id || '/p' || replace(l.message_id, '.', '') END AS link,
  '[' || c.number || '] #' || c.channel || ' - @' || c."user" || ' - ' || c.cited_at || CASE WHEN l.message_id IS NULL THEN ' (link unavailable)' ELSE '' END AS label FROM c LEFT JOIN l USING (answer_id, number)""", "answers", "search_queries", "doc_messages"))
def citation_links(spark, sf_dir):
    answers, context = _cited(spark, sf_dir)
    return an.citation_links(an.citations(answers), context)


@query("citation_validity", oracle(f"""{_CITED}, u AS (SELECT DISTINCT answer_id, channel, user_name FROM known), p AS (SELECT c.answer_id, count(*) AS n, count(u.channel) AS v FROM c LEFT JOIN u ON u.answer_id = c.answer_id AND ltrim(c.channel, '#') = u.channel AND ltrim(c."user", '@') = u.user_name GROUP BY 1)
SELECT a.answer_id, coalesce(n, 0) AS n_citations, coalesce(v, 0) AS n_valid, round(coalesce(v / n, 1.0E0), 6) AS score FROM answers a LEFT JOIN p USING (answer_id)""", "answers", "search_queries", "doc_messages"))
def citation_validity(spark, sf_dir):
    answers, context = _cited(spark, sf_dir)
    return an.citation_validity(answers, an.citations(answers), context)


_HAS = "length(trim(answer_text)) >= 50" + "".join(" AND NOT contains(lower(answer_text), '" + p.replace("'", "''") + "')" for p in an.NO_ANSWER)


@query("va_has_answer", oracle(f"SELECT answer_id, {_HAS} AS has_answer FROM answers", "answers"))
def va_has_answer(spark, sf_dir):
    return view(spark, sf_dir, "answers").select("answer_id", an.has_answer(F.col("answer_text")).alias("has_answer"))


def _cov(t: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({t}, '[.!?]+'), lambda s: trim(s)), lambda s: length(s) > 10 AND NOT regexp_matches(s, '^(However|Note|Additionally)'))"
    return rf"CASE WHEN len({parts}) = 0 THEN 1 ELSE round(len(list_filter({parts}, lambda s: regexp_matches(s, '\[[0-9]+\]'))) / len({parts}), 6) END"


@query("va_coverage", oracle(f"SELECT answer_id, {_cov('t')} AS coverage FROM ({_rewritten('answers')})", "answers"))
def va_coverage(spark, sf_dir):
    return an.rewritten(view(spark, sf_dir, "answers")).select("answer_id", an.coverage(F.col("text")).alias("coverage"))


def _ent(col: str) -> str:
    """Letters beyond ASCII become _ and other signs beyond ASCII a dot, as the oracle's \\b knows ASCII only."""
    plain = rf"regexp_replace(regexp_replace({col}, '[^\p{{L}}\p{{N}}_\x00-\x7F]', '.', 'g'), '[^\x00-\x7F]', '_', 'g')"
    return rf"""list_distinct(list_concat(list_concat(regexp_extract_all({plain}, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'), regexp_extract_all({plain}, '\b[0-9]+(?:\.[0-9]+)?\b')), regexp_extract_all({col}, '"([^"]+)"', 1)))"""


_GROUND = f"""{rt._ALL}, told AS ({_rewritten('answers')}), said AS (SELECT answer_id, unnest({_ent("t")}) AS e FROM told), known AS (SELECT DISTINCT answer_id, e FROM (SELECT c.query_id AS answer_id, unnest({_ent("m.text")}) AS e FROM sel c JOIN doc_messages m USING (message_id))),
p AS (SELECT s.answer_id, count(*) AS n, count(k.e) AS h, list_sort(list_distinct(list(s.e) FILTER (k.e IS NULL)))[1:5] AS miss FROM said s LEFT JOIN known k ON k.answer_id = s.answer_id AND k.e = s.e GROUP BY 1),
ground AS (SELECT a.answer_id, round(coalesce(h / n, 1.0E0), 6) AS grounding, coalesce(array_to_string(miss, ','), '') AS ungrounded FROM answers a LEFT JOIN p USING (answer_id))"""


def _context(spark, sf_dir):
    """An answer has the id of its query, whose assembled context holds at most 50 messages."""
    rows, _ = rt._selected(spark, sf_dir)
    return rows.select(F.col("query_id").alias("answer_id"), "message_id").join(view(spark, sf_dir, "doc_messages").select("message_id", "text"), "message_id")


def _told(spark, sf_dir):
    a = view(spark, sf_dir, "answers")
    return a.select("answer_id", "query_text").join(an.rewritten(a).withColumnRenamed("text", "answer_text"), "answer_id")


@query("va_grounding", oracle(f"{_GROUND} SELECT * FROM ground", "answers", "search_queries", "doc_messages"))
def va_grounding(spark, sf_dir):
    return an.grounding(_told(spark, sf_dir), _context(spark, sf_dir))


_RELW = r"list_filter(list_distinct(regexp_extract_all(lower(query_text), '[\p{L}\p{N}_]+')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in an.STOP_WORDS) + "], w))"


def _rel(t: str) -> str:
    return f"CASE WHEN len({_RELW}) = 0 THEN 1 ELSE round(len(list_filter({_RELW}, lambda w: contains(lower({t}), w))) / len({_RELW}), 6) END"


@query("va_relevance", oracle(f"SELECT answer_id, {_rel('answer_text')} AS relevance FROM answers", "answers"))
def va_relevance(spark, sf_dir):
    return view(spark, sf_dir, "answers").select("answer_id", an.relevance(F.col("query_text"), F.col("answer_text")).alias("relevance"))


def _bare(t: str, word: str) -> str:
    """Whether a match of the word has no citation near."""
    gaps, hits = f"regexp_split_to_array(lower({t}), '{word}')", f"regexp_extract_all(lower({t}), '{word}')"
    size = lambda x, n: f"coalesce(list_sum(list_transform({x}[1 : {n}], lambda y: length(y))), 0)"
    start = f"({size(gaps, 'i')} + {size(hits, 'i - 1')})"
    low = f"greatest({start} - {an.NEAR}, 0)"
    around = f"substr(lower({t}), CAST({low} + 1 AS BIGINT), CAST({start} + length({hits}[i]) + {an.NEAR} - {low} AS BIGINT))"
    return rf"len(list_filter(range(1, len({hits}) + 1), lambda i: NOT regexp_matches({around}, '\[[0-9]+\]'))) > 0"


def _flags(t: str) -> str:
    parts = [rf"CASE WHEN regexp_matches({t}, '(?i)[0-9]{{1,2}}:[0-9]{{2}}(am|pm)') AND NOT regexp_matches({t}, '\[[0-9]+\]') THEN 'time' END"]
    parts += [rf"CASE WHEN {_bare(t, chr(92) + 'b' + w + chr(92) + 'b')} THEN 'definite:{i}' END" for i, w in enumerate(an.DEFINITE)]
    parts.append(rf"CASE WHEN len(regexp_extract_all(lower({t}), '\b({'|'.join(an.VAGUE)})\b')) > 3 THEN 'vague' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@query("va_flags", oracle(f"SELECT answer_id, array_to_string({_flags('t')}, '|') AS flags FROM ({_rewritten('answers')})", "answers"))
def va_flags(spark, sf_dir):
    return an.rewritten(view(spark, sf_dir, "answers")).select("answer_id", F.array_join(an.flags(F.col("text")), "|").alias("flags"))


def _count(words: list[str]) -> str:
    return r"len(list_filter(regexp_extract_all(lower(answer_text), '[\p{L}\p{N}_]+'), lambda w: list_contains([" + ", ".join(f"'{w}'" for w in words) + "], w)))"


@query("va_confidence", oracle(f"SELECT answer_id, CASE WHEN {_count(an.CONFIDENCE['low'])} > {_count(an.CONFIDENCE['high'])} THEN 'low' WHEN {_count(an.CONFIDENCE['high'])} > {_count(an.CONFIDENCE['low'])} + {_count(an.CONFIDENCE['medium'])} THEN 'high' ELSE 'medium' END AS confidence FROM answers", "answers"))
def va_confidence(spark, sf_dir):
    return view(spark, sf_dir, "answers").select("answer_id", an.confidence(F.col("answer_text")).alias("confidence"))


_QUALITY = f"""{_GROUND}, v AS (SELECT answer_id, {_HAS.replace('answer_text', 't')} AS has_answer, {_cov('t')} AS coverage, {_rel('t')} AS relevance, {_flags('t')} AS f FROM told),
q AS (SELECT answer_id, round(greatest(0, least(1, CASE WHEN has_answer THEN 0.3E0 ELSE 0 END + 0.25E0 * coverage + 0.25E0 * grounding + 0.15E0 * relevance - least(0.02E0 * len(f), 0.05E0))), 3) AS quality FROM v JOIN ground USING (answer_id))"""


@query("va_quality", oracle(f"{_QUALITY} SELECT answer_id, quality, quality >= 0.6 AS acceptable FROM q", "answers", "search_queries", "doc_messages"))
def va_quality(spark, sf_dir):
    return an.validated(view(spark, sf_dir, "answers"), _context(spark, sf_dir)).select("answer_id", "quality", "acceptable")


_ENDS = " UNION ALL ".join(f"SELECT '{m}' AS metric, unnest([{', '.join(map(str, map(float, ends)))}, 'inf'::DOUBLE]) AS le" for m, ends in (("quality", an.QUALITY_ENDS), ("citations", an.CITATION_ENDS), ("turns", an.TURN_ENDS)))


@query("answer_hist", oracle(f"""{_QUALITY}, values_ AS (SELECT 'quality' AS metric, quality AS v FROM q UNION ALL SELECT 'citations', (SELECT count(*) FROM ({_CITES}) c WHERE c.answer_id = a.answer_id) FROM answers a UNION ALL SELECT 'turns', count(*) FROM conversations GROUP BY conv_id)
SELECT e.metric, CAST(NULL AS VARCHAR) AS kind, e.le, count(*) FILTER (v <= e.le) AS n FROM ({_ENDS}) e JOIN values_ USING (metric) GROUP BY 1, 2, 3 UNION ALL SELECT 'flags', split_part(f, ':', 1), NULL, count(*) FROM (SELECT unnest(f) AS f FROM v) GROUP BY 2""", "answers", "search_queries", "doc_messages"))
def answer_hist(spark, sf_dir):
    checked = an.validated(view(spark, sf_dir, "answers"), _context(spark, sf_dir))
    return an.distributions(checked, view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")))


_TURNS = "conv_id, turn, role, text, 1704067200 + conv_id * 3600 + turn * 60 AS at_s"


@query("convo_state", f"""
WITH t AS (SELECT {_TURNS} FROM conversations), l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t)
SELECT conv_id, substr(arg_min(text, turn), 1, 50) || CASE WHEN length(arg_min(text, turn)) > 50 THEN '...' ELSE '' END AS title, count(*) AS turn_count,
  count(*) FILTER (back <= 20) AS kept_turns, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (back <= 20)) AS history_sha, arg_max(text, turn) FILTER (role = 'user') AS last_query, arg_max(text, turn) FILTER (role = 'assistant') AS last_response, max(at_s) AS last_s
FROM l GROUP BY 1""")
def convo_state(spark, sf_dir):
    t = view(spark, sf_dir, "conversations").withColumn("at_s", F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    rows = t.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    first, recent = F.min_by("text", "turn"), F.col("back") <= 20
    history = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(recent, F.struct("turn", F.concat_ws(":", "role", "text").alias("t"))))), lambda x: x["t"]), "\n")
    return rows.groupBy("conv_id").agg(
        F.concat(F.substring(first, 1, 50), F.when(F.length(first) > 50, "...").otherwise("")).alias("title"), F.count(F.lit(1)).alias("turn_count"), F.count(F.when(recent, 1)).alias("kept_turns"), F.sha2(history, 256).alias("history_sha"),
        F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("last_query"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_response"), F.max("at_s").alias("last_s"),
    )


@query("convo_list", f"""
WITH t AS (SELECT {_TURNS} FROM conversations), c AS (SELECT conv_id, conv_id % 10 AS user_no, max(at_s) AS last_s, substr(arg_max(text, turn), 1, 100) AS preview FROM t GROUP BY 1)
SELECT user_no, conv_id, last_s, preview, row_number() OVER (PARTITION BY user_no ORDER BY last_s DESC, conv_id) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY user_no ORDER BY last_s DESC, conv_id) <= 10""")
def convo_list(spark, sf_dir):
    t = view(spark, sf_dir, "conversations").withColumn("at_s", F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    c = t.groupBy("conv_id").agg(F.max("at_s").alias("last_s"), F.substring(F.max_by("text", "turn"), 1, 100).alias("preview")).withColumn("user_no", F.col("conv_id") % 10)
    order = Window.partitionBy("user_no").orderBy(F.desc("last_s"), "conv_id")
    return c.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("user_no", "conv_id", "last_s", "preview", "rank")


@query("convo_expire", f"WITH t AS (SELECT {_TURNS} FROM conversations), c AS (SELECT conv_id, max(at_s) AS last_s FROM t GROUP BY 1) SELECT conv_id, last_s FROM c WHERE last_s >= 1704067200 + 60 * 3600 - 86400")
def convo_expire(spark, sf_dir):
    t = view(spark, sf_dir, "conversations")
    last = t.groupBy("conv_id").agg(F.max(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("last_s"))
    return last.where(F.col("last_s") >= 1704067200 + 60 * 3600 - 86400)


@query("history_trim", "SELECT conv_id, turn FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 10 OR back <= 20 OR role = 'system'")
def history_trim(spark, sf_dir):
    return an.trimmed(view(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query("convo_history", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 20")
def convo_history(spark, sf_dir):
    return an.history(view(spark, sf_dir, "conversations"))


@query("convo_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id % 9 <> 4")
def convo_delete(spark, sf_dir):
    t = view(spark, sf_dir, "conversations")
    return deleted(t, t.where("conv_id % 9 = 4").select("conv_id").distinct(), "conv_id").select("conv_id", "turn")
