"""Citations and quality of a table of answers (answer_id, query_text, answer_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from .search import permalink

# The form of a citation, and what counts as mentioned (with the group that is taken).
CITATION = r"\[([^,]+),\s*@?([^,]+),\s*([^\]]+)\]"
MENTIONED = [(ft.APART + r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*" + ft.ENDS, 0), (ft.APART + r"\p{Nd}+(?:\.\p{Nd}+)?" + ft.ENDS, 0), ('"([^"]+)"', 1)]
# Phrases and words of the checks.
NO_ANSWER = ["i don't have information", "i couldn't find", "there is no information", "not found in", "unable to locate", "no relevant information", "cannot answer", "don't see any"]
STARTERS = ["However", "Note", "Additionally"]
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "what", "who", "when", "where", "how", "why", "did", "do", "does"]
DEFINITE = ["definitely", "certainly", "without (?:a )?doubt", "always", "never", "everyone (?:agrees|thinks)"]
VAGUE = ["many", "some", "several", "a few", "most"]
CONFIDENCE = {
    "high": ["definitely", "certainly", "clearly", "confirmed"],
    "medium": ["likely", "probably", "appears", "seems"],
    "low": ["unclear", "uncertain", "possibly", "might", "may"],
    "hedging": ["however", "but", "although", "while"],
}
# Fixed value: the mark of a citation without a message.
UNAVAILABLE = " (link unavailable)"
NEAR = 100
TRIM_ABOVE, TRIM_TO = 10, 20
ACCEPTABLE = 0.6


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, number, channel, user, cited_at): numbered by the first appearance of the three."""
    t = F.col("answer_text")
    parts = F.arrays_zip(*(ft.all_of(t, CITATION, i).alias(n) for i, n in ((1, "channel"), (2, "user"), (3, "cited_at"))))
    rows = answers.select("answer_id", F.posexplode(parts).alias("pos", "c")).select("answer_id", "pos", *(F.trim(f"c.{n}").alias(n) for n in ("channel", "user", "cited_at")))
    first = rows.groupBy("answer_id", "channel", "user", "cited_at").agg(F.min("pos").alias("pos"))
    return first.select("answer_id", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos")).alias("number"), "channel", "user", "cited_at")


def _keys(text: Column) -> Column:
    """A key of each citation of a text, in turn."""
    return F.transform(F.arrays_zip(*(ft.all_of(text, CITATION, i).alias(f"g{i}") for i in (1, 2, 3))), lambda x: F.concat_ws(chr(1), F.trim(x["g1"]), F.trim(x["g2"]), F.trim(x["g3"])))


def n_citations(text: Column) -> Column:
    return F.size(F.array_distinct(_keys(text)))


def numbered(text: Column) -> Column:
    """The text with [n] for each citation: its gaps and the numbers of its citations, in turn."""
    marks = F.transform(_keys(text), lambda k: F.concat(F.lit("["), F.array_position(F.array_distinct(_keys(text)), k).cast("string"), F.lit("]")))
    return F.array_join(F.zip_with(F.split(text, CITATION, -1), marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def rewritten(answers: DataFrame) -> DataFrame:
    """(answer_id, text): the texts with numbered citations."""
    return answers.select("answer_id", numbered(F.col("answer_text")).alias("text"))


def citation_links(found: DataFrame, context: DataFrame) -> DataFrame:
    """(answer_id, number, message_id, link, label): each citation with the first message of its answer's context that it
    names, or a link to the channel only. A cited time is a part of the message's time in ISO form.
    context: answer_id, place (of the thread), pos, channel_id, channel_name, user_name, ts, message_id, at most a budget of rows for an answer."""
    key = lambda c, mark: F.ltrim(F.col(c), F.lit(mark))
    c = found.withColumns({"channel_name": key("channel", "#"), "user_name": key("user", "@")})
    m = context.where("channel_id <> '' AND message_id <> ''").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    met = c.join(m, ["answer_id", "channel_name", "user_name"]).where(F.contains("iso", "cited_at"))
    first = met.groupBy("answer_id", "number").agg(F.min_by(F.struct("channel_id", "message_id"), F.struct("place", "pos")).alias("m"))
    out = c.join(first, ["answer_id", "number"], "left")
    link = F.coalesce(permalink(F.col("m.channel_id"), F.col("m.message_id")), F.concat(F.lit("https://chat.example/app_redirect?channel="), "channel_name"))
    label = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] #"), "channel", F.lit(" - @"), "user", F.lit(" - "), "cited_at", F.when(F.col("m").isNull(), UNAVAILABLE).otherwise(""))
    return out.select("answer_id", "number", "m.message_id", link.alias("link"), label.alias("label"))


def citation_validity(answers: DataFrame, found: DataFrame, context: DataFrame) -> DataFrame:
    """(answer_id, n_citations, n_valid, score): the share of an answer's citations whose channel and user a message of its
    context has; 1 without citations. context: answer_id, channel_name, user_name."""
    known = context.select("answer_id", F.col("channel_name").alias("ck"), F.col("user_name").alias("uk")).distinct().withColumn("ok", F.lit(1))
    c = found.select("answer_id", F.ltrim(F.col("channel"), F.lit("#")).alias("ck"), F.ltrim(F.col("user"), F.lit("@")).alias("uk"))
    per = c.join(known, ["answer_id", "ck", "uk"], "left").groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("ok", F.lit(0))).alias("valid"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return answers.select("answer_id").join(per, "answer_id", "left").select("answer_id", zero("n").alias("n_citations"), zero("valid").alias("n_valid"), F.round(F.coalesce(F.col("valid") / F.col("n"), F.lit(1.0)), 6).alias("score"))


def has_answer(text: Column) -> Column:
    out = F.length(F.trim(text)) >= 50
    for phrase in NO_ANSWER:
        out = out & ~F.lower(text).contains(phrase)
    return out


def coverage(text: Column) -> Column:
    """Share of sentences over 10 characters with a [n]; sentences with certain openings do not count."""
    parts = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s)), lambda s: (F.length(s) > 10) & ~s.rlike("^(" + "|".join(STARTERS) + ")"))
    cited = F.filter(parts, lambda s: s.rlike(r"\[[0-9]+\]"))
    return F.when(F.size(parts) == 0, 1.0).otherwise(F.round(F.size(cited) / F.size(parts), 6))


def mentioned(text: Column) -> Column:
    """Runs of capitalised words, whole or decimal numbers, and quoted phrases, without repeats."""
    return F.array_distinct(F.concat(*(ft.all_of(text, p, i) for p, i in MENTIONED)))


def known_entities(context: DataFrame) -> DataFrame:
    """(answer_id, known): the entities of each answer's context, which is bounded. context: answer_id, text."""
    return context.groupBy("answer_id").agg(F.array_distinct(F.flatten(F.collect_list(mentioned(F.col("text"))))).alias("known"))


def grounded(text: Column, known: Column) -> tuple[Column, Column]:
    """The share of a text's entities that are known, 1 without entities, and up to five of the others."""
    said = mentioned(text)
    missing = F.array_except(said, F.coalesce(known, F.array().cast("array<string>")))
    share = F.when(F.size(said) == 0, 1.0).otherwise(F.round((F.size(said) - F.size(missing)) / F.size(said), 6))
    return share, F.array_join(F.slice(F.array_sort(missing), 1, 5), ",")


def grounding(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Share of an answer's entities that its context has; context: (answer_id, text). 1 without entities."""
    share, others = grounded(F.col("answer_text"), F.col("known"))
    return answers.join(known_entities(context), "answer_id", "left").select("answer_id", F.coalesce(share, F.lit(1.0)).alias("grounding"), F.coalesce(others, F.lit("")).alias("ungrounded"))


def relevance(query: Column, answer: Column) -> Column:
    words = F.array_except(F.array_distinct(ft.all_of(F.lower(query), ft.WORD)), F.array(*map(F.lit, STOP_WORDS)))
    hits = F.filter(words, lambda w: F.contains(F.lower(answer), w))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.round(F.size(hits) / F.size(words), 6))


def _bare(text: Column, pattern: str) -> Column:
    """Whether a match of the pattern has no [n] within NEAR characters: by running lengths of gaps and matches."""
    gaps, hits = F.split(text, pattern, -1), ft.all_of(text, pattern)
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.coalesce(F.length(h), F.lit(-1)).alias("h")))
    kind = "struct<at:int,bare:boolean>"

    def step(acc, s):
        start = acc["at"] + s["g"]
        low = F.greatest(start - NEAR, F.lit(0))
        around = F.substring(text, low + 1, start + s["h"] + NEAR - low)
        return F.struct((start + F.greatest(s["h"], F.lit(0))).alias("at"), (acc["bare"] | ((s["h"] >= 0) & ~around.rlike(r"\[[0-9]+\]"))).alias("bare"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(False).alias("bare")).cast(kind), step, lambda a: a["bare"])


def flags(text: Column) -> Column:
    """Names of doubtful traits: a time of day with no citation anywhere, definite words with none near, vague counts."""
    low = F.lower(text)
    out = [F.when(text.rlike(r"(?i)[0-9]{1,2}:[0-9]{2}(am|pm)") & ~text.rlike(r"\[[0-9]+\]"), "time")]
    out += [F.when(_bare(low, ft.words_pattern([w])), F.lit(f"definite:{i}")) for i, w in enumerate(DEFINITE)]
    out.append(F.when(F.regexp_count(low, F.lit(ft.words_pattern(VAGUE))) > 3, "vague"))
    return F.array_compact(F.array(*out))


def confidence(text: Column) -> Column:
    n = {k: F.regexp_count(F.lower(text), F.lit(ft.words_pattern(w))) for k, w in CONFIDENCE.items()}
    return F.when(n["low"] > n["high"], "low").when(n["high"] > n["low"] + n["medium"], "high").otherwise("medium")


def quality(answered: Column, cov: Column, ground: Column, rel: Column, n_flags: Column) -> Column:
    score = F.when(answered, 0.3).otherwise(0.0) + 0.25 * cov + 0.25 * ground + 0.15 * rel - F.least(0.02 * n_flags, F.lit(0.05))
    return F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 3)


def trimmed(turns: DataFrame, above: int = TRIM_ABOVE, last: int = TRIM_TO) -> DataFrame:
    """Of conversations of more than `above` turns the system turns and the `last` ones."""
    whole = Window.partitionBy("conv_id")
    t = turns.withColumn("back", F.row_number().over(whole.orderBy(F.desc("turn")))).withColumn("n", F.count(F.lit(1)).over(whole))
    return t.where((F.col("n") <= above) | (F.col("back") <= last) | (F.col("role") == "system")).drop("back", "n")


def validated(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Every check of each answer, on its text with numbered citations: n_citations, has_answer, coverage, grounding,
    ungrounded, relevance, flags, confidence, quality and acceptable. Answers are read once. context: (answer_id, text)."""
    t = F.col("told")
    told = answers.select("answer_id", "query_text", numbered(F.col("answer_text")).alias("told"), n_citations(F.col("answer_text")).alias("n_citations")).join(known_entities(context), "answer_id", "left")
    share, others = grounded(t, F.col("known"))
    out = told.select(
        "answer_id", "n_citations", has_answer(t).alias("has_answer"), coverage(t).alias("coverage"), F.coalesce(share, F.lit(1.0)).alias("grounding"), F.coalesce(others, F.lit("")).alias("ungrounded"),
        relevance(F.col("query_text"), t).alias("relevance"), flags(t).alias("flags"), confidence(t).alias("confidence"),
    )
    out = out.withColumn("quality", quality(F.col("has_answer"), F.col("coverage"), F.col("grounding"), F.col("relevance"), F.size("flags")))
    return out.withColumn("acceptable", F.col("quality") >= ACCEPTABLE)


def history(turns: DataFrame, last: int = TRIM_TO) -> DataFrame:
    """(conv_id, n, role, content): the `last` turns of each conversation in order."""
    recent = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= last)
    return recent.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"), "role", F.col("text").alias("content"))


#: Buckets of the distributions of answers: their upper ends.
QUALITY_ENDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
CITATION_ENDS = [0, 1, 2, 3, 5, 7, 10, 15, 20]
TURN_ENDS = [1, 2, 3, 5, 7, 10, 15, 20]


def distributions(checked: DataFrame, turns: DataFrame) -> DataFrame:
    """(metric, kind, le, n): cumulative counts of answers by quality and by number of citations and of conversations by
    turns (le: the upper end, infinity last), and of flags by their kind (le null). Each input is read once: a row
    becomes a bucket of each of its distributions, and what is left of a bucket is a count.
    checked: quality, n_citations, flags; turns: n_turns, a row for each conversation."""

    def bucket(metric, value, ends):
        le = F.lit(float("inf"))
        for e in reversed(ends):
            le = F.when(value <= e, F.lit(float(e))).otherwise(le)
        return F.struct(F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("kind"), le.alias("le"))

    flag = F.transform("flags", lambda f: F.struct(F.lit("flags").alias("metric"), F.element_at(F.split(f, ":"), 1).alias("kind"), F.lit(None).cast("double").alias("le")))
    answered = checked.select(F.explode(F.concat(F.array(bucket("quality", F.col("quality"), QUALITY_ENDS), bucket("citations", F.col("n_citations"), CITATION_ENDS)), flag)).alias("x"))
    counts = answered.unionByName(turns.select(bucket("turns", F.col("n_turns"), TURN_ENDS).alias("x"))).groupBy("x.metric", "x.kind", "x.le").agg(F.count(F.lit(1)).alias("m"))
    all_ends = {m: [*map(float, ends), float("inf")] for m, ends in (("quality", QUALITY_ENDS), ("citations", CITATION_ENDS), ("turns", TURN_ENDS))}
    # a bucket counts at its own end and at all greater ones; ends without a bucket below count 0
    ends = F.lit(None).cast("array<double>")
    for m, e in all_ends.items():
        ends = F.when(F.col("metric") == m, F.array(*map(F.lit, e))).otherwise(ends)
    upto = F.when(F.col("le").isNull(), F.array("le")).otherwise(F.filter(ends, lambda e: e >= F.col("le")))
    shown = counts.select("metric", "kind", F.explode(upto).alias("le"), "m")
    none = counts.sparkSession.createDataFrame([(m, None, e, 0) for m, x in all_ends.items() for e in x], "metric string, kind string, le double, m long")
    return shown.unionByName(none).groupBy("metric", "kind", "le").agg(F.sum("m").alias("n"))
