"""Thread context around ranked results, in rows (one per query, thread and message) until the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft

COMPRESS_ABOVE, MOST_MESSAGES = 10, 50


#: What a model is told before the prompt: in every case, and for the first intent of the query.
SYSTEM = {
    "base": "You answer questions about a team's chat history. Say only what the given messages support, name the source of each claim as [Channel, @User, timestamp], and say so where they hold no answer or leave it open.",
    "factual": "The question asks for a fact: answer it first, then give the details and any messages that contradict each other, the newest first.",
    "code": "The question asks for code: give whole snippets as they were posted, what they do, who wrote them, and warnings that go with them.",
    "summary": "The question asks for a summary: main points by theme, then decisions and open tasks, in short bullet points.",
    "timeline": "The question asks for a course of events: list them in order of time with their dates, and mark turning points.",
    "who": "The question asks for people: name them, quote what they said and where, and tell authors from those who agreed.",
    "comparison": "The question asks for a comparison: set the options side by side, with what speaks for and against each, and any decision.",
    "howto": "The question asks for a procedure: number the steps, name what they need beforehand, and add commands and known pitfalls.",
}


def threads(results: DataFrame, messages: DataFrame) -> DataFrame:
    """All messages of the threads that hold a result: (query_id, thread, message_id, ts, user_id, user_name, channel_id,
    channel_name, pos, thread_size, relevant, score, is_thread). A result outside any thread is alone."""
    fields = ("ts", "user_id", "user_name", "channel_id", "channel_name")
    m = messages.select("message_id", "thread_ts", *fields)
    hits = results.select("query_id", "message_id", "score").join(m, "message_id")
    keyed = hits.withColumn("thread", F.coalesce("thread_ts", "message_id")).withColumn("is_thread", F.max(F.col("thread_ts").isNotNull()).over(Window.partitionBy("query_id", "thread")))
    wanted = keyed.where("is_thread").select("query_id", "thread").distinct()
    body = m.where("thread_ts IS NOT NULL").select(F.col("thread_ts").alias("thread"), "message_id", *fields)
    held = wanted.join(body, "thread").join(keyed.select("query_id", "thread", "message_id", "score"), ["query_id", "thread", "message_id"], "left").withColumn("is_thread", F.lit(True))
    alone = keyed.where("NOT is_thread")
    columns = ("query_id", "thread", "message_id", *fields, "is_thread", "score")
    rows = held.select(*columns).unionByName(alone.select(*columns))
    order = Window.partitionBy("query_id", "thread").orderBy("ts", "message_id")
    whole = Window.partitionBy("query_id", "thread")
    return rows.select(
        "query_id", "thread", "message_id", *fields, (F.row_number().over(order) - 1).alias("pos"),
        F.count(F.lit(1)).over(whole).alias("thread_size"), F.col("score").isNotNull().alias("relevant"), F.coalesce("score", F.lit(0.0)).alias("score"), "is_thread",
    )


#: The message id of a placeholder row.
SUMMARY = "summary"


def compress(rows: DataFrame, above: int = COMPRESS_ABOVE) -> DataFrame:
    """Of longer threads the parent, the results and their neighbours, and where that is less than the thread a
    placeholder row after them; `left_out` counts the rest of the thread.
    A result at the parent's place pulls in no neighbour, as the walk starts after it."""
    order = Window.partitionBy("query_id", "thread").orderBy("pos")
    beside = lambda step: F.coalesce(F.lag("relevant", step).over(order) & (F.lag("pos", step).over(order) >= 1), F.lit(False))
    after = F.coalesce(F.lead("relevant").over(order) & (F.col("pos") >= 1), F.lit(False))
    flagged = rows.withColumn("keep", (F.col("thread_size") <= above) | (F.col("pos") == 0) | F.col("relevant") | beside(1) | after)
    kept = flagged.withColumn("left_out", F.sum((~F.col("keep")).cast("int")).over(Window.partitionBy("query_id", "thread"))).where("keep").drop("keep")
    # the parent's row gives the placeholder's, so that nothing is read twice
    gap = (F.col("pos") == 0) & (F.col("left_out") > 0)
    blank = {c: F.lit(None).cast(kept.schema[c].dataType) for c in ("ts", "user_id", "user_name") if c in kept.columns} | {"message_id": F.lit(SUMMARY), "pos": F.col("thread_size").cast(kept.schema["pos"].dataType), "relevant": F.lit(False), "score": F.lit(0.0)}
    placeholder = F.struct(*(blank.get(c, F.col(c)).alias(c) for c in kept.columns))
    return kept.select(F.explode(F.array_compact(F.array(F.struct(*kept.columns), F.when(gap, placeholder)))).alias("x")).select("x.*")


def scored(rows: DataFrame, thread_rows: DataFrame) -> DataFrame:
    """The context of each thread of a query: (query_id, thread, is_thread, channel_id, channel_name, participants,
    reply_count, importance_score, total_messages, n_messages, n_rows, left_out, score). The score is that of its messages plus a
    tenth of the thread's importance; n_messages is without the placeholder, n_rows with it. Participants are those of
    the thread's own row; a message outside threads has its user. thread_rows: as thread_rollup() gives them."""
    first = lambda c: F.min_by(c, "pos").alias(c)
    per = rows.groupBy("query_id", "thread").agg(
        F.sum("score").alias("s"), F.count(F.when(F.col("message_id") != SUMMARY, 1)).alias("n_messages"), F.count(F.lit(1)).alias("n_rows"), F.max("left_out").alias("left_out"),
        F.max("is_thread").alias("is_thread"), F.max("thread_size").alias("total_messages"), first("user_id"), first("channel_id"), first("channel_name"),
    )
    t = thread_rows.select(F.col("thread_ts").alias("thread"), F.col("participants").alias("__people"), F.col("reply_count").alias("__replies"), F.col("importance_score").alias("__importance"))
    joined = per.join(t, "thread", "left")
    own = lambda c, other: F.when(F.col("is_thread"), F.coalesce(F.col(c), other))
    people = own("__people", F.array().cast("array<string>")).otherwise(F.array("user_id"))
    boost = own("__importance", F.lit(0.0)).otherwise(0.0)
    return joined.select(
        "query_id", "thread", "is_thread", "channel_id", "channel_name", people.alias("participants"), own("__replies", F.lit(0)).otherwise(0).alias("reply_count"), boost.alias("importance_score"),
        "total_messages", "n_messages", "n_rows", "left_out", F.round(F.col("s") + boost / 10, 6).alias("score"),
    )


def budget(contexts: DataFrame, most: int = MOST_MESSAGES) -> DataFrame:
    """Contexts in order of score until `most` messages are reached, placeholders not counted; `taken` is the number of
    rows of each: all with the placeholder (n_rows, or n_messages where that is not given) where the messages fit, else the
    first ones up to the budget."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "thread").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_messages").over(order), F.lit(0))
    rows = contexts.withColumn("before", before).where(F.col("before") < most)
    return rows.withColumn("taken", F.when(F.col("before") + F.col("n_messages") <= most, F.col("n_rows" if "n_rows" in contexts.columns else "n_messages")).otherwise(F.lit(most) - F.col("before"))).drop("before")


def selected(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """The messages of the selected contexts, in the order of their threads, cut to `taken`."""
    order = Window.partitionBy("query_id", "thread").orderBy("pos")
    met = rows.join(contexts.select("query_id", "thread", "taken"), ["query_id", "thread"])
    return met.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("taken")).drop("at", "taken")


def meta(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, n_threads, n_messages, channels, participants, first_ts, last_ts): of the selected contexts, and of their
    messages, placeholders counted."""
    of = contexts.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_threads"), F.sum("taken").alias("n_messages"), F.array_join(F.array_sort(F.collect_set("channel_name")), ",").alias("channels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("participants")))).alias("participants"),
    )
    return of.join(rows.groupBy("query_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "query_id")


def connections(contexts: DataFrame) -> DataFrame:
    """Participants and channels that more than one selected thread of a query has."""
    named = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    names = F.concat(F.transform(F.array_distinct("participants"), lambda u: named("user", u)), F.array(named("channel", F.col("channel_name"))))
    both = contexts.select("query_id", "thread", F.explode(names).alias("x")).where("x.name IS NOT NULL")
    return both.groupBy("query_id", "x.kind", "x.name").agg(F.count(F.lit(1)).alias("n_threads")).where("n_threads > 1")


def message_fields(messages: DataFrame) -> DataFrame:
    """(message_id, m): the thirteen fields of a message that a context shows, as one struct. messages: with reactions (an
    array of name and count) and file_ids; code, links and mentions are taken from the text."""
    t = F.coalesce("text", F.lit(""))
    some = lambda a: F.when(F.size(a) > 0, a)
    fields = F.struct(
        "message_id", "user_id", "user_name", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "text", "has_code", some(F.array_sort(F.array_distinct(ft.code_languages(t)))).alias("code_languages"), "reactions", "reaction_count",
        some(ft.links(t)).alias("links"), "file_ids", some(ft.mentions(t)).alias("mentioned_users"), "importance_score",
    )
    return messages.select("message_id", fields.alias("m"))


# Lines of a prompt.
MORE, REACTIONS, THREADS = "_[{} additional messages in thread]_\n", "_Reactions: {}_\n", "## Relevant Discussions\n"
DISCUSSION, CHANNEL, MESSAGES = "### Discussion {}", "**Channel**: #{}", "**Messages** ({}):\n"
OVERVIEW = ["## Context Overview", "- Found {} relevant discussions", "- Total messages: {}", "- Channels: {}", "- Participants: {}", "  (and {} more)", "- Time period: {} to {}"]
ASKED = ["## User Question", "## Instructions", "- The user is looking for code. Include complete code snippets with syntax highlighting.", "- Pay special attention to the time period: {}", "- Focus on information related to: {}"]
CLOSING = ["- Provide citations with [Channel, @User, timestamp] format for all factual claims.", "- If information is not found in the context, explicitly state that.", "- Be concise but comprehensive."]


def _put(form: str, *values: Column) -> Column:
    """The form with its places filled; null if a value is null."""
    parts = form.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(values, parts[1:]) for x in (v.cast("string"), F.lit(p))))


def _line() -> Column:
    """A message as text, or the placeholder."""
    m = F.col("m")
    reactions = F.array_join(F.transform(m["reactions"], lambda r: F.concat(F.lit(":"), r["name"], F.lit(": "), r["count"].cast("string"))), ", ")
    return F.when(F.col("message_id") == SUMMARY, _put(MORE, F.col("left_out"))).otherwise(F.concat_ws(
        "\n", F.concat(F.lit("**"), F.coalesce(m["user_name"], F.lit("Unknown")), F.lit("** ("), F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("")), F.lit("):")), F.concat(F.coalesce(m["text"], F.lit("")), F.lit("\n")),
        F.when(F.size(m["reactions"]) > 0, _put(REACTIONS, reactions)),
    ))


def assembled(rows: DataFrame, contexts: DataFrame, fields: DataFrame) -> DataFrame:
    """One row for each query: contexts, by score, an array of structs of the thread, its messages in order and its metadata;
    meta, its overview; connections. A query has at most the budget's messages. fields: message_fields()."""
    met = rows.join(fields, "message_id", "left")
    is_summary = F.col("message_id") == SUMMARY
    message = F.struct("pos", "message_id", is_summary.alias("is_summary"), F.when(is_summary, F.concat(F.lit("["), F.col("left_out").cast("string"), F.lit(" additional messages in thread]"))).alias("summary_text"), "m")
    per = met.groupBy("query_id", "thread").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    facts = F.struct("total_messages", "participants", "reply_count", "importance_score").alias("metadata")
    one = F.struct((-F.col("score")).alias("o"), "thread", "is_thread", "channel_id", "channel_name", "messages", F.lit(None).cast("string").alias("summary"), facts, "score").alias("c")
    nested = contexts.join(per, ["query_id", "thread"]).select("query_id", one).groupBy("query_id").agg(F.sort_array(F.collect_list("c")).alias("contexts"))
    links = connections(contexts).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("kind", "name", "n_threads"))).alias("connections"))
    overview = meta(rows, contexts).select("query_id", F.struct("n_threads", "n_messages", "channels", "participants", "first_ts", "last_ts").alias("meta"))
    return nested.join(overview, "query_id").join(links, "query_id", "left")


def prompt_rows(rows: DataFrame, contexts: DataFrame, queries: DataFrame, fields: DataFrame, as_of: Column, most_threads: int = 10, most_people: int = 10) -> DataFrame:
    """(query_id, intent, system, prompt) of each query: instructions for its first intent, and one message with an
    overview, the threads by score with their messages, the question, and what to heed. fields: message_fields()."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "thread")
    ranked = contexts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most_threads).select("query_id", "thread", "r", F.col("channel_name").alias("channel"))
    met = rows.join(fields, "message_id", "left").join(ranked, ["query_id", "thread"])
    lines = met.groupBy("query_id", "r", "channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", _line().alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.concat_ws("\n", _put(DISCUSSION, F.col("r")), _put(CHANNEL, F.coalesce("channel", F.lit("unknown"))), _put(MESSAGES, F.size("lines")), F.array_join("lines", "\n"), F.lit(""))
    body = lines.select("query_id", F.struct("r", head.alias("t")).alias("t")).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["t"]), "\n").alias("threads"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    people = F.col("participants")
    overview = F.concat_ws(
        "\n", F.lit(OVERVIEW[0]), _put(OVERVIEW[1], F.col("n_threads")), _put(OVERVIEW[2], F.col("n_messages")), F.when(F.col("channels") != "", _put(OVERVIEW[3], F.replace("channels", F.lit(","), F.lit(", ")))),
        F.when(F.size(people) > 0, _put(OVERVIEW[4], F.array_join(F.slice(people, 1, most_people), ", "))), F.when(F.size(people) > most_people, _put(OVERVIEW[5], F.size(people) - most_people)),
        _put(OVERVIEW[6], stamp("first_ts"), stamp("last_ts")), F.lit(""),
    )
    q = F.col("query_text")
    names = F.transform(ft.entities(q), lambda e: e["text"])
    asked = F.concat_ws(
        "\n", F.lit(ASKED[0]), F.concat(q, F.lit("\n")), F.lit(ASKED[1]), F.when(F.col("has_code_intent"), ASKED[2]), _put(ASKED[3], ft.temporal(q, as_of)["phrase"]),
        F.when(F.size(names) > 0, _put(ASKED[4], F.array_join(names, ", "))), *map(F.lit, CLOSING),
    )
    known = meta(rows, contexts).select("query_id", overview.alias("overview")).join(body, "query_id")
    intent = F.element_at(ft.intents(q), 1)
    system = F.concat(F.lit(SYSTEM["base"] + "\n\n"), F.element_at(F.create_map(*(F.lit(x) for k in SYSTEM if k != "base" for x in (k, SYSTEM[k]))), intent))
    found = queries.select("query_id", intent.alias("intent"), system.alias("system"), asked.alias("asked")).join(known, "query_id", "left")
    return found.select("query_id", "intent", "system", F.concat_ws("\n", "overview", F.when(F.col("threads").isNotNull(), F.lit(THREADS)), "threads", "asked").alias("prompt"))
