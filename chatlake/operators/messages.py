"""Message rows from raw events, and the log of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as ft
from ..sources.shared import ready

#: Texts that the embedder gets at once.
EMBED_BATCH = 100


def _filled(a: Column) -> Column:
    """Null for an empty list."""
    return F.when(F.size(a) > 0, a)


def message_rows(events: DataFrame, team_id: Column) -> DataFrame:
    """The table's row of each message event; events with neither a user nor a bot are dropped.

    events: ts, event_ts, user, username, bot_id, channel, channel_name, thread_ts, text, type, subtype, files (array of
    structs with id), reaction_total, event_reply_count. A null text is empty."""
    text = F.coalesce("text", F.lit(""))
    at = F.coalesce("ts", "event_ts")
    bot = F.col("user").isNull() | (F.col("user") == "")
    user = F.when(~bot, F.col("user")).when(F.col("bot_id") != "", F.concat(F.lit("BOT:"), "bot_id"))
    files = F.filter(F.transform(F.coalesce("files", F.array().cast("array<struct<id:string>>")), lambda f: f["id"]), lambda i: i.isNotNull() & (i != ""))
    # taken from the text once, as several columns are derived of each
    events, raw = events.withColumns({"__links": ft.links(text), "__code": ft.code_languages(text), "__mentions": ft.mentions(text), "__files": files}), F.to_json(F.struct(*events.columns))
    links, code, held = F.col("__links"), F.col("__code"), F.col("__files")
    rows = events.select(
        at.alias("message_id"), F.col("channel").alias("channel_id"), "channel_name", user.alias("user_id"), F.when(bot, F.coalesce("username", F.lit("bot"))).otherwise(F.col("username")).alias("user_name"), team_id.alias("team_id"),
        "thread_ts", F.coalesce(F.col("thread_ts") == at, F.lit(False)).alias("is_thread_parent"), text.alias("text"), ft.clean(text).alias("text_processed"), F.coalesce("type", F.lit("message")).alias("message_type"), "subtype",
        F.timestamp_seconds(at.cast("double")).alias("timestamp"), (F.size(code) > 0).alias("has_code"), _filled(F.array_sort(F.array_distinct(code))).alias("code_languages"), (F.size(held) > 0).alias("has_files"), _filled(held).alias("file_ids"),
        (F.size(links) > 0).alias("has_links"), _filled(links).alias("links"), F.lit(0).cast("long").alias("reaction_count"), F.lit(None).cast("array<struct<name:string,count:int>>").alias("reactions"), _filled(F.col("__mentions")).alias("mentioned_users"),
        ft.importance(text, F.col("reaction_total"), F.col("event_reply_count"), F.size(held) > 0).alias("importance_score"), raw.alias("raw_json"),
    )
    return rows.where("user_id IS NOT NULL")


def embed_texts(rows: DataFrame) -> DataFrame:
    """(message_id, embed_text): what is embedded of a message, its channel, the start of the message that its thread
    replies to, its cleaned text and the languages of its code. rows: message_id, channel_id, channel_name, thread_ts,
    text, text_processed, code_languages (null without code)."""
    said = lambda c: F.when(F.col(c) != "", F.col(c))
    parent = rows.select(F.col("message_id").alias("__parent"), F.substring(said("text"), 1, 200).alias("topic"))
    met = rows.join(parent, rows["thread_ts"] == parent["__parent"], "left")
    parts = [
        F.concat(F.lit("Channel: "), F.coalesce(said("channel_name"), "channel_id")), F.when(F.col("thread_ts") != F.col("message_id"), F.concat(F.lit("Thread Topic: "), "topic")),
        F.concat(F.lit("Message: "), F.coalesce(said("text_processed"), "text")), F.when(F.size("code_languages") > 0, F.concat(F.lit("Contains code: "), F.array_join("code_languages", ", "))),
    ]
    return met.select("message_id", F.concat_ws("\n", *parts).alias("embed_text"))


def vector_metadata(rows: DataFrame) -> Column:
    """The metadata of a message's vector, as one struct; texts are cut to 1000 characters, nulls are empty."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return F.struct(
        "message_id", "channel_id", blank("channel_name"), "user_id", blank("user_name"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), blank("thread_ts"), "is_thread_parent", F.substring("text", 1, 1000).alias("text"),
        "has_code", none("code_languages"), none("mentioned_users"), "reaction_count", "reply_count", "importance_score", "has_files",
    )


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH, out_col: str = "embedding") -> DataFrame:
    """df with the vectors that `model` makes of its texts, at most `batch` at a time. Null texts have null vectors."""
    ready(df.sparkSession)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = part.column(place).to_pylist()
                made = iter(model([t for t in texts if t is not None]))
                yield part.append_column(out_col, pa.array([None if t is None else next(made) for t in texts], pa.list_(pa.float64())))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))


def hashing_model(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """An embedder without a service: words add or take 1 in a slot that their MD5 names, and vectors get length 1."""

    def model(texts: list[str]) -> list[list[float]]:
        import hashlib

        import regex

        word, out = regex.compile(ft.WORD), []
        for t in texts:
            v = [0.0] * dim
            for w in word.findall(t.lower()):
                h = hashlib.md5(w.encode()).hexdigest()
                v[int(h[:4], 16) % dim] += 1.0 if int(h[4], 16) % 2 == 0 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out

    return model


def query_log(queries: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """A log row for each query with the number of its results: what analysis found, the first intent as its type."""
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results_count"))
    a = queries.select("query_id", ft.analysis(F.col("query_text"), as_of).alias("a"))
    return a.join(counts, "query_id", "left").select(
        "query_id", F.col("a.original_query").alias("query_text"), F.element_at("a.intents", 1).alias("intent_type"), F.col("a.entities").alias("entities_extracted"),
        F.col("a.temporal.start").alias("date_range_start"), F.col("a.temporal.end").alias("date_range_end"), F.col("a.channels").alias("channel_filters"), F.coalesce("results_count", F.lit(0)).alias("results_count"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
