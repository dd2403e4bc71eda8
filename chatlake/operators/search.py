"""Retrieval of a table of queries over a table of messages: three ranked lists, fusion and rerank."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from .blocks import meet, meet_groups
from .grams import holding

SEMANTIC, KEYWORD, ENTITY, CANDIDATES, RRF_K = 100, 50, 30, 200, 60
AS_OF = "2024-06-01 00:00:00"


def best(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each group with their `rank`; at most k rows a group leave each task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def with_filters(queries: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """queries with the channels, users and time range that their texts name: channels, users, start_at, end_at."""
    span = ft.temporal(F.col("query_text"), F.lit(as_of).cast("timestamp"))
    return queries.withColumns({"channels": ft.channels(F.col("query_text")), "users": ft.users(F.col("query_text")), "start_at": span["start"], "end_at": span["end"]})


def passes(filtered: bool, by_user: bool = False) -> Column:
    """Channel, code and time filters of a query, cheap ones first, and by_user those on users, which the keyword list
    has and the vector list has not. Channels named in the text count as they stand here; the vector list drops unknown ones."""
    if not filtered:
        return F.lit(True)
    out = (F.col("channel_filter").isNull() | (F.col("channel_filter") == F.col("channel_name"))) & (~F.col("has_code_intent") | F.col("has_code"))
    out &= (F.col("start_at").isNull() | (F.col("ts") >= F.col("start_at"))) & (F.col("end_at").isNull() | (F.col("ts") <= F.col("end_at")))
    if by_user:
        out &= (F.size("channels") == 0) | F.array_contains("channels", F.col("channel_name"))
        out &= (F.size("users") == 0) | F.coalesce(F.array_contains("users", F.col("user_name")), F.lit(False)) | F.arrays_overlap("mentioned", "users")
    return out


def semantic(queries: DataFrame, messages: DataFrame, vectors: DataFrame, filtered: bool = False, k: int = SEMANTIC) -> DataFrame:
    """Top k by cosine: (query_id, message_id, score, rank). Vectors: (vec_id, embedding); those that are null, hold nulls
    or numbers that are not finite, or are all zeros take no part, and vectors meet those of their own length only. Exact:
    groups of blocks of messages meet blocks of queries as matrices, with the k-th best score of each query carried from
    block to block, so that a group gives k rows of a query at most."""
    v = vectors.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    micros = lambda c: F.unix_micros(F.col(c)).alias(c)
    known = F.broadcast(messages.agg(F.collect_set("channel_name").alias("known")))  # each channel's name once
    q = with_filters(queries).join(v, queries["query_id"] == v["vec_id"]).crossJoin(known).select("query_id", "channel_filter", F.array_intersect("channels", "known").alias("channels"), F.coalesce("has_code_intent", F.lit(False)).alias("code"), micros("start_at"), micros("end_at"), "v")
    m = messages.join(v, messages["doc_id"] == v["vec_id"]).select("message_id", "channel_name", F.coalesce("has_code", F.lit(False)).alias("code"), micros("ts"), "v")

    def run(blocks, q):
        rows = q.drop_columns("v").to_pylist()
        top = [_NONE] * len(rows)
        asked = _by_length(q)
        for m in blocks:
            for length, (there, x, norm) in _by_length(m).items():
                if length not in asked:
                    continue
                here, y, asked_norm = asked[length]
                part = m.take(pa.array(there))
                ids = np.array(part["message_id"].to_pylist(), object)
                at, names, code = part["ts"].to_numpy(), np.array(part["channel_name"].to_pylist(), object), part["code"].to_numpy()
                scores = np.round(y @ x.T / (asked_norm[:, None] * norm), 9)
                for n, s in zip(here.tolist(), scores):
                    row = rows[n]
                    ok = s >= top[n][0][-1] if len(top[n][0]) == k else np.ones(len(s), bool)
                    if filtered:
                        ok &= code | (not row["code"])
                        if row["channel_filter"] is not None:
                            ok &= names == row["channel_filter"]
                        if row["channels"]:
                            ok &= np.isin(names.astype(str), row["channels"])
                        if row["start_at"] is not None:
                            ok &= at >= row["start_at"]
                        if row["end_at"] is not None:
                            ok &= at <= row["end_at"]
                    which = np.flatnonzero(ok)
                    if len(which) > k:  # with all of the k-th score, as ids decide between these
                        which = which[s[which] >= np.partition(s[which], -k)[-k]]
                    if len(which):
                        score, who = np.append(top[n][0], s[which]), np.append(top[n][1], ids[which])
                        order = np.lexsort((who, -score))[:k]
                        top[n] = score[order], who[order]
        for row, (score, who) in zip(rows, top):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), row["query_id"], np.int64)), pa.array(who.tolist(), pa.string()), pa.array(score)], ["query_id", "message_id", "score"])

    scored = meet_groups(m, q, run, "query_id long, message_id string, score double")
    return best(scored, k, F.desc("score"), F.col("message_id"))


_NONE = (np.zeros(0), np.zeros(0, object))


def _by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, matrix and norms of the vectors `v` of each length."""
    v = rows["v"].combine_chunks()
    sizes = np.diff(v.offsets.to_numpy())
    flat, starts, out = v.flatten().to_numpy(), np.cumsum(sizes) - sizes, {}
    for n in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == n)
        x = flat[starts[which][:, None] + np.arange(n)]
        out[n] = which, x, np.sqrt((x * x).sum(1))
    return out


def keyword(queries: DataFrame, messages: DataFrame, k: int = KEYWORD) -> DataFrame:
    """The whole query as a substring, by importance: (query_id, message_id, score, rank). A query meets only the messages
    that have its rarest gram."""
    q = with_filters(queries).select("query_id", F.lower("query_text").alias("needle"), "channel_filter", F.coalesce("has_code_intent", F.lit(False)).alias("has_code_intent"), "channels", "users", "start_at", "end_at")
    m = messages.select("message_id", "channel_name", "user_name", ft.mentions(F.col("text")).alias("mentioned"), "ts", "has_code", "importance_score", F.lower("text").alias("hay"))
    met = holding(m, q).where(passes(True, by_user=True)).select("query_id", "message_id", "importance_score")
    ranked = best(met, k, F.desc("importance_score"), F.col("message_id"))
    score = (k - (F.col("rank") - 1)) / k * 0.5 + F.col("importance_score") / 10 * 0.5
    return ranked.select("query_id", "message_id", F.round(score, 9).alias("score"), "rank")


def entity(queries: DataFrame, messages: DataFrame, k: int = ENTITY) -> DataFrame:
    """Any entity of the query as a substring, by importance: (query_id, message_id, score, rank).

    One automaton of a block's distinct entities finds all of them in a text at once. A query's k best messages are
    among the k best of each of its entities, so that no task gives more than k rows for each entity."""
    q = queries.select("query_id", F.transform(ft.entities(F.col("query_text")), lambda e: F.lower(e["text"])).alias("needles")).where(F.size("needles") > 0)
    m = messages.select("message_id", F.col("importance_score").cast("double").alias("importance_score"), F.lower("text").alias("hay")).where("hay IS NOT NULL")
    asked = q.select("query_id", F.explode(F.array_distinct("needles")).alias("needle"))

    def pair(m, needles):
        machine = ahocorasick.Automaton()
        for needle in needles["needle"].to_pylist():
            machine.add_word(needle, needle)
        machine.make_automaton()
        texts, ids = m["hay"].to_pylist(), m["message_id"].to_pylist()
        weight = m["importance_score"].to_numpy(zero_copy_only=False)
        found: dict[str, list[int]] = {}
        # best first, so that an entity that has its k messages needs no more
        for i in np.lexsort((np.array(ids, object), -np.nan_to_num(weight, nan=-np.inf))).tolist():
            for needle in {x for _, x in machine.iter(texts[i])}:
                rows = found.setdefault(needle, [])
                if len(rows) < k:
                    rows.append(i)
        at = pa.array([i for rows in found.values() for i in rows], pa.int64())
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([n for n, rows in found.items() for _ in rows], pa.string()), m["message_id"].combine_chunks().take(at), m["importance_score"].combine_chunks().take(at)], ["needle", "message_id", "importance_score"])

    hits = meet(m, asked.select("needle").distinct(), pair, "needle string, message_id string, importance_score double", small_rows=4096)
    hits = best(hits, k, F.desc("importance_score"), F.col("message_id"), by="needle").drop("rank")
    top = best(asked.join(hits, "needle").select("query_id", "message_id", "importance_score").distinct(), k, F.desc("importance_score"), F.col("message_id"))
    # the texts go along only for the k rows that stay
    top = top.join(q, "query_id").join(m.select("message_id", "hay"), "message_id")
    share = F.size(F.filter("needles", lambda e: F.contains(F.col("hay"), e))) / F.size("needles")
    return top.select("query_id", "message_id", F.round(share * 0.7 + F.col("importance_score") / 10 * 0.3, 9).alias("score"), "rank")


def fuse(**lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, in the order given: (query_id, message_id, rrf, n_sources, first, rank)."""
    parts = None
    for i, ranked in enumerate(lists.values()):
        part = ranked.select("query_id", "message_id", F.col("rank").alias("at"), F.lit(i).alias("source"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", "message_id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("at"))), 12).alias("rrf"), F.count(F.lit(1)).alias("n_sources"), F.min(F.col("source") * 1000 + F.col("at")).alias("first")
    )
    return best(fused, CANDIDATES, F.desc("rrf"), F.col("first"), F.col("message_id"))


def recency(ts: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000))
    return F.coalesce(F.exp(-days / 30.0), F.lit(0.0))


def rerank(fused: DataFrame, messages: DataFrame, top_k: int = 10, as_of: str = AS_OF) -> DataFrame:
    """The top_k of each query: reranked by features if a query has more candidates than that, else in fused order.
    Reactions and code count only for rows that the semantic list (source 0) saw."""
    m = messages.select("message_id", "importance_score", "reaction_count", "has_code", "ts", "channel_id", "channel_name", "user_name", F.substring("text", 1, 500).alias("text"))
    rows = fused.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).join(m, "message_id")
    seen = F.col("first") < 1000
    final = (
        0.4 * F.col("rrf") + 0.2 * F.col("importance_score") / 10 + 0.15 * recency(F.col("ts"), F.lit(as_of).cast("timestamp"))
        + 0.1 * F.when(seen, F.least(F.col("reaction_count") / 10, F.lit(1.0))).otherwise(0.0) + 0.1 * F.when(seen & F.col("has_code"), 1.0).otherwise(0.0) + 0.05 * F.col("n_sources") / 3
    )
    scored = rows.withColumn("relevance", F.when(F.col("n") > top_k, F.round(final, 9)).otherwise(F.col("rrf"))).withColumnRenamed("rank", "fused_rank")
    return best(scored, top_k, F.desc("relevance"), F.col("fused_rank"))


def permalink(channel: Column, message_id: Column) -> Column:
    return F.when(channel.isNotNull(), F.concat(F.lit("https://chat.example/archives/"), channel, F.lit("/p"), F.replace(message_id, F.lit("."), F.lit(""))))


def precision_at(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean precision at each k; relevant: (message_id) of good messages."""
    hit = results.join(relevant.select("message_id", F.lit(1.0).alias("good")).distinct(), "message_id", "left")
    cuts = hit.select("query_id", F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank", F.coalesce("good", F.lit(0.0)).alias("good")).where("rank <= k")
    return cuts.groupBy("query_id", "k").agg(F.avg("good").alias("p")).groupBy("k").agg(F.round(F.avg("p"), 6).alias("precision"), F.count(F.lit(1)).alias("n_queries"))
