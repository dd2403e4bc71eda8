"""Exact top-k search by inner product, by columnar branch-and-bound.

Vectors become whole numbers, floor(scale * x). Candidates are laid out dimension by dimension in blocks.
A block of queries meets a block of candidates a few dimensions at a time: after each step a candidate
goes on only if its score so far plus what the remaining dimensions can add at most (the product of the
two remaining norms) reaches the k-th best score known, and the survivors are moved together.

Candidate blocks are dealt into groups once; bundles of query blocks, which are few, are sent to every group. A block of
queries takes the blocks of a group one after another, with the k-th best score of each query as the bar of the next, so that a group
gives at most k rows per query; these are merged by a window that keeps k per query before it shuffles.

Ties go to the smaller id. Scores are exact wherever they fit in 64 bits: sums that 53 bits don't hold are made again
in whole numbers. Vectors that are null, hold null or non-finite components, or have no id take no part; empty
vectors score 0; queries meet candidates of their own length only. Of rows that repeat an id, each counts as a row of
its own, and none is a candidate for a query of the same id. Empty tables give empty tables; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import ready, table, written

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
#: Candidate blocks in a group, and query blocks in a bundle, about; a task holds one of each.
GROUP_BLOCKS, BUNDLE_BLOCKS = 16, 64
#: Dimensions that are added up between two bounds.
STEP = 16
_BLOCKS = "dim int, block long, ids binary, width int, rows binary"


def _packed(df: DataFrame, size: int) -> DataFrame:
    """Rows (id, v array<long>, dim) as blocks of `size` vectors of equal length, whole numbers of the fewest bytes that
    hold them, dimension by dimension."""

    def run(batches):
        part, count, held = TaskContext.get().partitionId(), 0, {}

        def flush(dim):
            nonlocal count
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for a in range(0, len(ids), size):
                count += 1
                block = rows[a : a + size].T
                low, high = (block.min(), block.max()) if block.size else (0, 0)
                kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
                arrays = [pa.array([dim], pa.int32()), pa.array([(part << 32) + count], pa.int64()), pa.array([ids[a : a + size].tobytes()], pa.binary()), pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([np.ascontiguousarray(block, kind).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["dim", "block", "ids", "width", "rows"])

        for batch in batches:
            dims = batch.column(2).to_numpy()
            ids = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy()
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                held.setdefault(dim, []).append((ids[which], flat[starts[which][:, None] + np.arange(dim)]))
                if sum(len(x) for x, _ in held[dim]) >= size:
                    yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    return df.select("id", "v", "dim").mapInArrow(run, _BLOCKS)


def block_top_k(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, those below its bar `known` left out: query numbers, candidate numbers,
    scores. q, c: whole numbers, dimension by row."""
    dims, n = c.shape
    whole_q, whole_c = q.astype(np.int64), c
    q, c = q.astype(np.float64), c.astype(np.float64)
    edges = [*range(0, dims, STEP), dims]
    rest_q = [np.sqrt((q[e:] ** 2).sum(0)) for e in edges]
    rest_c = [np.sqrt((c[e:] ** 2).sum(0)) for e in edges]
    most = rest_q[0] * rest_c[0].max(initial=0)  # no sum of a query is larger
    exact = most.max(initial=0) < 2**52
    slack = most * (1e-12 if exact else 1e-12 + dims * 2.0**-50) + 1e-6
    # scores of the candidates of largest norm set the first bar
    seed = np.argsort(-rest_c[0], kind="stable")[: 4 * k]
    first = q.T @ c[:, seed]
    first[q_ids[:, None] == c_ids[seed][None, :]] = -np.inf
    bar = np.partition(first, -k, 1)[:, -k] if first.shape[1] >= k else np.full(len(q_ids), -np.inf)
    bar = (bar if known is None else np.maximum(bar, known)) - 2 * slack
    out_q, out_c, out_s = [], [], []
    step_scores = q[: edges[1]].T @ c[: edges[1]]
    for i in range(len(q_ids)):
        alive, score = None, step_scores[i]
        for s in range(1, len(edges)):
            if s > 1:
                score = score + q[edges[s - 1] : edges[s], i] @ (c[edges[s - 1] : edges[s]] if alive is None else c[edges[s - 1] : edges[s]][:, alive])
            if s + 1 < len(edges):
                reach = score + rest_q[s][i] * (rest_c[s] if alive is None else rest_c[s][alive])
                stay = np.flatnonzero(reach >= bar[i])
                if len(stay) < 0.7 * len(score):
                    alive = stay if alive is None else alive[stay]
                    score = score[stay]
        who = np.arange(n) if alive is None else alive
        stay = (c_ids[who] != q_ids[i]) & (score >= bar[i])
        if not stay.all():
            who, score = who[stay], score[stay]
        if len(who) > k:
            near = score >= np.partition(score, -k)[-k] - (0 if exact else 2 * slack[i])
            who, score = who[near], score[near]
        score = score.astype(np.int64) if exact else (whole_q[:, i, None] * whole_c[:, who].astype(np.int64)).sum(0)
        order = np.lexsort((c_ids[who], ~score))[:k]
        out_q.append(np.full(len(order), i))
        out_c.append(who[order])
        out_s.append(score[order])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _block(raw: bytes, width: int, dim: int) -> np.ndarray:
    """A block's rows, dimension by row; of vectors without dimensions there is nothing."""
    return np.frombuffer(raw, f"<i{width}").reshape(dim, -1) if dim else np.zeros((0, 0), np.int8)


def _group_top_k(candidates: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of the k best of a group's blocks for each row of a query block."""
    who, near, score = (np.zeros(0, np.int64) for _ in range(3))
    bar = np.full(len(ids), -np.inf)
    for c_ids, c in candidates:
        if len(q):
            left, right, s = block_top_k(q, c, ids, c_ids, k, bar)
            found = c_ids[right]
        else:  # all scores are 0, so that the first ids are the best
            first = np.sort(c_ids)
            picked = [x[x != i][:k] for i in ids for x in (first[: k + int((first == i).sum())],)]
            left, found = np.repeat(np.arange(len(ids)), [len(x) for x in picked]), np.concatenate(picked)
            s = np.zeros(len(found), np.int64)
        who, near, score = np.append(who, left), np.append(near, found), np.append(score, s)
        order = np.lexsort((near, ~score, who))
        who, near, score = who[order], near[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        who, near, score = who[rank < k], near[rank < k], score[rank < k]
        last = np.flatnonzero(rank[rank < k] == k - 1)
        bar[who[last]] = score[last]
    return ids[who], near, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best of `vectors` for each row of `queries`."""
    spark = ready(vectors.sparkSession)

    def whole(df):
        rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        return rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.size("v").alias("dim"))

    c = written(_packed(whole(vectors), CANDIDATE_BLOCK), "topk-blocks")
    q = written(_packed(whole(queries), QUERY_BLOCK), "topk-queries")
    blocks = c.count()
    groups = max(-(-blocks // GROUP_BLOCKS), min(blocks, 2 * spark.sparkContext.defaultParallelism), 1)
    bundles = max(1, -(-q.count() // BUNDLE_BLOCKS))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.select("dim", "ids", "width", "rows", dealt(groups).alias("part"), each(bundles).alias("bundle"))
    q = q.select("dim", "ids", "width", "rows", dealt(bundles).alias("bundle"), each(groups).alias("part"))
    keys = ("dim", "part", "bundle")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if len(left) and len(right):
            opened = lambda t: [(np.frombuffer(ids, np.int64), _block(raw, width, dim)) for dim, ids, width, raw in zip(*(t[x].to_pylist() for x in ("dim", "ids", "width", "rows")))]
            candidates = opened(left)
            parts = [_group_top_k(candidates, *block, k) for block in opened(right)]
            out = [np.concatenate(x) for x in zip(*parts)]
        return pa.table([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    found = c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
