"""Harmonic packing of token sequences.

Lengths fall into classes of reciprocal capacity: a piece of length l is of class k = floor(capacity / l), and a bin of
class k takes k pieces, whatever their lengths in that class. Nothing but the class and the count decides where a
piece goes, so that every task packs its rows alone.

A document longer than a bin gives full pieces, and its rest goes whole into its class, or in two pieces if these leave
at least WORTH tokens less of their bins' shares empty: 700 tokens as 512 and 188 fill halves and fifths. The bins that a
task leaves open at its end are packed together, largest pieces first.

Null texts are empty: a document of the end id alone. Empty tables give empty tables. Repeated rows are
packed like different documents, and rows without an id too. Very long texts give as many full pieces as they fill.
Ties between two cuts go to the shorter second piece. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .session import ready, table

CAPACITY = 1024
#: Tokens of padding that a second piece has to save.
WORTH = 4
END_ID = 0


@functools.lru_cache(4)
def second_pieces(capacity: int) -> np.ndarray:
    """The length of the second piece of a rest of each length, 0 where the rest stays whole."""
    length = np.arange(capacity + 1)
    empty = np.full(capacity + 1, np.inf)
    empty[1:] = capacity / (capacity // length[1:]) - length[1:]  # of a piece's share of its bin
    out = np.zeros(capacity + 1, np.int64)
    for r in range(2, capacity + 1):
        both = empty[1 : r // 2 + 1] + empty[r - 1 : r - r // 2 - 1 : -1]
        best = int(both.argmin())
        if both[best] + WORTH <= empty[r]:
            out[r] = best + 1
    return out


def cut(n: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of n tokens: document numbers, starts and lengths, in order."""
    full = n // capacity
    rest = n - full * capacity
    second = second_pieces(capacity)[rest]
    count = full + (rest > 0) + (second > 0)
    docs = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(docs)) - np.repeat(np.cumsum(count) - count, count)
    lengths = np.where(place < full[docs], capacity, np.where(place == full[docs], (rest - second)[docs], second[docs]))
    return docs, np.minimum(place, full[docs]) * capacity + np.where(place > full[docs], (rest - second)[docs], 0), lengths


class Bins:
    """Places pieces class by class; pieces of a bin that is not yet full are held back."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.held = capacity, worker << 36, {}

    def add(self, lengths: np.ndarray, rows: np.ndarray):
        """Rows (any 2-d array) of pieces; gives (rows, sequence ids, offsets) of the bins that are full now."""
        classes = self.capacity // lengths
        for k in np.unique(classes).tolist():
            here = classes == k
            size, new = lengths[here], rows[here]
            if k in self.held:
                size, new = np.concatenate([self.held[k][0], size]), np.concatenate([self.held.pop(k)[1], new])
            whole = len(new) // k * k
            if whole < len(new):
                self.held[k] = size[whole:], new[whole:]
            if whole:
                inside = size[:whole].reshape(-1, k)
                yield new[:whole], self.next + np.arange(whole) // k, (np.cumsum(inside, 1) - inside).ravel()
                self.next += whole // k

    def close(self):
        """What is held back, largest pieces first, each bin filled before the next."""
        if not self.held:
            return
        size, rows = (np.concatenate(x) for x in zip(*self.held.values()))
        self.held = {}
        order = np.argsort(-size, kind="stable")
        seqs, offs = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        used, self.next = self.capacity, self.next - 1
        for i, length in enumerate(size[order].tolist()):
            if used + length > self.capacity:
                self.next, used = self.next + 1, 0
            seqs[i], offs[i] = self.next, used
            used += length
        yield rows[order], seqs, offs


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids)."""
    ready(df.sparkSession)
    source = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(bpe.vocabulary(path))

    def run(batches):
        bins = Bins(TaskContext.get().partitionId(), capacity)

        def rows(placed):
            for part, seqs, offs in placed:
                arrays = [pa.array(part[:, 0], mask=part[:, 6].astype(bool)), *(pa.array(part[:, j]) for j in (1, 2, 3, 4)), pa.array(seqs), pa.array(offs)]
                if with_ids:
                    arrays.append(pa.array([tokens.pop(int(x)) for x in part[:, 5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        tokens: dict[int, np.ndarray] = {}
        seen = 0

        def keep(batch, ids, at, *_):
            nonlocal seen
            n = np.diff(at) + 1
            docs, starts, lengths = cut(n, capacity)
            closed = np.full(len(ids) + len(n), END_ID, np.uint32)
            closed[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            begin = (np.cumsum(n) - n)[docs] + starts
            raw = memoryview(closed.astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + lengths).tolist())), np.int64, len(docs))
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            if with_ids:
                for i, (a, b) in enumerate(zip(begin.tolist(), (begin + lengths).tolist())):
                    tokens[seen + i] = closed[a:b].astype(np.int32)
            part = np.stack([doc_ids[docs], starts, lengths, crc, n[docs], seen + np.arange(len(docs)), null[docs]], 1)
            seen += len(docs)
            yield from rows(bins.add(lengths, part))

        yield from bpe.encoded_batches(batches, shared.value, keep)
        yield from rows(bins.close())

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), bpe.default_path())
