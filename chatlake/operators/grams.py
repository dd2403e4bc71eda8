"""Substring search by an index of byte grams: a needle meets only the texts that have its rarest gram.

A gram is six bytes of UTF-8, hashed to 24 bits; needles of three to five bytes have grams of three, a needle of fewer bytes
is a gram of its own, and the empty one stands in every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import ready, written

#: Where the codes of grams of six, three, two, one and no byte begin, and their number.
_BASE = {6: 0, 3: 1 << 24, 2: 2 << 24, 1: (2 << 24) + (1 << 16), 0: (2 << 24) + (1 << 16) + (1 << 8)}
_ALL = _BASE[0] + 1
#: Bytes of text that are looked up at a time.
_CHUNK = 1 << 20


def _codes(raw: np.ndarray, size: int) -> np.ndarray:
    """The code of each run of `size` bytes (one at least): eight bytes are read at each place at once, and the others masked."""
    number = np.ndarray((len(raw) - size + 1,), "<u8", np.append(raw, np.zeros(8, np.uint8)), 0, (1,)) & np.uint64((1 << 8 * size) - 1)
    if size == 6:
        number *= np.uint64(0x9E3779B97F4A7C15)
        number >>= np.uint64(40)
    number += np.uint64(_BASE[size])
    return number.view(np.int64)


def codes_of(needle: str) -> list[int]:
    """The distinct grams of a needle."""
    raw = np.frombuffer(needle.encode(), np.uint8)
    size = next(n for n in _BASE if n <= len(raw))
    return np.unique(_codes(raw, size)).tolist() if size else [_BASE[0]]


def _found(texts: pa.Array, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and codes of the wanted grams of texts, each once for a text. wanted: a flag for each code."""
    for row, code in _seen(texts, wanted):
        both = np.unique(row * _ALL + code)
        yield both // _ALL, both % _ALL


def _seen(texts: pa.Array, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and codes of the wanted grams of texts, as often as they stand there; a text's are given at once."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    _, where, data = texts.buffers()
    off = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    used = [n for n in (6, 3, 2, 1) if wanted[_BASE[n] : _BASE[{6: 3, 3: 2, 2: 1, 1: 0}[n]]].any()]
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + _CHUNK, "right")) - 1))
        b, starts = raw[off[at] : off[to]], off[at : to + 1] - off[at]
        rows, codes = [], []
        for size in used:
            if len(b) >= size:
                code = _codes(b, size)
                hit = np.flatnonzero(wanted[code])
                row = np.searchsorted(starts, hit, "right") - 1
                inside = hit + size <= starts[row + 1]
                rows.append(row[inside])
                codes.append(code[hit[inside]])
        if wanted[_BASE[0]]:
            rows.append(np.flatnonzero(known[at:to]))
            codes.append(np.full(len(rows[-1]), _BASE[0]))
        if rows:
            yield at + np.concatenate(rows), np.concatenate(codes)
        at = to


def _flags(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(_ALL, bool)
    out[codes] = True
    return out


def with_rarest(needles: DataFrame, texts: DataFrame, needle: str = "needle", text: str = "hay") -> DataFrame:
    """needles, written, with `code`: the gram that stands least often in all texts. Needles with a gram that no text has are left out."""
    spark = ready(needles.sparkSession)
    place = needles.columns.index(needle)

    def split(batches):
        for batch in batches:
            grams = [codes_of(x) if x is not None else [] for x in batch.column(place).to_pylist()]
            yield batch.append_column("codes", pa.array(grams, pa.list_(pa.int32())))

    schema = T.StructType([*needles.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])
    each = written(needles.mapInArrow(split, schema), "grams-needles")
    codes = each.select(F.explode("codes").alias("code")).distinct()
    # a number for each of at most 2**24 grams
    wanted = spark.sparkContext.broadcast(np.sort(codes.toArrow()["code"].to_numpy()))

    def counted(batches):
        flags, n = _flags(wanted.value), np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for _, code in _seen(batch.column(0), flags):
                n += np.bincount(np.searchsorted(wanted.value, code), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(wanted.value[at].astype(np.int32)), pa.array(n[at])], ["code", "n"])

    counts = texts.select(text).mapInArrow(counted, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    keys = [c for c in needles.columns if c != needle]
    ranked = each.select(needle, F.size("codes").alias("size"), F.explode(F.array_distinct("codes")).alias("code")).distinct().join(counts, "code")
    rarest = ranked.groupBy(needle, "size").agg(F.count(F.lit(1)).alias("seen"), F.min(F.struct("n", "code")).alias("x")).where("seen = size").select(needle, "x.code")
    return written(each.select(*keys, needle).join(rarest, needle), "grams-rarest")


def postings(texts: DataFrame, needles: DataFrame, text: str = "hay") -> DataFrame:
    """texts, once for each gram `code` of the needles that they have."""
    spark = ready(texts.sparkSession)
    wanted = spark.sparkContext.broadcast(needles.select("code").distinct().toArrow()["code"].to_numpy())
    place = texts.columns.index(text)

    def run(batches):
        flags = _flags(wanted.value)
        for batch in batches:
            for row, code in _found(batch.column(place), flags):
                for at in range(0, len(row), 1024):
                    yield batch.take(pa.array(row[at : at + 1024])).append_column("code", pa.array(code[at : at + 1024].astype(np.int32)))

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("code", T.IntegerType())]))


def holding(texts: DataFrame, needles: DataFrame, needle: str = "needle", text: str = "hay") -> DataFrame:
    """Each text with each needle that stands in it. Needles are few enough to be sent where Spark finds them so; texts
    are not dealt out then."""
    known = with_rarest(needles, texts, needle, text)
    return postings(texts, known, text).join(known, "code").where(F.contains(text, needle)).drop("code")
