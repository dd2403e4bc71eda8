"""Removal of passages that repeat an earlier document, by sharded phrase automata.

A window is `WINDOW` consecutive words. Documents are dealt into shards of about SHARD_BYTES of text, which are
written once. The steps:

1. confirm: each window has an anchor, the phrase of `PHRASE` words inside it with the smallest hash, so that equal
   windows have equal anchors. Anchors that two documents have are recurring; the windows around them meet, one row
   for each distinct window of a shard (in runs of one anchor), and the smallest id of each window goes back to
   every shard that has a larger one only. Windows that recur inside a shard are confirmed there;
2. compile: the confirmed windows of a shard become the patterns of Aho-Corasick automata, word by word, with the
   smallest id as value (automata of PATTERNS patterns at most, as their memory is some hundred bytes a word);
3. stream: all documents of the shard run through its automata. Every hit whose value is smaller than the
   document's id removes its words; nothing else does.

In an automaton words are equal by their bytes. Between shards windows are equal by a hash of 64 bits among those of
one anchor, which itself is 60 bits.

Null and empty texts have no words. Rows without an id neither remove nor lose anything. Rows that repeat
an id do not remove from each other. Texts with fewer words than a window stay; very long texts are a shard of their
own and take time and memory in proportion. Of documents with equal windows the smallest id keeps its words. An empty table gives an empty table. Columns
with other names are ignored unless they are named in `carry`.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .session import ready, table, written

WINDOW, PHRASE = 13, 5
#: A phrase of five words of so many bits is a key of 60 bits.
LETTER_BITS = 12
#: Bytes of text in a shard, and what a row counts besides its text.
SHARD_BYTES, ROW_BYTES = 1 << 19, 64
#: Windows whose anchor is chosen more often than this meet by their own hashes, each in a row of its own, so that
#: a very common phrase isn't one key.
HOT_TIMES = 1024
#: Hot windows that a task remembers, so that its later shards needn't ask again. A full memory costs rows only.
REMEMBERED = 1 << 16
PATTERNS = 1 << 15
#: Level at which shards are compressed.
LEVEL = 6
_FIRST_LETTER = 0x100
_NONE = np.iinfo(np.int64).max


def phrase_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of the phrase at each place."""
    n = max(0, len(hashes) - PHRASE + 1)
    x = np.zeros(n, np.uint64)
    for j in range(PHRASE):
        x |= (hashes[j : j + n] & np.uint64((1 << LETTER_BITS) - 1)) << np.uint64(LETTER_BITS * j)
    return tx.mix(x)


class Words:
    """The words of a shard; its windows with their hashes and anchors come on demand."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.starts, self.ends, self.doc = tx.words(data, off)
        self.first = np.searchsorted(self.doc, np.arange(len(off)))
        n = len(self.doc) - WINDOW + 1
        inside = self.doc[WINDOW - 1 :] == self.doc[:n] if n > 0 else np.zeros(0, bool)
        self.at = np.flatnonzero(inside)  # the first word of each window

    def hashed(self) -> "Words":
        self.hash = tx.span_hashes(self.data, self.starts, self.ends)
        self.windows = tx.grams(self.hash, WINDOW)[self.at]
        return self

    def anchored(self) -> "Words":
        """keys: of the phrase at each word; anchor: the first word of each window's anchor."""
        self.keys = phrase_keys(self.hash)
        if not len(self.at):
            self.anchor = self.at
            return self
        key, at, width, goal = self.keys, np.arange(len(self.keys)), 1, WINDOW - PHRASE + 1
        while width < goal:  # the smallest of twice as many places, then of exactly as many as a window has
            by = min(width, goal - width)
            less = key[by:] < key[: len(key) - by]
            at = np.where(less, at[by:], at[: len(at) - by])
            key = np.where(less, key[by:], key[: len(key) - by])
            width += by
        self.anchor = at[self.at]
        return self


def _sharded(docs: DataFrame) -> DataFrame:
    """Shards of (id, text, others) as a written table: `shard` long, `z` (the shard's rows, compressed Arrow)."""

    def run(batches):
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            z = zstandard.ZstdCompressor(level=LEVEL).compress(memoryview(sink.getvalue()))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + count], pa.int64()), pa.array([z], pa.binary())], ["shard", "z"])

        for batch in batches:
            _, off = tx.utf8(batch.column(1))
            off = off + ROW_BYTES * np.arange(len(off))
            at, n = 0, batch.num_rows
            while at < n:
                to = int(np.searchsorted(off, off[at] + SHARD_BYTES - size, "right")) - 1
                if to <= at and not held:
                    to = at + 1
                if to > at:
                    to = min(n, to)
                    held.append(batch.slice(at, to - at))
                    size += int(off[to] - off[at])
                    at = to
                if at < n or size >= SHARD_BYTES:
                    yield flush()
                    held, size, count = [], 0, count + 1
        if held:
            yield flush()

    return written(docs.mapInArrow(run, "shard long, z binary"), "passages-shards")


def _rows_of(z: bytes) -> pa.RecordBatch:
    t = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(z)).read_all().combine_chunks()
    return t.to_batches()[0]


def _opened(z: bytes) -> tuple[pa.RecordBatch, np.ndarray, Words]:
    """A shard's rows, their ids (null: the largest number, which removes from and loses to none), their words."""
    rows = _rows_of(z)
    ids = rows.column(0).fill_null(_NONE).to_numpy()
    return rows, ids, Words(*tx.utf8(rows.column(1)))


def _phrases(shards: DataFrame) -> DataFrame:
    """(key, shard, low, high, times): each distinct anchor of a shard with the smallest and largest id that has it, and
    how often it is one."""

    def run(batches):
        for batch in batches:
            for shard, z in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, ids, w = _opened(z.as_py())
                w.hashed().anchored()
                at = w.anchor[np.flatnonzero(np.diff(w.anchor, prepend=-1))]
                key, who = w.keys[at], ids[w.doc[at]]
                key, who = key[who != _NONE], who[who != _NONE]
                order = np.argsort(key, kind="stable")
                key, who = key[order], who[order]
                if not len(key):
                    continue
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(key[head])), pa.array(np.full(len(head), shard)), pa.array(np.minimum.reduceat(who, head)), pa.array(np.maximum.reduceat(who, head)), pa.array(np.diff(np.append(head, len(key))).astype(np.int32))], ["key", "shard", "low", "high", "times"])
            tx.trim()

    return shards.mapInArrow(run, "key long, shard long, low long, high long, times int")


def _within(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    return of[np.minimum(at, len(of) - 1)] == values


def _asked(joined: DataFrame) -> DataFrame:
    """(shard, z, keys, hot) to rows for the judge: a key to meet by, the shard, the smallest id in it, the first
    word and the number of windows, and their hashes. Without hashes, the row is an answer: the id is smaller."""
    names = ["key", "shard", "id", "at", "n", "windows"]

    def run(batches):
        remembered: dict[int, int] = {}
        for batch in batches:
            for shard, z, keys, hot_keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                if not keys.is_valid:
                    continue
                _, ids, w = _opened(z.as_py())
                w.hashed().anchored()
                who = ids[w.doc[w.at]]
                hit = _within(w.keys[w.anchor], np.sort(keys.values.to_numpy().view(np.uint64))) & (who != _NONE)
                at, anchor, h, who = w.at[hit], w.anchor[hit], w.windows[hit], who[hit]
                if not len(at):
                    continue
                # each distinct window asks once, where its smallest id has it
                order = np.lexsort((who, h))
                lead = np.ones(len(order), bool)
                lead[1:] = h[order][1:] != h[order][:-1]
                asks = np.sort(order[lead])
                at, anchor, h, who = at[asks], anchor[asks], h[asks], who[asks]
                hot = _within(w.keys[anchor], np.sort(hot_keys.values.to_numpy().view(np.uint64)))
                answer = np.full(len(at), _NONE)
                for i in np.flatnonzero(hot).tolist():
                    least = remembered.get(int(h[i]), _NONE)
                    if least < who[i]:
                        answer[i] = least
                    elif least == _NONE and len(remembered) < REMEMBERED or least > who[i] and least != _NONE:
                        remembered[int(h[i])] = int(who[i])
                known = answer != _NONE
                meet = np.where(hot, h, w.keys[anchor])
                start = np.ones(len(at), bool)  # windows of one anchor go in one row
                start[1:] = (at[1:] != at[:-1] + 1) | hot[1:] | (anchor[1:] != anchor[:-1])
                start = np.flatnonzero(start)
                n = np.diff(np.append(start, len(at)))
                raw = h.tobytes()
                windows = [None if k else raw[8 * a : 8 * (a + m)] for a, m, k in zip(start.tolist(), n.tolist(), known[start].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(meet[start])), pa.array(np.full(len(start), shard)), pa.array(np.where(known, answer, who)[start]), pa.array(at[start].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(windows, pa.binary())], names)
            tx.trim()

    return joined.mapInArrow(run, "key long, shard long, id long, at int, n int, windows binary")


def _judged(rows: DataFrame) -> DataFrame:
    """(shard, at, n, low): windows that a smaller id of another shard has. Rows come by key and id, so that the
    first row of a window has its smallest id; between batches only the windows of the last key are kept."""
    names = ["shard", "at", "n", "low"]

    def run(batches):
        last, kept_h, kept_id = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            key, shard, ids, at, n = (batch.column(i).to_numpy() for i in range(5))
            local = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            if local.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[local]) for x in (shard, at, n, ids)], names)
            asks = ~local
            if not asks.any():
                continue
            h = np.frombuffer(tx.utf8(batch.column(5))[0].tobytes(), np.uint64)
            key, shard, ids, at, n = key[asks], shard[asks], ids[asks], at[asks], n[asks].astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            k, d, s = key[row], ids[row], shard[row]
            place = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            old = len(kept_h) if last is not None and last == key[0] else 0
            if old:
                h, k, d = np.concatenate([kept_h, h]), np.concatenate([np.full(old, last), k]), np.concatenate([kept_id, d])
            order = np.lexsort((d, h, k))
            head = np.ones(len(order), bool)
            head[1:] = (h[order][1:] != h[order][:-1]) | (k[order][1:] != k[order][:-1])
            low = np.empty(len(order), np.int64)
            low[order] = d[order][np.flatnonzero(head)][np.cumsum(head) - 1]
            gone = (d > low)[old:]
            lead = order[head]
            lead = lead[k[lead] == key[-1]]
            last, kept_h, kept_id = key[-1], h[lead], d[lead]
            place, s, low = place[gone], s[gone], low[old:][gone]
            if len(s):
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (place[1:] != place[:-1] + 1) | (low[1:] != low[:-1])
                start = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(s[start]), pa.array(place[start].astype(np.int32)), pa.array(np.diff(np.append(start, len(s))).astype(np.int32)), pa.array(low[start])], names)

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "shard long, at int, n int, low long")


def confirmed(w: Words, ids: np.ndarray, at: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a shard that some document in it has to lose: the first word of one occurrence of each, and
    the smallest id that has it, here or (at, low) elsewhere."""
    h, who = w.windows, ids[w.doc[w.at]]
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    elsewhere = np.full(len(w.starts), _NONE)
    elsewhere[at] = low
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    who = who[order]
    smallest = np.minimum(np.minimum.reduceat(who, head), np.minimum.reduceat(elsewhere[w.at[order]], head))
    loses = smallest < np.maximum.reduceat(np.where(who == _NONE, np.iinfo(np.int64).min, who), head)
    return w.at[order][head[loses]], smallest[loses]


def automata(word: np.ndarray, at: np.ndarray, low: np.ndarray):
    """The patterns (windows of words that start at `at`) as automata, each with what it needs to spell a word.

    word: a number for each word, the same for equal words only. The words of an automaton's patterns are numbered,
    and spelt as two digits with letters of their own, so that no node has many branches."""
    for a in range(0, len(at), PATTERNS):
        names, numbers = np.unique(word[at[a : a + PATTERNS, None] + np.arange(WINDOW)], return_inverse=True)
        base = math.isqrt(len(names)) + 1
        flat = _spelt(numbers.ravel(), base)
        machine = ahocorasick.Automaton()
        for i, value in enumerate(low[a : a + PATTERNS].tolist()):
            machine.add_word(flat[2 * i * WINDOW : 2 * (i + 1) * WINDOW], value)
        machine.make_automaton()
        yield machine, names, base


def _spelt(numbers: np.ndarray, base: int) -> str:
    return (np.stack([numbers // base, base + numbers % base], 1) + _FIRST_LETTER).astype("<u4").tobytes().decode("utf-32-le")


def occurrences(machine: ahocorasick.Automaton, names: np.ndarray, base: int, word: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every window that the automaton finds, and its value; none crosses documents.

    Words that are in no pattern, and what stands between two of them without room for a window, are passed over."""
    numbers = np.searchsorted(names, word)
    numbers[numbers == len(names)] = 0
    other = names[numbers] != word
    cuts = np.union1d(w.first[:-1][np.diff(w.first) > 0], np.concatenate([np.flatnonzero(other), np.flatnonzero(other) + 1, [len(word)]]))
    runs = np.diff(cuts)
    begin, size = cuts[:-1][runs >= WINDOW], runs[runs >= WINDOW]
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    ends, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    text, to = _spelt(numbers[place], base), np.cumsum(size).tolist()
    for x, y in zip([0, *to], to):
        hits = itertools.chain.from_iterable(machine.iter(text, 2 * x, 2 * y))
        found = np.fromiter(hits, np.int64).reshape(-1, 2)
        ends.append(found[:, 0])
        values.append(found[:, 1])
    return place[np.concatenate(ends) // 2 - WINDOW + 1], np.concatenate(values)


def removed(w: Words, ids: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which words of a shard go: those under a hit whose value is smaller than the document's id."""
    cover = np.zeros(len(w.starts) + 1, np.int64)
    if len(w.at):
        patterns, smallest = confirmed(w.hashed(), ids, at, low)
        word = tx.exact_keys(w.data, w.starts, w.ends, w.hash) if len(patterns) else None
        for machine, names, base in automata(word, patterns, smallest) if len(patterns) else ():
            start, value = occurrences(machine, names, base, word, w)
            who = ids[w.doc[start]]
            start = start[(value < who) & (who != _NONE)]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + WINDOW, -1)
    return np.cumsum(cover)[:-1] > 0


def _kept(joined: DataFrame, kinds: list[T.StructField]) -> DataFrame:
    """(shard, z, answers) to the rows of the result."""
    names = ["id", "n_words", "n_removed", "kept_sha256", "kept_text", *(k.name for k in kinds)]

    def run(batches):
        for batch in batches:
            for z, answers in zip(batch.column(1), batch.column(2)):
                rows, ids, w = _opened(z.as_py())
                at = low = np.zeros(0, np.int64)
                if answers.is_valid and len(answers.values):
                    spans = answers.values
                    n = spans.field("n").to_numpy().astype(np.int64)
                    at = np.repeat(spans.field("at").to_numpy() - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    low = np.repeat(spans.field("low").to_numpy(), n)
                keep = ~removed(w, ids, at, low)
                raw, first, off = w.data.tobytes(), w.first, w.off
                kept = np.append(0, np.cumsum(keep))[first]
                s, e = w.starts[keep].tolist(), w.ends[keep].tolist()
                texts = [b" ".join([raw[x:y] for x, y in zip(s[a:b], e[a:b])]) for a, b in zip(kept[:-1].tolist(), kept[1:].tolist())]
                n = np.diff(first)
                whole = (np.diff(kept) == n).tolist()
                out = [raw[x:y] if same else t for same, t, x, y in zip(whole, texts, off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()), pa.array(n - np.diff(kept), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(out, pa.binary()).cast(pa.string()), *rows.columns[2:]],
                    names,
                )
            tx.trim()

    fields = [("id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())]
    return joined.mapInArrow(run, T.StructType([T.StructField(*x) for x in fields] + kinds))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: its id, n_words, n_removed, kept_sha256 (of the words left, joined by one space),
    kept_text (these words; the text itself where nothing is removed), and the columns named in `carry`."""
    ready(docs.sparkSession)
    others = [f"carried_{i}" for i in range(len(carry))]
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *(docs[c].alias(o) for c, o in zip(carry, others)))
    shards = _sharded(docs)
    phrases = _phrases(shards)
    recurring = phrases.groupBy("key").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.sum("times").alias("times")).where("least < most").drop("least", "most")
    is_hot = F.col("times") > HOT_TIMES
    found = phrases.select("key", "shard").join(recurring, "key").groupBy("shard").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(is_hot, F.col("key"))).alias("hot"))
    # both joins are left ones, so that they read one shuffle of the shards
    asked = _asked(shards.join(found, "shard", "left").select("shard", "z", "keys", "hot"))
    answers = _judged(asked).groupBy("shard").agg(F.collect_list(F.struct("at", "n", "low")).alias("answers"))
    out = _kept(shards.join(answers, "shard", "left").select("shard", "z", "answers"), [docs.schema[o] for o in others])
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text", *(F.col(o).alias(c) for c, o in zip(carry, others)))


def op3_passages(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, p, w[p : p + 12] AS ws FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE doc_id IS NOT NULL)),
l AS (SELECT ws, min(doc_id) AS low FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT s.r, unnest(range(s.p, s.p + 13)) AS p FROM s JOIN l ON s.ws = l.ws WHERE l.low < s.doc_id),
k AS (SELECT d.r, d.doc_id, d.w, list(g.p) AS gone FROM d LEFT JOIN g ON g.r = d.r GROUP BY 1, 2, 3)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(gone, lambda x: x IS NOT NULL)) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
FROM k
"""
