"""Spelling variants: pairs of words one edit apart, by composing finite-state machines.

The vocabulary becomes a minimised acyclic acceptor A. Composed with T, the transducer that inserts, deletes or replaces
exactly one code point, and with A again, it accepts the pairs of words that are one edit apart. The states of the
composition are (state, state, edited or not); it is never built whole, but walked from an initial state, and what
two states have in common after the edit is found once and kept.

Partitions. An initial state of a partition is the state of A after a prefix, the shortest that at most PART words
share, so a task composes the words of one prefix and finds all pairs whose edit comes after it. Edits inside the prefix are
found by the same walk over reversed words, from the shortest suffix that at most PART words share. Where an edit
lies inside both, that is where more than PART words share what is before it and more than PART what is after it, the pair is found by
the word without its code point there: such a group has no more words than there are code points. So no pair is lost, and no task
gets more than PART words, whatever prefix or suffix is common.

Words. Runs of letters A-Z, a-z and U+00C0 to U+00FF in lower case (A-Z only); each occurrence may lose a code point by a
check sum of its document's id and itself (a planted typo). Those of `least` code points or more that occur `often` or more
times are words. Null texts have none; an id that is null counts as empty; repeated rows count each time; very long runs are runs like others.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .session import forget, ready, table, written

LEAST, OFTEN, TIMES, TYPO = 6, 5, 5, 199
#: Words of a partition at most, and code points of a word that goes through a machine.
PART, LONG = 2_000, 64
#: Words that a task composes, about: the work is large for its bytes, by which Spark would deal it to few tasks.
TASK_WORDS = 10_000
#: Prefixes that are sent to all executors at most.
MOST_SENT = 100_000
#: Rows of counts that a task holds before it hands them on.
HELD = 200_000
_ASCII = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_LOWER = tx._LOWER.astype(np.uint8)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _check_sums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """CRC-32 of a head and a span's bytes; heads: the CRC-32 of each head."""
    order = np.argsort(-sizes, kind="stable")
    start, size = starts[order], sizes[order]
    less = -size
    state = ~heads[order]
    first = int((size > 96).sum())
    for i in range(first):  # long spans, one by one
        state[i] = ~np.uint32(zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(heads[order[i]])))
    for j in range(int(size[first]) if first < len(size) else 0):
        to = int(np.searchsorted(less, -j, "left"))  # those with a byte j
        part = state[first:to]
        state[first:to] = _CRC[(part ^ data[start[first:to] + j]) & 255] ^ (part >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def runs(column: pa.Array, ids: list[str], least: int = LEAST, typo: int = TYPO) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The runs of letters of texts, in lower case, with their typos, that have `least` code points: distinct ones and
    their counts, chunk by chunk."""
    data, off = tx.utf8(column)
    for a, b in tx.chunks(off):
        raw, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        lead = raw == 0xC3  # of U+00C0 to U+00FF
        letter = _ASCII[raw] | lead
        letter[1:] |= lead[:-1]
        s, e, doc = tx.words(np.where(letter, 65, 32).astype(np.uint8), at)
        low = _LOWER[raw]
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        n = points[e] - points[s]
        long = n >= least
        s, e, doc, n = s[long], e[long], doc[long], n[long]
        if not len(s):
            continue
        heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[a:b]], np.uint32)
        sums = _check_sums(low, s, e - s, heads[doc])
        hit = sums % typo == 0
        typos = []
        for i in np.flatnonzero(hit & (n > least)).tolist():
            word = low[s[i] : e[i]].tobytes().decode()
            cut = int(sums[i]) % int(n[i])
            typos.append(word[:cut] + word[cut + 1 :])
        s, size = s[~hit], (e - s)[~hit]
        ends = np.cumsum(size)
        flat = low[np.repeat(s - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        plain = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(flat))
        counts = pc.value_counts(pa.concat_arrays([plain, pa.array(typos, pa.large_string())]))
        yield counts.field(0), counts.field(1)


def word_counts(docs: DataFrame, least: int = LEAST, often: int = OFTEN, typo: int = TYPO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of docs."""
    ready(docs.sparkSession)

    def run(batches):
        held: list[pa.Table] = []

        def summed():
            out = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table([out["word"].cast(pa.string()), out["n_sum"]], ["word", "n"])

        for batch in batches:
            ids = ["" if i is None else str(i) for i in batch.column(0).to_pylist()]
            for words, counts in runs(batch.column(1), ids, least, typo):
                held.append(pa.table([words.cast(pa.string()), counts], ["word", "n"]))
                if sum(map(len, held)) > HELD:
                    held = [summed()]
                    if len(held[0]) > HELD // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    parts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


class Acceptor:
    """The minimised acyclic acceptor of sorted, distinct words; state 0 is the initial one."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []

        def minimise(down: int) -> None:
            while len(path) > down:
                parent, c, child = path.pop()
                self.edges[parent][c] = known.setdefault((self.final[child], tuple(self.edges[child].items())), child)

        before = ""
        for word in words:
            shared = 0
            while shared < min(len(word), len(before)) and word[shared] == before[shared]:
                shared += 1
            minimise(shared)
            at = path[-1][2] if path else 0
            for c in word[shared:]:
                self.edges.append({})
                self.final.append(False)
                path.append((at, c, len(self.edges) - 1))
                self.edges[at][c] = at = len(self.edges) - 1
            self.final[at] = True
            before = word
        minimise(0)
        # bit k of a state: it accepts a suffix of k code points
        self.sizes = [0] * len(self.edges)
        self.several = [False] * len(self.edges)  # whether it accepts more than one suffix
        for q in self._children_first():
            self.sizes[q] = int(self.final[q])
            for to in self.edges[q].values():
                self.sizes[q] |= self.sizes[to] << 1
            self.several[q] = len(self.edges[q]) + self.final[q] > 1 or any(self.several[to] for to in self.edges[q].values())

    def _children_first(self) -> list[int]:
        seen, out, stack = {0}, [], [(0, iter(self.edges[0].values()))]
        while stack:
            q, rest = stack[-1]
            to = next((t for t in rest if t not in seen), None)
            if to is None:
                out.append(q)
                stack.pop()
            else:
                seen.add(to)
                stack.append((to, iter(self.edges[to].values())))
        return out


def one_edit_pairs(words: list[str], after: int | None = None) -> Iterator[tuple[str, str]]:
    """Each pair of the sorted, distinct words that are exactly one edit apart, once: what A, the edit transducer and A
    accept when composed, without the mirrored pairs. after: only pairs with less than so many code points after the edit."""
    low = -1 if after is None else (1 << after) - 1  # sizes of suffixes that count
    a = Acceptor(words)
    edges, final, sizes = a.edges, a.final, a.sizes
    met: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        """The suffixes that both states accept: the composition's walk after the edit."""
        key = (p, q) if p < q else (q, p)
        if key not in met:
            out, stack = [], [(*key, "", low)]
            while stack:
                x, y, said, left = stack.pop()
                if final[x] and final[y]:
                    out.append(said)
                ex, ey = edges[x], edges[y]
                for c in ex if len(ex) <= len(ey) else ey:
                    if c in ex and c in ey and sizes[ex[c]] & sizes[ey[c]] & (left >> 1):
                        stack.append((ex[c], ey[c], said + c, left >> 1))
            met[key] = out
        return met[key]

    stack = [(0, "")]
    while stack:  # before the edit both sides are in the same state
        q, said = stack.pop()
        out = list(edges[q].items())
        for k, (c, to) in enumerate(out):
            for d, other in out[:k]:  # c for d
                if sizes[to] & sizes[other] & low:
                    for rest in common(to, other):
                        yield said + d + rest, said + c + rest
            if sizes[to] & sizes[q] & low:  # c left out; of equal code points in a row the last one is
                for rest in common(to, q):
                    if not rest.startswith(c):
                        yield said + rest, said + c + rest
            if a.several[to]:
                stack.append((to, said + c))


def _depth(words: DataFrame, form: Column, part: int) -> DataFrame:
    """words with `depth`: the code points of the shortest prefix of `form` that at most `part` words share; one more than
    the word has where there is none."""
    prefixes = words.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring(form, F.lit(1), k))).alias("prefix"))
    hot = written(prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") > part).select("prefix"), "spelling-hot")
    # a hot prefix is that of many words, so that its rows are better not dealt by it; there are few, as each needs `part` words
    deepest = prefixes.join(F.broadcast(hot) if hot.count() <= MOST_SENT else hot, "prefix").groupBy("word").agg(F.max(F.length("prefix")).alias("hot"))
    return words.join(deepest, "word", "left").withColumn("depth", F.coalesce("hot", F.lit(0)) + 1).drop("hot")


def _by_machine(words: DataFrame, tasks: int) -> DataFrame:
    """(word, n, near, near_n) of pairs whose edit comes after the prefix by which words are dealt, `depth` code points,
    with less than `after` code points after it. words: word, n, depth, after (null: any number)."""
    dealt = words.where(F.col("depth") <= F.length("word"))
    dealt = dealt.select(F.expr("substring(word, 1, depth)").alias("prefix"), F.expr("substring(word, depth + 1)").alias("rest"), "n", "after")

    def run(group: pa.Table) -> pa.Table:
        rest, n = group["rest"].to_pylist(), group["n"].to_pylist()
        prefix, of = group["prefix"][0].as_py(), dict(zip(rest, n))
        pairs = list(one_edit_pairs(sorted(rest), pc.max(group["after"]).as_py()))
        left, right = ([prefix + p[k] for p in pairs] for k in (0, 1))
        return pa.table([pa.array(left, pa.string()), pa.array([of[x] for x, _ in pairs], pa.int64()), pa.array(right, pa.string()), pa.array([of[y] for _, y in pairs], pa.int64())], ["word", "n", "near", "near_n"])

    return dealt.repartition(tasks, "prefix").groupBy("prefix").applyInArrow(run, "word string, n long, near string, near_n long")


def _without_each(word: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word without its code point at each place from low to high, and of the whole word."""
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    c = tx.mix(c) * tx._power("up", len(c))
    total = np.append(np.uint64(0), np.cumsum(c))
    p = np.arange(low, high)
    less = total[p] + (total[-1] - total[p + 1]) * tx._power("down", 2)[1]
    return tx.mix(less), tx.mix(total[-1:])


def _by_place(words: DataFrame) -> DataFrame:
    """Pairs whose edit is at a place that no prefix and no suffix of a partition leaves free, and all pairs with a long
    word: words that are equal without the code point at a place, of which there are few, meet by a hash and are compared.
    words: word, n, ahead, behind (the depths)."""

    def run(batches):
        for batch in batches:
            for word, ahead, behind, name in zip(*(batch.column(k).to_pylist() for k in range(4))):
                n = len(word)
                whole = n >= LONG
                # as the longer or equal word: places p < ahead with n - p - 1 < behind; as the shorter one n - p < behind
                low, high = (0, n) if whole else (max(0, n - behind), min(n, ahead))
                short_low, short_high = (0, n + 1) if whole else (max(0, n - behind + 1), min(n + 1, ahead))
                parts = []
                if low < high:
                    parts.append((np.arange(low, high), _without_each(word, low, high)[0]))
                if short_low < short_high:
                    places = np.arange(short_low, short_high)
                    parts.append((places, np.repeat(_without_each(word, 0, 0)[1], len(places))))
                for places, keys in parts:
                    for at in range(0, len(places), 4096):
                        k = places[at : at + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(tx.signed(keys[at : at + 4096])), pa.array(np.full(len(k), name, np.int64))], ["place", "key", "id"])

    wanted = words.where((F.length("word") >= LONG) | (F.col("ahead") + F.col("behind") > F.length("word")))
    keys = wanted.select("word", "ahead", "behind", F.xxhash64("word")).mapInArrow(run, "place int, key long, id long").distinct()
    groups = keys.groupBy("place", "key").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1")
    ahead = groups.select("ids", F.posexplode("ids").alias("i", "left"))
    pairs = ahead.select("left", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("right")).distinct()
    named = wanted.select("word", "n", F.xxhash64("word").alias("id"))
    met = pairs.join(named.withColumnRenamed("id", "left"), "left").join(named.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("id").alias("right")), "right")
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n, near, near_n): every pair of words one edit apart, in both directions. words: word, n."""
    short = words.where(F.length("word") <= LONG)
    n = words.count()
    tasks = max(1, -(-n // TASK_WORDS))
    if n > part:
        ahead = _depth(short, F.col("word"), part).select("word", F.col("depth").alias("ahead"))
        behind = _depth(short, F.reverse("word"), part).select("word", F.col("depth").alias("behind"))
        deep = written(words.join(ahead, "word", "left").join(behind, "word", "left"), "spelling-depths")
    else:
        deep = words.withColumns({"ahead": F.lit(1), "behind": F.lit(1)})
    deep = deep.withColumns({"ahead": F.coalesce("ahead", F.lit(0)), "behind": F.coalesce("behind", F.lit(0))})
    machine = deep.where(F.length("word") <= LONG)
    front = _by_machine(machine.select("word", "n", F.col("ahead").alias("depth"), F.lit(None).cast("int").alias("after")), tasks)
    # reversed words, for the edits inside the prefixes only
    back = _by_machine(machine.select(F.reverse("word").alias("word"), "n", F.col("behind").alias("depth"), F.col("ahead").alias("after")), tasks)
    back = back.select(F.reverse("word").alias("word"), "n", F.reverse("near").alias("near"), "near_n")
    once = front.unionByName(back).unionByName(_by_place(deep))
    turned = once.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("x")).select("x.*")
    return turned.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: forms of forms, followed twice as far in each round. Each step goes to a word
    that occurs `times` as often, so that ways are short and have an end. forms: word, form."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = now.join(on, "root", "left")
        if not met.where("further IS NOT NULL").limit(1).count():
            return now
        old, now = now, written(met.select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        forget(old)


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, times: int = TIMES, typo: int = TYPO, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs: its form is the most frequent word one edit away, if it
    occurs `times` as often or more."""
    words = written(word_counts(docs, least, often, typo, id_col, text_col), "spelling-words")
    near = near_words(words, part)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    per = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    held = -F.col("b.less") >= times * F.col("n")
    per = written(per.select("word", "n_near", F.when(held, F.col("b.form")).alias("form"), F.when(held, -F.col("b.less")).alias("form_n")), "spelling-near")
    roots = _roots(per.where("form IS NOT NULL"))
    out = words.join(per, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
