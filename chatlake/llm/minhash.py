"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document is the set of its distinct word shingles. One pass over the hashes of a set fills the bins of
its signature with the smallest hash of each bin; an empty bin copies a bin that a sequence of hashed
probes finds, the same sequence for all documents. Bands of bins are bucket keys. Equal sets are one class
with the smallest id as its representative, and only representatives go into buckets.

In a bucket each member gets one candidate edge, to the bucket's centre (the member that shares most
buckets with others), and of its edges a member keeps the one to the best centre, so that a group of any
size gives a star. Edges are confirmed on the full sets. As a star can miss links between its outer
members, what shares a bucket and is still in different components is tried again, once with other centres
and then by an exact prefix filter on the full sets, which needs no cap on the size of a bucket.

Null and empty texts have empty sets and are linked with nothing. Rows without an id are linked with
nothing and stay. Repeated rows (same id, same text) give equal rows. An empty table gives an empty table. Very long
texts take memory in proportion to them. Of equal sets, as of a component, the smallest id stands for all. Columns with
other names are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import connected
from .session import forget, ready, table, written

BINS = 256
WORDS = 5
#: The chance that a pair at the threshold shares no bucket.
MISS = 1e-8
#: Rounds of stars, and the last round.
TURNS = 3
#: Counters of the sketch that orders shingles in the last round.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Of which so many go to the driver as one value.
SLOT_PIECE = 1 << 14
_SET_SEED = np.uint64(0x5851F42D4C957F2D)


def bands(percent: int, bins: int = BINS, miss: float = MISS) -> tuple[int, int]:
    """Number of bands and bins in each, so that a pair at the threshold misses all buckets with a chance of `miss` at most."""
    s = percent / 100
    rows = max((r for r in range(1, 13) if (1 - s**r) ** (bins // r) <= miss), default=1)
    return bins // rows, rows


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted in each, and the document of each."""
    s, e, doc = tx.words(data, off)
    w = tx.span_hashes(data, s, e, lower=True)
    n = len(off) - 1
    g = tx.grams(w, size)
    same = doc[size - 1 :] == doc[: len(doc) - size + 1] if len(g) else np.zeros(0, bool)
    h, d = g[same], doc[: len(g)][same]
    count = np.bincount(doc, minlength=n)
    for k in range(1, size):  # a document of fewer words is one shingle
        short = np.flatnonzero(count == k)
        if len(short):
            first = np.searchsorted(doc, short)
            x = np.full(len(short), k, np.uint64)
            for j in range(k):
                x = tx.mix(x * np.uint64(0x9E3779B97F4A7C15) + w[first + j])
            h, d = np.concatenate([h, x]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[first], d[first]


def signatures(h: np.ndarray, d: np.ndarray, docs: int, bins: int = BINS) -> np.ndarray:
    """The densified one-permutation signature of each document; of empty sets it is all zeros."""
    bits = bins.bit_length() - 1
    sig = np.zeros((docs, bins), np.uint64)
    full = np.zeros((docs, bins), bool)
    cell = d * bins + (h >> np.uint64(64 - bits)).astype(np.int64)
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]  # sets are sorted: the first hash of a bin is its smallest
    sig.ravel()[cell[lead]] = h[lead]
    full.ravel()[cell[lead]] = True
    doc, at = np.nonzero(~full & full.any(1)[:, None])
    source, t = sig.copy(), 0
    while len(doc):
        t += 1
        probe = (tx.mix((at * 65537 + t).astype(np.uint64) + _SET_SEED) & np.uint64(bins - 1)).astype(np.int64)
        hit = full[doc, probe]
        sig[doc[hit], at[hit]] = source[doc[hit], probe[hit]]
        doc, at = doc[~hit], at[~hit]
    return sig


def band_keys(sig: np.ndarray, n: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), n), np.uint64)
    for b in range(n):
        x = np.full(len(sig), b, np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            x = tx.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
        out[:, b] = x
    return out


def _described(docs: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """id, n (size of the set), f1 and f2 (its fingerprint), keys of its bands."""

    def run(batches):
        for batch in batches:
            data, off = tx.utf8(batch.column(1))
            for a, b in tx.chunks(off, each=8 * BINS):
                n = b - a
                h, d = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a])
                count = np.bincount(d, minlength=n)
                prints = []
                for seed in (1, 2):
                    total = np.append(np.uint64(0), np.cumsum(tx.mix(h + np.uint64(seed) * _SET_SEED), dtype=np.uint64))
                    at = np.searchsorted(d, np.arange(n + 1))
                    prints.append(total[at[1:]] - total[at[:-1]])
                keys = band_keys(signatures(h, d, n), n_bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_bands, pa.int32()), pa.array(tx.signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(count.astype(np.int64)), *(pa.array(tx.signed(p)) for p in prints), lists], ["id", "n", "f1", "f2", "keys"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>")


def _packed_texts(docs: DataFrame) -> DataFrame:
    """id and the text, compressed for the shuffle."""

    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, off = tx.utf8(batch.column(1))
            raw = memoryview(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.compress(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())], ["id", "z"])

    return docs.mapInArrow(run, "id long, z binary")


def _confirmed(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    both = edges.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b").join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")

    def run(batches):
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            _, off = tx.utf8(batch.column(3))
            _, off_b = tx.utf8(batch.column(2))
            for lo, hi in tx.chunks(off + off_b, tx.CHUNK // 4, each=1 << 12):
                part = batch.slice(lo, hi - lo)
                n = hi - lo
                sides = []
                for column in (3, 2):
                    data, at = tx.utf8(pa.array([d.decompress(z) if z else b"" for z in part.column(column).to_pylist()], pa.large_binary()))
                    sides.append(shingle_sets(data, at))
                h, pair = (np.concatenate([x[j] for x in sides]) for j in (0, 1))
                order = np.lexsort((h, pair))
                h, pair = h[order], pair[order]
                common = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=n)
                union = np.bincount(pair, minlength=n) - common
                yield part.select(["a", "b"]).filter(pa.array(100 * common >= percent * union))

    return both.select("a", "b", "zb", "za").mapInArrow(run, "a long, b long")


def _unpacked_sets(batches):
    """Slices of batches whose last column holds compressed texts, each with its shingle hashes and their rows."""
    d = zstandard.ZstdDecompressor()
    for batch in batches:
        _, off = tx.utf8(batch.column(batch.num_columns - 1))
        for lo, hi in tx.chunks(off, tx.CHUNK // 4, each=1 << 12):
            part = batch.slice(lo, hi - lo)
            data, at = tx.utf8(pa.array([d.decompress(z) if z else b"" for z in part.column(batch.num_columns - 1).to_pylist()], pa.large_binary()))
            yield part, *shingle_sets(data, at)


def _prefix_pairs(texts: DataFrame, members: DataFrame, percent: int, spent: list[DataFrame]) -> DataFrame:
    """All pairs (a, b) of members (rep, comp) of different components that can be similar enough.

    In any order of shingles, two sets of similarity s share one of the first n - ceil(s * n) + 1 shingles
    of each. The order puts rare shingles first, by a count sketch of fixed size, so that what a group of
    copies has in common is hardly ever met; a bad count costs time but loses no pair. Shingles that one
    member alone has bound what it can share with any other. Tables that the pairs are read from go to `spent`."""
    rows = written(texts.join(members.withColumnRenamed("rep", "id"), "id").select("id", "comp", "z"), "minhash-left")

    def listed(batches):
        for part, h, doc in _unpacked_sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(h)), part.column(0).take(pa.array(doc))], ["token", "rep"])

    alone = rows.select("id", "z").mapInArrow(listed, "token long, rep long").groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("id")).where("m = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    spent.append(rows)
    rows = written(rows.join(alone, "id", "left").select("id", "comp", F.coalesce("own", F.lit(0)).alias("own"), "z"), "minhash-own")

    def counted(batches):
        total = np.zeros(SLOTS, np.int64)
        for _, h, _ in _unpacked_sets(batches):
            total += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        for a in range(0, len(used), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(used[a : a + (1 << 16)]), pa.array(total[used[a : a + (1 << 16)]])], ["slot", "n"])

    def piece(key, table):
        out = np.zeros(SLOT_PIECE, np.uint32)
        out[table["slot"].to_numpy() % SLOT_PIECE] = np.minimum(table["n"].to_numpy(), 0xFFFFFFFF)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["piece", "counts"])

    counts = rows.mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # the driver gets 4 bytes for each counter, not a row
    got = counts.groupBy(F.floor(F.col("slot") / SLOT_PIECE).alias("piece")).applyInArrow(piece, "piece long, counts binary").collect()
    sketch = np.zeros(SLOTS, np.uint32)
    for r in got:
        sketch[r.piece * SLOT_PIECE : (r.piece + 1) * SLOT_PIECE] = np.frombuffer(r.counts, np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(sketch)
    del got, sketch

    def prefixes(batches):
        for part, h, doc in _unpacked_sets(batches):
            order = np.lexsort((h, shared.value[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], doc))
            h, doc = h[order], doc[order]
            first = np.searchsorted(doc, np.arange(part.num_rows))
            n = np.bincount(doc, minlength=part.num_rows)
            take = np.arange(len(h)) - first[doc] < (n + (-percent * n) // 100 + 1)[doc]
            at = pa.array(doc[take])
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(h[take])), part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(n[doc[take]].astype(np.int64)), pa.array((np.arange(len(h)) - first[doc])[take].astype(np.int32))], ["token", "rep", "comp", "own", "n", "at"])

    tokens = written(rows.mapInArrow(prefixes, "token long, rep long, comp long, own long, n long, at int").where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "minhash-prefixes")
    shared.destroy()
    tx.trim()
    spent += [rows, tokens]
    mixed = tokens.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    tokens = tokens.join(mixed, "token", "left_semi")
    other = tokens.select("token", F.col("rep").alias("b"), F.col("comp").alias("kb"), F.col("n").alias("nb"), F.col("own").alias("ob"), F.col("at").alias("pb"))
    # what two sets share at most, if this is the first shingle that they share
    most = F.least(F.col("n") - F.col("own"), F.col("nb") - F.col("ob"), F.col("n") - F.col("at"), F.col("nb") - F.col("pb"))
    close = 100 * most >= percent * (F.col("n") + F.col("nb") - most)
    return tokens.join(other, "token").where((F.col("rep") < F.col("b")) & (F.col("comp") != F.col("kb")) & close).select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_shingles, component_id (smallest id reachable over links of
    similarity >= percent / 100, itself included) and kept (the id is the component's)."""
    spark = ready(docs.sparkSession)
    n_bands, rows = bands(percent)
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    described = written(_described(docs, n_bands, rows), "minhash-sets")
    sets = described.where("n > 0 AND id IS NOT NULL")
    classes = written(sets.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys")), "minhash-classes")

    members = classes.select(F.explode("keys").alias("key"), "rep", "n")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = written(members.join(shared, "key"), "minhash-buckets")
    # a member that shares buckets with many is a good centre: near copies differ least from it
    weight = written(buckets.groupBy("rep").agg(F.sum("m").alias("weight")), "minhash-weights")
    spent = [buckets, weight]  # what nothing reads any more in the end
    buckets = buckets.drop("m").join(weight, "rep")
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    texts = written(_packed_texts(docs.where("id IS NOT NULL")).join(buckets.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]), "minhash-texts")

    spent.append(texts)
    tried = labels = None
    for turn in range(1, TURNS + 1):
        rows_now = buckets if labels is None else buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        if labels is None:
            rows_now = rows_now.withColumn("comp", F.col("rep"))
        mixed = rows_now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key") if labels is not None else None
        if mixed is not None:
            rows_now = written(rows_now.join(mixed, "key", "left_semi"), "minhash-mixed")
            spent.append(rows_now)
        if turn < TURNS:
            # centres: the first member by a hash, and the first of those in other components than its own
            share = F.lit(1.0) if turn == 1 else 0.25 + F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
            order = -F.round(F.col("weight") * share * 1024).cast("long") * 1024 + F.pmod(F.xxhash64("rep"), F.lit(1024))
            first = rows_now.groupBy("key").agg(F.min_by("rep", order).alias("c1"), F.min_by("comp", order).alias("k1"), F.min_by("n", order).alias("n1"), F.min(order).alias("o1"))
            met = rows_now.join(first, "key")
            if turn == 1:
                pairs = met.where(F.col("rep") != F.col("c1")).where(near(F.col("n"), F.col("n1"))).select("rep", F.col("c1").alias("centre"), F.col("o1").alias("o"))
            else:
                second = met.where(F.col("comp") != F.col("k1")).groupBy("key").agg(F.min_by("rep", order).alias("c2"), F.min_by("n", order).alias("n2"), F.min(order).alias("o2"))
                met = met.join(second, "key")
                own = F.col("comp") == F.col("k1")
                pairs = met.select("rep", "n", F.when(own, F.col("c2")).otherwise(F.col("c1")).alias("centre"), F.when(own, F.col("n2")).otherwise(F.col("n1")).alias("nc"), F.when(own, F.col("o2")).otherwise(F.col("o1")).alias("o"))
                pairs = pairs.where(near(F.col("n"), F.col("nc")))
            best = pairs.groupBy("rep").agg(F.min_by("centre", "o").alias("centre"))
            edges = best.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        else:
            edges = _prefix_pairs(texts, rows_now.select("rep", "comp").distinct(), percent, spent)
        if tried is not None:
            edges = edges.join(tried, ["a", "b"], "left_anti")
        edges = written(edges, "minhash-edges")
        found = written(_confirmed(edges, texts, percent), "minhash-links")
        spent += [edges, found]
        tried = edges if tried is None else tried.unionByName(edges)
        if not found.isEmpty() or labels is None:
            # what is known of the components stands for the links before this turn
            known = labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")) if labels is not None else None
            labels = connected(found if known is None else found.unionByName(known))
    for df in spent:
        forget(df)
    parts = classes.select("f1", "f2", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.col("n").alias("size"), F.coalesce("component", "rep").alias("component"))
    on = (described["f1"] == parts["f1"]) & (described["f2"] == parts["f2"]) & (described["n"] == parts["size"]) & (described["n"] > 0) & described["id"].isNotNull()
    out = described.join(parts, on, "left").select("id", described["n"].alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS e FROM d),
c AS (SELECT list_sort(e) AS e, min(doc_id) AS rep FROM s WHERE len(e) > 0 AND doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT rep, len(e) AS n, unnest(e) AS x FROM c),
f AS (SELECT x, count(*) AS m FROM t GROUP BY 1),
o AS (SELECT rep, n, t.x, row_number() OVER (PARTITION BY rep ORDER BY m, t.x) AS p FROM t JOIN f ON t.x = f.x),
k AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM o a JOIN o b ON a.x = b.x AND a.rep < b.rep AND a.p <= a.n - ceil(0.85 * a.n) + 1 AND b.p <= b.n - ceil(0.85 * b.n) + 1),
l AS (SELECT a, b FROM k JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE 100 * len(list_intersect(x.e, y.e)) >= 85 * (len(x.e) + len(y.e) - len(list_intersect(x.e, y.e)))),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT rep, rep FROM c UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
q AS (SELECT s.doc_id, len(s.e) AS n, coalesce(m.root, s.doc_id) AS component_id FROM s LEFT JOIN c ON list_sort(s.e) = c.e LEFT JOIN m ON m.node = c.rep)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM q
"""
