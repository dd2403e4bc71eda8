"""Resharding by minimum-cost flow.

A dataset lies as files in folders shard=K. Given the capacities of the new shards, a minimum-cost flow from the bytes
of the old shards to the new ones (staying costs nothing) says how many bytes go from where to where; the fewest move.
A block is a file. In each old shard its blocks are laid end to end, those that stay first, and the flow cuts this line
into stretches: a block inside one stretch moves, or stays, whole; one that a cut runs through is divided by rows,
the largest first, each into the first part that still has room for it. So shards meet their capacities but for less
than a cut block's smallest rows. Only files that move or are cut are rewritten; the others stay where they lie.

The driver sees one size for each old shard and the names of the files that are rewritten, never rows. Cut blocks, less
than old plus new shards in number, are divided in a task each, by ids and sizes only.

A row's size is its text's UTF-8 bytes plus 1; null texts have none. Rows with null, equal or repeated ids are rows like
others: a row is told by its file and its place there. Empty shards are allowed on both sides, an empty table gives no rows. Other
columns travel along in stored files, whatever their names.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .session import forget, new_path, ready, table, written

OLD_SHARDS, NEW_SHARDS = 5, 8
#: Names of the columns that a stored dataset has besides its own.
SHARD, SIZE, CRC, FILE, ROW = "__shard", "__size", "__crc", "__file", "__row"
#: Files whose names are sent to all executors at most; beyond that they are joined as a table.
MOST_SENT = 50_000
_FAR = 1 << 60


def moving(i: int, j: int) -> int:
    """What a byte costs from the old shard i to the new shard j."""
    return 0 if i == j else 1


def capacities(total: int, shards: int) -> list[int]:
    """Equal whole capacities that sum to `total`."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def min_cost_flow(supply: dict[int, int], demand: list[int], cost: Callable[[int, int], int] = moving) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one, all of `supply` into `demand` (of the same sum), at the least total cost:
    by successive shortest augmenting paths."""
    if sum(supply.values()) != sum(demand):
        raise ValueError("capacities and sizes differ in sum")
    old = sorted(i for i, n in supply.items() if n)
    price = np.array([[cost(i, j) for j in range(len(demand))] for i in old], np.int64).reshape(len(old), len(demand))
    flow, left, room = np.zeros_like(price), np.array([supply[i] for i in old], np.int64), np.array(demand, np.int64)
    while left.any():
        # the cheapest ways from old shards that have bytes left; bytes that were sent can be taken back
        far, via = np.where(left > 0, 0, _FAR), np.full(len(old), -1)
        reach, into = np.full(len(demand), 2 * _FAR), np.full(len(demand), -1)
        while True:
            to_new = far[:, None] + price
            shorter = to_new.min(0) < reach
            reach, into = np.where(shorter, to_new.min(0), reach), np.where(shorter, to_new.argmin(0), into)
            back = np.where(flow > 0, reach[None, :] - price, _FAR)
            nearer = back.min(1) < far
            if not nearer.any():
                break
            far, via = np.where(nearer, back.min(1), far), np.where(nearer, back.argmin(1), via)
        j = end = int(np.where(room > 0, reach, 2 * _FAR).argmin())
        steps = []
        while True:
            i = int(into[j])
            steps.append((i, j))
            if via[i] < 0:
                break
            j = int(via[i])
        taken = [(i, int(via[i])) for i, _ in steps[:-1]]
        amount = min([left[i], room[end], *(flow[x] for x in taken)])
        for x in steps:
            flow[x] += amount
        for x in taken:
            flow[x] -= amount
        left[i] -= amount
        room[end] -= amount
    return {(old[i], int(j)): int(flow[i, j]) for i, j in zip(*np.nonzero(flow))}


def stretches(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, from, to, new): the line of each old shard's bytes, cut by the flow; what stays lies first."""
    out = []
    for i in sorted({i for i, _ in flow}):
        at = 0
        for j in sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j)):
            out.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
    return out


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


@dataclasses.dataclass
class Stored:
    """A dataset in shards: the files of `folder` but for the `replaced` ones, and those of `rewritten`."""

    spark: SparkSession
    schema: StructType
    folder: str
    replaced: list[str] = dataclasses.field(default_factory=list)
    rewritten: str | None = None

    def read(self, *columns: str) -> DataFrame:
        """The named columns, with FILE and ROW, which tell a row."""
        kept = self._named(self.spark.read.schema(self.schema).parquet(self.folder), *columns)
        if self.replaced:
            kept = kept.join(_sent(self.spark.createDataFrame([(x,) for x in self.replaced], f"{FILE} string"), len(self.replaced)), FILE, "left_anti")
        return kept.unionByName(self._named(self.spark.read.schema(self.schema).parquet(self.rewritten), *columns)) if self.rewritten else kept

    def read_files(self, names: list[str], *columns: str) -> DataFrame:
        return self._named(self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(*names), *columns)

    def _named(self, df: DataFrame, *columns: str) -> DataFrame:
        return df.select(*columns, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def store(docs: DataFrame, shard: Column, text_col: str = "text") -> Stored:
    """docs as files in folders of shards; each task writes a file for each shard that it meets."""
    spark = docs.sparkSession
    out = new_path(spark, "shards")
    text = docs[text_col]
    kept = docs.withColumns({SIZE: size_of(text), CRC: F.crc32(F.coalesce(text, F.lit(""))), SHARD: shard.cast("int")})
    kept.write.partitionBy(SHARD).option("compression", "zstd").parquet(out)
    return Stored(spark, kept.schema, out)


def divided(rows: pd.DataFrame, parts: list[tuple[int, int]]) -> list[int]:
    """The new shard of each row of a cut block: the largest rows first, each into the first part with room for it, else
    into the one with most room. rows: size, row; parts: (new shard, bytes)."""
    room, out = [b for _, b in parts], [0] * len(rows)
    for at, size in zip((order := np.lexsort((rows["row"], -rows["size"]))).tolist(), rows["size"].to_numpy()[order].tolist()):
        k = next((k for k, r in enumerate(room) if r >= size), None)
        if k is None:
            k = max(range(len(room)), key=room.__getitem__)
        room[k] -= size
        out[at] = parts[k][0]
    return out


def reshard(stored: Stored, shards: int, cost: Callable[[int, int], int] = moving) -> Stored:
    """The dataset in `shards` shards of equal bytes, with the fewest bytes moved; only affected files are written again."""
    spark = ready(stored.spark)
    files = stored.read(SHARD, SIZE).groupBy(F.col(SHARD).alias("shard"), FILE).agg(F.sum(SIZE).alias("bytes"), F.max(SIZE).alias("widest"))
    line = Window.partitionBy("shard").orderBy(F.desc("widest"), FILE)  # a row for each file; cuts rather meet files of small rows
    blocks = files.withColumn("hi", F.sum("bytes").over(line)).select("shard", FILE, (F.col("hi") - F.col("bytes")).alias("lo"), "hi")
    blocks = written(blocks, "reshard-blocks")
    supply = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.max("hi").alias("n")).collect()}  # a row for each old shard
    flow = min_cost_flow(supply, capacities(sum(supply.values()), shards), cost)
    cuts = stretches(flow)
    if not cuts:
        return stored
    met = blocks.join(F.broadcast(spark.createDataFrame(cuts, "shard int, a long, b long, new int")), "shard").where("lo < b AND a < hi")
    part = F.struct("a", "new", (F.least("b", "hi") - F.greatest("a", "lo")).alias("bytes"))
    plan = met.groupBy("shard", FILE).agg(F.sort_array(F.collect_list(part)).alias("parts")).where("size(parts) > 1 OR parts[0].new <> shard")
    affected = [(r[FILE], [(p.new, p.bytes) for p in r.parts]) for r in plan.collect()]  # names of files that are written again
    forget(blocks)
    if not affected:
        return stored
    columns = [c for c in stored.schema.names if c != SHARD]
    moved = [(f, parts[0][0]) for f, parts in affected if len(parts) == 1]
    cut = {f: parts for f, parts in affected if len(parts) > 1}
    out, rows = new_path(spark, "resharded"), []
    if moved:
        to = _sent(spark.createDataFrame(moved, f"{FILE} string, {SHARD} int"), len(moved))
        rows.append(stored.read_files([f for f, _ in moved], *columns).join(to, FILE).select(*columns, SHARD))
    if cut:

        def divide(block: pd.DataFrame) -> pd.DataFrame:
            return block.assign(to=divided(block, cut[block["file"].iloc[0]]))[["file", "row", "to"]]

        narrow = stored.read_files(list(cut), SIZE).select(F.col(FILE).alias("file"), F.col(ROW).alias("row"), F.col(SIZE).alias("size"))
        to = narrow.groupBy("file").applyInPandas(divide, "file string, row long, to int").select(F.col("file").alias(FILE), F.col("row").alias(ROW), F.col("to").alias(SHARD))
        rows.append(stored.read_files(list(cut), *columns).join(to, [FILE, ROW]).select(*columns, SHARD))
    every = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    every.write.partitionBy(SHARD).option("compression", "zstd").parquet(out)
    return Stored(spark, stored.schema, stored.folder, [f for f, _ in affected], out)


def slots(stored: Stored, *columns: str) -> DataFrame:
    """The named columns of each row, with SIZE, CRC, shard and slot, the row's number in its shard from 0: rows count
    inside their files, whose numbers of rows are added up by shard."""
    rows = stored.read(*columns, SIZE, CRC, SHARD)
    line = Window.partitionBy("shard").orderBy("file")  # a row for each file
    files = rows.groupBy(F.col(FILE).alias("file"), F.col(SHARD).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    first = written(files.withColumn("first", F.sum("n").over(line) - F.col("n")).select(F.col("file").alias(FILE), "shard", "first"), "reshard-files")
    return rows.join(_sent(first, first.count()), FILE).select(*columns, SIZE, CRC, "shard", (F.col("first") + F.col(ROW)).alias("slot"))


def op13_resharding(spark, sf_dir: str) -> DataFrame:
    """Documents that lie in OLD_SHARDS shards, by a check sum of their ids, come into NEW_SHARDS."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(OLD_SHARDS))
    after = slots(reshard(store(docs, before), NEW_SHARDS), "doc_id")
    return after.select("doc_id", F.col(SIZE).alias("size"), F.col(CRC).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
