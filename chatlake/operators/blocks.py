"""Two tables that meet block by block: a large one that stays in its blocks, and one that is sent to all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..sources.shared import ready, written

_BLOCK = "block long, rows binary"


def _packed(df: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows of df as blocks of Arrow data."""

    def run(batches):
        part, count, held, rows, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            sink = pa.BufferOutputStream()
            t = pa.Table.from_batches(held)
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, most_rows):
                piece = batch.slice(at, most_rows)
                if held and (rows + piece.num_rows > most_rows or size + piece.nbytes > most_bytes):
                    yield flush()
                    held, rows, size, count = [], 0, 0, count + 1
                held.append(piece)
                rows, size = rows + piece.num_rows, size + piece.nbytes
        if held:
            yield flush()

    return df.mapInArrow(run, _BLOCK)


def _opened(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def meet(large: DataFrame, small: DataFrame, pair: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, rows: int = 4096, small_rows: int = 256, size: int = 4 << 20) -> DataFrame:
    """What `pair` gives for each block of `large` with each block of `small`.

    The blocks of the large side are dealt into groups, and each block of the small side goes to every group, so that
    the large side moves once, or not at all where Spark finds the small side small enough to broadcast."""
    spark = ready(large.sparkSession)
    groups = 2 * spark.sparkContext.defaultParallelism
    a = _packed(large, rows, size).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    b = _packed(small, small_rows, size).select(F.col("rows").alias("small"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                yield from pair(_opened(x.as_py()), _opened(y.as_py()))

    return a.join(b, "part").select("rows", "small").mapInArrow(run, schema)


#: Blocks of the large and of the small side that a task holds at a time.
GROUP_BLOCKS, SMALL_BLOCKS = 16, 64


def meet_groups(large: DataFrame, small: DataFrame, run: Callable[[list[pa.Table], pa.Table], Iterator[pa.RecordBatch]], schema: str, rows: int = 4096, small_rows: int = 256, size: int = 4 << 20) -> DataFrame:
    """What `run` gives for each group of blocks of `large` with each block of `small`, so that what is known after one
    block of the group serves at the next.

    The packed blocks are written, as their numbers say how many groups and bundles there are."""
    spark = ready(large.sparkSession)
    a, b = written(_packed(large, rows, size), "large-blocks"), written(_packed(small, small_rows, size), "small-blocks")
    n = a.count()
    groups = max(-(-n // GROUP_BLOCKS), min(n, 2 * spark.sparkContext.defaultParallelism), 1)
    bundles = max(1, -(-b.count() // SMALL_BLOCKS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    a = a.select("rows", dealt(groups).alias("part"), each(bundles).alias("bundle"))
    b = b.select("rows", dealt(bundles).alias("bundle"), each(groups).alias("part"))
    empty = to_arrow_schema(_parse_datatype_string(schema))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            held = [_opened(x.as_py()) for x in left["rows"]]
            for x in right["rows"]:
                out += run(held, _opened(x.as_py()))
        return pa.Table.from_batches(out) if out else empty.empty_table()

    return a.groupBy("part", "bundle").cogroup(b.groupBy("part", "bundle")).applyInArrow(both, schema)
