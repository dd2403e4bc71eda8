"""The graph of entities that stand together in messages, as a sparse product of the entity by message matrix with itself."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ready, written

#: Pairs that a block adds up, about, and that are laid out at a time.
BLOCK_PAIRS, STEP_PAIRS = 40_000_000, 1_000_000
#: Mentions that a task deals to the blocks at a time, and rows of a batch of results.
CHUNK, BATCH_ROWS = 2_000_000, 1 << 17
_PARCEL = "block int, rows binary"
#: What a block is sent of some messages: the names that stand in them, how often each of its own does, and of each message
#: the names from its first own one on (`sizes`, `codes`) and the places of its own ones among these (`owns`, `mine`).
_ROWS = pa.schema([("names", pa.list_(pa.string())), ("here", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("owns", pa.list_(pa.int32())), ("mine", pa.list_(pa.int32())), ("channels", pa.list_(pa.string())), ("channel", pa.list_(pa.int32())), ("ts", pa.list_(pa.int64()))])
_SUMMED = "entity_1 string, entity_2 string, n long, channels long, first_ts timestamp, last_ts timestamp, fewer long"
_ARROW = pa.schema([("entity_1", pa.string()), ("entity_2", pa.string()), ("n", pa.int64()), ("channels", pa.int64()), ("first_ts", pa.timestamp("us", "UTC")), ("last_ts", pa.timestamp("us", "UTC")), ("fewer", pa.int64())])


def entity_counts(mentions: DataFrame) -> DataFrame:
    """(entity, n, pairs) of each entity: its messages, and its pairs with entities after it. mentions: names, each once."""
    each = mentions.select(F.size("names").alias("m"), F.posexplode("names").alias("i", "entity"))
    return each.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m") - F.col("i") - 1).alias("pairs"))


def _ranked(mentions: DataFrame, counts: DataFrame) -> DataFrame:
    """mentions with the names of each message from the rarest to the most frequent, so that a frequent name, which stands in
    many messages, has few after it. Names without a message stand alone, as they make no pairs."""
    each = mentions.select("message_id", "channel_id", "ts", F.explode("names").alias("entity")).join(counts.select("entity", "n"), "entity")
    found = F.sort_array(F.collect_set(F.struct("n", "entity")))
    alone = F.when(F.col("message_id").isNull(), F.col("entity"))
    return each.groupBy("message_id", "channel_id", "ts", alone.alias("alone")).agg(F.transform(found, lambda x: x["entity"]).alias("names")).drop("alone")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, count of them, one after the other."""
    ends = np.cumsum(count, dtype=np.int64)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _parcels(batch: pa.Table, blocks: int, hot: set[str]):
    """(block, rows) of each block that has an entity in these messages."""
    names, times = (batch[c].combine_chunks() for c in ("names", "ts"))
    channels = batch["channel_id"].combine_chunks().dictionary_encode()
    channel, when = channels.indices.fill_null(len(channels.dictionary)).to_numpy().astype(np.int32), times.cast(pa.int64()).fill_null(0).to_numpy()
    named = pa.concat_arrays([channels.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    coded = names.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    known = words.to_pylist()
    block_of = np.array([-1 if k in hot else zlib.crc32(k.encode()) % blocks for k in known], np.int32)
    times_here = np.bincount(code, minlength=len(known))
    sizes = np.diff(names.offsets.to_numpy())
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - begins[row]
    at = np.flatnonzero((place < sizes[row] - 1) & (block_of[code] >= 0))
    at = at[np.argsort(block_of[code[at]], kind="stable")]
    block, row, place = block_of[code[at]], row[at], place[at]
    own = np.argsort(block_of, kind="stable")
    number = np.zeros(len(known), np.int32)
    for b in np.unique(block_of[block_of >= 0]):
        lo, hi = np.searchsorted(block, [b, b + 1])
        r, p = row[lo:hi], place[lo:hi]
        first = _runs(r)
        r, owns = r[first], np.diff(np.append(first, hi - lo))
        head = p[first]
        left = sizes[r] - head
        codes = code[_spread(begins[r] + head, left)]
        mine = own[slice(*np.searchsorted(block_of, [b, b + 1], sorter=own))]
        used = np.zeros(len(known), bool)
        used[codes] = used[mine] = True
        used = np.flatnonzero(used)
        number[used] = np.arange(len(used))
        columns = [words.take(pa.array(used)), np.where(block_of[used] == b, times_here[used], 0), left, number[codes], owns, p - np.repeat(head, owns), named, channel[r], when[r]]
        yield int(b), [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c).cast(f.type.value_type)) for c, f in zip(columns, _ROWS)]


def _parceled(mentions: DataFrame, blocks: int, hot) -> DataFrame:
    """What each block is sent: its entities' messages, with the names from the first of its own on, some messages in a row.
    The last name of a message has no pairs of its own, and the entities in `hot` are in no block."""
    shared = mentions.sparkSession.sparkContext.broadcast(set(hot))

    def sent(held):
        for block, lists in _parcels(pa.Table.from_batches(held), blocks, shared.value):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ROWS) as to:
                to.write_batch(pa.RecordBatch.from_arrays(lists, schema=_ROWS))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(0).flatten())
            if n >= CHUNK:
                yield from sent(held)
                held, n = [], 0
        if held:
            yield from sent(held)

    return mentions.select("names", "channel_id", "ts").mapInArrow(run, _PARCEL)


def _opened(raw: bytes) -> dict[str, pa.Array]:
    """The columns of what a block is sent."""
    batch = next(iter(pa.ipc.open_stream(raw)))
    return {f.name: batch.column(i).values for i, f in enumerate(_ROWS)}


def _routed(mentions: DataFrame, blocks: int, hot) -> DataFrame:
    """_parceled() with one row for each block and message, to look at."""

    def run(batches):
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _opened(raw)
                cut = lambda sizes, of: pa.ListArray.from_arrays(np.append(0, np.cumsum(x[sizes])).astype(np.int32), of)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(x["sizes"]), pa.int32()), cut("sizes", x["names"].take(x["codes"])), cut("owns", x["mine"])], ["block", "names", "mine"])

    return _parceled(mentions, blocks, hot).mapInArrow(run, "block int, names array<string>, mine array<int>")


def _joined(parcels: list[bytes]):
    """The parcels of a block as one: names in the order of their bytes, how often each of its own stands, the codes of the
    names of all messages, and of each own name in a message its code, its place in the codes, how many follow, channel and time.
    Takes the parcels out of the list, so that they are freed one by one."""
    opened = [_opened(raw) for raw in parcels]
    parcels.clear()
    coded = pa.concat_arrays([x["names"] for x in opened]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    rank = np.empty(len(words), np.int32)
    rank[order.to_numpy()] = np.arange(len(words), dtype=np.int32)
    number = rank[coded.indices.to_numpy()]
    here = np.zeros(len(words), np.int64)
    np.add.at(here, number, np.concatenate([x["here"].to_numpy() for x in opened]))
    named = pa.concat_arrays([x["channels"] for x in opened]).dictionary_encode()
    channel_of = named.indices.fill_null(len(named.dictionary)).to_numpy()
    codes, lefts, starts, counts, channels, times = [], [], [], [], [], []
    n = k = done = 0
    opened.reverse()
    while opened:
        x = opened.pop()
        own, size, count, channel = (x[c].to_numpy() for c in ("mine", "sizes", "owns", "channel"))
        codes.append(number[n + x["codes"].to_numpy()])
        ends = np.cumsum(size)
        row = np.repeat(np.arange(len(size)), count)
        start = (ends - size)[row] + own
        lefts.append(codes[-1][start])
        starts.append(done + start + 1)
        counts.append((ends[row] - start - 1).astype(np.int32))
        channels.append(channel_of[k + channel][row])
        times.append(x["ts"].to_numpy()[row])
        n, k, done = n + len(x["names"]), k + len(x["channels"]), done + len(codes[-1])
    left, start, count, channel, ts = (np.concatenate(x) for x in (lefts, starts, counts, channels, times))
    order = np.lexsort((ts, channel, left))
    return words, here, len(named.dictionary), np.concatenate(codes), left[order], start[order], count[order], channel[order], ts[order]


def _added(pair, channel, n, low, high):
    """Sums, least and greatest by pair and channel, of rows in the order of both."""
    first = _runs(pair, channel)
    if not len(first):
        return pair, channel, n, low, high
    return pair[first], channel[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _summed(parcels: list[bytes], step_pairs: int = STEP_PAIRS):
    """The pairs of a block: an entity of its own with each one after it in a message."""
    words, here, none, codes, left, start, count, channel, ts = _joined(parcels)
    wide = max(1, int(len(words)).bit_length())
    done = np.cumsum(count, dtype=np.int64)
    bounds = np.append(_runs(left), len(left))

    def by_channel(a, b):
        """(pair, channel, n, low, high) of the mentions a to b, which are in the order of left name, channel and time."""
        own = left[a:b] - left[a]
        c = count[a:b]
        bits = max(1, int(b - a).bit_length())
        nth = np.cumsum(np.append(False, own[1:] != own[:-1]))
        lots = nth.astype(np.int64) << wide
        key = np.repeat((lots << bits) | np.arange(b - a), c) | (codes[_spread(start[a:b], c)].astype(np.int64) << bits)
        key.sort()
        nth, pair = key & ((1 << bits) - 1), key >> bits
        of = channel[a:b][nth]
        first = _runs(pair, of)
        ends = np.append(first[1:], len(pair)) - 1
        names = left[a:b][_runs(own)].astype(np.int64)
        pair = pair[first]
        return (names[pair >> wide] << wide) | (pair & ((1 << wide) - 1)), of[first], ends - first + 1, ts[a:b][nth[first]], ts[a:b][nth[ends]]

    def results(pair, of, n, low, high):
        first = _runs(pair)
        pair = pair[first]
        one, two = pair >> wide, pair & ((1 << wide) - 1)
        sums = [words.take(pa.array(np.minimum(one, two))), words.take(pa.array(np.maximum(one, two))), np.add.reduceat(n, first), np.add.reduceat((of < none).astype(np.int64), first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), here[one]]
        out = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x).cast(f.type) for x, f in zip(sums, _ARROW)], schema=_ARROW)
        for i in range(0, out.num_rows, BATCH_ROWS):
            yield out.slice(i, BATCH_ROWS)

    # whole left names up to step_pairs and so many that a pair and its mention fit into 62 bits
    i = 0
    while i < len(bounds) - 1:
        a = bounds[i]
        before = done[a - 1] if a else 0
        j = i + max(1, int(np.searchsorted(done[bounds[i + 1 :] - 1], before + step_pairs, "right")))
        while j > i + 1 and int(bounds[j] - a).bit_length() + wide + (j - i).bit_length() > 62:
            j = i + (j - i) // 2
        b = bounds[j]
        if done[b - 1] - before <= step_pairs or b - a == 1:
            yield from results(*by_channel(a, b))
        else:
            kept = None
            while a < b:
                to = min(b, max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + step_pairs, "right"))))
                part = by_channel(a, to)
                if kept:
                    part = [np.concatenate(x) for x in zip(kept, part)]
                    order = np.lexsort((part[1], part[0]))
                    part = _added(*(x[order] for x in part))
                kept, a = part, to
            yield from results(*kept)
        i = j


def _hot_pairs(ranked: DataFrame, counts: DataFrame, hot: list[str]) -> DataFrame:
    """The pairs of entities that have too many for one block, each with all names after it. Few partners, many messages:
    summed before they are shuffled."""
    left = ranked.where(F.arrays_overlap("names", F.array(*map(F.lit, hot)))).select("channel_id", "ts", "names", F.posexplode("names").alias("i", "left")).where(F.col("left").isin(hot))
    met = left.select("channel_id", "ts", "left", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("right"))
    low, high = F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    by_channel = met.groupBy("left", "right", "channel_id").agg(F.count(F.lit(1)).alias("n"), low, high)
    sums = by_channel.groupBy("left", "right").agg(F.sum("n").alias("n"), F.count("channel_id").alias("channels"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    few = F.broadcast(counts.where(F.col("entity").isin(hot)).select(F.col("entity").alias("left"), F.col("n").alias("fewer")))
    return sums.join(few, "left").select(F.least("left", "right").alias("entity_1"), F.greatest("left", "right").alias("entity_2"), "n", "channels", "first_ts", "last_ts", "fewer")


def weighed_pairs(mentions: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """co_occurrences() with `fewer`, the number of messages of the rarer entity of each pair.

    The rarer entity of a pair leads it. Entities are dealt into blocks; a block gets the messages of its entities and adds up
    all their pairs, some entities at a time, so that no pair is shuffled and no result meets a table of names again. Entities
    with more pairs than a block should have, fewer than there are blocks, are summed as rows."""
    spark = ready(mentions.sparkSession)
    ranked = written(_ranked(mentions, counts), "kg-ranked")
    leading = written(entity_counts(ranked), "kg-leading")
    total = leading.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    cores = spark.sparkContext.defaultParallelism
    blocks = max(4 * cores, -(-total // block_pairs))
    most = max(total // blocks, min(block_pairs, STEP_PAIRS))
    hot = [r.entity for r in leading.where(F.col("pairs") > most).select("entity").collect()]
    tasks = min(blocks, 8 * cores)

    def run(batches):
        block, held = None, []
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != block and held:
                    yield from _summed(held)
                    held = []
                block = b
                held.append(raw.as_buffer())
                del raw
        if held:
            yield from _summed(held)

    dealt = _parceled(ranked, blocks, hot).withColumn("task", F.col("block") % tasks).repartitionById(tasks, "task").drop("task")
    sums = dealt.sortWithinPartitions("block").mapInArrow(run, _SUMMED)
    return sums.unionByName(_hot_pairs(ranked, leading, hot)) if hot else sums


def co_occurrences(mentions: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(entity_1, entity_2, n, channels, first_ts, last_ts) of each pair of entities that stand in one message.

    mentions: message_id, channel_id, ts, names; counts: entity_counts() of them."""
    return weighed_pairs(mentions, counts, block_pairs).drop("fewer")
