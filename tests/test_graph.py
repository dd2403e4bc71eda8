"""Pairs of entities against plain loops."""

import datetime as dt
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.functions import text as ft
from chatlake.operators import graph


@pytest.mark.parametrize("block_pairs", [5, 400, 10**6])
def test_co_occurrences(spark, block_pairs):
    rng = random.Random(block_pairs)
    start = dt.datetime(2024, 1, 1)
    names = ["common", "é", "ab", ""] + [f"n{i}" for i in range(40)]
    rows = [(f"m{i}", rng.choice(["C1", "C2", "C3", None]), start + dt.timedelta(minutes=rng.randint(0, 999)), sorted({"common"} | set(rng.sample(names, rng.randint(0, 9))))) for i in range(150)]
    rows += [("empty", "C1", start, []), ("one", "C1", start, ["x"])]
    want = defaultdict(list)
    for _, channel, ts, found in rows:
        for i, a in enumerate(found):
            for b in found[i + 1 :]:
                want[a, b].append((channel, ts))
    df = spark.createDataFrame(rows, "message_id string, channel_id string, ts timestamp, names array<string>").repartition(3)
    got = graph.co_occurrences(df, graph.entity_counts(df), block_pairs)
    assert got.columns == ["entity_1", "entity_2", "n", "channels", "first_ts", "last_ts"]
    assert {(r.entity_1, r.entity_2): (r.n, r.channels, r.first_ts, r.last_ts) for r in got.collect()} == {k: (len(v), len({c for c, _ in v if c}), min(t for _, t in v), max(t for _, t in v)) for k, v in want.items()}
    none = df.limit(0)
    assert graph.co_occurrences(none, graph.entity_counts(none)).count() == 0


def test_capital_words(spark):
    text = "Kafka xAb éCafe A Ab Abé AB_C 9Ab AB1 Ünder IBM's ABé1 A9"
    assert [x["text"] for x in spark.range(1).select(ft.entities(F.lit(text)).alias("e")).first().e if x["type"] == "technical"] == ["Kafka", "Ab", "AB1", "IBM", "A9"]


def test_blocks_get_no_names_before_their_own(spark):
    """A block is sent the names after its first own one only, and nothing for the last name of a message."""
    df = spark.createDataFrame([("m", "C1", dt.datetime(2024, 1, 1), [f"n{i:02}" for i in range(30)])], "message_id string, channel_id string, ts timestamp, names array<string>")
    rows = graph._routed(df, 10**6, {}).collect()
    assert len(rows) == 29 and all(r.mine[0] == 0 for r in rows) and sum(len(r.names) for r in rows) == sum(range(2, 31))


def test_a_frequent_name_leads_no_pairs(spark):
    """Of two names the rarer one leads, so that a name of all messages, first in the order of names or not, is no block's burden."""
    rows = [(f"m{i}", "C1", dt.datetime(2024, 1, 1), sorted(["a", f"n{i}", f"n{i + 1}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "message_id string, channel_id string, ts timestamp, names array<string>")
    ranked = graph._ranked(df, graph.entity_counts(df))
    assert graph.entity_counts(ranked).where("entity = 'a'").first().pairs == 0
    sent = graph._routed(ranked, 64, {})
    assert sent.select(F.explode("names")).count() == 200 * (3 + 2) - sum(1 for r in sent.collect() if len(r.mine) == 2) * 2


def test_block_in_steps():
    """A block's pairs are the same, however many are laid out at a time; a name's many pairs may be added up in several steps."""
    rng = random.Random(1)
    names = [f"n{i}" for i in range(12)] + ["é", ""]
    found = [rng.sample(names, rng.randint(0, 8)) for _ in range(300)]
    stamps = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 99)) for _ in found]
    table = pa.table({"names": pa.array(found, pa.list_(pa.string())), "channel_id": [rng.choice(["C1", "C2", None]) for _ in found], "ts": pa.array(stamps, pa.timestamp("us", "UTC"))})
    parcels = []
    for part in (table.slice(0, 100), table.slice(100)):
        for _, lists in graph._parcels(part, 1, set()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, graph._ROWS) as to:
                to.write_batch(pa.RecordBatch.from_arrays(lists, schema=graph._ROWS))
            parcels.append(sink.getvalue())
    want = {}
    for step in (10**6, 300, 7, 1):
        got = {}
        for batch in graph._summed(list(parcels), step):
            for r in batch.to_pylist():
                assert r["entity_1"] < r["entity_2"]
                x = got.setdefault((r["entity_1"], r["entity_2"]), [0, r["channels"], r["first_ts"], r["last_ts"]])
                x[0], x[1], x[2], x[3] = x[0] + r["n"], max(x[1], r["channels"]), min(x[2], r["first_ts"]), max(x[3], r["last_ts"])
        want = want or got
        assert got == want
    assert sum(x[0] for x in want.values()) == sum(len(f) * (len(f) - 1) // 2 for f in found)
