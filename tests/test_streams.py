"""Streams against their batch twins: late and split batches, restarts, repeated batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators import folds as batch
from chatlake.streaming import folds, ingest

START = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, parts, schema, stream, mode, name, per_trigger=None):
    """Run the stream after each part of the rows, with one checkpoint; what it wrote."""
    src, out, cp = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "cp"))
    for rows in parts:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(src)
        reader = spark.readStream.schema(schema)
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
        folds.to_end(stream(reader.parquet(src)), folds.replacing(out), cp, mode)
    return spark.read.parquet(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_reactions(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"m{rng.randint(0, 2)}", rng.choice("ab"), rng.choice([1, -1, -1]), START + dt.timedelta(minutes=rng.randint(0, 6000)), i) for i in range(300)]
    # delivered up to 20 hours late, in many batches
    rows.sort(key=lambda r: r[3] + dt.timedelta(hours=rng.randint(0, 20)))
    schema = "key string, name string, delta int, event_time timestamp, event_id int"
    kept = feed(spark, tmp_path, [rows[i : i + 50] for i in range(0, 300, 50)], schema, folds.reaction_segments, "update", "r")
    want = {}
    for key, name, delta, _, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        n, adds = want.get((key, name), (0, 0))
        want[key, name] = (max(0, n + delta), adds + (delta > 0))
    assert {(r.key, r.name): (r.n, r.adds) for r in folds.reaction_counts(kept).collect()} == want
    for hours in (0, 30, 61, 200):
        less = folds.compacted(kept, F.lit(START + dt.timedelta(hours=hours)))
        assert {(r.key, r.name): (r.n, r.adds) for r in folds.reaction_counts(less).collect()} == want
        assert less.where(F.col("since") < F.lit(START + dt.timedelta(hours=hours))).groupBy("key", "name").count().where("count > 1").count() == 0


def test_edits(spark, tmp_path):
    rng = random.Random(3)
    said = [(f"m{i}", "message", START, 0, f"first {i}") for i in range(8)]
    edits = [(f"m{i}", "edit", START + dt.timedelta(minutes=rng.randint(0, 5)), n, f"<#C1|c>  edit {n}") for i in range(10) for n in range(rng.randint(0, 4))]
    rows = said + edits
    rng.shuffle(rows)
    schema = "message_id string, kind string, event_time timestamp, event_id int, text string"
    got = folds.latest(feed(spark, tmp_path, [rows[:15], rows[15:]], schema, folds.edited, "update", "e", 1), "message_id")
    df = spark.createDataFrame(rows, schema)
    want = batch.edits(df.where("kind = 'message'"), df.where("kind = 'edit'"))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and want.count() > 3
    row = batch.edits(spark.createDataFrame([("a", "one")], "message_id string, text string"), spark.createDataFrame([("a", 5, 1, "three"), ("a", 4, 2, "two"), ("b", 1, 1, "x")], "message_id string, event_time int, event_id int, text string")).collect()
    assert [(r.text, r.edited_at, r.n_edits, [tuple(h) for h in r.history]) for r in row] == [("three", 5, 2, [(4, "one"), (5, "two")])]


def test_threads(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"t{t}" if k == 0 else f"t{t}-{k}", f"t{t}", "C", f"u{rng.randint(0, 4)}", START + dt.timedelta(minutes=rng.randint(0, 99)), float(t)) for t in range(6) for k in range(rng.randint(1, 6)) if t < 5 or k]
    rng.shuffle(rows)
    schema = "message_id string, thread_ts string, channel_id string, user_id string, ts timestamp, importance_score double"
    got = folds.latest(feed(spark, tmp_path, [rows[:7], rows[7:]], schema, folds.threads, "update", "t", 1), "thread_ts")
    want = batch.thread_rollup(spark.createDataFrame(rows, schema))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and want.count() == 5


def test_conversations(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    parts = [[(1, at(0)), (1, at(20)), (2, at(1))], [(3, at(30)), (1, at(29.5))], [(2, at(60)), (3, at(61))]]
    kept = feed(spark, tmp_path, parts, "conv_id int, at timestamp", folds.expired_conversations, "append", "c")
    # 1 had a late turn; 2 came back after it had expired, and its second life goes on, as 3 does
    assert sorted((r.conv_id, r.started_at, r.last_at, r.turns) for r in kept.collect()) == [(1, at(0), at(29.5), 3), (2, at(1), at(1), 1), (3, at(30), at(30), 1)]


def test_expiry_needs_no_output(spark, tmp_path):
    """A restart with the written events gone, and a batch that runs again, judge by the ledger's one row."""
    schema = "event_id string, event_time timestamp, type string"
    out = str(tmp_path / "out")
    save = folds.expiring(out)
    days = lambda *d: spark.createDataFrame([(str(x), START + dt.timedelta(days=x), "k") for x in d], schema)
    save(days(0, 3), 0)
    (tmp_path / "out/events").rename(tmp_path / "gone")
    for _ in range(2):
        save(days(1, 1.5, 2.5, 5), 1)
    save(days(4.5, 3.9), 2)
    kept = sorted((r.event_id, r.batch_id) for r in spark.read.parquet(f"{out}/events").collect())
    assert kept == [("2.5", 1), ("4.5", 2), ("5", 1)]
    assert sorted((r.type, r.n, r.batch_id) for r in spark.read.parquet(f"{out}/late").collect()) == [("k", 1, 2), ("k", 2, 1)]


def test_ingest_reads_touched_days_only(spark):
    rows = spark.createDataFrame([("1704067200.000001",), ("86399.5",), ("86400",), ("odd",), (None,), ("",)], "m string")
    assert [r[0] for r in rows.select(ingest.day_of(F.col("m"))).collect()] == [19723, 0, 1, -1, -1, -1]
