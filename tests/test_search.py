"""Vector search on odd vectors, against plain loops."""

import datetime as dt
import random

import pytest

from chatlake.operators import grams
from chatlake.operators import blocks, search

START = dt.datetime(2024, 1, 1)


def tables(spark, vectors, n_queries):
    q = spark.createDataFrame([(i, "text", None, False) for i in range(n_queries)], "query_id long, query_text string, channel_filter string, has_code_intent boolean")
    m = spark.createDataFrame([(f"D{i:04}", "c", "u", START, None, i) for i, _ in vectors], "message_id string, channel_name string, user_name string, ts timestamp, has_code boolean, doc_id long")
    return q, m, spark.createDataFrame(vectors, "vec_id long, embedding array<double>")


def brute(vectors, n_queries, k):
    import math

    good = {i: v for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    out = []
    for q in range(n_queries):
        if q in good:
            s = [(round(sum(a * b for a, b in zip(good[q], v)) / (norm(good[q]) * norm(v)), 9), f"D{i:04}") for i, v in good.items() if len(v) == len(good[q])]
            out += [(q, m, s) for s, m in sorted(s, key=lambda x: (-x[0], x[1]))[:k]]
    return sorted(out)


def test_odd_vectors(spark):
    nan = float("nan")
    vectors = [(0, [1.0, 0.0]), (1, [nan, 1.0]), (2, [nan, nan]), (3, [1.0]), (4, [0.5, 0.5]), (5, None), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, [float("inf"), 1.0]), (9, []), (10, [2.0, 0.0, 1.0])]
    got = sorted(map(tuple, search.semantic(*tables(spark, vectors, 4), k=2).select("query_id", "message_id", "score").collect()))
    assert got == brute(vectors, 4, 2) and {x[:2] for x in got} == {(0, "D0000"), (0, "D0004"), (3, "D0003")}


@pytest.mark.parametrize("group", [1, 3])
def test_bar_over_blocks(spark, monkeypatch, group):
    """Ties at the k-th place, over many small blocks of a group."""
    rng = random.Random(group)
    vectors = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)] + [1.0]) for i in range(300)]
    q, m, v = tables(spark, vectors, 40)
    small = lambda *a, **k: blocks.meet_groups(*a, rows=11, small_rows=7, **k)
    monkeypatch.setattr(search, "meet_groups", small)
    monkeypatch.setattr(blocks, "GROUP_BLOCKS", group * 8)
    monkeypatch.setattr(blocks, "SMALL_BLOCKS", 2)
    got = sorted(map(tuple, search.semantic(q, m, v, k=5).select("query_id", "message_id", "score").collect()))
    want = brute(vectors, 40, 5)
    assert [x[:2] for x in got] == [x[:2] for x in want] and max(abs(a[2] - b[2]) for a, b in zip(got, want)) < 2e-9


def test_grams(spark):
    """Needles of any length, with bytes of several scripts, in null, empty and long texts."""
    from chatlake.operators import grams

    rng = random.Random(7)
    alphabet = "ab é漢😀"
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(200, None), (201, ""), (202, "b" * 10**5 + "é漢a")]
    needles = sorted({t[a : a + n] for _, t in texts[:40] for a in (0, 3) for n in (0, 1, 2, 3, 5)} | {"zzz", "z", "abz", "aé漢z"}) + [None]
    q = spark.createDataFrame([(i, n) for i, n in enumerate(needles)] + [(900, "ab")], "query_id int, needle string")
    t = spark.createDataFrame(texts, "message_id int, hay string").repartition(3)
    got = sorted((r.query_id, r.message_id) for r in grams.holding(t, q).collect())
    want = sorted((r.query_id, i) for r in q.collect() for i, x in texts if r.needle is not None and x is not None and r.needle in x)
    assert got == want and len(want) > 500
    plan = grams.holding(t, q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_grams_are_counted_as_they_stand(spark):
    """A needle's gram is the one that stands least often in all texts, counted without sorting."""
    texts = spark.createDataFrame([("abcdefabcdefabcdefabcdef xbcdefg",), ("xbcdefg",), ("bcdefg",)], "hay string")
    got = grams.with_rarest(spark.createDataFrame([(1, "abcdefg")], "query_id long, needle string"), texts).collect()
    assert [r.code for r in got] == grams.codes_of("bcdefg")
