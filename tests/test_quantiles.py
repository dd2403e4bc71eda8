"""Exact quantiles against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators.quantiles import exact_quantile


@pytest.mark.parametrize("q,ranges", [(0.95, 4), (0.5, 2), (0.0, 1024), (1.0, 3), (0.333, 1024)])
def test_quantile(spark, q, ranges):
    rng = random.Random(int(q * 100))
    nan, inf = float("nan"), float("inf")
    groups = {
        "ties": [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(200)], "one": [5.0], "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, 3.0], "odd": [nan, inf, -inf, 1.0, nan, 2.0], "same": [7.0] * 50, "nan": [nan, nan],
        None: [rng.gauss(0, 1) for _ in range(301)], "tail": [10.0 ** rng.randint(-20, 20) for _ in range(150)] + [-0.0, 0.0], "none": [None],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "stage string, value double").repartition(3)
    got = {r.stage: (r.n, r.quantile) for r in exact_quantile(df, F.col("value"), q, "stage", ranges=ranges).collect()}
    want = {}
    for g, vs in groups.items():
        vs = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
        if vs:
            want[g] = (len(vs), vs[max(1, math.ceil(q * len(vs))) - 1])
    assert {k: (n, v + 0.0 if v == v else "nan") for k, (n, v) in got.items()} == {k: (n, v + 0.0 if v == v else "nan") for k, (n, v) in want.items()}


def test_all_rows_as_one_group(spark):
    df = spark.range(1001).select((F.col("id") * 8 % 1001).alias("v"))
    assert [tuple(r) for r in exact_quantile(df, F.col("v"), 0.5).collect()] == [(1001, 500.0)]
    assert exact_quantile(df.limit(0), F.col("v"), 0.5).count() == 0
