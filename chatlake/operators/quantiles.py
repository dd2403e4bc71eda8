"""Exact quantiles by selection: count by range, narrow to the range that holds the wanted rank, repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, ready, written

RANGES = 1024


def exact_quantile(df: DataFrame, value: Column, q: float, *by: str, ranges: int = RANGES) -> DataFrame:
    """(by, n, quantile): of each group's values in order the one at rank ceil(q * n), the first for q = 0. Nulls do not count; NaN is the
    largest value.

    A pass leaves at most `ranges` + 3 rows of a group: the counts of equal ranges between the least and the greatest
    finite value left, with the least and the greatest of each. As the least and the greatest fall into different
    ranges, each pass has less left; equal values end it. Groups that are done take no part in later passes."""
    ready(df.sparkSession)
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), value.cast("double").alias("__v")).where("__v IS NOT NULL")
    v, finite = F.col("__v"), ~F.isnan("__v") & (F.abs("__v") < float("inf"))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q)).cast("long"))
    state, first, done = written(sums.withColumns({"rank": rank, "found": F.lit(None).cast("double")}), "quantile"), True, None
    while True:
        s = state.where("found IS NULL").select(*(F.col(k).alias(f"s{k}") for k in keys), "lo", "hi", "rank", "n")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"s{k}"))
        met = rows.join(s, same) if keys else rows.crossJoin(F.broadcast(s))  # one row
        if not first:
            met = met.where(finite & (v >= F.col("lo")) & (v <= F.col("hi")))
        first = False
        # halves, as the distance of two doubles may be none
        share = (v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        inside = F.when(F.col("lo") == F.col("hi"), 0).when(v == F.col("hi"), ranges - 1).otherwise(F.least(F.floor(share * ranges).cast("int"), F.lit(ranges - 1)))
        at = F.when(F.isnan(v), ranges + 1).when(v == float("inf"), ranges).when(v == float("-inf"), -1).otherwise(inside)
        counts = met.groupBy(*keys, "rank", "n", at.alias("at")).agg(F.count(F.lit(1)).alias("m"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        line = Window.partitionBy(*keys).orderBy("at")  # a row for each range
        upto = counts.withColumn("upto", F.sum("m").over(line)).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
        found = F.when((F.col("lo") == F.col("hi")) | F.isnan("lo"), F.col("lo"))
        now = written(upto.select(*keys, "n", "lo", "hi", (F.col("rank") - (F.col("upto") - F.col("m"))).alias("rank"), found.alias("found")), "quantile")
        if done is None:
            forget(state)
        state = now
        over = now.where("found IS NOT NULL").select(*keys, "n", "found")
        done = over if done is None else done.unionByName(over)
        if not now.where("found IS NULL").limit(1).count():
            return done.select(*(F.col(k).alias(b) for k, b in zip(keys, by)), "n", F.col("found").alias("quantile"))
