"""A long list of rules of many shapes, against a loop."""

import random

from pyspark.sql import functions as F

from chatlake.llm import urls


def test_many_rules(spark):
    rng = random.Random(11)
    part = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    host = lambda n: ".".join(part() for _ in range(n))
    path = lambda: "/" + "/".join(part() for _ in range(rng.randint(0, 3)))
    rules = [(rng.choice(["allow", "block"]), host(rng.randint(1, 5)) + path() + rng.choice(["", "x" * rng.randint(0, 90)])) for _ in range(4000)]
    rules = list({r: v for v, r in rules}.items())
    pages = [(i, "http://" + ".".join([host(rng.randint(0, 3))] * bool(rng.randint(0, 2)) + [r.split("/", 1)[0]]) + "/" + r.split("/", 1)[1] + rng.choice(["", "q", "?z", "#z"])) for i, (r, _) in enumerate(rng.choices(rules, k=600))] + [(1000 + i, f"http://{host(3)}{path()}") for i in range(200)]
    by = spark.createDataFrame([(v, r) for r, v in rules], "verdict string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.apply_rules(spark.createDataFrame(pages, "page_id int, url string"), by, default="none").collect()}
    want = {}
    for i, u in pages:
        rest = u.split("://", 1)[1]
        h, p = (rest.split("/", 1) + [""])[:2]
        p = ("/" + p).split("?")[0].split("#")[0]
        fit = [(len(r), r, v) for r, v in rules for a, b in [r.split("/", 1)] if (h == a or h.endswith("." + a)) and p.startswith("/" + b)]
        longest = max((n for n, _, _ in fit), default=0)
        want[i] = {(r, v) for n, r, v in fit if n == longest} or {(None, "none")}
    assert all(got[i] in w for i, w in want.items()) and sum(got[i][0] is not None for i in got) > 590
    shown = urls.apply_rules(spark.createDataFrame(pages, "page_id int, url string"), by).where(F.col("rule").isNotNull())
    assert "Python" not in shown._jdf.queryExecution().executedPlan().toString()
