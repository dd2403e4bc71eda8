"""Connected components against a walk, and without a round in vain."""

import random

import pytest

from chatlake.llm import components


@pytest.mark.parametrize("links, tables", [([(9, 1), (1, 7), (5, 2), (2, 2)], 1), ([(i, i + 1) for i in range(20)], None), ([(1, 9), (2, 9)], 2), ([], 1)])
def test_connected(spark, monkeypatch, links, tables):
    random.Random(1).shuffle(links)
    made, put = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: made.append(name) or put(df, name))
    got = {(r.node, r.component) for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == set(root.items())
    assert tables is None or len(made) == tables  # stars are known as such, whether given or made
