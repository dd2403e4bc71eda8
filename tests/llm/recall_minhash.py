"""Recall of op9_minhash against an exact search over all pairs: python recall_minhash.py FOLDER [PERCENT].

The exact search holds full sets of word tuples against each other wherever they share a word tuple of their prefix,
rarest first, which loses no pair of the given similarity. Not collected by pytest."""

import collections
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]


def exact(rows, percent):
    """{id: (size of the set, component)} and the linked pairs of different sets."""
    import re

    word = re.compile("[^\x20\x09-\x0d]+")
    lower = {c: c + 32 for c in range(65, 91)}
    sets, same = {}, {}
    for i, t in rows:
        w = word.findall((t or "").translate(lower))
        s = frozenset(hash(tuple(w[j : j + 5])) for j in range(len(w) - 4)) or (frozenset([hash(tuple(w))]) if w else frozenset())
        sets[i] = s
        if s:
            same.setdefault(s, []).append(i)
    often = collections.Counter(x for s in same for x in s)
    posts, links = collections.defaultdict(list), []
    for s in same:
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]:
            posts[x].append(s)
    tried = set()
    for group in posts.values():
        for n, a in enumerate(group):
            for b in group[:n]:
                key = (id(a), id(b)) if id(a) < id(b) else (id(b), id(a))
                if key not in tried and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    tried.add(key)
                    if 100 * len(a & b) >= percent * len(a | b):
                        links.append((min(same[a]), min(same[b])))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in [*links, *((min(g), i) for g in same.values() for i in g)]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}, links


def main(folder, percent):
    from pyspark.sql import SparkSession

    from chatlake.llm import minhash
    from chatlake.llm.session import table

    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "12").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = table(spark, folder, "documents")
    want, links = exact([(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("doc_id IS NOT NULL").toLocalIterator()], percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, percent).where("doc_id IS NOT NULL").toLocalIterator()}
    kept = sum(got[a][1] == got[b][1] for a, b in links)
    print(f"{folder}, {percent} percent: {len(want)} documents, {sum(i != c for i, (_, c) in want.items())} not kept, {sum(got[i] != want[i] for i in want)} rows differ; of {len(links)} links between different sets {kept} lie in one component")


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 85)
