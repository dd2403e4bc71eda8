"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from chatlake.llm import queries, spelling


def near(a, b):
    """Whether one edit apart, by trying all."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows, typo=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % typo else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(rows):
    words = counts(rows)
    of = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in of.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(of[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    letters = "abé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["abcdef", "abcdeg", "abcdegh", "Éabcde", "éabcde", "aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "x" * 63 + "y", "x" * 65, "x" * 64, "x" * 300, "x" * 299 + "z", "×÷×÷×÷", "×÷×÷×÷ÿ"]
    docs = [(None, "abcdef " * 9), (1, None), (2, ""), (3, "ab1cdefghĀabcdefgſß abcdef" * 7)]
    docs += [(i, " ".join(rng.choice(base[: 1 + i % len(base)]) for _ in range(60)) + ",") for i in range(10, 160)] + [(160 + i % 3, "ABCDEF abcdeg") for i in range(40)]
    docs += [(300 + i, "abcdeh " * (1 if i % 2 else 3) + "abcdehi " + "q" * 5000) for i in range(8)] + [(400, "letter" * 20000 + " abcdef")]
    return docs


@pytest.mark.parametrize("part", [1, 4, 25, 8000])
def test_variants(spark, rows, part):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS word", "'c' AS n", "'c' AS id").repartition(3)
    want = brute(rows)
    assert sum(w[1] is not None for w in want) >= 5 and len({w[2] for w in want if w[1]}) >= 2
    assert got(spelling.variants(docs, part=part)) == want


def test_chain(spark):
    docs = [(i, "abcdef " * 1000) for i in range(1)] + [(5, "abcdeg " * 150), (6, "abcdgg " * 25), (7, "abchgg " * 5)]
    want = brute(docs)
    assert ("abchgg", "abcdef") in {(w[0], w[2]) for w in want}
    assert got(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == want


@pytest.mark.parametrize("seed", range(30))
def test_pairs(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc"[: 1 + seed % 3]) for _ in range(rng.randint(0, 7))) for _ in range(80)})
    want = {tuple(sorted((a, b))) for a in words for b in words if near(a, b)}
    have = [tuple(sorted(p)) for p in spelling.one_edit_pairs(words)]
    assert len(have) == len(set(have)) and set(have) == want
    # only those with less than two code points after the last place where the edit can be
    short = {p for p in want if min(k for k in range(8) for a, b in (p, p[::-1]) if len(a) <= len(b) and a[len(a) - k :] == b[len(b) - k :] and a[: len(a) - k - (len(a) == len(b))] == b[: len(b) - k - 1]) < 2}
    assert {tuple(sorted(p)) for p in spelling.one_edit_pairs(words, 2)} == short


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in ("x", "y", "zz") for b in ("", "1", "22") for c in ("end", "and"))
    a = spelling.Acceptor(words)
    live, stack, said = set(), [(0, "")], []
    while stack:
        q, w = stack.pop()
        live.add(q)
        if a.final[q]:
            said.append(w)
        stack += [(to, w + c) for c, to in a.edges[q].items()]
    assert sorted(said) == words
    languages = {}
    for q in live:
        out, stack = set(), [(q, "")]
        while stack:
            x, w = stack.pop()
            if a.final[x]:
                out.add(w)
            stack += [(to, w + c) for c, to in a.edges[x].items()]
        assert languages.setdefault(frozenset(out), q) == q


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op11_spelling"](spark, sf)) == brute(rows)
