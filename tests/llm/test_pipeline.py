"""Every stage of the pipeline against brute force, given the models that its first two stages fit."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_operators import noise, words
from tokenizers import Tokenizer

import corpus_pipeline
from chatlake.llm import bpe, language, toxicity
from chatlake.llm.session import table, written


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The smallest documents and labels with odd rows, near copies of 80 percent, copies of an id, and repeats."""
    rng = random.Random(12)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = noise(rng, 100).split()
    extra = [(None, noise(rng, 30), "en"), (10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "½ 12", "en"), (10**6 + 3, noise(rng, 60), "en"), (10**6 + 3, noise(rng, 60), "en")]
    extra[-1] = extra[-2]
    for n in range(12):  # one to twelve words changed at the end: similarities of 0.98 to 0.78
        extra.append((10**6 + 10 + n, " ".join(base[: 100 - n] + [f"end{n}x{j}" for j in range(n)]), "en"))
    to = str(tmp_path_factory.mktemp("pipeline"))
    more = spark.createDataFrame([(i, t, lang, "odd", len(t or "")) for i, t, lang in extra], docs.schema)
    docs.unionByName(docs.where("doc_id % 40 = 0")).unionByName(more).repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{to}/labels.parquet")
    return to


def near_groups(rows, percent):
    sets = {i: (lambda w: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()))(words(t, True)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            if sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_stages(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, folder, "documents")
    columns = docs.columns

    model = toxicity.fit(docs, table(spark, folder, "labels"))
    clean = written(stages["toxicity"](spark, docs, folder), "test-toxicity")
    texts = pa.array([r.text for r in docs.collect()])
    scores = np.concatenate([s for _, _, s in toxicity._scores(model, model.responses(), texts)])
    assert clean.columns == columns and plain(clean) == sorted((tuple(r) for r, s in zip(docs.collect(), scores) if s < 0.5), key=repr)

    judge = language.Classifier(language.learn(clean)).judge
    known = written(stages["language"](spark, clean, folder), "test-language")
    want = [tuple(r) for r in clean.collect() if (lambda x: x[0] != "und" and x[2] >= language.NARROW)(judge(r.text))]
    assert known.columns == columns and plain(known) == sorted(want, key=repr) and 10**6 + 2 not in {r[0] for r in want}

    single = written(stages["near_duplicates"](spark, known, folder), "test-near")
    rows = plain(known)
    group = near_groups([(r[0], r[1]) for r in rows if r[0] is not None], 80)
    want = {r for r in rows if r[0] is None or group[r[0]] == r[0]}
    assert single.columns == columns and plain(single) == sorted(want, key=repr) and len(want) < len(set(rows)) < len(rows)

    cut = written(stages["repeats"](spark, single, folder), "test-repeats")
    low, want = {}, []
    for r in plain(single):
        w = words(r[1])
        for j in range(len(w) - 12) if r[0] is not None else ():
            low[tuple(w[j : j + 13])] = min(low.get(tuple(w[j : j + 13]), r[0]), r[0])
    for r in plain(single):
        w = words(r[1])
        gone = [False] * len(w)
        for j in range(len(w) - 12) if r[0] is not None else ():
            if low[tuple(w[j : j + 13])] < r[0]:
                gone[j : j + 13] = [True] * 13
        t = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else r[1]
        want.append((r[0], t, r[2], r[3], len(t)))
    assert cut.columns == columns and sorted((tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in cut.collect()), key=repr) == sorted(want, key=repr)

    packed = stages["packing"](spark, cut, folder).collect()
    t = Tokenizer.from_file(bpe.default_path())
    ids = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [0] for r in cut.collect()}
    spans = {}
    for r in packed:
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.doc_id][r.start : r.start + r.length]))
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, parts in spans.items():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and sum(n for _, n in parts) == len(ids[i])
    assert set(spans) == set(ids)

    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in packed)


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
