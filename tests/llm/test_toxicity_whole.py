"""op6 learns from all labelled rows, also where its bounded start does not hold them."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
from test_operators import noise

from chatlake.llm import toxicity


def test_words_beyond_the_sample(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    bad = [f"vile{i}" for i in range(40)]
    rows = [(i, f"{noise(rng, 20)} {rng.choice(bad) if i % 3 == 0 else 'kind'} {noise(rng, 10)}", "en") for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(3600)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 12)  # fewer than there are bad words
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 24)
    monkeypatch.setattr(toxicity, "PART_BYTES", 100_000)
    got = {r.doc_id: r.score for r in toxicity.op6_toxicity(spark, str(tmp_path)).collect()}
    new = [i for i in range(4000) if i >= 3600 or zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 4000 and np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in new]) > 0.95
    again = toxicity.op6_toxicity(spark, str(tmp_path)).where("score IS NOT NULL").collect()
    assert all(abs(got[r.doc_id] - r.score) < 1e-6 for r in again)


def test_binned_thresholds():
    """At bins as fine as here, the threshold splits the labels as the exact one does."""
    rng = np.random.default_rng(4)
    y = (rng.random(3000) < 0.2).astype(int)
    z = rng.normal(size=3000) + 2 * y
    at = np.floor(z * toxicity.BINS).astype(int)

    class Row:
        def __init__(self, b, label, n):
            self.lang, self.bin, self.y, self.n = 0, b, label, n

    rows = [Row(int(b), label, int(((at == b) & (y == label)).sum())) for b in np.unique(at) for label in (0, 1)]
    f1 = lambda t: 2 * y[z >= t].sum() / ((z >= t).sum() + y.sum())
    assert abs(f1(toxicity._binned_thresholds(rows, 1)[0]) - f1(toxicity._threshold(z, y, 0.0))) < 0.003


def test_driver_trains_nothing(spark, monkeypatch):
    """The start's training runs in a task: the driver gets neither the texts nor the arrays of it, and the model is the same."""
    rng = random.Random(6)
    rows = [(i, f"{noise(rng, 12)} {'vile' if i % 3 == 0 else 'kind'} {noise(rng, 5)}", "en") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    want = toxicity.train(pa.array([t for _, t, _ in rows]), np.array([int(i % 3 == 0) for i in range(150)]), ["en"] * 150)

    driver, real = os.getpid(), toxicity.train

    def elsewhere(*x):
        assert os.getpid() != driver, "trained in the driver"
        return real(*x)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    got = toxicity.fit(docs, labels)
    assert np.allclose(got.embedding, want.embedding, atol=1e-5) and np.allclose(got.weights, want.weights, atol=1e-5) and np.allclose(got.thresholds, want.thresholds, atol=1e-4)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(docs.limit(0), labels) is None
