"""The training-data operators against brute force, round trips and held-out labels."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chatlake.llm import bpe, flac, language, minhash, packing, passages, text, topk, toxicity, urls, warc

DOCS = "doc_id long, text string"
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "é" * 70000), (4, "a b c"), (4, "a b c"), (None, "a b c d e f g h i j k l m n"), (6, "<|endoftext|> don't  stop\n"), (7, "😀 \x1c\x85 ١٢")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS + ", id string")  # a clashing name


def words(t, lower=False):
    t = t or ""
    if lower:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return re.findall("[^\x20\x09-\x0d]+", t)


def noise(rng, n, size=40):
    return " ".join(rng.choice("abcdefghijklmnopqrst") + str(rng.randint(0, size)) for _ in range(n))


def test_bpe_equals_library():
    rng = random.Random(1)
    parts = ["a", "é", "1", " ", "  ", "\n", "'s", "'ll", "'re", "!", "<|endoftext|>", "😀", "don't", "aaaa", "\x85", "​", "the", ""]
    texts = [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    v, t = bpe.vocabulary(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    data, off = text.utf8(pa.array(texts))
    ids, at = bpe.encode(data, off, v)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert bpe.decode(ids, at, v)[0].tobytes() == data.tobytes()


def test_bpe_frames(spark):
    coded = bpe.bpe_encode(docs(spark), bpe.default_path())
    t = Tokenizer.from_file(bpe.default_path())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in coded.collect()) == sorted((i is None, i or 0, t.encode(x or "", add_special_tokens=False).ids) for i, x in ODD)
    assert sorted(r.text for r in bpe.bpe_decode(coded, bpe.default_path()).collect()) == sorted(x or "" for _, x in ODD)


def without_seek_table(stream):
    at, last, blocks = 4, False, []
    while not last:
        last, n = bool(stream[at] & 0x80), int.from_bytes(stream[at + 1 : at + 4], "big")
        blocks.append((stream[at] & 0x7F, stream[at + 4 : at + 4 + n]))
        at += 4 + n
    blocks = [x for x in blocks if x[0] != 3]
    return b"fLaC" + b"".join(bytes([k | 0x80 * (i + 1 == len(blocks))]) + len(x).to_bytes(3, "big") + x for i, (k, x) in enumerate(blocks)) + stream[at:]


def unpacked(streams):
    samples, off, _, _, ranked = flac.decode_streams(streams)
    return flac.expanded(samples, off, ranked).tobytes()


def test_flac(spark, monkeypatch):
    rng = np.random.default_rng(2)
    payloads = [bytes(64), rng.integers(0, 256, 64 * 40, dtype=np.uint8).tobytes(), b"hello world   x" * 64, bytes(range(256)) * 4 + b"ab" * 32, b"a" * 1000 + b"b" * 24 + b"z" * 1024 + b"q" * 64]
    off = np.cumsum([0, *map(len, payloads)])
    streams = flac.encode_streams(np.frombuffer(b"".join(payloads), np.uint8), off)
    assert unpacked(streams) == b"".join(payloads) == unpacked([without_seek_table(x) for x in streams])
    bad = bytearray(streams[2])
    bad[-30] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode_streams([bytes(bad)])
    # plain samples: waves and ramps take linear and fixed predictors
    monkeypatch.setattr(flac, "_ranks", lambda data, offsets: ((data ^ 0x80).view(np.int8), [b""] * (len(offsets) - 1)))
    monkeypatch.setattr(flac, "expanded", lambda samples, off, ranked: samples.view(np.uint8) ^ 0x80)
    waves = [np.rint(np.sin(np.arange(64 * 50) / t) * 100 + 128).astype(np.uint8).tobytes() for t in (3, 9, 40)] + [(np.arange(1024) // 5 % 200).astype(np.uint8).tobytes()]
    streams = flac.encode_streams(np.frombuffer(b"".join(waves), np.uint8), np.cumsum([0, *map(len, waves)]))
    assert unpacked(streams) == b"".join(waves) and all(len(x) < 0.75 * len(w) for x, w in zip(streams, waves))
    monkeypatch.undo()
    coded = flac.flac_encode(docs(spark))
    blocks = {}
    for r in flac.flac_blocks(coded.where("doc_id < 4")).orderBy("sample_offset").collect():
        blocks[r.doc_id] = blocks.get(r.doc_id, b"") + bytes(r.pcm)
    assert all(blocks[i].rstrip(b"\0") == (t or "").encode() and len(blocks[i]) % 64 == 0 for i, t in ODD[:4])


def test_warc(spark, tmp_path):
    rows = [(i, None if i == 3 else f"http://h/{i}\n", [None, "", "same", "é", "same"][i % 5]) for i in range(40)] + [(None, "u", "same"), (50, "u", "x" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages)
    back = warc.read_archives(archives).collect()
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for r in back:
        h = next((x or "" for i, _, x in rows if i == r.page_id), "same") if r.page_id is not None else "same"
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert r.refers_to == (None if first[h] == r.page_id else first[h]) and (r.record_type == "response") == (r.refers_to is None)
    for name in ("a", "b"):  # a repeated task replaces its files
        warc.export_archives(archives, str(tmp_path))
    files = sorted(tmp_path.iterdir())
    assert sum(len(list(warc.records_of(f.read_bytes()))) for f in files) == len(rows) and len(files) == archives.count()
    assert len(back) == len(rows) and warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    assert all(r.record_type == "response" for r in warc.read_archives(warc.write_archives(pages, 10**9)).collect())


@pytest.mark.parametrize(("hot", "size"), [(3, 2000), (passages.HOT_TIMES, 2000), (passages.HOT_TIMES, passages.SHARD_BYTES)])
def test_passages(spark, monkeypatch, hot, size):
    monkeypatch.setattr(passages, "HOT_TIMES", hot)
    monkeypatch.setattr(passages, "SHARD_BYTES", size)
    rng = random.Random(4)
    shared = [noise(rng, 30) for _ in range(4)]
    rows = [(i + 10, noise(rng, rng.randint(0, 40)) + " " + rng.choice(shared) + rng.choice(["\n", " "]) + noise(rng, rng.randint(0, 20)) if i % 3 else noise(rng, 12)) for i in range(150)] + ODD
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeats(docs(spark, rows)).collect()}
    seen, want = {}, set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if seen.setdefault(tuple(w[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        want.add((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert {r for r in got if r[0] is not None} == want and any(r[2] for r in want)


def test_minhash(spark):
    rng = random.Random(5)
    rows = list(ODD)
    for g in range(12):
        base = noise(rng, 120).split()
        for c in range(15):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 10**6))
            rows.append((100 + g * 20 + c, " ".join(w)))
    out = minhash.near_duplicates(docs(spark, rows), 85).collect()
    sets = {}
    for i, t in rows:
        if i is not None:
            w = words(t, True)
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(6)
    make = lambda a: " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(60))
    rows = [(i, make(["ka", "ti", "mo"]) if i % 2 else make(["sch", "ung", "der"]), "x" if i % 2 else "y") for i in range(200)]
    learned = language.learn(spark.createDataFrame(rows[:150], "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learned).collect()}
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 for i, _, lang in rows)
    assert {r.lang_pred for r in language.identify(docs(spark, ODD[:3]), learned).collect()} == {"und"}
    assert {r.lang_pred for r in language.identify(docs(spark), {}).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(7)
    rows = [(i, noise(rng, 80) + (" you vile worm " if i % 4 == 0 else " ") + noise(rng, 40), "en") for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    out = {r.doc_id: r.predicted for r in toxicity.score(d, model).collect()}
    assert np.mean([out[i] == (i % 4 == 0) for i in range(600, 800)]) > 0.97
    assert toxicity.score(docs(spark), model).count() == len(ODD) and toxicity.keep_clean(d, model).columns == d.columns
    assert toxicity.fit(d, labels.limit(0)) is None and toxicity.score(d, None).agg({"score": "max"}).first()[0] == 0


def test_urls(spark):
    rows = [(1, "HTTP://Blog.Example.ORG/es/x?q"), (2, "http://example.org/en/12"), (3, "http://a.com/fr/"), (4, "http://a.com/de/x"), (5, None), (6, "nothing"), (7, "http://xorg/"), (8, "http://org"), (9, "http://x.example.org/es")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.apply_rules(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark, urls.QUERY_RULES)).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("com/fr/", "allow"), 4: ("com/de/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("org/", "allow")}


def exact_top(rows, k, step=20):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x):
            v.setdefault(i, []).append([math.floor(64 * y) for y in x])
    out = {}
    for i in (i for i in v if i % step == 0):
        for q in v[i]:
            all_ = [(sum(a * b for a, b in zip(q, c)), j) for j in v if j != i for c in v[j] if len(c) == len(q)]
            out.setdefault(i, []).append([(j, s) for s, j in sorted(all_, key=lambda x: (-x[0], x[1]))[:k]])
    return out


@pytest.mark.parametrize(("scale", "query_scale"), [(1.0, 1.0), (1e6, 1e6), (1e8, 1.0), (3e12, 1.0)])  # the second and last need more than 53 bits
def test_topk(spark, scale, query_scale):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=40).round(1) * (scale if i % 20 else query_scale)).tolist()) for i in range(300)] + [(1000, None), (1001, [float("nan")] * 32), (1002, [1.0, None] * 16), (1003, [0.5] * 7), (None, [0.5] * 40), (1004, []), (1020, []), (1006, [float("inf")])]
    rows += [(2000 + i, [1.0] * 6) for i in range(30)]  # ties
    df = spark.createDataFrame([(i, x, i) for i, x in rows], "vec_id long, embedding array<double>, id long")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {i: x[0] for i, x in exact_top(rows, 5).items() if x[0]}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(9)
    rows = ODD + [(20 + i, noise(rng, rng.randint(0, 900))) for i in range(60)]
    out = packing.pack(docs(spark, rows), bpe.default_path(), with_ids=True).collect()
    t = Tokenizer.from_file(bpe.default_path())
    by_doc, by_seq = {}, {}
    for r in out:
        assert 0 < r.length <= 1024 and r.length == len(r.ids)
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in rows:
        if i is not None and i != 4:
            parts = sorted(by_doc[i], key=lambda r: r.start)
            assert [y for p in parts for y in p.ids] == t.encode(x or "", add_special_tokens=False).ids + [0]
    padding = 0
    for spans in by_seq.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding <= 0.06 * sum(r.length for r in out)


def test_language_sample_counts_copies_once(spark):
    texts = [f"opening line {'z' * 500} body{i}" for i in range(40)]
    rows = [(i, t, "x") for i, t in enumerate(t for t in texts for _ in range(40))] + [(9000, "y" * (language.TEXT_BYTES + 1), "long"), (9001, "y" * (language.TEXT_BYTES + 9), "long")]
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(learned["x"].decode().splitlines()) == sorted(texts) and len(learned["long"]) == language.TEXT_BYTES + 2
    many = language.learn(spark.createDataFrame([(i, f"{i} " + "word " * 1000, "x") for i in range(200)], "doc_id long, text string, lang string"))
    assert language.DICTIONARY_BYTES - 5100 < len(many["x"]) <= language.DICTIONARY_BYTES and set(map(len, many["x"].decode().splitlines())) <= {5002, 5003, 5004}
