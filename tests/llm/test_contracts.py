"""Every registered query of the operators on odd tables, held against brute force column by column."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib

import pytest
from test_operators import exact_top, noise, words
from tokenizers import Tokenizer

from chatlake.llm import bpe, language, queries, toxicity

CLASH = ["id", "key", "n", "at", "z", "shard", "keys", "text_", "lang_pred", "score", "host", "rule", "word", "part", "dim", "held_out"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared, near = noise(rng, 40), noise(rng, 150)
    docs = [(None, "a b c", "en"), (1, None, "en"), (2, "", None), (3, " \t\n", "de"), (4, "½ ² ① 12", "en"), (5, "é" * 20000 + " ü", None), (6, noise(rng, 150000), "en"), (7, "x y z w v", "fr"), (7, "x y z w v", "fr"), (8, "X y\x0bz w v", "fr"), (9, "<|endoftext|> don't  stop\n 😀 \x1c\x85 ١٢", "en")]
    docs += [(20 + i, noise(rng, 30) + " " + shared + "\n" + noise(rng, rng.randint(0, 20)), rng.choice(["en", "de"])) for i in range(25)]
    docs += [(60 + i, near if i % 2 else near + " end" + str(i), "en") for i in range(12)] + [(100 + i, noise(rng, rng.randint(0, 900)), "en") for i in range(60)]
    pages = [(None, "http://a.org/", "p"), (1, None, None), (2, "", ""), (3, "HTTP://A.Org/x?y#z", "same"), (4, "ftp://b.com/fr/a", "same"), (5, "x://com/de/" + "y" * 10**6, "h" * 10**6), (5, "x://com/de/", "same"), (6, "http://sub.example.org/es/", "é"), (7, "http://example.org#/es/", "é"), (8, "nothing", "p")]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(200)] + [(i, [1.0] * 16) for i in range(200, 230)] + [(None, [1.0] * 16), (240, None), (260, [float("nan")] * 16), (280, [1.0, None]), (300, [])]
    return {"documents": docs, "pages": pages, "embeddings": vectors, "labels": [(i, 1, int(i % 3 == 0)) for i in range(20, 160)] + [(1, None, None), (None, 1, 1), (20, 0, 2)]}


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """A folder of the odd tables, and one of empty ones; all with columns that clash with the operators' own."""
    kinds = {"documents": "doc_id long, text string, lang string", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<double>", "labels": "doc_id long, quality int, toxic int"}
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    for name, kind in kinds.items():
        df = spark.createDataFrame(rows[name], kind)
        for c in CLASH if name != "labels" else []:
            df = df.selectExpr("*", f"'clash' AS {c}")
        df.repartition(3).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


def got(spark, tables, name, *columns):
    df = queries.QUERIES[name](spark, tables[0])
    assert set(columns) <= set(df.columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def same(a, b):
    assert a == sorted(b, key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty(spark, tables, name):
    assert queries.QUERIES[name](spark, tables[1]).count() == 0


def test_op1(spark, tables, rows):
    first = {}
    for i, _, h in rows["pages"]:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in rows["pages"]:
        to = first[h or ""] if first[h or ""] != i else None
        want.append((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if to is None else "revisit", to))
    same(got(spark, tables, "op1_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), want)


def test_op2(spark, tables, rows):
    want = []
    for i, t, _ in rows["documents"]:
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    same(got(spark, tables, "op2_flac", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"), want)
    media = {}
    for r in got(spark, tables, "op2_flac", "payload_sha256", "media_bytes", "media_sha256", "feature"):
        assert media.setdefault(r[0], r) == r and r[1] > 0 and re.fullmatch("[0-9a-f]{64}", r[2])


def test_op3(spark, tables, rows):
    low = {}
    for i, t, _ in rows["documents"]:
        w = words(t)
        for j in range(len(w) - 12) if i is not None else ():
            k = tuple(w[j : j + 13])
            low[k] = min(low.get(k, i), i)
    want = []
    for i, t, _ in rows["documents"]:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12) if i is not None else ():
            if low[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert sum(x[2] for x in want) > 1000
    same(got(spark, tables, "op3_passages", "doc_id", "n_words", "n_removed", "kept_sha256"), want)


def test_op4(spark, tables, rows):
    out = got(spark, tables, "op4_language", "doc_id", "held_out", "lang_pred", "score")
    assert [x[0] for x in out] == [x[0] for x in sorted(((i,) for i, _, _ in rows["documents"]), key=lambda x: repr((x[0], held(x[0]))))]
    assert all(h == held(i) and 0 <= s <= 1 for i, h, _, s in out) and {x for _, _, x, _ in out} <= {"en", "de", "fr", "und"}
    letters = {i: bool(t) and any(c.isalpha() for c in t) for i, t, _ in rows["documents"]}
    assert all((x == "und") == (not letters[i]) for i, _, x, _ in out) and not letters[4]


def naive_language(rows):
    """Language, score and margin of texts by zstandard alone, with dictionaries of texts drawn by the documented hash."""
    import regex
    import xxhash
    import zstandard

    whole = lambda raw: xxhash.xxh64_intdigest(raw, 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    usable = {}
    for i, t, lang in rows:
        if i is not None and not held(i) and lang is not None and t and regex.search(r"\p{L}", t):
            usable.setdefault(lang, {})[signed(whole(t.encode()))] = t
    dicts = {}
    for lang in sorted(usable, key=lambda x: (-len(usable[x]), x)):
        short = {h: t for h, t in usable[lang].items() if len(t.encode()) <= language.TEXT_BYTES}
        if short:
            share = int(min(1.0, language.DRAWN * language.DICTIONARY_BYTES / sum(len(t.encode()) for t in short.values())) * (1 << 40))
            drawn = sorted(h for h in short if signed(whole(struct.pack("<q", h))) % (1 << 40) < share)
        else:
            short = usable[lang]
            drawn = [min(short, key=lambda h: (len(short[h].encode()), h))]
        content = b""
        for h in drawn:
            raw = (short[h].lower().encode() + b"\n")[: language.DICTIONARY_BYTES]
            if not content or len(content) + len(raw) <= language.DICTIONARY_BYTES:
                content += raw
        if content:
            dicts[lang] = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def judge(t):
        if not dicts or t is None or not regex.search(r"\p{L}", t):
            return "und", 0.0
        raw = t.lower().encode()
        parts = [raw[i : i + language.BLOCK] for i in range(0, len(raw), language.BLOCK)]
        if len(parts) > 1 and len(parts[-1]) < language.BLOCK / 4:
            parts = [*parts[:-2], parts[-2] + parts[-1]]
        sizes = {lang: sum(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(p)) for p in parts) for lang, d in dicts.items()}
        order = sorted(sizes, key=lambda x: sizes[x])
        second = sizes[order[1]] if len(order) > 1 else sum(len(zstandard.ZstdCompressor(level=language.LEVEL, write_content_size=False).compress(p)) for p in parts)
        return order[0], 1 - 0.5 * math.exp(-max(0.0, (second - sizes[order[0]]) / second) / language.SOFT)

    return judge


def test_op4_brute_force(spark, tables, rows):
    judge = naive_language(rows["documents"])
    out = got(spark, tables, "op4_language", "doc_id", "lang_pred", "score")
    want = sorted(((i, *judge(t)) for i, t, _ in rows["documents"]), key=repr)
    assert [x[:2] for x in out] == [x[:2] for x in want] and len({x[1] for x in out}) > 2
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(out, want))


def naive_score(m, text):
    """The classifier's score of one text, word by word and window by window."""
    import numpy as np

    from chatlake.llm import text as tx

    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    found = [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower) if w]
    row = []
    for w in found:
        h = int(tx.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        shift = 64 - toxicity.BUCKET_BITS
        row.append(m.embedding[1 + (h >> shift)] + m.embedding[1 + ((h << 32 & (1 << 64) - 1) >> shift)])
    pad = np.zeros(toxicity.DIM, np.float32)
    total, k = m.bias, 0
    for width, filters in zip(toxicity.WIDTHS, m.filters):
        windows = [np.concatenate([row[i + o] if i + o < len(row) else pad for o in range(width)]) for i in range(max(1, len(row)))]
        for f in range(toxicity.FILTERS):
            total += max(0.0, max(float(x @ filters[:, f]) for x in windows) + float(m.shifts[k])) * float(m.weights[k])
            k += 1
    guess = int(np.argmax([sum(float(logs[b]) for b in lower) for logs in m.byte_logs]))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, total - float(m.thresholds[guess])))))


def test_op6_brute_force(spark, tables, rows):
    docs, labels = (spark.read.parquet(f"{tables[0]}/{x}.parquet").where(~language.held_out()) for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    out = got(spark, tables, "op6_toxicity", "doc_id", "score", "predicted")
    want = sorted(((i, naive_score(model, t)) for i, t, _ in rows["documents"] if not t or len(t) < 10**5), key=repr)
    near = {}
    for i, s, p in out:
        near.setdefault(i, []).append((s, p))
    for i, s in want:
        assert any(abs(s - x) < 1e-4 and (abs(s - 0.5) < 1e-4 or p == (s >= 0.5)) for x, p in near[i])


def test_op6_sample_is_bounded(spark, monkeypatch):
    """Repeats of one labelled id count once, and texts are taken up to a number of bytes."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, langs: seen.append((texts.to_pylist(), y.tolist())) or "model")
    docs = spark.range(60_000).selectExpr("CASE WHEN id < 100 THEN id ELSE 7L END AS doc_id", "CASE WHEN id < 100 THEN repeat('a ', 50) ELSE concat('b', repeat(' c', 99)) END AS text", "'en' AS lang")
    labels = spark.range(100).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    assert toxicity.fit(docs, labels) == "model" and len(seen[0][0]) == 100 and sum(seen[0][1]) == 50
    assert set(seen[0][0]) == {"a " * 50}  # the shortest text of the repeated id
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 3)
    assert toxicity.fit(docs, labels) == "model" and [seen[1][1].count(y) for y in (0, 1)] == [3, 10]


def test_op5(spark, tables, rows):
    rules = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}
    want = []
    for i, u, _ in rows["pages"]:
        m = re.match("[^/?#]*", u.split("://", 1)[1]) if u and "://" in u else None
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0]) if m else ""
        path = re.match("[^?#]*", u.split("://", 1)[1][m.end() :])[0] if m else ""
        hit = max(((len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        want.append((i, host, path, hit[1], hit[2]))
    same(got(spark, tables, "op5_urls", "page_id", "host", "path", "rule", "verdict"), want)


def test_op6(spark, tables, rows):
    out = got(spark, tables, "op6_toxicity", "doc_id", "held_out", "score", "predicted")
    assert len(out) == len(rows["documents"]) and all(h == held(i) and 0 <= s <= 1 and p == (s >= 0.5) for i, h, s, p in out)
    assert len({x[2] for x in out if x[0] == 7}) == 1


def test_op7(spark, tables, rows):
    t = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, x, _ in rows["documents"]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(got(spark, tables, "op7_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_op8(spark, tables, rows):
    want = [(q, n + 1, j, s) for q, lists in exact_top(rows["embeddings"], 20).items() for best in lists for n, (j, s) in enumerate(best)]
    same(got(spark, tables, "op8_topk", "query_id", "rank", "vec_id", "score"), want)


def test_op9(spark, tables, rows):
    sets, root = [], {}
    for i, t, _ in rows["documents"]:
        w = words(t, True)
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())))
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = [(i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets]
    out = queries.QUERIES["op9_minhash"](spark, tables[0])
    assert dict(out.dtypes)["n_shingles"] == "bigint" and any(not x[3] for x in want)
    same(got(spark, tables, "op9_minhash", "doc_id", "n_shingles", "component_id", "kept"), want)


def test_op10(spark, tables, rows):
    t = Tokenizer.from_file(bpe.default_path())
    ids = {}
    for i, x, _ in rows["documents"]:
        ids[i] = t.encode(x or "", add_special_tokens=False).ids + [0]
    out = got(spark, tables, "op10_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    by_doc, by_seq = {}, {}
    for i, start, n, crc, total, seq, off in out:
        assert 0 < n <= 1024 and total == len(ids[i]) and crc == zlib.crc32(struct.pack(f"<{n}I", *ids[i][start : start + n]))
        by_doc.setdefault(i, []).append((start, n))
        by_seq.setdefault(seq, []).append((off, n))
    times = {i: sum(x[0] == i for x in rows["documents"]) for i in ids}
    for i, spans in by_doc.items():
        assert sorted(spans) == sorted(sorted(set(spans)) * times[i])
        end = 0
        for start, n in sorted(set(spans)):
            assert start == end
            end += n
        assert end == len(ids[i]) and len(set(spans)) <= len(ids[i]) // 1024 + 2
    assert set(by_doc) == set(ids)
    used = []
    for spans in by_seq.values():
        end = 0
        for off, n in sorted(spans):
            assert off == end
            end += n
        assert end <= 1024
        used.append(end)
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in used) <= 0.05 * sum(used)
