"""Contexts, citations and distributions on hand-made rows, against loops that follow the rules step by step."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators import answers as an
from chatlake.operators import context as cx
from chatlake.operators import folds, messages

START = dt.datetime(2024, 1, 1)
KIND = "message_id string, thread_ts string, channel_id string, channel_name string, user_id string, user_name string, ts timestamp, importance_score double, text string"


def rows(rng):
    """Threads of 1 to 40 messages, one without its parent, and messages outside threads."""
    out = []
    for t in range(14):
        for k in range(rng.choice([1, 2, 3, 11, 12, 25, 40])):
            if (t, k) != (3, 0):
                out.append((f"t{t}" if k == 0 else f"t{t}.{k:02}", f"t{t}", f"C{t % 3}", f"chan{t % 3}", f"U{rng.randint(0, 30)}", f"u{k}", START + dt.timedelta(hours=t, minutes=k), float(t % 7), "x"))
    return out + [(f"s{i}", None, "C9", None if i else "solo", f"U{i}", "s", START, 9.0, "y") for i in range(4)]


def by_rule(all_rows, hits):
    """A query's contexts, as the rules say: threads of the results, compressed, scored, taken in turn within the budget."""
    by_id = {r[0]: r for r in all_rows}
    parents = {r[1]: r for r in all_rows if r[0] == r[1]}
    contexts = []
    for key in sorted({by_id[m][1] or m for m, _ in hits}):
        score = {m: s for m, s in hits}
        relevant = [by_id[m] for m, _ in hits if (by_id[m][1] or m) == key]
        if not any(r[1] for r in relevant):
            r = relevant[0]
            contexts.append({"thread": key, "list": [r[0]], "people": [r[4]], "channel": r[3], "importance": 0.0, "total": 1, "replies": 0, "score": score})
            continue
        all_ = sorted((r for r in all_rows if r[1] == key), key=lambda r: (r[6], r[0]))
        ids = [r[0] for r in all_]
        found = {r[0] for r in relevant}
        kept = list(ids)
        if len(ids) > 10:
            keep = {0}
            for i in range(1, len(ids)):
                if ids[i] in found:
                    keep |= {i} | ({i - 1} if i > 1 else set()) | ({i + 1} if i < len(ids) - 1 else set())
            kept = [ids[i] for i in sorted(keep)]
            if len(kept) < len(ids):
                kept.append(cx.SUMMARY)
        parent = parents.get(key)
        people = sorted({r[4] for r in all_}) if parent else []
        contexts.append({"thread": key, "list": kept, "people": people, "channel": all_[0][3], "importance": parent[7] if parent else 0.0, "total": len(ids), "replies": len(ids) - 1 if parent else 0, "score": score})
    for c in contexts:
        c["s"] = round(sum(c["score"].get(m, 0.0) for m in c["list"]) + c["importance"] / 10, 6)
    out, total = [], 0
    for c in sorted(contexts, key=lambda c: (-c["s"], c["thread"])):
        n = len([m for m in c["list"] if m != cx.SUMMARY])
        if total + n <= 50:
            out.append(c)
            total += n
        elif total < 50:
            c["list"] = c["list"][: 50 - total]
            out.append(c)
            break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contexts_by_rule(spark, seed):
    rng = random.Random(seed)
    data = rows(rng)
    ids = [r[0] for r in data]
    hits = {q: [(m, round(rng.random(), 3)) for m in rng.sample(ids, n)] for q, n in ((1, 1), (2, 4), (3, 12), (4, 30))}
    hits[5] = [("s0", 0.5), ("s1", 0.25), ("t3.01", 0.1)] if "t3.01" in ids else [("s0", 0.5)]
    df = spark.createDataFrame(data, KIND)
    found = spark.createDataFrame([(q, m, s) for q, x in hits.items() for m, s in x], "query_id int, message_id string, score double")
    kept = cx.compress(cx.threads(found, df))
    contexts = cx.budget(cx.scored(kept, folds.thread_rollup(df)))
    chosen = cx.selected(kept, contexts)
    got = {(r.query_id, r.thread): r for r in contexts.collect()}
    lists = {}
    for r in chosen.orderBy("pos").collect():
        lists.setdefault((r.query_id, r.thread), []).append(r.message_id)
    meta = {r.query_id: r for r in cx.meta(chosen, contexts).collect()}
    links = {(r.query_id, r.kind, r["name"]): r.n_threads for r in cx.connections(contexts).collect()}
    want, cut = {}, 0
    for q, x in hits.items():
        rule = by_rule(data, x)
        for c in rule:
            want[q, c["thread"]] = c["list"]
            r = got[q, c["thread"]]
            assert (r.score, sorted(set(r.participants)), r.channel_name, r.total_messages, r.reply_count, r.importance_score) == (c["s"], c["people"], c["channel"], c["total"], c["replies"], c["importance"])
        people = [u for c in rule for u in set(c["people"])]
        assert (meta[q].n_threads, meta[q].n_messages, meta[q].participants) == (len(rule), sum(len(c["list"]) for c in rule), sorted(set(people)))
        cut = max(cut, meta[q].n_messages)
        assert {n: k for (y, kind, n), k in links.items() if y == q and kind == "user"} == {u: people.count(u) for u in people if people.count(u) > 1}
        channels = [c["channel"] for c in rule if c["channel"]]
        assert {n: k for (y, kind, n), k in links.items() if y == q and kind == "channel"} == {u: channels.count(u) for u in channels if channels.count(u) > 1}
    assert lists == want and cut >= 50


def test_placeholders_do_not_count(spark):
    """Five threads of ten kept messages and a placeholder each fill the budget of fifty; the sixth is left out."""
    data = spark.createDataFrame([(1, f"t{i}", True, None, None, [], 0, 0.0, 30, 10, 11, 20, 1.0 - i / 10) for i in range(6)], "query_id int, thread string, is_thread boolean, channel_id string, channel_name string, participants array<string>, reply_count int, importance_score double, total_messages int, n_messages int, n_rows int, left_out int, score double")
    assert sorted((r.thread, r.taken) for r in cx.budget(data).collect()) == [(f"t{i}", 11) for i in range(5)]
    assert sorted((r.thread, r.taken) for r in cx.budget(data, 25).collect()) == [("t0", 11), ("t1", 11), ("t2", 5)]


def test_citations_in_own_context(spark):
    a = spark.createDataFrame([(1, "q", "x [#c, @u, 2024-01-01] [c, u, T05] [d, v, 2024]"), (2, "q", "x [#c, @u, 2024-01-01]"), (3, "q", "none")], "answer_id int, query_text string, answer_text string")
    at = lambda h: START + dt.timedelta(hours=h)
    known = [(1, 2, 0, "C1", "c", "u", at(1), "1.5"), (1, 1, 4, "C1", "c", "u", at(5), "9.1"), (1, 1, 6, "C1", "c", "u", at(2), "9.2"), (1, 1, 0, "C1", "c", "w", at(1), "9.0"), (1, 1, 1, None, "d", "v", at(1), "8.1"), (2, 1, 0, "C2", "other", "u", at(1), "7.1")]
    context = spark.createDataFrame(known, "answer_id int, place int, pos int, channel_id string, channel_name string, user_name string, ts timestamp, message_id string")
    got = {(r.answer_id, r.number): (r.message_id, r.link, r.label) for r in an.citation_links(an.citations(a), context).collect()}
    base = "https://chat.example/"
    assert got == {
        (1, 1): ("9.1", base + "archives/C1/p91", "[1] ##c - @u - 2024-01-01"), (1, 2): ("9.1", base + "archives/C1/p91", "[2] #c - @u - T05"),
        (1, 3): (None, base + "app_redirect?channel=d", "[3] #d - @v - 2024 (link unavailable)"), (2, 1): (None, base + "app_redirect?channel=c", "[1] ##c - @u - 2024-01-01 (link unavailable)"),
    }
    assert sorted(map(tuple, an.citation_validity(a, an.citations(a), context).collect())) == [(1, 3, 3, 1.0), (2, 1, 0, 0.0), (3, 0, 0, 1.0)]


def test_time_of_day_in_any_case(spark):
    flags = [spark.range(1).select(an.flags(F.lit(t)).alias("f")).first().f for t in ("at 10:30Am", "at 9:05pM [1]", "at 10:30 am")]
    assert flags == [["time"], [], []]


def test_distributions(spark):
    checked = spark.createDataFrame([(0.0, 0, ["time", "definite:1", "definite:4"]), (0.55, 3, []), (1.0, 99, ["vague"])], "quality double, n_citations int, flags array<string>")
    turns = spark.createDataFrame([(1,), (4,), (50,)], "n_turns int")
    got = {(r.metric, r.kind, r.le): r.n for r in an.distributions(checked, turns).collect()}
    inf = float("inf")
    assert [got["quality", None, x] for x in (0.0, 0.5, 0.6, 0.9, 1.0, inf)] == [1, 1, 2, 2, 3, 3]
    assert [got["citations", None, x] for x in (0.0, 2.0, 3.0, 20.0, inf)] == [1, 1, 2, 2, 3] and [got["turns", None, x] for x in (1.0, 3.0, 5.0, 20.0, inf)] == [1, 1, 2, 2, 3]
    assert {k[1]: n for k, n in got.items() if k[0] == "flags"} == {"time": 1, "definite": 2, "vague": 1} and len(got) == 12 + 10 + 9 + 3


def test_embed_texts(spark):
    data = [("p", "C1", "", "p", "t" * 300, "clean", None), ("r", "C1", "chan", "p", "```\nx", "", None), ("c", "C1", "chan", "gone", "raw", None, ["go", "sql"]), ("e", "C1", None, "x", "raw", "ok", []), ("x", "C2", "y", "x", "", "z", None)]
    df = spark.createDataFrame(data, "message_id string, channel_id string, channel_name string, thread_ts string, text string, text_processed string, code_languages array<string>")
    assert {r.message_id: r.embed_text for r in messages.embed_texts(df).collect()} == {
        "p": "Channel: C1\nMessage: clean", "r": "Channel: chan\nThread Topic: " + "t" * 200 + "\nMessage: ```\nx", "c": "Channel: chan\nMessage: raw\nContains code: go, sql", "e": "Channel: C1\nMessage: ok", "x": "Channel: y\nMessage: z",
    }
