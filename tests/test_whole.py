"""Small hand-made tables on which a query that does less than the whole job shows it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chatlake import catalog
from chatlake.functions import text as ft
from chatlake.operators import answers, context, folds, messages, search
from chatlake.sources import files


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """A folder with the given rows as tables."""

    def make(**tables):
        d = str(tmp_path_factory.mktemp("tables"))
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
        return d

    return make


CONVERSATIONS = "conv_id long, turn long, role string, text string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_graph_has_all_turns_kinds_and_documents(spark, tiny):
    d = tiny(conversations=([(1, 0, "user", 'about Redis, ABC-12 and "big plan"'), (1, 1, "user", "see https://a.example/x Redis")], CONVERSATIONS), documents=([(7, "redis Spark DEF-3", "en", "s", 17)], DOCUMENTS))
    seen = {r.entity: r.occurrence_count for r in catalog.QUERIES["kg_entities"](spark, d).collect()}
    assert seen == {"redis": 2, "abc": 1, "abc-12": 1, "big plan": 1, "https://a.example/x": 1, "spark": 1, "def": 1, "def-3": 1}
    edges = {(r.entity_1, r.entity_2): (r.co_occurrence_count, r.confidence) for r in catalog.QUERIES["kg_edges"](spark, d).collect()}
    assert len(edges) == 6 + 1 + 3 and edges["abc-12", "redis"] == (1, 1.0)


def test_edges_meet_no_table_of_names_again(spark, tiny):
    """What a block has added up is the result: it isn't joined, sorted or added up once more."""
    d = tiny(conversations=([(1, t, "user", "Aa Bb Cc Dd") for t in range(9)], CONVERSATIONS), documents=([], DOCUMENTS))
    plan = catalog.QUERIES["kg_edges"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1


def test_rows_of_one_message_are_one(spark, tiny):
    """As in the SQL: a repeated row counts once, and texts of one message pair with one another."""
    rows = [(1, 1, "user", "Aa Bb"), (1, 1, "user", "Bb Cc Aa"), (1, 2, "user", "Cc Dd"), (2, 1, "user", "Dd Aa")]
    edges = lambda d: {(r.entity_1, r.entity_2): (r.co_occurrence_count, r.channels, r.confidence) for r in catalog.QUERIES["kg_edges"](spark, d).collect()}
    d = tiny(conversations=(rows, CONVERSATIONS), documents=([], DOCUMENTS))
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("conversations", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet/*.parquet')")
    got = edges(d)
    assert got == {(r[0], r[1]): (r[2], r[3], r[6]) for r in con.execute(catalog.ORACLES["kg_edges"]).fetchall()}
    assert got["aa", "bb"] == (1, 1, 1.0) and got["aa", "cc"][0] == 1
    # a row without a key is no message
    assert ("ee", "ff") not in edges(tiny(conversations=([*rows, (None, 1, "user", "Ee Ff")], CONVERSATIONS), documents=([], DOCUMENTS)))


def test_related_keeps_all_partners(spark, tiny):
    words = ["Aa", "Bb", "Cc", "Dd", "Ee", "Ff", "Gg"]
    d = tiny(conversations=([(1, 1, "user", " ".join(words))], CONVERSATIONS), documents=([], DOCUMENTS))
    got = [(r.entity, r.other) for r in catalog.QUERIES["kg_related"](spark, d).collect()]
    assert len(got) == 42 and set(got) == {(a.lower(), b.lower()) for a in words for b in words if a != b}


def test_history_trim_limits(spark, tiny):
    rows = [(1, t, "user", "x") for t in range(20)] + [(2, t, "system" if t == 0 else "user", "x") for t in range(23)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    got = sorted((r.conv_id, r.turn) for r in catalog.QUERIES["history_trim"](spark, tiny(conversations=(rows, CONVERSATIONS))).collect())
    assert got == [(1, t) for t in range(20)] + [(2, 0)] + [(2, t) for t in range(3, 23)]
    assert sorted(r.turn for r in answers.trimmed(df.where("conv_id = 2"), 5, 4).collect()) == [0, 19, 20, 21, 22]
    assert answers.trimmed(df.where("conv_id = 2 AND turn < 5"), 5, 4).count() == 5


def test_backfill_limits(spark, tiny):
    d = tiny(conversations=([(8 + i // 1002, i % 1002, "user", "x") for i in range(1003)], CONVERSATIONS))
    assert {r.channel_id: (r.n_added, r.total_messages) for r in catalog.QUERIES["backfill_counts"](spark, d).collect()} == {"C000": (1000, 1100), "C001": (1, 101)}
    m = spark.createDataFrame([("a", str(t), t) for t in range(4)] + [("b", "0", 0)], "channel_id string, message_id string, ts long")
    assert sorted((r.channel_id, r.ts, r.n) for r in folds.latest_per_channel(m, 2).collect()) == [("a", 2, 2), ("a", 3, 1), ("b", 0, 1)]
    late = tiny(conversations=([(16, 1000 + i, "user", "x") for i in range(30)], CONVERSATIONS))
    assert catalog.QUERIES["backfill_latest_n"](spark, late).count() == 30


PROMPT = """## Context Overview
- Found 2 relevant discussions
- Total messages: 13
- Channels: c1, c2
- Participants: u00, u01, u02, u03, u04, u05, u06, u07, u08, u09
  (and 2 more)
- Time period: 2024-01-01T00:00:00 to 2024-01-01T00:11:00

## Relevant Discussions

### Discussion 1
**Channel**: #c1
**Messages** (3):

**u00** (2024-01-01 00:00):
text 0

**u01** (2024-01-01 00:01):
text 1

_Reactions: :eyes: 1, :ok: 3_

_[9 additional messages in thread]_


### Discussion 2
**Channel**: #c2
**Messages** (10):

""" + "\n".join(f"**u{i:02}** (2024-01-01 00:{i:02}):\ntext {i}\n" for i in range(2, 12)) + """

## User Question
Where is ABC-12 yesterday?

## Instructions
- The user is looking for code. Include complete code snippets with syntax highlighting.
- Pay special attention to the time period: yesterday
- Focus on information related to: Where, ABC, ABC-12
- Provide citations with [Channel, @User, timestamp] format for all factual claims.
- If information is not found in the context, explicitly state that.
- Be concise but comprehensive."""


def test_prompt_equals_hand_made(spark):
    ids = [(i, 1704067200 + 60 * i) for i in range(12)]
    m = spark.createDataFrame([(f"m{i}", (f"text {i}", f"u{i:02}", [("eyes", 1), ("ok", 3)] if i == 1 else [] if i else None)) for i, _ in ids], "message_id string, m struct<text:string,user_name:string,reactions:array<struct<name:string,count:int>>>")
    given = [(1, "a" if i < 2 else "b", f"m{i}", s, f"u{i:02}", "c1" if i < 2 else "c2", i, 9 if i < 2 else 0) for i, s in ids] + [(1, "a", context.SUMMARY, None, None, "c1", 11, 9)]
    rows = spark.createDataFrame(given, "query_id long, thread string, message_id string, s long, user_name string, channel_name string, pos long, left_out long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    people = [f"u{i:02}" for i in range(12)]
    contexts = spark.createDataFrame([(1, "b", 1.0, "c2", people[2:], 10), (1, "a", 2.0, "c1", people[:2], 3)], "query_id long, thread string, score double, channel_name string, participants array<string>, taken long")
    queries = spark.createDataFrame([(1, "Where is ABC-12 yesterday?", True), (2, "none", False)], "query_id long, query_text string, has_code_intent boolean")
    got = {r.query_id: r.prompt for r in context.prompt_rows(rows, contexts, queries, m, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert {r.query_id: (r.intent, r.system.split("\n\n")) for r in context.prompt_rows(rows, contexts, queries, m, F.lit("2024-02-01").cast("timestamp")).collect()} == {i: ("factual", [context.SYSTEM["base"], context.SYSTEM["factual"]]) for i in (1, 2)}
    assert got[1] == PROMPT and got[2].startswith("## User Question\nnone\n\n## Instructions\n- Provide")


def test_query_entities_keep_tickets(spark, tiny):
    d = tiny(benchmark=([(1, "Show me the SQL query for ABC-12"), (2, 'is "a b" in xABC-1 or T-9, https://x.example/U-7?')], "item_id long, text string"))
    want = {1: "technical:Show|technical:SQL|technical:ABC|ticket:ABC-12", 2: "quoted:a b|ticket:T-9|ticket:U-7|url:https://x.example/U-7?"}
    assert {r.query_id: r.entities for r in catalog.QUERIES["q_entities"](spark, d).collect()} == want
    c = duckdb.connect()
    c.execute(f"create view benchmark as select * from '{d}/benchmark.parquet/*.parquet'")
    assert dict(c.execute(f"select query_id, entities from ({catalog.ORACLES['q_entities']})").fetchall()) == want


def test_filters_by_user_and_time(spark):
    day = 1717200000  # 2024-06-01, search.AS_OF
    m = spark.createDataFrame([(i, f"m{i}", "c", u, day - back * 86400, False, 1.0, f"x by alice last week {more}") for i, (u, back, more) in enumerate([("alice", 1, ""), ("bob", 1, ""), ("bob", 1, "<@U1>"), ("alice", 15, ""), ("alice", -1, ""), ("alice", 14, "")])], "doc_id long, message_id string, channel_name string, user_name string, s long, has_code boolean, importance_score double, text string").withColumn("ts", F.timestamp_seconds("s"))
    q = spark.createDataFrame([(0, "by alice last week", None, False)], "query_id long, query_text string, channel_filter string, has_code_intent boolean")
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "vec_id long, embedding array<float>")
    assert {r.message_id for r in search.keyword(q, m).collect()} == {"m0", "m5"}
    assert {r.message_id for r in search.keyword(q.withColumn("query_text", F.lit("Last week")), m).collect()} == {"m0", "m1", "m2", "m5"}
    assert {r.message_id for r in search.keyword(q.withColumn("query_text", F.lit("x")), m).collect()} == {f"m{i}" for i in range(6)}
    m2 = m.withColumn("text", F.concat("text", F.lit(" @U1")))
    assert {r.message_id for r in search.keyword(q.withColumn("query_text", F.lit("@U1")), m2).collect()} == {"m2"}
    assert {r.message_id for r in search.semantic(q, m, v, filtered=True).collect()} == {"m0", "m1", "m2", "m5"}
    assert search.semantic(q, m, v).count() == 6
    # a channel named in the text: unknown ones hold in the keyword list and are dropped in the vector list
    m3 = m.withColumn("text", F.lit("see #c and #d")).withColumn("channel_name", F.when(F.col("doc_id") < 2, "c").otherwise("e"))
    for text, words, near in (("#c", {"m0", "m1"}, {"m0", "m1"}), ("#d", set(), {f"m{i}" for i in range(6)})):
        named = q.withColumn("query_text", F.lit(text))
        assert {r.message_id for r in search.keyword(named, m3).collect()} == words
        assert {r.message_id for r in search.semantic(named, m3, v, filtered=True).collect()} == near


def test_hybrid_filters_the_vector_list(spark, tiny):
    docs = [(i, f"word{i}", "en", "s", 5) for i in range(64)]
    d = tiny(documents=(docs, DOCUMENTS), benchmark=([(1, "nothing alike")], "item_id long, text string"), embeddings=([(i, [1.0, float(i)], 0) for i in range(64)], "vec_id long, embedding array<float>, label int"))
    assert {r.message_id for r in catalog.QUERIES["hybrid_rrf"](spark, d).collect()} == {f"D{i:08}" for i in range(16, 32)}  # channel_filter chan-1


def test_long_threads_get_a_placeholder(spark):
    given = [(1, "t", f"m{i:02}", i, "u", "c", i, 12, i in (3, 5), 1.0 if i in (3, 5) else 0.0) for i in range(12)] + [(2, "t", f"m{i:02}", i, "u", "c", i, 10, i == 0, 0.0) for i in range(10)]
    rows = spark.createDataFrame(given, "query_id long, thread string, message_id string, ts long, user_name string, channel_name string, pos long, thread_size long, relevant boolean, score double")
    out = context.compress(rows).orderBy("query_id", "pos").collect()
    assert [r.message_id for r in out if r.query_id == 1] == ["m00", "m02", "m03", "m04", "m05", "m06", context.SUMMARY] and {r.left_out for r in out if r.query_id == 1} == {6}
    assert len([r for r in out if r.query_id == 2]) == 10


def test_message_rows_identity(spark):
    schema = "ts string, event_ts string, user string, username string, bot_id string, channel string, channel_name string, thread_ts string, text string, type string, subtype string, files array<struct<id:string>>, reaction_total long, event_reply_count long"
    blank = [None, None, None, "x", None, None, None, 0, 0]
    raw = [("1.5", None, "U1", "ann", "B1", *blank[1:3], "1.5", "```py\n1\n``` <@U2>", None, None, [("F1",), (None,), ("",)], 2, 1), (None, "2.5", None, None, "B1", None, None, None, None, None, "bot", None, 0, 0), ("3.5", "9", "", "hook", "B2", None, None, "1.5", "x", "message", None, None, 0, 0), ("4.5", None, None, "ghost", None, None, None, None, "x", None, None, None, 0, 0)]
    got = {r.message_id: r for r in messages.message_rows(spark.createDataFrame(raw, schema), F.lit("T")).collect()}
    assert set(got) == {"1.5", "2.5", "3.5"}
    assert [(got[i].user_id, got[i].user_name, got[i].is_thread_parent, got[i].message_type) for i in sorted(got)] == [("U1", "ann", True, "message"), ("BOT:B1", "bot", False, "message"), ("BOT:B2", "hook", False, "message")]
    assert got["1.5"].file_ids == ["F1"] and got["1.5"].code_languages == ["py"] and got["1.5"].mentioned_users == ["U2"] and got["1.5"].importance_score == 1 + 1 + 0.3 + 2 + 1.5
    assert got["2.5"].text == "" and got["2.5"].links is None and got["2.5"].file_ids is None and not got["2.5"].has_files


def test_embedder_gets_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"w{i}") for i in range(7)], "id long, text string").coalesce(1)
    out = {r.id: r.embedding for r in messages.embed(df, "text", lambda texts: [[float(len(texts))] for _ in texts], batch=4).collect()}
    assert out == {0: [3.0], 1: [3.0], 2: [3.0], 3: None, 4: [3.0], 5: [3.0], 6: [3.0]}


def test_query_log_appends(spark, tmp_path):
    q = spark.createDataFrame([(1, "who said it yesterday in the ops channel"), (2, "x")], "query_id long, query_text string")
    r = spark.createDataFrame([(1, "m"), (1, "n")], "query_id long, message_id string")
    for _ in range(2):
        messages.append_log(messages.query_log(q, r, F.lit("2024-02-01 12:34:56").cast("timestamp")), str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log")).orderBy("query_id").collect()
    assert [(x.query_id, x.intent_type, x.results_count, x.channel_filters) for x in rows] == [(1, "who", 2, ["ops"])] * 2 + [(2, "factual", 0, [])] * 2 and str(rows[0].date_range_start) == "2024-01-31 00:00:00"


def test_file_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes("é1".encode() + b"\xff\xfe2")
    (tmp_path / "long.txt").write_text("z" * 10_005)
    (tmp_path / "pic.PNG").write_bytes(b"\x89PNG")
    (tmp_path / "old.md").write_text("old")
    (tmp_path / "o[l]{d}*?.md").write_text("stars")
    done = spark.createDataFrame([("old.md",)], "file_id string")
    found = files.scan(spark, str(tmp_path), done, F.lit("2024-01-01").cast("timestamp"))
    assert len(found.inputFiles()) == 4 and not any(x.endswith("old.md") for x in found.inputFiles())  # what is known is not opened
    got = {r.file_id: r for r in found.collect()}
    assert {k: (r.filetype, r.extracted_text) for k, r in got.items()} == {"x.py": ("python", "é12"), "long.txt": ("text", "z" * 10_000), "pic.PNG": ("png", None), "o[l]{d}*?.md": ("markdown", "stars")}
    every = spark.createDataFrame([(x,) for x in got] + [("old.md",)], "file_id string")
    assert files.scan(spark, str(tmp_path), every, F.lit("2024-01-01").cast("timestamp")).count() == 0
    assert str(got["x.py"].expires_at) == "2024-01-31 00:00:00"


def test_file_scan_lists_in_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"{i}.txt").write_text(str(i))
    before = spark.conf.get(files._LISTING)
    spark.sparkContext.setJobGroup("listing", "")
    found = files.scan(spark, str(tmp_path), spark.createDataFrame([("7.txt",)], "file_id string"), F.lit("2024-01-01").cast("timestamp"))
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= files.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert {r.extracted_text for r in found.collect()} == {str(i) for i in range(60)} - {"7"} and spark.conf.get(files._LISTING) == before
