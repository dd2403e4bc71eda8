"""Hand-made edge rows."""

import json

from pyspark.sql import functions as F

from chatlake.functions import text as ft
from chatlake.operators import answers, context, folds, search
from chatlake.streaming import ingest


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_code_blocks(spark):
    t = F.col("t")
    assert one(spark, "```\na\n``` and ```py\nb\n```", ft.code_languages(t))[0] == ["unknown", "py"]
    assert one(spark, "```py\nopen fence", ft.code_languages(t))[0] == []
    assert one(spark, "`inline`", ft.code_bodies(t))[0] == []


def test_importance_caps(spark):
    df = spark.createDataFrame([("x" * 501, 20, 11, True), ("x" * 500, 0, 0, False)], "t string, r long, p long, f boolean")
    assert [r[0] for r in df.select(ft.importance(F.col("t"), F.col("r"), F.col("p"), F.col("f"))).collect()] == [12.0, 1.0]


def test_queries(spark):
    t = F.col("t")
    row = one(spark, 'Who said "ship it" in #eng-core yesterday?', ft.intents(t), ft.question_type(t), ft.channels(t))
    assert row[0] == ["who"] and row[1] == "who" and "eng-core" in row[2]
    assert one(spark, "classic cars?", ft.code_intent(t), ft.question_type(t)) == (True, "question")
    assert one(spark, "ask #Eng-Core  in  the ops channel: x, channel:\tqa", ft.channels(t))[0] == ["eng-core", "ops", "x", "qa"]
    assert one(spark, "said by  Alice", ft.users(t))[0] == ["alice"]
    assert one(spark, "Deploy guide", ft.expansions(t))[0] == ["Deploy guide"]
    assert one(spark, "What is?", ft.expansions(t))[0] == ["What is?", "?"]
    assert one(spark, "who is", ft.expansions(t))[0] == ["who is"]
    assert one(spark, "The DB", ft.expansions(t))[0] == ["The DB", "the database"]
    assert one(spark, "recap 2024-13-45", ft.temporal(t, F.lit("2024-02-01 12:34:56").cast("timestamp")))[0] is None


def test_fusion_of_one_two_three_lists(spark):
    rows = lambda *x: spark.createDataFrame([(1, m, i + 1) for i, m in enumerate(x)], "query_id long, message_id string, rank int")
    out = search.fuse(a=rows("x", "y"), b=rows("y"), c=rows("y", "z")).orderBy("rank").collect()
    assert [(r.message_id, r.n_sources) for r in out] == [("y", 3), ("x", 1), ("z", 1)]


def test_budget_cut(spark):
    df = spark.createDataFrame([(1, "a", 3.0, 49, 0), (1, "b", 2.0, 2, 0), (1, "c", 1.0, 5, 0), (2, "a", 1.0, 50, 0), (2, "b", 0.5, 1, 0)], "query_id long, thread string, score double, n_messages long, left_out long")
    assert {(r.query_id, r.thread): r.taken for r in context.budget(df).collect()} == {(1, "a"): 49, (1, "b"): 1, (2, "a"): 50}


def test_reactions_floor(spark):
    m = spark.createDataFrame([("k", "m1")], "k string, message_id string")
    e = spark.createDataFrame([("k", "r", -1, 1, 1), ("k", "r", 1, 2, 2), ("k", "r", -1, 3, 3), ("k", "r", 1, 4, 4), ("u", "r", 1, 5, 5)], "k string, name string, delta int, event_time int, event_id int")
    row = folds.reactions(m, e, ["k"]).first()
    assert row.reaction_count == 1 and row.importance_gain == 1.0


def test_citations_and_flags(spark):
    a = spark.createDataFrame([(1, "q", "A [#c, @u, t] b [#c, u, t] c [d, v, w]"), (2, "q", "none")], "answer_id long, query_text string, answer_text string")
    assert answers.citations(a).count() == 2
    assert {r.answer_id: r.text for r in answers.rewritten(a).collect()} == {1: "A [1] b [1] c [2]", 2: "none"}
    t = F.col("t")
    assert one(spark, "It never stops. " + "x" * 120 + " It never stops [1].", answers.flags(t))[0] == ["definite:4"]
    assert one(spark, "It never stops [1].", answers.flags(t))[0] == []


def test_mentioned_and_quality(spark):
    t = F.col("t")
    assert one(spark, 'New York saw 3.5 Kafka Streams, 7 éCafe "a b" IBM xAb', answers.mentioned(t))[0] == ["New York", "Kafka Streams", "3.5", "7", "a b"]
    rows = [(1, "deploy kafka", "We deploy Kafka to production with the new release train [#c, @u, t]."), (2, "deploy kafka", "I don't have information about it, sorry, nothing at all was said there.")]
    a = spark.createDataFrame(rows, "answer_id long, query_text string, answer_text string")
    context = spark.createDataFrame([(1, "We use Kafka")], "answer_id long, text string")
    got = {r.answer_id: r for r in answers.validated(a, context).collect()}
    # entities of the first: We, Kafka, 1 (of its own citation); two of three are grounded
    assert (got[1].has_answer, got[1].coverage, got[1].grounding, got[1].relevance, got[1].quality, got[1].acceptable) == (True, 1.0, 0.666667, 1.0, 0.867, True)
    assert (got[2].has_answer, got[2].coverage, got[2].relevance, got[2].acceptable) == (False, 0.0, 0.0, False)


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [json.dumps({"team_id": "t", "event_id": str(i), "event_time": f"2024-01-01T00:0{i % 9}:00Z", "event": {"type": kind, "message_id": f"m{i % 4}", "text": "x"}}) for i, kind in enumerate(["message"] * 6 + ["file_shared", "odd"])]
    for i in range(0, len(lines), 3):
        (src / f"{i}.json").write_text("\n".join(lines[i : i + 3]) + "\n")
    (src / "bad.json").write_text("{broken\n")
    q = ingest.write_tables(ingest.read_envelopes(spark, str(src), 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    # six deliveries of four messages
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "out/messages")).collect()) == ["m0", "m1", "m2", "m3"]
    assert spark.read.parquet(str(tmp_path / "out/tasks")).count() == 7
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "out/dead")).collect()) == ["undecodable", "unknown type"]
    q = ingest.new_messages(ingest.read_envelopes(spark, str(src), 1)).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").count() == 4
