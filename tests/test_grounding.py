"""Answers are grounded in the context of their own query."""

from chatlake import catalog


def test_grounding_takes_the_context_of_the_query(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    # the query finds 40 and 41, which hold Redis; no document whose id is 2 modulo 40 holds it
    put("documents", [(i, "Redis helps" if i == 41 else "Kafka helps" if i == 122 else "note" if i != 40 else "about Redis, Kafka now", "en", "s", 5) for i in range(128)], "doc_id long, text string, lang string, source string, n_chars long")
    put("benchmark", [(2, "about Redis, Kafka now")], "item_id long, text string")
    put("embeddings", [(2, [1.0, 0.0], 0), (41, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    row = catalog.QUERIES["va_grounding"](spark, str(tmp_path)).first()
    # of the answer's text with its citation numbered: Redis and Kafka are known, Decided and the number are not
    assert row.grounding == 0.5 and row.ungrounded == "1,Decided"
