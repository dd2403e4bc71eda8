"""A corpus pipeline: toxicity, language, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. Null and empty texts have no language and go with the second stage. Rows without an id
pass the third and fourth stage unchanged; of rows that repeat an id one stays in the
third: that with the shortest text, and of these the first by a hash of the text and then by the row. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import bpe, language, minhash, packing, passages, toxicity
from chatlake.llm.session import forget, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_all(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.learn(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs, 80).where("NOT kept").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    first = F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("__size"), F.xxhash64("text").alias("__hash"), *(c for c in docs.columns if c != "doc_id")))
    kept = kept.groupBy("doc_id").agg(first.alias("__row")).select(*(F.col(c if c == "doc_id" else f"__row.{c}") for c in docs.columns))
    return kept.unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = passages.remove_repeats(docs, carry=others).withColumnRenamed("kept_text", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near_duplicates", one_of_each_group),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: The first two stages are fitted models; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)
    return docs
