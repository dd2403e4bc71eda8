"""Contents of shared files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File types whose content is read.
FILE_TYPES = ["text", "python", "javascript", "java", "go", "rust", "markdown", "json", "xml", "yaml", "csv", "sql"]
# The type of a file by the ending of its name.
ENDINGS = {"txt": "text", "py": "python", "js": "javascript", "java": "java", "go": "go", "rs": "rust", "md": "markdown", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "csv": "csv", "sql": "sql"}
PREVIEW, DAYS_KEPT = 10_000, 30


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, without those that are none."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def _plain(path: str) -> str:
    """A path in which no sign stands for others."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


#: Tasks for each core that list or write many small files.
TASKS_PER_CORE = 4
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists up to 10000 folders or files with a task for each; loading lists at once, so that the setting holds only here."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def scan(spark: SparkSession, folder: str, processed: DataFrame, as_of: Column, name: Column | None = None) -> DataFrame:
    """(file_id, filetype, extracted_text, expires_at) of the files below `folder` that are not among the file_ids of
    `processed`. A file's id is its name, the last part of its path unless `name`, an expression of `path`, says
    otherwise. The text is null for types that are not read, and else its first PREVIEW characters.

    Files are listed without being opened; only the contents of new ones are read, in partitions of Spark's size for files."""
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    with _listed_in_few_tasks(spark):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", name.alias("file_id"))
    # their paths, as the driver has them of all files
    fresh = [_plain(r.path) for r in listed.join(processed.select("file_id"), "file_id", "left_anti").select("path").collect()]
    ending = F.lower(F.element_at(F.split("file_id", r"\."), -1))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair)), ending)
    with _listed_in_few_tasks(spark):
        files = spark.read.format("binaryFile").load(fresh) if fresh else spark.createDataFrame([], "path string, content binary")
    rows = files.select(name.alias("file_id"), "content").withColumn("filetype", F.coalesce(kind, ending))
    text = F.when(F.col("filetype").isin(FILE_TYPES), F.substring(decoded(F.col("content")), 1, PREVIEW))
    return rows.select("file_id", "filetype", text.alias("extracted_text"), (as_of + F.make_dt_interval(F.lit(DAYS_KEPT))).alias("expires_at"))
