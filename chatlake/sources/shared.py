"""Tables in the folder that all executors share, and what Python workers of a session need."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a Python worker gets at a time, as the arrays of a batch are many times its size.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What each application has in the shared folder.
_made: dict[str, set[str]] = {}
_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers that this session starts later import this package, and bound their batches by bytes where
    the session has no bound of its own: Spark takes that setting of the whole session only."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_BYTES)
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session on one machine, as in tests, gets one
    of its own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-chatlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; clear() deletes what lies there."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    _made.get(spark.sparkContext.applicationId, set()).discard(path)


def forget(df: DataFrame | None) -> None:
    """Delete the table of a frame that written() gave; only for one that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        _delete(df.sparkSession, path)
        df._written_to = None


def clear(spark: SparkSession) -> int:
    """Delete all that this application has written to the shared folder and not deleted yet, and say how much that was. Results are read
    from there, so this is for when they have been stored."""
    paths = sorted(_made.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _delete(spark, path)
    return len(paths)
