"""What the operators of this folder share: tables, written intermediate results, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch to Python: texts may be long, and a worker holds a batch whole.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where none is named, a local master gets a
    folder of this process; on a cluster that is an error, as executors would not find each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='collatio-')}")
    return _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of a new name in the shared one, which goes when the program ends."""
    path = f"{shared_dir(spark)}/collatio-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again; the shuffles that made it are deleted.

    This cuts the lineage, survives lost executors, and fixes whatever was decided by the order of
    rows in a task. The files go when the program ends, as the caller's plan still reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/collatio-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    again = spark.read.schema(df.schema).parquet(path)
    again.collatio_path = path
    return again


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` wrote, once no plan will read it any more."""
    for t in tables:
        _remove(t.sparkSession, t.collatio_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session has ended already
        pass


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes of an Arrow batch, so that one of long texts fits a worker's memory.

    The settings are read when the caller runs the plan, so they stay lowered.
    """
    for key, most, usual in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, "64m")):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", usual).lower().rstrip("b")
        now = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:] in "kmg" else int(now)
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null gives empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (x for x in rows if x.num_rows)


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """`df` under column names that clash with none of ours, the names by the old ones, and the way back."""
    columns = df.columns
    names = {c: f"__c{k}" for k, c in enumerate(columns)}
    return df.toDF(*names.values()), names, lambda out: out.select(*names.values()).toDF(*columns)
