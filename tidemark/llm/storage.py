"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of whole texts; at Spark's 10,000 rows one of texts takes some ten times this, in the JVM and in Python.
TEXT_BATCH_BYTES = 2 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a new temporary one if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that start in here send Python batches of about ``TEXT_BATCH_BYTES`` at most; the session's own limit holds again after."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(TEXT_BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def settle(df: DataFrame, what: str, note: list[str] | None = None, texts: bool = False) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: lost executors cannot undo it.

    ``note`` gets the path, for :func:`discard` once the last reader is done. ``texts``: Python functions in ``df`` read whole texts
    and get them in small batches.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    with text_batches(spark) if texts else contextlib.nullcontext():
        df.write.parquet(path)
    if note is not None:
        note.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes settled tables that nothing reads any more, and forgets their paths."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors as a zip, once for a Spark application; they need no copy of their own."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, Path(package.name) / path.relative_to(package))
    context.addPyFile(str(target))
    context._tidemark_shipped = True


def shuffle_partitions(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for ``rows`` rows: as many as the session asks for, more if they would pass ``rows_each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))
