"""SRC-15: sets of tables kept under the id of what they were made from.

The id is a hash of the parameters and of the inputs' rows, whatever their order; a set is written beside its place and appears there by one
rename, so readers see all of it or nothing, and what a lost writer left behind is never taken for a result.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share; one for this machine where it is unset and all runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # A running session takes no core setting, so the folder is kept at its context.
        context = spark.sparkContext
        named = context._tidemark_shared = getattr(context, "_tidemark_shared", None) or "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
    return named.rstrip("/")


def settled(rows: DataFrame, what: str) -> DataFrame:
    """``rows`` written once as Parquet to the shared folder and read again, for what several fits or joins read."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def rows_id(rows: DataFrame) -> str:
    """An id of a table's columns and rows: equal for equal rows in any order, counted with repeats. One aggregation to one row."""
    names = sorted(rows.columns)
    # Rows as text, so that nulls, empty values and their places differ; two sums of independent hashes of 64 bits.
    text = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]), {"ignoreNullFields": "false"})
    hashed = rows.select(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
    wide = [F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0)).cast("string") for c in ("a", "b")]
    found = hashed.agg(F.count("*").cast("string"), *wide).first()
    kinds = dict(rows.dtypes)
    return hashlib.sha256(json.dumps([[[c, kinds[c]] for c in names], list(found)]).encode()).hexdigest()


def content_id(inputs: dict[str, DataFrame], parameters: dict) -> str:
    """An id of inputs and parameters; parameters are what JSON can hold."""
    parts = {name: rows_id(rows) for name, rows in inputs.items()}
    return hashlib.sha256(json.dumps([parts, parameters], sort_keys=True, allow_nan=False).encode()).hexdigest()[:32]


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, root: str, key: str) -> bool:
    """Whether the set of this id stands complete below ``root``."""
    at, fs = _files(spark, f"{root}/{key}")
    return fs.exists(at)


def load_or_build_set(spark: SparkSession, root: str, inputs: dict[str, DataFrame], parameters: dict, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables made from these inputs and parameters: read where they stand, else built, written beside and published by one rename.

    Writers that meet build the same tables; the first to rename wins and the others drop theirs.
    """
    key = content_id(inputs, parameters)
    place = f"{root}/{key}"
    if not published(spark, root, key):
        draft = f"{root}/.draft-{key}-{uuid.uuid4().hex}"
        tables = build()
        for name, rows in tables.items():
            rows.write.parquet(f"{draft}/{name}")
        listed = [(name, rows.schema.json()) for name, rows in sorted(tables.items())]
        spark.createDataFrame(listed, "name string, columns string").coalesce(1).write.json(f"{draft}/tables")
        source, fs = _files(spark, draft)
        target, _ = _files(spark, place)
        # A rename onto a folder that is there would move the draft into it.
        if published(spark, root, key) or not fs.rename(source, target):
            fs.delete(source, True)
            if not published(spark, root, key):
                raise OSError(f"cannot publish {place}")
    names = [r["name"] for r in spark.read.schema("name string, columns string").json(f"{place}/tables").collect()]
    return {name: spark.read.parquet(f"{place}/{name}") for name in names}


def drop_drafts(spark: SparkSession, root: str) -> int:
    """Deletes what writers that never published left below ``root``; only while none is at work. How many there were."""
    at, fs = _files(spark, root)
    drafts = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(".draft-")] if fs.exists(at) else []
    for path in drafts:
        fs.delete(path, True)
    return len(drafts)
