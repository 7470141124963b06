"""Tables in the folder that all executors share, and small files that are swapped whole."""

from __future__ import annotations

import contextlib
import gc
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How the files of an index are written.
CODEC = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
#: Where tables go in a local session that names no shared folder, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session that names none, a new folder for the application."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        where = _LOCAL.get(application) or _LOCAL.setdefault(application, tempfile.mkdtemp(prefix="lodestar-"))
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: worked out once, its lineage cut."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let go of plans that are done, so that Spark deletes their shuffle files, which else stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = _path(spark, path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that nothing reads; if it stays, it only costs disk."""
    where = _path(spark, path)
    with contextlib.suppress(Exception):
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Swap the file at `path` whole: readers see the old contents or the new ones."""
    where, draft = _path(spark, path), _path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(draft, True)
    try:
        out.write(bytearray(json.dumps(value, indent=1).encode()))
    finally:
        out.close()
    files = spark._jvm.org.apache.hadoop.fs
    overwrite = getattr(files, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(overwrite, 1)
    options[0] = overwrite.OVERWRITE
    files.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, where, options)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores if it stands in fewer partitions, as a small table in one row group does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
