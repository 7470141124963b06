"""What several operators of this subpackage share: tables, cut lineage, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only after its rows were counted and found to hold at most so many bytes.
BROADCAST_BYTES = 64 << 20
#: Where tables go in a local session that names no shared folder, by application.
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; in a local session that names none (tests), a new one for the application."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        where = _LOCAL.get(application) or _LOCAL.setdefault(application, tempfile.mkdtemp(prefix="lodestar-"))
    return where.rstrip("/")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` as a table in the shared folder, with options of the writer, and read it back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete a table of `stored` that nothing will read again."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):  # a left-over table only costs disk
            where.getFileSystem(conf).delete(where, True)


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in a broadcast table: 8 for a number, 48 for a string or a nested field, 24 around them."""
    return 24 + sum(8 if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else 48 for f in df.schema.fields)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its rows, counted, hold at most `limit` bytes, else as it is (then Spark shuffles both sides). Not for tables of long strings."""
    rows = limit // row_bytes(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores before it as it takes to differ from all columns of `df`, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Components of an undirected graph.

    `edges` has long columns `a` and `b`. Returns `node`, `component` (the smallest node id
    reachable) for every node of an edge. Each round every node hooks onto its smallest
    neighbour, the hooks are followed twice, and the edges are rewritten onto what is left, so
    the graph shrinks by at least half a round. A component's smallest node never moves, so it names
    the component in the end. A hub's edges meet only in a pre-aggregated
    `min` and in joins that Spark may split; nothing is gathered in one task or the driver.
    """
    work = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges")
    hops: list[DataFrame] = []
    while not work.isEmpty():
        both = work.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(work.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hook = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("up"))
        hook = stored(hook, f"{label}-hook")
        top = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook2 = stored(hook.join(top, "up").select("node", F.col("top").alias("up")), f"{label}-hook2")
        discard(hook)
        at_a = hook2.select(F.col("node").alias("a"), F.col("up").alias("a2"))
        at_b = hook2.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        left = work.join(at_a, "a").join(at_b, "b").where("a2 <> b2")
        rest = stored(left.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{label}-edges")
        discard(work)
        work = rest
        hops.append(hook2)
    if not hops:
        return work.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = hops[0]
    for hop in hops[1:]:
        step = hop.select(F.col("node").alias("up"), F.col("up").alias("next"))
        found = found.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
    return stored(found.select("node", F.col("up").alias("component")), f"{label}-components")


def batches(it: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches cut down, so that a batch of very long texts stays small in Python."""
    for pdf in it:
        for start in range(0, len(pdf), rows):
            yield pdf.iloc[start : start + rows]
