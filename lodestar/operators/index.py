"""The index as tables: upsert and delete by document, checks of ids; on disk it is a `Store`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.search import B, K1


def upsert(old: DataFrame, new: DataFrame, evict_ids: bool = False) -> DataFrame:
    """`old` (chunk_id, doc_id, ord, ...) with all chunks of the documents of `new` replaced; `ord` goes on from the last, in the batch's own order if it has one.

    With `evict_ids` a chunk of another document with an equal chunk_id goes too, as a lexical
    index must. The batch's documents are an anti-join: nothing of `old` is collected.
    """
    kept = old.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
    if evict_ids:
        kept = kept.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti")
    last = old.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    if "ord" in new.columns:  # places go on in the batch's own order
        first = new.agg(F.min("ord").alias("first"))
        place = F.col("ord") - F.col("first")
        new = new.crossJoin(F.broadcast(first))
    else:
        place = F.monotonically_increasing_id()
    added = new.crossJoin(F.broadcast(last)).withColumn("ord", F.col("last") + 1 + place).drop("last", "first")
    return kept.select(old.columns).unionByName(added.select(old.columns))


def delete(old: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return old.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(old.columns)


def repeated_ids(batch: DataFrame) -> DataFrame:
    """chunk_ids that a batch holds more than once; it must not be written."""
    return batch.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")


def different_ids(a: DataFrame, b: DataFrame, column: str = "chunk_id") -> DataFrame:
    """Ids that only one of two tables holds."""
    left, right = a.select(column).distinct(), b.select(column).distinct()
    return left.join(right, column, "left_anti").withColumn("side", F.lit("first")).unionByName(right.join(left, column, "left_anti").withColumn("side", F.lit("second")))


class IndexFault(ValueError):
    """An index that must not be written or loaded."""


def save(path: str, chunks: DataFrame, docs: DataFrame, embedder: str, dimension: int, k1: float = K1, b: float = B) -> dict:
    """Chunks (with embedding) and documents as the whole of the index at `path`, its lexical index too: the next version of one that stands there."""
    from lodestar.operators.store import Store

    return Store.create(chunks.sparkSession, path, chunks, docs, embedder, dimension, k1, b).manifest


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(chunks, documents, manifest) of a saved index whose counts, ids, dimension and offsets hold."""
    from lodestar.operators.store import Store

    store = Store.open(spark, path)
    store.check()
    return store.chunks(), store.documents(), store.manifest


def cached_replies(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """`requests` (key, ...) with `content` from the cache (key, content); null where it must still be asked for."""
    return requests.join(cache.select("key", "content").distinct(), "key", "left")


def conflicting_replies(cache: DataFrame) -> DataFrame:
    """Keys with more than one content."""
    return cache.groupBy("key").agg(F.countDistinct("content").alias("contents")).where("contents > 1")


def reply_key(model: Column, prompt: Column) -> Column:
    """A key for a reply: a digest of model and prompt."""
    return F.sha2(F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"))), 256)
