"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors of a label are one class first. Each class gets one sign code a table; classes with
one label and code meet in a bucket. Codes have LOAD_BITS bits more than the largest label needs
to tell its classes apart, and there are as many tables as it takes to miss a pair at the
threshold with a chance of MISS. Buckets of two classes or more are compared by matrix product in
double precision, large ones in blocks against blocks. A pair that meets in several tables counts
in the first one only, so links are counted without ever being listed; what leaves a block is each
vector's count and a spanning forest of the block's links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import connected_components, discard, stored, table

COSINE = 0.98
MISS = 0.001
LOAD_BITS = 3
BLOCK = 1024
SEED = 20240229


def tables_for(classes: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits, tables) for so many classes in the largest label."""
    bits = min(30, max(8, math.ceil(math.log2(max(classes, 2))) + LOAD_BITS))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Sign codes (rows x tables)."""
    signs = (vectors @ planes(vectors.shape[1], bits, tables) >= 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype(np.int32)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges (i, j)."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one bucket's two blocks: a row for each vector with links (cid, links) and each forest edge (cid, other)."""
    first, second, t = int(group["first"].iloc[0]), int(group["second"].iloc[0]), int(group["t"].iloc[0])
    block = group["block"].to_numpy()
    cid, weight = group["cid"].to_numpy(), group["w"].to_numpy()
    x, sign = unit(list(group["embedding"])), np.stack(group["codes"].to_list())
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    i, j = np.nonzero(x[left] @ x[right].T >= COSINE)
    i, j = left[i], right[j]
    if first == second:
        i, j = i[i < j], j[i < j]
    if t:
        new = np.ones(len(i), bool)
        for s in range(0, len(i), 1 << 18):  # bounded memory
            new[s : s + (1 << 18)] = ~(sign[i[s : s + (1 << 18)], :t] == sign[j[s : s + (1 << 18)], :t]).any(1)
        i, j = i[new], j[new]
    n = np.bincount(i, weight[j], len(cid)) + np.bincount(j, weight[i], len(cid))
    has = np.flatnonzero(n)
    edges = forest(len(cid), i, j)
    return pd.DataFrame(
        {
            "cid": np.concatenate([cid[has], cid[[a for a, _ in edges]]]).astype(np.int64),
            "links": np.concatenate([n[has], np.zeros(len(edges))]).astype(np.int64),
            "other": pd.array([*[None] * len(has), *(int(cid[b]) for _, b in edges)], dtype="Int64"),
        }
    )


def _groups(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows with one (key, first, second), which stand together, through `_compare`."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in it:
        keys = list(zip(pdf["key"], pdf["first"], pdf["second"], strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if held and keys[s] != last:
                yield _compare(pd.concat(held, ignore_index=True))
                held = []
            last = keys[s]
            held.append(pdf.iloc[s:e])
    if held:
        yield _compare(pd.concat(held, ignore_index=True))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without
    label, link with nothing. Only vectors of one label and one length are compared. Repeated rows
    of a vec_id count once in others' links. Labels may be of any type, components floats or
    doubles. Other columns are ignored.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding", "label").withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("w"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    largest = max([r["count"] for r in classes.groupBy("label").count().orderBy(F.desc("count")).limit(1).collect()], default=0)
    bits, tables = tables_for(largest)

    def hashed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            sizes = pdf["embedding"].map(len).to_numpy()
            for dim in np.unique(sizes):
                part = pdf[sizes == dim]
                yield part.assign(codes=list(codes(unit(list(part["embedding"])), bits, tables)))

    kind = dict(classes.dtypes)
    coded = stored(classes.select("cid", "label", "w", "embedding").mapInPandas(hashed, f"cid long, label {kind['label']}, w long, embedding {kind['embedding']}, codes array<int>"), "coded")
    spots = coded.select("cid", "label", F.size("embedding").alias("dim"), F.posexplode("codes").alias("t", "code"))
    spots = spots.select("cid", "t", F.xxhash64("label", "dim", "t", "code").alias("key"))
    full = spots.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    meet = spots.join(full, "key").withColumn("block", F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meet = meet.withColumn("other", other).select("cid", "key", "t", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    dealt = meet.join(coded.select("cid", "w", "embedding", "codes"), "cid").repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")
    found = stored(dealt.mapInPandas(_groups, "cid long, links long, other long"), "links")
    discard(coded)
    comps = connected_components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")), "embeddings")
    counts = found.where("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = classes.select("label", "embedding", "cid", "least", "w").join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").join(counts, "cid", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    linked = rows.where("usable").join(named, ["label", "embedding"]).select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `embeddings` with its links and component, as `near_duplicates` says."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT DISTINCT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= {COSINE}),
r AS (SELECT x AS a, x AS b FROM l UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN k USING (vec_id) LEFT JOIN c USING (vec_id)
"""
