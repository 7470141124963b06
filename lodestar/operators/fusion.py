"""Fusion of ranked lists, and reranking.

A list is a table (query_id, chunk_id, score, rank) with a name; lists are stacked and grouped by
query and chunk, which costs one shuffle where full outer joins would cost one for each list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
CANDIDATES = 50
DIGITS = 9


def check_weights(names: list[str], weights: Mapping[str, float] | None) -> dict[str, float]:
    """A weight for each list, 1 where none is given; unknown, negative, infinite and all-zero weights are errors."""
    given = dict(weights or {})
    if unknown := sorted(set(given) - set(names)):
        raise ValueError(f"weights for unknown lists: {unknown}")
    out = {n: float(given.get(n, 1.0)) for n in names}
    if any(not 0 <= w < float("inf") for w in out.values()):
        raise ValueError("weights must be finite and not negative")
    if names and not any(out.values()):
        raise ValueError("at least one weight must be positive")
    return out


def stacked(lists: Mapping[str, DataFrame], weights: Mapping[str, float] | None) -> DataFrame:
    weight = check_weights(list(lists), weights)
    both = None
    for at, (name, hits) in enumerate(lists.items()):
        own = hits.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"), F.lit(name).alias("list"), F.lit(at).alias("at"), F.lit(weight[name]).alias("weight"))
        both = own if both is None else both.unionByName(own)
    if both is None:
        raise ValueError("no lists to fuse")
    return both


def _fused(both: DataFrame, part: Column, label: str, k: int | None) -> DataFrame:
    """Sum the parts; order by score, then best rank, then the list (in order) and rank where it was first seen. The job fails for hits that `faulty_hits` would name."""
    finite = F.min(F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False)))
    whole = finite & (F.count("*") == F.count_distinct("list")) & (F.min("rank") >= 1)
    grouped = both.withColumn("part", part).groupBy("query_id", "chunk_id").agg(
        F.when(whole, F.round(F.sum("part"), DIGITS)).otherwise(F.raise_error(F.lit("a chunk twice in a list, a score that is no finite number, or a rank under 1"))).alias("score"),
        F.min("rank").alias("best"),
        F.min(F.col("at") * F.lit(1 << 40) + F.col("rank")).alias("seen"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("list", "score")))).alias("components"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("list", "rank")))).alias("ranks"),
    )
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "seen")
    ranked = grouped.withColumn("rank", F.row_number().over(window))
    if k is not None:
        if k < 1:
            raise ValueError("k must be positive")
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), F.lit(label).alias("retriever"), "components", "ranks")


def reciprocal_rank_fusion(lists: Mapping[str, DataFrame], k: int | None = None, rrf_k: float = RRF_K, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Sum of weight / (rrf_k + rank) over the lists that hold a chunk. A list of weight 0 still brings candidates."""
    if rrf_k < 0:
        raise ValueError("rrf_k must not be negative")
    return _fused(stacked(lists, weights), F.col("weight") / (F.lit(float(rrf_k)) + F.col("rank")), "hybrid-rrf", k)


def weighted_score_fusion(lists: Mapping[str, DataFrame], k: int | None = None, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Sum of weighted scores, each scaled to 0..1 over its list and query (1 where all are equal)."""
    window = Window.partitionBy("query_id", "list")
    low, high = F.min("score").over(window), F.max("score").over(window)
    scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    both = stacked(lists, weights).withColumn("scaled", scaled)
    return _fused(both, F.col("weight") * F.col("scaled"), "hybrid-weighted", k)


def faulty_hits(lists: Mapping[str, DataFrame]) -> DataFrame:
    """Hits that must not be fused: a chunk twice in a list, a score that is no finite number, a rank under 1."""
    both = stacked(lists, None)
    again = F.count("*").over(Window.partitionBy("query_id", "list", "chunk_id")) > 1
    reason = F.when(again, "duplicate chunk").when(F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull(), "non-finite score").when(F.col("rank") < 1, "rank under 1")
    return both.withColumn("reason", reason).where("reason is not null").select("query_id", "list", "chunk_id", "reason")


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame], k: int, candidates: int = CANDIDATES, stage: str = "hybrid", label: str = "rerank") -> DataFrame:
    """Rescore the first max(k, candidates) hits of each query; order by the new score, then the old rank.

    `scorer` adds `new_score` to its table. The old score and rank are kept under the name `stage`
    in `components` and `ranks`; a stage that is there already is an error when the job runs.
    """
    pool = hits.where(F.col("rank") <= max(k, candidates))
    scored = scorer(pool)
    window = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank")
    none_d, none_l = F.create_map().cast("map<string,double>"), F.create_map().cast("map<string,bigint>")
    components = F.col("components") if "components" in hits.columns else none_d
    ranks = F.col("ranks") if "ranks" in hits.columns else none_l
    out = scored.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)
    return out.select(
        "query_id", "chunk_id", F.col("new_score").alias("score"), F.col("position").cast("long").alias("rank"), F.lit(label).alias("retriever"),
        F.map_concat(components, F.create_map(F.lit(stage), F.col("score"))).alias("components"), F.map_concat(ranks, F.create_map(F.lit(stage), F.col("rank"))).alias("ranks"),
    )


def overlap_scorer(texts: DataFrame, queries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A scorer without a model: the share of the query's distinct words that the chunk holds.

    `texts` (chunk_id, text), `queries` (query_id, text). Only the hits' texts are read into the score.
    """
    from lodestar.functions.text import bm25_tokens

    def score(hits: DataFrame) -> DataFrame:
        asked = queries.select("query_id", F.array_distinct(bm25_tokens(F.col("text"))).alias("asked"))
        both = hits.join(asked, "query_id").join(texts.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id")
        share = F.size(F.array_intersect("asked", bm25_tokens(F.col("chunk_text")))) / F.greatest(F.size("asked"), F.lit(1))
        return both.withColumn("new_score", F.round(share, 6)).drop("asked", "chunk_text")

    return score


def pair_scorer(texts: DataFrame, queries: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], batch: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A scorer around a model of (query, text) pairs: `load` runs once in each task, the model gets `batch` pairs at a time.

    `texts` (chunk_id, text), `queries` (query_id, text); a null text is an empty one. A model that
    returns another number of scores, or one that is not finite, fails the job.
    """
    if batch < 1:
        raise ValueError("a batch has at least one pair")

    @F.pandas_udf("double")
    def scores(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for asked, text in pairs:
            both, out = list(zip(asked.fillna(""), text.fillna(""), strict=True)), []
            for at in range(0, len(both), batch):
                part = both[at : at + batch]
                own = np.asarray(model(part), np.float64)
                if own.shape != (len(part),) or not np.isfinite(own).all():
                    raise ValueError("the model returned another number of scores than pairs, or one that is not finite")
                out.append(own)
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    def score(hits: DataFrame) -> DataFrame:
        both = hits.join(queries.select("query_id", F.col("text").alias("asked")), "query_id").join(texts.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id")
        return both.withColumn("new_score", scores("asked", "chunk_text")).drop("asked", "chunk_text")

    return score
