"""Retrieval metrics, percentiles, intervals and comparisons.

Tables: ranked (query_id, doc_id, rank), qrels (query_id, doc_id, grade), metrics in long form
(mode, query_id, metric, value).
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.tables import stored

KS = (1, 5, 10)
#: Words of the generator that are made at once.
AHEAD = 1 << 22


def unique_documents(ranked: DataFrame) -> DataFrame:
    """Each document of a query at its best rank, ranks closed up."""
    best = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    window = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return best.withColumn("rank", F.row_number().over(window).cast("long"))


def relevant(qrels: DataFrame, least: int = 1) -> DataFrame:
    return qrels.where(F.col("grade") >= least).select("query_id", "doc_id")


def query_kinds(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, kind): unlabelled, no-relevant or scored."""
    counts = qrels.groupBy("query_id").agg(F.max(F.when(F.col("grade") >= 1, 1).otherwise(0)).alias("any"))
    kind = F.when(F.col("any").isNull(), "unlabelled").when(F.col("any") == 0, "no-relevant").otherwise("scored")
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", kind.alias("kind"))


def score_queries(ranked: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Recall and hit at each k, MRR and nDCG at the largest: one row for each query with judgements, zeros where nothing was found.

    One pass: judgements meet the ranking once, the ideal ranking is a window over judgements alone.
    """
    top = max(ks)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    judged = qrels.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade")).withColumn("ideal", ideal_rank)
    both = judged.join(unique_documents(ranked), ["query_id", "doc_id"], "left")
    found = lambda k: (F.col("grade") >= 1) & (F.col("rank") <= k)
    n = F.sum(F.when(F.col("grade") >= 1, 1).otherwise(0))
    out = []
    for k in ks:
        hits = F.sum(F.when(found(k), 1).otherwise(0))
        out += [F.when(n > 0, hits / n).otherwise(0.0).alias(f"recall@{k}"), F.when(hits > 0, 1.0).otherwise(0.0).alias(f"hit@{k}")]
    first = F.min(F.when(found(top), F.col("rank")))
    dcg = F.sum(F.when(F.col("rank") <= top, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    best = F.sum(F.when(F.col("ideal") <= top, gain / F.log2(F.col("ideal") + 1.0)).otherwise(0.0))
    out += [F.coalesce(1.0 / first, F.lit(0.0)).alias(f"mrr@{top}"), F.when(best > 0, dcg / best).otherwise(0.0).alias(f"ndcg@{top}")]
    return both.groupBy("query_id").agg(*out)


def long_form(scores: DataFrame, mode: str) -> DataFrame:
    names = [c for c in scores.columns if c != "query_id"]
    return scores.select(F.lit(mode).alias("mode"), "query_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"`{c}`").cast("double") for c in names]))).alias("metric", "value"))


def macro(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """Mean of each metric over the queries that have it."""
    return metrics.groupBy("mode", "metric").agg(F.round(F.avg("value"), digits).alias("mean"), F.count("value").alias("n"))


def nearest_rank(column: str, share: float) -> Column:
    """The nearest-rank percentile: the value at place ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def linear_percentile(column: str, share: float) -> Column:
    return F.percentile(F.col(column), share)


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval of successes / n, clamped to 0..1 and exact at both ends; null where n < 1."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p = successes / n
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low = F.when(successes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half))
    high = F.when(successes == n, 1.0).otherwise(F.least(F.lit(1.0), middle + half))
    return F.when(n >= 1, low), F.when(n >= 1, high)


def _starts(n: int, resamples: int, block: int, seed: int) -> list[tuple[int, int, list[int], int]]:
    """(first resample, how many, state, place in it) of blocks of resamples of `n` draws of Python's generator.

    The generator is run ahead without drawing anything (some ten nanoseconds a word); a draw takes the
    high bits of a word and is made again while it is not under n.
    """
    _, state, _ = random.Random(seed).getstate()
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    shift, out, drawn = 32 - n.bit_length(), [], 0
    for first in range(0, resamples, block):
        while drawn < first * n:
            before, left = bits.state, first * n - drawn
            taken = np.flatnonzero((bits.random_raw(min(2 * left + 64, AHEAD)) >> np.uint64(shift)) < n)
            if len(taken) > left:  # back to the word after the last one that is needed
                bits.state = before
                bits.random_raw(int(taken[left - 1]) + 1, output=False)
                taken = taken[:left]
            drawn += len(taken)
        own = bits.state["state"]
        out.append((first, min(block, resamples - first), [int(x) for x in own["key"]], int(own["pos"])))
    return out


def _means(gaps: np.ndarray, count: int, key: list[int], pos: int) -> np.ndarray:
    """Means of `count` resamples from a state of the generator on; each sum is added up in the order of its draws."""
    bits, n = np.random.MT19937(), len(gaps)
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": pos}}
    shift, held, means = np.uint64(32 - n.bit_length()), np.zeros(0, np.uint64), []
    side_by_side = max(1, AHEAD // n)
    while count:
        now = min(count, side_by_side)
        while len(held) < now * n:
            word = bits.random_raw(now * n - len(held) + 64) >> shift
            held = np.concatenate([held, word[word < n]])
        drawn, held = gaps[held[: now * n].astype(np.int64)].reshape(now, n), held[now * n :]
        means.append(np.add.accumulate(drawn, axis=1)[:, -1] / n)
        count -= now
    return np.concatenate(means)


def bootstrap(pairs: DataFrame, by: Sequence[str], resamples: int = 10_000, confidence: float = 0.95, seed: int = 0, blocks: int = 64) -> DataFrame:
    """Paired bootstrap interval of mean(a - b) for each group: `pairs` has `by`, query_id, a, b.

    The draws are those of Python's Mersenne Twister, in query order, so that numbers can be
    compared with published ones. Resamples are dealt to tasks in `blocks`, each from the state that the
    generator has reached there; the states depend on a group's size alone and are found once for each
    size. A task holds one group's differences, a number for each query.
    """
    if not 0 < confidence < 1 or resamples < 1:
        raise ValueError("confidence must be between 0 and 1 and resamples at least 1")
    fields = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    gap = F.col("a").cast("double") - F.col("b").cast("double")
    groups = pairs.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", gap.alias("gap")))), lambda x: x["gap"]).alias("gaps"))
    groups = stored(groups.withColumn("n", F.size("gaps").cast("long")), "gaps")
    block = -(-resamples // blocks)
    starts = [(r["n"], first, count, key, pos) for r in groups.select("n").distinct().collect() for first, count, key, pos in _starts(r["n"], resamples, block, seed)]
    dealt = groups.join(F.broadcast(pairs.sparkSession.createDataFrame(starts, "n long, first long, count long, key array<long>, pos long")), "n").repartition(*by, "first")

    def draw(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(len(pdf)):
                row = pdf.iloc[at]
                means = _means(np.asarray(row["gaps"], np.float64), int(row["count"]), list(row["key"]), int(row["pos"]))
                yield pd.DataFrame({**{c: pd.Series([row[c]] * len(means), dtype=pdf[c].dtype) for c in by}, "mean": means})

    drawn = dealt.select(*by, "gaps", "count", "key", "pos").mapInPandas(draw, f"{fields}, mean double")
    tail = (1 - confidence) / 2
    low, high = math.floor(tail * (resamples - 1)), math.ceil((1 - tail) * (resamples - 1))
    each = drawn.groupBy(*by).agg(F.array_sort(F.collect_list("mean")).alias("means"), F.count_if(F.col("mean") > 0).alias("n_positive"), F.count_if(F.col("mean") < 0).alias("n_negative"))  # `resamples` numbers a group
    mean = F.aggregate("gaps", F.lit(0.0), lambda t, x: t + x) / F.col("n")
    return groups.select(*by, "n", mean.alias("mean_diff")).join(each, list(by)).select(*by, "n", "mean_diff", F.get("means", F.lit(low)).alias("ci_low"), F.get("means", F.lit(high)).alias("ci_high"), "n_positive", "n_negative")


def compare_modes(metrics: DataFrame, mode_a: str, mode_b: str) -> DataFrame:
    """(metric, query_id, a, b) of two modes; a query that only one of them has is an error when the job runs."""
    side = lambda mode, name: metrics.where(F.col("mode") == mode).select("metric", "query_id", F.col("value").alias(name))
    both = side(mode_a, "a").join(side(mode_b, "b"), ["metric", "query_id"], "full")
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.select("metric", F.when(whole, F.col("query_id")).otherwise(F.raise_error(F.lit("modes were scored on different queries"))).alias("query_id"), "a", "b")


def enough_depth(ranked: DataFrame, k: int, depth: int, most: int) -> DataFrame:
    """For a ranking whose first hits do not depend on its depth: (query_id, depth, n_docs, short).

    The depth is doubled from `depth` up to `most` until k distinct documents are among the hits or
    the hits run out; closed form, from one full ranking.
    """
    steps = [depth]
    while steps[-1] < most:
        steps.append(min(2 * steps[-1], most))
    window = Window.partitionBy("query_id").orderBy("rank")
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")) == 1
    seen = ranked.withColumn("first", first.cast("int")).withColumn("docs", F.sum("first").over(window))
    at = seen.groupBy("query_id").agg(F.count("*").alias("hits"), *[F.max(F.when(F.col("rank") <= d, F.col("docs"))).alias(f"d{d}") for d in steps])
    chosen = None
    for d in steps:
        stop = (F.col(f"d{d}") >= k) | (F.col("hits") < d) | F.lit(d == steps[-1])
        value = F.struct(F.lit(d).cast("long").alias("depth"), F.least(F.col(f"d{d}"), F.lit(k)).cast("long").alias("n_docs"), (F.col(f"d{d}") < k).alias("short"))
        chosen = F.when(stop, value) if chosen is None else chosen.when(stop, value)
    return at.select("query_id", chosen.alias("x")).select("query_id", "x.depth", "x.n_docs", "x.short")


def deepen(search: Callable[[DataFrame, int], DataFrame], queries: DataFrame, k: int, depth: int, most: int) -> DataFrame:
    """As `enough_depth` for rankings that change with their depth (fusion, reranking): searches again, deeper, for the queries left."""
    left, parts = queries, []
    while True:
        hits = stored(search(left, depth), "deepened")
        counts = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))
        done = (F.col("docs") >= k) | (F.col("hits") < depth)
        state = stored(left.join(counts, "query_id", "left").na.fill(0, ["hits", "docs"]).withColumn("done", done | F.lit(depth >= most)), "depths")
        ready = state.where("done").select("query_id")
        parts.append(hits.join(ready, "query_id", "left_semi").withColumn("depth", F.lit(depth).cast("long")))
        left = state.where("not done").drop("hits", "docs", "done")
        if depth >= most or left.isEmpty():
            break
        depth = min(2 * depth, most)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def subset(ids: Iterable[str], n: int, seed: int) -> list[str]:
    """A seeded sample of distinct query ids, sorted."""
    return sorted(random.Random(seed).sample(sorted(set(ids)), n))


def drop_gold(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Hits of documents that are not relevant to their query, first k, ranks closed up, with a 0-based `context`."""
    left = hits.join(gold, ["query_id", "doc_id"], "left_anti")
    window = Window.partitionBy("query_id").orderBy("rank")
    out = left.withColumn("new", F.row_number().over(window)).where(F.col("new") <= k)
    return out.withColumn("rank", F.col("new").cast("long")).withColumn("context", F.col("new").cast("long") - 1).drop("new")
