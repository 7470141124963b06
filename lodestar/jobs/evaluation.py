"""An evaluation run: modes over an index, metrics for each query and on the whole, and a report."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.jobs.options import MODES, Request
from lodestar.jobs.service import Index
from lodestar.operators import evaluate
from lodestar.operators.tables import stored

TOP, DEPTH = 10, 50


def run(held: Index, queries: DataFrame, judged: DataFrame, modes: Sequence[str] = MODES, k: int = TOP, depth: int = DEPTH, rerank: bool = False, timed: int = 0) -> tuple[DataFrame, dict]:
    """(metrics mode, query_id, metric, value; report) of the scored queries.

    Each mode is one batch over all queries. Where hits of one document crowd out others, the mode
    searches again at twice the depth for the queries that are short of k documents. The report has the
    seconds that a mode's searches took and, if `timed` is over 0, the latencies of so many single ones.
    """
    kinds = evaluate.query_kinds(queries, judged)
    scored = stored(queries.join(kinds.where("kind = 'scored'"), "query_id", "left_semi"), "scored")
    qrels = judged.join(scored.select("query_id"), "query_id", "left_semi")
    owners = held.chunks.select("chunk_id", "doc_id")
    most = max(held.chunks.count(), 1)
    parts, report = None, {"queries": {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}, "modes": {}}
    for mode in modes:
        began = time.time()

        def search(asked: DataFrame, n: int, mode: str = mode) -> DataFrame:
            options = Request("x", min(n, 100), mode, candidates=min(max(n, DEPTH), 1000) if mode == "hybrid" or rerank else None, rerank=rerank)
            return held.search(asked, options, n).join(owners, "chunk_id").select("query_id", "doc_id", "rank")

        hits = stored(evaluate.deepen(search, scored, k, min(depth, most), most), "hits")
        seconds = round(time.time() - began, 3)
        best = evaluate.unique_documents(hits).where(F.col("rank") <= k)
        own = evaluate.long_form(evaluate.score_queries(best, qrels), mode)
        found = best.groupBy("query_id").count()
        each = scored.select("query_id").join(hits.groupBy("query_id").agg(F.max("depth").alias("depth")), "query_id", "left").join(found, "query_id", "left")
        seen = each.agg(F.min("depth"), F.max("depth"), F.avg("depth"), F.count_if(F.coalesce("count", F.lit(0)) < k)).first()
        report["modes"][mode] = {"depth": [seen[0], seen[1]], "mean_depth": seen[2], "short_queries": seen[3], "seconds": seconds}
        if timed:
            report["modes"][mode]["latency"] = latencies(held, scored, mode, timed)
        parts = own if parts is None else parts.unionByName(own)
    for r in evaluate.macro(parts).collect():
        report["modes"][r["mode"]][r["metric"]] = r["mean"]
    return parts, report


def latencies(held: Index, queries: DataFrame, mode: str, sample: int = 20) -> dict:
    """Nearest-rank p50 and p95 in seconds of single searches: one to warm up, then `sample` queries one by one. Batches are what Spark is for; this is what one request waits."""
    asked = queries.orderBy("query_id").limit(sample + 1).collect()
    times = []
    for row in asked:
        one = queries.sparkSession.createDataFrame([(row["query_id"], row["text"])], queries.select("query_id", "text").schema)
        began = time.time()
        held.search(one, Request("x", TOP, mode)).collect()
        times.append(time.time() - began)
    times = sorted(times[1:] or times)
    rank = lambda share: times[max(0, math.ceil(share * len(times)) - 1)] if times else None
    return {"n": len(times), "p50": rank(0.5), "p95": rank(0.95)}


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """The report as strict JSON (a figure that is no finite number is an error), in one file wherever Spark can write."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(report, indent=1, sort_keys=True, allow_nan=False).encode()))
    finally:
        out.close()


def write_scores(metrics: DataFrame, path: str) -> None:
    """The metrics of each query, as rows of Parquet by mode."""
    metrics.write.mode("overwrite").partitionBy("mode").parquet(path)


def as_markdown(report: dict) -> str:
    """A table of the report's means."""
    metrics = sorted({m for v in report["modes"].values() for m in v if "@" in m})
    lines = ["| mode | " + " | ".join(metrics) + " |", "| --- " * (len(metrics) + 1) + "|"]
    return "\n".join([*lines, *("| " + " | ".join([mode, *(f"{v[m]:.4f}" for m in metrics)]) + " |" for mode, v in report["modes"].items())])
