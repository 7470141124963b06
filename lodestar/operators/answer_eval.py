"""Evaluation of answers: items with exactly k contexts, replies from a cache, and reports that are recomputed from their grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.evaluate import drop_gold, wilson

# The words around a claim.
QUESTION = "Claim: %s\nDo the contexts support or contradict this claim? Answer briefly, citing the evidence. If the contexts do not address the claim, abstain."
TOLERANCE = 1e-12


def question(claim: Column) -> Column:
    return F.format_string(QUESTION, claim)


def _or_error(good: Column, value: Column, message: Column) -> Column:
    """`value`; the job fails with `message` where it is not good."""
    return F.when(good, value).otherwise(F.raise_error(message))


def answer_items(claims: DataFrame, hits: DataFrame, gold: DataFrame, kinds: DataFrame, k: int, exact: bool = True) -> DataFrame:
    """(query_id, kind, question, context, doc_id, rank, ...): exactly k contexts for each query of `kinds`.

    `claims` (query_id, text), `hits` (query_id, doc_id, rank, ...), `gold` (query_id, doc_id),
    `kinds` (query_id, kind: `answerable` or `no_relevant`). An answerable query gets its first k
    hits, the other kind the first k that are not relevant. ValueError for a query of both
    kinds; the job fails for one with fewer than k contexts left. Without `exact` such a query
    keeps the contexts that are left, and has no row if there are none.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = kinds.groupBy("query_id").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"))
    both = asked.where("kind <> other").take(1)
    if both:
        raise ValueError(f"in both subsets: {both[0]['query_id']}")
    asked = asked.drop("other")
    own = hits.join(asked, "query_id")
    first = own.where("kind = 'answerable'").withColumn("new", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("new") <= k)
    first = first.withColumn("rank", F.col("new").cast("long")).withColumn("context", F.col("new").cast("long") - 1).drop("new")
    rest = drop_gold(own.where("kind = 'no_relevant'"), gold.select("query_id", "doc_id").distinct(), k)
    asking = claims.select("query_id", question(F.col("text")).alias("question"))
    if not exact:
        return first.unionByName(rest).join(asking, "query_id")
    counted = asked.select("query_id").join(first.unionByName(rest), "query_id", "left").withColumn("held", F.count("context").over(Window.partitionBy("query_id")))
    whole = _or_error(F.col("held") == k, F.col("kind"), F.concat(F.lit("too few contexts: "), F.col("query_id").cast("string")))
    return counted.withColumn("kind", whole).drop("held").join(asking, "query_id")


def replayed(requests: DataFrame, cache: DataFrame, replay_only: bool = True) -> DataFrame:
    """`requests` (key, ...) with `content` and `cached`. With `replay_only` the job fails where the cache (key, content) has no reply; else content is null there, to be asked for."""
    known = cache.select("key", "content").distinct()
    met = requests.join(known, "key", "left")
    found = F.col("content").isNotNull()
    content = _or_error(found, F.col("content"), F.concat(F.lit("no cached reply for key "), F.substring("key", 1, 12))) if replay_only else F.col("content")
    return met.withColumn("cached", found).withColumn("content", content)


def appended(cache: DataFrame, replies: DataFrame) -> DataFrame:
    """New entries (key, model, content) of `replies` for the cache: one for each key that it lacks. ValueError for a key with two contents, here or there."""
    both = cache.select("key", "model", "content", F.lit(True).alias("old")).unionByName(replies.select("key", "model", "content", F.lit(False).alias("old")))
    each = both.groupBy("key").agg(F.min("content").alias("content"), F.max("content").alias("last"), F.min("model").alias("model"), F.max("old").alias("old"))
    torn = each.where("content <> last").take(1)
    if torn:
        raise ValueError(f"two contents of key {torn[0]['key']}")
    return each.where("not old").select("key", "model", "content")


def rechecked(grades: DataFrame, reported: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(metric, successes, n, rate, low, high, reported, agrees) of a report, recomputed from the grades of its items.

    `grades` as `answer.grade` returns them, `reported` (metric, value). Rates agree within
    TOLERANCE; an undefined one (n is 0) agrees with null. The recall is a mean and has no interval.
    """
    with_gold = (F.col("kind") == "answerable") & (F.col("gold_in_context") > 0)
    none = F.col("kind") == "no_relevant"
    pairs = {
        "parse_ok_rate": (F.count_if("parse_ok"), F.count("*")),
        "citation_span_validity": (F.sum("n_valid"), F.sum("n_raw")),
        "citation_precision": (F.sum("n_valid_gold"), F.sum("n_valid")),
        "false_abstention_rate": (F.count_if(with_gold & F.col("abstained")), F.count_if(with_gold)),
        "correct_abstention_rate": (F.count_if(none & F.col("abstained")), F.count_if(none)),
    }
    rows = [F.struct(F.lit(name).alias("metric"), F.coalesce(x, F.lit(0)).cast("double").alias("successes"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for name, (x, n) in pairs.items()]
    rows.append(F.struct(F.lit("citation_recall").alias("metric"), F.coalesce(F.sum("citation_recall"), F.lit(0.0)).alias("successes"), F.count("citation_recall").alias("n")))
    each = grades.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    low, high = wilson(F.col("successes"), F.col("n"), confidence)
    counted = F.col("metric") != "citation_recall"
    rate = F.try_divide("successes", "n")
    own = each.select("metric", "successes", "n", rate.alias("rate"), F.when(counted, low).alias("low"), F.when(counted, high).alias("high"))
    met = own.join(reported.select("metric", F.col("value").cast("double").alias("reported")), "metric", "left")
    return met.withColumn("agrees", F.coalesce(F.abs(F.col("rate") - F.col("reported")) <= TOLERANCE, F.col("rate").isNull() & F.col("reported").isNull()))
