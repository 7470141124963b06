"""Lexical and dense retrieval for whole tables of queries.

Statistics are always those of the whole corpus; filters come before ranking. Both searches have
the same shape: what is known of the queries is broadcast (counted first, in blocks of bounded
size), each task scores the rows it reads and keeps its own first k of each query, and only those
are shuffled. No posting and no vector is. Texts never travel with scores: join them to the few
hits afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import bm25_tokens

K1, B = 1.2, 0.75
DIGITS = 6
#: Distinct query terms, or query vectors, that may be broadcast; they are counted first.
BROADCAST_TERMS, BROADCAST_VECTORS = 1_000_000, 20_000
#: Scores (rows times queries, of 8 bytes) that a task holds at once.
CELLS = 8_000_000


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """`df` for broadcast if it has at most `limit` rows, else for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def tokenized(chunks: DataFrame, text: str = "text") -> DataFrame:
    """`chunks` (chunk_id, ..., text) with `tokens` and their count `length` in place of the text."""
    return chunks.withColumn("tokens", F.coalesce(bm25_tokens(F.col(text)), F.array().cast("array<string>"))).withColumn("length", F.size("tokens").cast("long")).drop(text)


def postings(tokens: DataFrame) -> DataFrame:
    """(term, chunk_id, tf) of a table with `tokens`."""
    return tokens.select("chunk_id", F.explode("tokens").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n, avgdl (1 if all chunks are empty). Chunks without tokens count."""
    mean = F.avg(F.col("length").cast("double"))
    return tokens.agg(F.count("*").alias("n"), F.when(F.coalesce(mean, F.lit(0.0)) == 0, 1.0).otherwise(mean).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) of all terms of `postings`."""
    return posted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of `queries` (query_id, text): distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("term"))


def bm25_scores(tokens: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that shares a term with the query.

    Only postings of the queries' terms are made: tokens are filtered before anything is grouped
    or shuffled, and each chunk's length goes along.
    """
    if not (k1 >= 0 and 0 <= b <= 1):
        raise ValueError("k1 must be at least 0 and b in [0, 1]")
    terms = query_terms(queries)
    wanted = bounded(terms.select("term").distinct(), BROADCAST_TERMS)
    stats = corpus_stats(tokens)
    posted = tokens.select("chunk_id", "length", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    weights = posted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl"))
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / norm
    gains = posted.join(weights, "term").select("term", "chunk_id", gain.alias("gain"))
    return gains.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.sum("gain").alias("score"))


def top_k(scores: DataFrame, k: int, order: Sequence[Column] | None = None, digits: int = DIGITS) -> DataFrame:
    """The first k of each query by score (rounded), ties by chunk_id: adds `rank`."""
    if k < 1:
        raise ValueError("k must be positive")
    rounded = scores.withColumn("score", F.round("score", digits))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), *(order or [F.col("chunk_id")]))
    return rounded.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


class _First:
    """The first k rows of each query that a task has met."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    def add(self, scores: np.ndarray, chunks: np.ndarray, met: np.ndarray | None = None) -> None:
        """scores: queries x rows, rounded; met: those that count."""
        scores = np.where(met, scores, -np.inf) if met is not None else scores
        if scores.shape[1] > self.k:  # what reaches the k-th, ties too
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k, None]
            query, row = np.nonzero((scores >= kth) & (scores > -np.inf))
        else:
            query, row = np.nonzero(scores > -np.inf)
        self.held.append(pd.DataFrame({"query": query, "chunk_id": chunks[row], "score": scores[query, row]}))
        if len(self.held) > 8:
            self.held = [self.best()]

    def best(self) -> pd.DataFrame:
        if not self.held:
            return pd.DataFrame({"query": np.zeros(0, np.int64), "chunk_id": [], "score": []})
        rows = pd.concat(self.held).sort_values(["query", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
        return rows.groupby("query", sort=False).head(self.k)

    def as_arrow(self, ids: list, schema: pa.Schema) -> pa.RecordBatch:
        rows = self.best()
        return pa.RecordBatch.from_arrays([pa.array([ids[q] for q in rows["query"]], schema.field(0).type), pa.array(rows["chunk_id"].to_list(), schema.field(1).type), pa.array(rows["score"].to_numpy(float), pa.float64())], schema=schema)


def _hits_schema(queries: DataFrame, chunks: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    return f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double", pa.schema([("query_id", to_arrow_type(kinds[0])), ("chunk_id", to_arrow_type(kinds[1])), ("score", pa.float64())])


def _encoded(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, term, occurrences) of the query terms in a batch with `tokens`, by row and term, and the number of rows."""
    tokens = batch.column("tokens")
    row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
    term = pc.index_in(pc.list_flatten(tokens), value_set=vocabulary)
    known = term.is_valid().to_numpy(zero_copy_only=False)
    key, count = np.unique(row[known].astype(np.int64) * len(vocabulary) + term.drop_null().to_numpy(), return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), count, batch.num_rows


def _lexical_stats(tokens: DataFrame, vocabulary: pa.Array) -> tuple[int, float, np.ndarray]:
    """(chunks, mean length, how many chunks hold each term): one narrow pass, a row for each task and term."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, length = np.zeros(len(shared.value), np.int64), 0, 0
        for batch in it:
            _, term, _, rows = _encoded(batch, shared.value)
            held += np.bincount(term, minlength=len(held))
            n, length = n + rows, length + (pc.sum(batch.column("length")).as_py() or 0)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([[-2, -1], term]), "n": np.concatenate([[n, length], held[term]])})

    rows = tokens.select("tokens", "length").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    total = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist(), strict=True))
    n, length = total.pop(-2, 0), total.pop(-1, 0)
    df[list(total)] = list(total.values())
    return n, (length / n if n and length else 1.0), df


def bm25_search(tokens: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 top k: (query_id, chunk_id, score, rank).

    `tokens` (chunk_id, tokens, length, what `keep` names), `queries` (query_id, text). `keep`
    filters chunks after the statistics and before the ranking. The first pass counts the chunks of
    each query term, the second scores each row's own tokens; queries go in blocks of at most
    BROADCAST_VECTORS. Past BROADCAST_TERMS terms both sides are joined on the term instead.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if not (k1 >= 0 and 0 <= b <= 1):
        raise ValueError("k1 must be at least 0 and b in [0, 1]")
    terms = query_terms(queries)
    if terms.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        scores = bm25_scores(tokens, queries, k1, b)
        return top_k(scores.join(tokens.where(keep).select("chunk_id"), "chunk_id", "left_semi") if keep is not None else scores, k)
    asked = terms.toArrow()
    vocabulary = asked["term"].unique()
    n, mean, df = _lexical_stats(tokens, vocabulary)
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5))
    term_of = pc.index_in(asked["term"], value_set=vocabulary).to_numpy() if asked.num_rows else np.zeros(0, np.int64)
    names, query_of = np.unique(np.array(asked["query_id"].to_pylist(), object), return_inverse=True) if asked.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    schema, arrow = _hits_schema(queries, tokens)
    kept = (tokens.where(keep) if keep is not None else tokens).select("chunk_id", "tokens", "length")
    parts = []
    for first in range(0, max(1, len(names)), BROADCAST_VECTORS):
        own = np.flatnonzero((query_of >= first) & (query_of < first + BROADCAST_VECTORS))
        own = own[np.argsort(term_of[own], kind="stable")]
        ids = list(names[first : first + BROADCAST_VECTORS])
        starts = np.searchsorted(term_of[own], np.arange(len(vocabulary) + 1))
        shared = tokens.sparkSession.sparkContext.broadcast((vocabulary, weight, ids, query_of[own] - first, starts))

        def score(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            vocabulary, weight, ids, query, starts = shared.value
            best, step = _First(k), max(1, CELLS // max(1, len(ids)))
            for whole in it:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    row, term, tf, rows = _encoded(batch, vocabulary)
                    length = batch.column("length").to_numpy()
                    gain = weight[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
                    times = starts[term + 1] - starts[term]  # the queries that ask for the term
                    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[term], times)
                    cell = query[place] * rows + np.repeat(row, times)
                    scores = np.bincount(cell, np.repeat(gain, times), len(ids) * rows).reshape(len(ids), rows)
                    met = np.bincount(cell, minlength=len(ids) * rows).reshape(len(ids), rows) > 0
                    best.add(np.round(scores, DIGITS), np.array(batch.column("chunk_id").to_pylist(), object), met)
            yield best.as_arrow(ids, arrow)

        parts.append(kept.mapInArrow(score, schema))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return top_k(both, k)


def matches(column: Column, value: object, is_list: bool = False) -> Column:
    """Metadata filter: equality, any of a list, or overlap where the field is a list; a missing field never matches, nor does a value of another kind (2 is not "2")."""
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    kind = F.regexp_extract(F.typeof(column), "^(?:array<)?([a-z]+)", 1)
    text = kind.isin("string", "varchar", "char")
    truth = kind == "boolean"
    words = [v for v in values if isinstance(v, str)]
    bools = [v for v in values if isinstance(v, bool)]
    numbers = [v for v in values if not isinstance(v, (str, bool))]

    def among(own: list, fits: Column, sql: str) -> Column:
        if not own:
            return F.lit(False)
        listed = F.array(*[F.lit(v).cast(sql) for v in own])
        # Cast only where the kinds agree: elsewhere the condition before it decides.
        hit = F.arrays_overlap(F.transform(column, lambda x: x.try_cast(sql)), listed) if is_list else F.array_contains(listed, column.try_cast(sql))
        return fits & F.coalesce(hit, F.lit(False))

    return among(words, text, "string") | among(bools, truth, "boolean") | among(numbers, ~text & ~truth, "double")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit length in double precision; a zero vector stays as it is."""
    size = norm(vector)
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def valid_vector(vector: Column, dimension: int | Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = BROADCAST_VECTORS) -> DataFrame:
    """Exact cosine top k: (query_id, chunk_id, score, rank).

    `vectors` (chunk_id, embedding), filtered beforehand; `queries` (query_id, embedding). Zero and
    null query vectors find nothing, nor do those with null or non-finite parts; stored vectors of
    that kind, or of another length than the queries', are not found. Queries of two lengths are a ValueError. The queries are broadcast in blocks of at most `query_block`
    vectors; each task multiplies so many of its vectors with the block that CELLS scores are held,
    and keeps its own first k of each query, so what is shuffled is k rows a query and task.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    sound = queries.where("query_id is not null").where(valid_vector(F.col("embedding"), F.size("embedding")))
    usable = sound.where(norm(F.col("embedding")) > 0).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = usable.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if asked[1] != asked[2]:
        raise ValueError("queries have vectors of different lengths")
    vectors = vectors.where(valid_vector(F.col("embedding"), asked[1] or 0))
    blocks = max(1, -(-asked[0] // query_block))
    schema, arrow = _hits_schema(queries, vectors)
    parts = []
    for block in range(blocks):
        own = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else usable
        rows = own.toArrow()  # at most about query_block vectors
        matrix = pc.list_flatten(rows["embedding"]).to_numpy().reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast((rows["query_id"].to_pylist(), matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if rows.num_rows else matrix))

        def score(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, matrix = shared.value
            best, step = _First(k), max(1, CELLS // max(1, len(ids)))
            for whole in it if ids else ():
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    x = pc.list_flatten(batch.column("embedding")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                    size = np.linalg.norm(x, axis=1, keepdims=True)
                    best.add(np.round(matrix @ (x / np.where(size > 0, size, 1)).T, DIGITS), np.array(batch.column("chunk_id").to_pylist(), object))
            yield best.as_arrow(ids, arrow)

        parts.append(vectors.select("chunk_id", "embedding").mapInArrow(score, schema))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return top_k(both, k)
