"""A stored inverted index: posting lists in buckets by term, cut into aligned blocks of chunks with their maxima.

A segment's chunks are numbered (`ord`); BLOCK numbers in a row are a block. A row of the index is the
list of one term in one block: places in the block, occurrences, and the two figures that bound any
score in it for any statistics of the corpus, the most occurrences and the least length. A block's head (no
term) has its chunk ids and lengths. Building tokenizes each chunk once and shuffles posting lists;
searching reads the rows of the queries' terms, which their buckets and sorting let the scan find, and no text.

Because blocks are aligned over all terms, the sum of a block's bounds over the terms of a query is a
bound of every score in it. The most promising blocks are scored first, which gives each query a score that k
chunks reach; of the others only blocks with a bound over it are read. Nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import bm25_tokens
from lodestar.operators.search import B, BROADCAST_TERMS, DIGITS, K1, query_terms, top_k
from lodestar.operators.tables import CODEC

BLOCK, BUCKETS = 1024, 64
#: Blocks that are bounded in one group; blocks that each query has scored first; an index of fewer blocks is scored whole.
SIDE_BY_SIDE, FIRST, PRUNED_FROM = 64, 4, 64
#: Queries that are answered side by side.
QUERIES = 20_000
Tokenizer = Callable[[Column], Column]


def bucket(term: Column) -> Column:
    """The bucket of a term; heads of blocks stand in bucket -1."""
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def build(chunks: DataFrame, text: str = "embedding_text", tokenizer: Tokenizer = bm25_tokens) -> DataFrame:
    """Rows of the index of `chunks` (ord, chunk_id, `text`): bucket, term, block, n, top_tf, least_length, places, tfs, ids. A null text has no tokens."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = chunks.schema["chunk_id"].dataType
    schema = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("top_tf", pa.int32()), ("least_length", pa.int32()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(to_arrow_type(id_type)))])

    def lists(values: np.ndarray, edge: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(edge, len(values)), pa.int32()), pa.array(values, pa.int32()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            number = batch.column("ord").to_numpy()
            tokens = batch.column("tokens")
            row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.list_flatten(tokens).dictionary_encode()
            size = np.bincount(row, minlength=batch.num_rows)
            block, place = number // BLOCK, number % BLOCK
            # Heads: the chunks of each block in this batch.
            order = np.argsort(number, kind="stable")
            edge = np.flatnonzero(np.diff(block[order], prepend=-1))
            ids = pa.ListArray.from_arrays(pa.array(np.append(edge, len(order)), pa.int32()), batch.column("chunk_id").take(pa.array(order)))
            blank = pa.nulls(len(edge), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(edge), pa.string()), pa.array(block[order][edge]), pa.array(np.diff(np.append(edge, len(order)))), blank, blank, lists(place[order], edge), lists(size[order], edge), ids], schema=schema)
            # Postings: occurrences by row and term, then lists by block and term.
            words = max(1, len(coded.dictionary))
            held, tf = np.unique(row * words + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            if not len(held):
                continue
            row, term = held // words, held % words
            order = np.lexsort((place[row], term, block[row]))
            row, term, tf = row[order], term[order], tf[order]
            edge = np.flatnonzero((np.diff(block[row], prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(term[edge])), pa.array(block[row][edge]), pa.array(np.diff(np.append(edge, len(row)))), pa.array(np.maximum.reduceat(tf, edge), pa.int32()), pa.array(np.minimum.reduceat(size[row], edge), pa.int32()),
                 lists(place[row], edge), lists(tf, edge), pa.nulls(len(edge), schema.field("ids").type)], schema=schema)

    tokens = chunks.select("ord", "chunk_id", F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    sql = f"term string, block long, n long, top_tf int, least_length int, places array<int>, tfs array<int>, ids array<{id_type.simpleString()}>"
    return tokens.mapInArrow(run, sql).select(bucket(F.col("term")).alias("bucket"), "*")


def write(postings: DataFrame, path: str) -> None:
    """In a folder for each bucket, sorted by term; a bucket's rows are dealt by block too, so that a hot term is many tasks' work."""
    dealt = postings.repartition("bucket", F.expr("block div 256")).sortWithinPartitions("bucket", "term", "block")
    dealt.write.options(**CODEC).partitionBy("bucket").parquet(path)


class Postings:
    """Rows of one or more segments with what was deleted since.

    `rows` (segment, bucket, term, block, ...), `n` live chunks of `length` tokens; `gone` (segment, block, place)
    and `gone_terms` (bucket, term, n) are None where nothing was deleted.
    """

    def __init__(self, rows: DataFrame, n: int, length: int, gone: DataFrame | None = None, gone_terms: DataFrame | None = None):
        self.rows, self.n, self.length, self.gone, self.gone_terms = rows, n, length, gone, gone_terms

    def heads(self) -> DataFrame:
        """(segment, block, places, lengths, ids) of all blocks."""
        return self.rows.where("bucket = -1").select("segment", "block", "places", F.col("tfs").alias("lengths"), "ids")

    def document_frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df) of those `terms` (term) that live chunks hold."""
        wanted = terms.withColumn("bucket", bucket(F.col("term")))
        held = self.rows.select("bucket", "term", "n").join(F.broadcast(wanted), ["bucket", "term"], "left_semi")
        if self.gone_terms is not None:
            held = held.unionByName(self.gone_terms.join(F.broadcast(wanted), ["bucket", "term"], "left_semi").select("bucket", "term", (-F.col("n")).alias("n")))
        return held.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def search(self, queries: DataFrame, k: int, keep: DataFrame | None = None, k1: float = K1, b: float = B, pruned_from: int = PRUNED_FROM) -> DataFrame:
        """BM25 top k of `queries` (query_id, text): (query_id, chunk_id, score, rank), ties by chunk_id.

        `keep` (segment, block, place) names the chunks that may be found; statistics are of all live
        chunks. Queries go in blocks of at most QUERIES and BROADCAST_TERMS terms.
        """
        if k < 1:
            raise ValueError("k must be positive")
        if not (k1 >= 0 and 0 <= b <= 1):
            raise ValueError("k1 must be at least 0 and b in [0, 1]")
        terms = query_terms(queries)
        size = terms.agg(F.count("*"), F.countDistinct("query_id")).first()
        parts = max(1, -(-size[0] // BROADCAST_TERMS), -(-size[1] // QUERIES))
        found = [self._search(terms if parts == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k, keep, k1, b, pruned_from) for i in range(parts)]
        both = found[0]
        for part in found[1:]:
            both = both.unionByName(part)
        return top_k(both, k)

    def _search(self, terms: DataFrame, k: int, keep: DataFrame | None, k1: float, b: float, pruned_from: int) -> DataFrame:
        spark = self.rows.sparkSession
        asked = terms.toArrow()
        vocabulary = asked["term"].unique().to_pylist() if asked.num_rows else []
        wanted = spark.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.string()), "code": pa.array(range(len(vocabulary)), pa.int64())})).withColumn("bucket", bucket(F.col("term")))
        df = dict(self.document_frequencies(wanted.select("term")).toArrow().to_pandas().itertuples(index=False)) if vocabulary else {}
        weight = np.array([np.log(1 + (self.n - df[t] + 0.5) / (df[t] + 0.5)) if t in df else 0.0 for t in vocabulary])
        names = sorted(set(asked["query_id"].to_pylist())) if asked.num_rows else []
        number = {q: i for i, q in enumerate(names)}
        query_of = np.array([number[q] for q in asked["query_id"].to_pylist()], np.int64) if asked.num_rows else np.zeros(0, np.int64)
        code = pc.index_in(asked["term"].combine_chunks(), value_set=pa.array(vocabulary, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) if asked.num_rows else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        query_of, starts = query_of[order], np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
        mean = self.length / self.n if self.n and self.length else 1.0
        plan = spark.sparkContext.broadcast((names, weight, query_of, starts, mean, k1, b, dict(terms.dtypes)["query_id"]))
        # Heads are rows of their own bucket: only the wanted terms' buckets are read besides.
        buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]
        posted = self.rows.where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted), ["bucket", "term"]) if vocabulary else self.rows.where("false").withColumn("code", F.lit(0).cast("long"))
        lists = posted.select("segment", "block", "code", "places", "tfs")
        bounds = posted.select("segment", "block", "code", "top_tf", "least_length")
        if bounds.select("segment", "block").distinct().limit(pruned_from + 1).count() <= pruned_from:
            return self._scored(lists, keep, plan, k)
        first = _promising(bounds, plan)
        seeds = lists.join(F.broadcast(first), ["segment", "block"], "left_semi")  # at most FIRST blocks a query, QUERIES queries
        begun = self._scored(seeds, keep, plan, k)
        reached = top_k(begun, k).groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).toArrow()  # a row a query
        least = np.full(len(names), -np.inf)
        for q, s in zip(reached["query_id"].to_pylist(), reached["score"].to_pylist(), strict=True):
            least[number[q]] = s
        open_ = _over(bounds, plan, least).join(F.broadcast(first), ["segment", "block"], "left_anti")
        return begun.unionByName(self._scored(lists.join(open_, ["segment", "block"], "left_semi"), keep, plan, k))

    def _scored(self, lists: DataFrame, keep: DataFrame | None, plan: object, k: int) -> DataFrame:
        """The first k chunks of each query in each block of `lists`: (query_id, chunk_id, score)."""
        heads = self.heads()
        by = lambda df, name: df.groupBy("segment", "block").agg(F.collect_list("place").alias(name))  # noqa: E731 - at most BLOCK places
        heads = heads.withColumn("gone", F.lit(None).cast("array<int>")) if self.gone is None else heads.join(by(self.gone, "gone"), ["segment", "block"], "left")
        heads = heads.withColumn("kept", F.lit(None).cast("array<int>")) if keep is None else heads.join(by(keep, "kept"), ["segment", "block"])
        heads = heads.join(lists.select("segment", "block").distinct(), ["segment", "block"], "left_semi")
        heads = heads.toDF(*heads.columns)  # names of their own: both sides come from the same table
        id_type = dict(heads.dtypes)["ids"][len("array<") : -1]

        def score(rows: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
            names, weight, query, starts, mean, k1, b, _ = plan.value
            if not len(rows) or not len(head):
                return pd.DataFrame({"query": np.zeros(0, np.int64), "chunk_id": pd.Series([], dtype=object), "score": np.zeros(0)})
            length, ids, live = np.zeros(BLOCK), np.zeros(BLOCK, object), np.zeros(BLOCK, bool)
            for places, sizes, own in zip(head["places"], head["lengths"], head["ids"], strict=True):
                length[places], ids[places], live[places] = sizes, own, True
            for gone in head["gone"].dropna():
                live[gone] = False
            if not head["kept"].isna().all():
                kept = np.zeros(BLOCK, bool)
                kept[np.concatenate([np.asarray(x, np.int64) for x in head["kept"].dropna()])] = True
                live &= kept
            size = rows["places"].str.len().to_numpy()
            code = np.repeat(rows["code"].to_numpy(), size)
            place, tf = np.concatenate(rows["places"].to_list()), np.concatenate(rows["tfs"].to_list())
            on = live[place]
            code, place, tf = code[on], place[on], tf[on]
            gain = weight[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[place] / mean))
            times = starts[code + 1] - starts[code]
            asked = query[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[code], times)]
            cell, where = np.unique(asked * BLOCK + np.repeat(place, times), return_inverse=True)
            total = np.round(np.bincount(where, np.repeat(gain, times), len(cell)), DIGITS)
            out = pd.DataFrame({"query": cell // BLOCK, "chunk_id": pd.Series(ids[cell % BLOCK], dtype=object), "score": total})
            return out.sort_values(["query", "score", "chunk_id"], ascending=[True, False, True]).groupby("query", sort=False).head(k)

        found = lists.groupBy("segment", "block").cogroup(heads.groupBy("segment", "block")).applyInPandas(score, f"query long, chunk_id {id_type}, score double")
        names, plan_type = plan.value[0], plan.value[-1]
        spark = lists.sparkSession
        listed = spark.createDataFrame(pa.table({"query": pa.array(range(len(names)), pa.int64()), "query_id": pa.array(names) if names else pa.array([], pa.string())}))
        return found.join(F.broadcast(listed), "query").select(F.col("query_id").cast(plan_type).alias("query_id"), "chunk_id", "score")


def _bounds(rows: pd.DataFrame, plan: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of blocks of one segment: (query, index of its block, bound) of what meets, and the blocks."""
    _, weight, query, starts, mean, k1, b, _ = plan.value
    code, tf, least = rows["code"].to_numpy(), rows["top_tf"].to_numpy(), rows["least_length"].to_numpy()
    gain = weight[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * least / mean))
    blocks, at = np.unique(rows["block"].to_numpy(), return_inverse=True)
    times = starts[code + 1] - starts[code]
    asked = query[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[code], times)]
    cell, where = np.unique(asked * len(blocks) + np.repeat(at, times), return_inverse=True)
    return cell, np.bincount(where, np.repeat(gain, times), len(cell)), blocks


def _promising(bounds: DataFrame, plan: object) -> DataFrame:
    """(segment, block): the FIRST blocks of each query by bound."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        cell, bound, blocks = _bounds(rows, plan)
        out = pd.DataFrame({"query": cell // len(blocks), "segment": pd.Series([rows["segment"].iloc[0]] * len(cell), dtype=object), "block": blocks[cell % len(blocks)], "bound": bound})
        return out.sort_values(["query", "bound"], ascending=[True, False]).groupby("query", sort=False).head(FIRST)

    most = Window.partitionBy("query").orderBy(F.desc("bound"), "segment", "block")
    each = bounds.groupBy("segment", F.expr(f"block div {SIDE_BY_SIDE}")).applyInPandas(best, "query long, segment string, block long, bound double")
    return each.withColumn("nth", F.row_number().over(most)).where(F.col("nth") <= FIRST).select("segment", "block").distinct()


def _over(bounds: DataFrame, plan: object, least: np.ndarray) -> DataFrame:
    """(segment, block) of the blocks where some query may have a score that reaches its `least`, rounding allowed for."""
    shared = bounds.sparkSession.sparkContext.broadcast(least)

    def reaching(rows: pd.DataFrame) -> pd.DataFrame:
        cell, bound, blocks = _bounds(rows, plan)
        own = np.unique(cell[bound >= shared.value[cell // len(blocks)] - 2 * 10.0**-DIGITS] % len(blocks))
        return pd.DataFrame({"segment": pd.Series([rows["segment"].iloc[0]] * len(own), dtype=object), "block": blocks[own]})

    return bounds.groupBy("segment", F.expr(f"block div {SIDE_BY_SIDE}")).applyInPandas(reaching, "segment string, block long")
