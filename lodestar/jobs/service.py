"""Search over a saved index: one request or a table of queries, and the command line around it."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.jobs.options import MODES, Request, Settings, parse_filters, parse_weights
from lodestar.operators import answer, chunking, embedding, fusion, index, search
from lodestar.operators.store import Store, metadata_matches
from lodestar.sources.evaluation import write_documents
from lodestar.sources.files import ingest


class Index:
    """A loaded index. `chunks` has chunk_id, doc_id, text, embedding_text, embedding, and what filters name."""

    def __init__(self, chunks: DataFrame, embedder: str, k1: float = search.K1, b: float = search.B, store: Store | None = None):
        """`store` is the store that `chunks` are of; without one, lexical searches tokenize the chunks."""
        self.chunks, self.k1, self.b, self.store = chunks, k1, b, store
        self.embed = embedding.embedder(embedder)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        store = Store.open(spark, path)
        store.check()
        return cls(store.chunks(), store.manifest["embedder"], **store.manifest["bm25"], store=store)

    def _keep(self, filters: Mapping[str, object]) -> Column | None:
        """Chunks that meet all filters: on a column of the chunks, else on a field of their metadata; a field that neither has is never met."""
        keep = None
        for name, value in filters.items():
            if name in self.chunks.columns and name not in ("segment", "ord", "embedding"):
                own = search.matches(F.col(name), value, dict(self.chunks.dtypes)[name].startswith("array"))
            else:
                own = metadata_matches(F.col("metadata"), name, value) if "metadata" in self.chunks.columns else F.lit(False)
            keep = own if keep is None else keep & own
        return keep

    def lexical(self, asked: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
        """BM25 top k from the stored lists; of an index without a store, from the chunks' texts."""
        if self.store is None:
            return search.bm25_search(search.tokenized(self.chunks.drop("embedding", "text"), "embedding_text"), asked, k, keep, self.k1, self.b)
        places = None if keep is None else self.store.places(self.chunks.where(keep))
        return self.store.postings().search(asked, k, places, self.k1, self.b)

    def search(self, queries: DataFrame, options: Request, depth: int | None = None) -> DataFrame:
        """Hits of all `queries` (query_id, text) under the options (their own query is not used); `depth` hits of each in place of the options' k. A filter on a field that no chunk has finds nothing."""
        keep, k = self._keep(options.filters), depth or options.k
        asked = queries.where("trim(text) <> ''")
        pool = max(k, options.candidates or fusion.CANDIDATES) if options.mode == "hybrid" or options.rerank else k
        lists = {}
        if options.mode != "lexical":
            lists["dense"] = search.dense_search(self.chunks if keep is None else self.chunks.where(keep), asked.select("query_id", self.embed(F.col("text")).alias("embedding")), pool)
        if options.mode != "dense":
            lists["lexical"] = self.lexical(asked, pool, keep)
        if options.mode != "hybrid":
            hits = lists[options.mode].withColumn("retriever", F.lit(options.mode))
        elif options.fusion == "weighted":
            hits = fusion.weighted_score_fusion(lists, pool if options.rerank else k, options.weights)
        else:
            hits = fusion.reciprocal_rank_fusion(lists, pool if options.rerank else k, 60 if options.rrf_k is None else options.rrf_k, options.weights)
        if options.rerank:
            scorer = fusion.overlap_scorer(self.chunks.select("chunk_id", F.col("embedding_text").alias("text")), asked)
            hits = fusion.rerank(hits, scorer, k, pool, options.mode)
        return hits

    def provenance(self, hits: DataFrame) -> DataFrame:
        """`hits` with what a client is told of each chunk, as one struct without the null fields' guesses: ids, place, headings, pages (the last is the first where there is one only), source."""
        own = [c for c in ("doc_id", "source", "title", "format", "content_hash", "start_char", "end_char", "heading_path", "page", "page_end") if c in self.chunks.columns]
        last = {"page_end": F.coalesce("page_end", "page").alias("page_end")} if {"page", "page_end"} <= set(own) else {}
        told = self.chunks.select("chunk_id", "text", F.struct(*[last.get(c, F.col(c)) for c in own]).alias("provenance"))
        return hits.join(told, "chunk_id")

    def cited(self, queries: DataFrame, options: Request, sentences: int = answer.MAX_SENTENCES) -> DataFrame:
        """Citations of the extractive answers, with their places in the documents."""
        hits = self.search(queries, options).join(self.chunks.select("chunk_id", "text", *[c for c in ("format",) if c in self.chunks.columns]), "chunk_id")
        return answer.citations(answer.cited_sentences(queries, hits, sentences), self.chunks)

    def answer(self, queries: DataFrame, options: Request, sentences: int = answer.MAX_SENTENCES) -> DataFrame:
        hits = self.search(queries, options).join(self.chunks.select("chunk_id", "text"), "chunk_id")
        return answer.extractive_answers(queries, hits, sentences)


def build(spark: SparkSession, root: str, out: str, corpus: str, settings: Settings) -> dict:
    """Files to a saved index."""
    files = ingest(spark, root, corpus, settings.max_bytes)
    docs = files.where("skipped is null")
    config = chunking.Config(settings.strategy, settings.size, settings.overlap, settings.min_tokens)
    embed = embedding.embedder(settings.embedder)
    chunks = chunking.chunk_documents(docs, config).withColumn("embedding", embed(F.col("embedding_text")))
    chunks.write.mode("overwrite").parquet(f"{out}/building")  # embedded once; the checks and the copy read it
    done = spark.read.parquet(f"{out}/building")
    width = done.select(F.max(F.size("embedding"))).first()[0]
    if width is None:
        raise index.IndexFault("no chunks")
    return index.save(out, done, docs.drop("skipped"), settings.embedder, width)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("lodestar")
    commands = parser.add_subparsers(dest="command", required=True)
    read = commands.add_parser("ingest", help="read a folder of files; writes documents as JSON lines and prints what was left out and why")
    read.add_argument("root")
    read.add_argument("--out", required=True)
    read.add_argument("--corpus", default="default")
    tried = commands.add_parser("evaluate", help="measure retrieval over a ranked or structured evaluation set")
    tried.add_argument("index")
    tried.add_argument("--queries", required=True, help="Parquet (query_id, text)")
    tried.add_argument("--judged", required=True, help="Parquet (query_id, doc_id, grade)")
    tried.add_argument("--mode", action="append", default=[])
    tried.add_argument("--out", required=True)
    made = commands.add_parser("index", help="build an index from a folder of files")
    made.add_argument("root")
    made.add_argument("--out", required=True)
    made.add_argument("--corpus", default="default")
    for name in ("search", "answer"):
        one = commands.add_parser(name)
        one.add_argument("index")
        one.add_argument("query")
        one.add_argument("-k", type=int, default=5)
        one.add_argument("--mode", default="dense" if name == "search" else "hybrid")
        one.add_argument("--fusion")
        one.add_argument("--rrf-k", type=int)
        one.add_argument("--candidates", type=int)
        one.add_argument("--rerank", action="store_true")
        one.add_argument("--filter", action="append", default=[])
        one.add_argument("--weight", action="append", default=[])
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    try:
        if args.command == "index":
            print(json.dumps(build(spark, args.root, args.out, args.corpus, Settings.from_env())))
            return 0
        if args.command == "ingest":
            files = ingest(spark, args.root, args.corpus, Settings.from_env().max_bytes)
            write_documents(files.where("skipped is null").drop("skipped"), args.out)
            for row in files.where("skipped is not null").select("source", "skipped").toLocalIterator():
                print(f"{row['source']}: {row['skipped']}", file=sys.stderr)
            print(json.dumps({"documents": spark.read.text(args.out).count()}))
            return 0
        if args.command == "evaluate":
            from lodestar.jobs import evaluation

            metrics, report = evaluation.run(Index.load(spark, args.index), spark.read.parquet(args.queries), spark.read.parquet(args.judged), args.mode or MODES)
            evaluation.write_report(spark, report, f"{args.out}/report.json")
            evaluation.write_scores(metrics, f"{args.out}/scores")
            print(evaluation.as_markdown(report))
            return 0
        options = Request(args.query, args.k, args.mode, args.fusion, args.rrf_k, parse_weights(args.weight), args.candidates, args.rerank, parse_filters(args.filter))
        held = Index.load(spark, args.index)
        queries = spark.createDataFrame([("q", args.query)], "query_id string, text string")
        out = held.search(queries, options).orderBy("rank") if args.command == "search" else held.answer(queries, options)
        for row in out.toJSON().toLocalIterator():
            print(row)
        return 0
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
