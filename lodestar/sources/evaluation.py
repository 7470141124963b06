"""Evaluation sets, chunk files and reply caches as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import content_hash, document_id
from lodestar.sources.files import ingest


class BadSet(ValueError):
    """An evaluation set or file that does not hold together."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1 in each file.

    A file is read in splits; the lines of each split are counted, and what stands before a split is
    added up over the splits of its file, a row each. No file is read in one task.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "split", (before - F.col("first") + 1).alias("shift"))
    return rows.join(starts, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def _first_line(lines: DataFrame) -> str:
    """The first of some numbered lines, as FILE: line N."""
    found = lines.select("file", "line").orderBy("file", "line").first()
    return f"{found['file']}: line {found['line']}"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no JSON object is an error that names its file and number (only then are lines counted)."""
    rows = spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    wrong = rows.where("broken is not null").take(1)
    if wrong:
        same = numbered_lines(spark, path).where(F.trim("value") == wrong[0]["broken"].strip())
        raise BadSet(f"{_first_line(same)} is not a JSON object: {wrong[0]['broken'][:80]!r}")
    return rows.drop("broken")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) of a tab-separated file: lines without a whole-number grade (the header) and short lines are left out, of repeated pairs the last counts."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    parts = lines.select("at", F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    rows = parts.select("at", F.trim(F.col("p")[0]).alias("query_id"), F.trim(F.col("p")[1]).alias("doc_id"), F.expr("try_cast(trim(p[2]) AS int)").alias("grade")).where("grade is not null")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("grade", "at").alias("grade"))


def load_ranked_set(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, judgements) of a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv; queries without judgements are left out."""
    corpus = _json(spark, f"{root}/corpus.jsonl", "_id string, id string, title string, text string").select(F.coalesce("_id", "id").alias("doc_id"), "title", "text")
    judged = read_judgements(spark, f"{root}/qrels/{split}.tsv")
    queries = _json(spark, f"{root}/queries.jsonl", "_id string, id string, text string").select(F.coalesce("_id", "id").alias("query_id"), "text")
    return corpus, queries.join(judged.select("query_id").distinct(), "query_id", "left_semi"), judged


def as_documents(corpus: DataFrame, name: str) -> DataFrame:
    """Documents of a ranked set: title and text in one, not normalised, one section, `set_id` the id in the set."""
    text = F.concat_ws("\n\n", F.nullif(F.col("title"), F.lit("")), "text")
    source = F.concat(F.lit(f"{name}/"), "doc_id", F.lit(".txt"))
    docs = corpus.select(F.col("doc_id").alias("set_id"), "title", text.alias("text"), source.alias("source"))
    whole = F.array(F.struct(F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page")))
    return docs.select(document_id(name, F.col("source")).alias("doc_id"), "set_id", "title", "text", "source", content_hash(F.col("text")).alias("content_hash"), whole.alias("sections"))


def on_documents(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """Judgements with the documents' own ids; one about a document that is not there is an error."""
    known = docs.select("set_id", F.col("doc_id").alias("own")).distinct()
    lost = judged.join(known, judged["doc_id"] == known["set_id"], "left_anti").take(1)
    if lost:
        raise BadSet(f"judged but not there: {lost[0]['doc_id']}")
    return judged.join(known, judged["doc_id"] == known["set_id"]).select("query_id", F.col("own").alias("doc_id"), "grade")


def load_structured_set(spark: SparkSession, root: str, corpus: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, judgements) of a folder with docs/*.md and qrels.jsonl {query_id, text, relevant_docs, relevant_sections}; all grades are 1."""
    docs = ingest(spark, f"{root}/docs", corpus).where("skipped is null").withColumn("set_id", F.regexp_replace("source", r"\.[^./]+$", ""))
    rows = _json(spark, f"{root}/qrels.jsonl", "query_id string, text string, relevant_docs array<string>, relevant_sections array<array<string>>")
    wrong = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.size("relevant_docs"), F.lit(0))).alias("docs"), F.max(F.coalesce(F.size("relevant_sections") != F.size("relevant_docs"), F.lit(False))).alias("uneven"))
    bad = wrong.where("query_id is null or n > 1 or docs < 1 or uneven").take(1)
    if bad:
        raise BadSet(f"query {bad[0]['query_id']!r}: repeated, without documents, or with other sections than documents")
    judged = rows.select("query_id", F.explode("relevant_docs").alias("doc_id")).distinct().withColumn("grade", F.lit(1))
    return docs, rows.select("query_id", "text"), on_documents(judged, docs)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines."""
    return _json(spark, path, "chunk_id string, doc_id string, index long, text string, start_char long, end_char long, token_count long, heading_path array<string>, content_hash string, context_header string")


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """(key, content) of a reply cache; another format or two contents of one key are errors."""
    schema = "schema_version int, key string, model string, content string"
    rows = _json(spark, path, schema)
    lines = lambda: numbered_lines(spark, path).where("trim(value) <> ''").withColumn("x", F.from_json("value", schema))
    other = "schema_version is null or schema_version <> 1 or key is null or content is null"
    if rows.where(other).limit(1).count():
        raise BadSet(f"{_first_line(lines().select('file', 'line', 'x.*').where(other))} is an entry of another format")
    torn = rows.groupBy("key").agg(F.countDistinct("content").alias("n")).where("n > 1").take(1)
    if torn:
        own = lines().where(F.col("x.key") == torn[0]["key"])
        first = own.select(F.min_by("x.content", F.struct("file", "line")).alias("content")).first()["content"]
        raise BadSet(f"{_first_line(own.where(F.col('x.content') != first))} has another content for key {torn[0]['key']!r}")
    return rows.select("key", "content").distinct()


DOCUMENT_FILE = "doc_id string, corpus_id string, source string, title string, format string, text string, content_hash string, metadata string, sections array<struct<start_char:int,end_char:int,heading_path:array<string>,page:int>>"


def _once(docs: DataFrame, where: str) -> DataFrame:
    twice = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1)
    if twice:
        raise BadSet(f"{where}: doc_id {twice[0]['doc_id']!r} is missing or there twice")
    return docs


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as JSON lines; a doc_id that is missing or there twice is an error."""
    _once(docs, path).write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON lines, refused where a doc_id is missing or there twice, or a text does not have its hash."""
    docs = _once(_json(spark, path, DOCUMENT_FILE), path)
    changed = docs.where(content_hash(F.col("text")) != F.col("content_hash")).take(1)
    if changed:
        raise BadSet(f"{path}: the text of {changed[0]['doc_id']!r} is not what was hashed")
    return docs


def write_replies(replies: DataFrame, path: str) -> None:
    """Entries (key, model, content) added to a reply cache."""
    replies.select(F.lit(1).alias("schema_version"), "key", "model", "content").write.mode("append").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(mode, query_id, metric, value) of a per-query sidecar file; a mode that lacks one of its query_ids is an error."""
    whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    if whole.where("v is null or try_variant_get(v, '$.schema_version', 'int') is distinct from 1").limit(1).count():
        raise BadSet(f"{path}: another format")
    modes = whole.select(F.try_variant_get("v", "$.query_ids", "array<string>").alias("ids"), F.explode(F.try_variant_get("v", "$.modes", "map<string,map<string,map<string,double>>>")).alias("mode", "scores"))
    short = modes.where(F.array_sort(F.map_keys("scores")) != F.array_sort("ids")).take(1)
    if short:
        raise BadSet(f"{path}: mode {short[0]['mode']!r} was not scored on the file's queries")
    return modes.select("mode", F.explode("scores").alias("query_id", "own")).select("mode", "query_id", F.explode("own").alias("metric", "value"))
