"""Registered queries of the retrieval library: name -> (query, DuckDB SQL or None).

All run over whole tables. `documents` are the corpus (each a chunk unless it says otherwise),
`benchmark` the batch of questions, `embeddings` a vector store whose ids divisible by 100 ask.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.operators import answer, answer_eval, chunking, embedding, evaluate, fusion, generate, index, search
from lodestar.operators import postings as lists
from lodestar.operators.store import Store, metadata_matches
from lodestar.operators.tables import new_path, spread, stored
from lodestar.sources.evaluation import numbered_lines
from lodestar.sources.files import parse_pages
from lodestar.streaming.ingest import latency_by_window

K, POOL = 10, 50
CORPUS = "corpus"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _source() -> Column:
    return F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _hits(spark: SparkSession, d: str, k: int = POOL) -> DataFrame:
    return search.bm25_search(search.tokenized(_docs(spark, d)), _asked(spark, d), k)


def _overlap(spark: SparkSession, d: str, k: int = POOL) -> DataFrame:
    """A second list: documents by the number of distinct query terms they hold."""
    terms = search.query_terms(_asked(spark, d))
    wanted = search.bounded(terms.select("term").distinct(), search.BROADCAST_TERMS)
    held = _docs(spark, d).select("chunk_id", F.explode(F.array_distinct(X.bm25_tokens(F.col("text")))).alias("term")).join(wanted, "term", "left_semi")
    return search.top_k(held.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.count("*").cast("double").alias("score")), k)


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    """A document is relevant to an item that it shares eight tokens in a row with; more so (grade 2) if its quality label is 1."""
    grams = lambda df, name: df.where(F.size("t") >= 8).select(name, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("t") - 7), lambda i: F.array_join(F.slice("t", i, 8), " ")))).alias("gram"))
    asked = grams(_asked(spark, d).select("query_id", X.bm25_tokens(F.col("text")).alias("t")), "query_id")
    held = grams(_docs(spark, d).select("chunk_id", X.bm25_tokens(F.col("text")).alias("t")), "chunk_id")
    pairs = held.join(search.bounded(asked, search.BROADCAST_TERMS), "gram").select("query_id", F.col("chunk_id").alias("doc_id")).distinct()
    good = _table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("good")).distinct()
    return pairs.join(good, "doc_id", "left").select("query_id", "doc_id", (1 + F.coalesce("good", F.lit(0))).alias("grade"))


# SQL shared by several oracles.
TOK = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"


def tok(column: str) -> str:
    return TOK.format(column)


def bm25_sql(docs: str = "SELECT doc_id AS chunk_id, lang, text FROM documents", keep: str = "true", k: int = POOL) -> str:
    """CTEs up to `hits` (query_id, chunk_id, score, rank)."""
    return f"""
docs AS ({docs}),
tk AS (SELECT chunk_id, {tok('text')} AS t FROM docs),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)::DOUBLE) AS avgdl FROM tk),
q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark)),
p AS (SELECT chunk_id, term, dl, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tk) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term),
sc AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM p JOIN w USING (term) JOIN q USING (term), st GROUP BY 1, 2),
hits AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc JOIN docs USING (chunk_id) WHERE {keep}) WHERE rank <= {k})"""


OVERLAP_SQL = f"""
ov AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
  (SELECT query_id, chunk_id, count(*)::DOUBLE AS score FROM p JOIN q USING (term) GROUP BY 1, 2)) WHERE rank <= {POOL})"""

QRELS_SQL = """
head AS (SELECT DISTINCT query_id, array_to_string(t[i:i + 7], ' ') AS gram FROM (SELECT item_id AS query_id, t, unnest(generate_series(1, len(t) - 7)) AS i FROM (SELECT item_id, """ + tok("text") + """ AS t FROM benchmark) WHERE len(t) >= 8)),
gr AS (SELECT chunk_id, array_to_string(t[i:i + 7], ' ') AS gram FROM (SELECT chunk_id, t, unnest(generate_series(1, len(t) - 7)) AS i FROM tk WHERE len(t) >= 8)),
qr AS (SELECT DISTINCT query_id, chunk_id AS doc_id, CASE WHEN chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 2 ELSE 1 END AS grade FROM gr JOIN head USING (gram))"""

CHUNK_SQL = """SELECT doc_id, idx, i, n, size, ltrim(raw, E' \\n\\t\\r') AS text, before + length(raw) - length(ltrim(raw, E' \\n\\t\\r')) AS start_char FROM (
  SELECT doc_id, i // step AS idx, i, n, size, array_to_string(p[i + 1:i + size], '') AS raw, length(array_to_string(p[1:i], '')) AS before FROM (
    SELECT doc_id, p, len(p) AS n, {size} AS size, {step} AS step, unnest(generate_series(0, greatest(len(p) - {overlap} - 1, 0), {step})) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '\\s*\\S+') AS p FROM documents) WHERE len(p) > 0))"""


def chunk_sql(size: int, overlap: int) -> str:
    return CHUNK_SQL.format(size=size, overlap=overlap, step=size - overlap)


# --- identities and text ---------------------------------------------------------------------


def doc_ids_hashes(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", X.document_id(CORPUS, _source()).alias("document_id"), X.content_hash(F.col("text")).alias("content_hash"), X.valid_source(_source()).alias("valid_source"))


DOC_IDS_SQL = f"""SELECT doc_id, substr(sha256('{CORPUS}:' || s), 1, 16) AS document_id, sha256(text) AS content_hash, regexp_full_match(s, '[^/\\\\]+(/[^/\\\\]+)*') AND NOT regexp_matches(s, '(^|/)[.]{{1,2}}(/|$)') AS valid_source FROM (SELECT *, 'src/' || doc_id || '.txt' AS s FROM documents)"""


def duplicate_documents(spark, d):
    """Documents whose content an earlier path holds already."""
    docs = _table(spark, d, "documents").select(_source().alias("source"), X.content_hash(F.col("text")).alias("h"), F.split(_source(), "/").alias("path"))
    first = docs.groupBy("h").agg(F.min("path").alias("least"))
    return docs.join(first, "h").where("path <> least").select("source", F.array_join("least", "/").alias("duplicate_of"))


DUPLICATES_SQL = """SELECT source, first AS duplicate_of FROM (SELECT source, first_value(source) OVER (PARTITION BY h ORDER BY string_split(source, '/')) AS first FROM
  (SELECT 'src/' || doc_id || '.txt' AS source, sha256(text) AS h FROM documents)) WHERE source <> first"""


def corpus_slugs(spark, d):
    return _table(spark, d, "documents").select("source", "lang").distinct().select(F.concat_ws(" ", F.upper("source"), "lang").alias("name")).select("name", X.corpus_slug(F.col("name")).alias("slug"), X.valid_corpus_id(X.corpus_slug(F.col("name"))).alias("valid"))


SLUGS_SQL = """SELECT name, slug, regexp_full_match(slug, '[a-z0-9][a-z0-9._-]{0,63}') AS valid FROM (SELECT name, substr(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9._-]+', '-', 'g'), '^[^a-z0-9]+', ''), '-+$', ''), 1, 64) AS slug FROM
  (SELECT DISTINCT upper(source) || ' ' || lang AS name FROM documents))"""


def normalized_text(spark, d):
    docs = _table(spark, d, "documents")
    text = X.normalize(F.col("text"))
    return docs.select("doc_id", X.content_hash(text).alias("normalized_hash"), F.length(text).cast("long").alias("length"))


_N = "regexp_replace(regexp_replace(text, '(\\S)[ \\t]{2,}(\\S)', '\\1 \\2', 'g'), '(\\S)[ \\t]{2,}(\\S)', '\\1 \\2', 'g')"
NORMALIZED_SQL = f"""SELECT doc_id, sha256(t) AS normalized_hash, length(t) AS length FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace({_N}, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), E' \\n\\t') AS t FROM documents)"""


def token_counts(spark, d):
    return chunking.tokens_per_document(_table(spark, d, "documents"))


TOKENS_SQL = r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_tokens FROM documents"


def broken_lines(spark, d):
    """Documents as JSON lines, some of them cut short, and read with their places: how many of the lines, the broken ones and the distinct places there are."""
    path = new_path(spark, "lines")
    line = F.to_json(F.struct("doc_id", "text"))
    _table(spark, d, "documents").select(F.when(F.col("doc_id") % 97 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    lines = numbered_lines(spark, path)
    broken = F.from_json("value", "doc_id long, text string, broken string", {"columnNameOfCorruptRecord": "broken"})["broken"].isNotNull()
    each = lines.groupBy("file").agg(F.count("*").alias("n"), F.count_if(broken).alias("broken"), F.countDistinct("line").alias("places"), F.max("line").alias("last"))
    return each.agg(F.sum("n").alias("n_lines"), F.sum("broken").alias("n_broken"), F.sum("places").alias("n_places"), F.sum("last").alias("last_lines"))


BROKEN_SQL = "SELECT count(*) AS n_lines, count(*) FILTER (WHERE doc_id % 97 = 0) AS n_broken, count(*) AS n_places, count(*) AS last_lines FROM documents"

# --- chunks ----------------------------------------------------------------------------------


def _fixed(spark, d, size=512, overlap=64):
    return chunking.fixed_chunks(_table(spark, d, "documents").select("doc_id", "text"), size, overlap)


def fixed_chunks(spark, d):
    return _fixed(spark, d).select("doc_id", "index", X.content_hash(F.col("text")).alias("text_hash"), "start_char", "end_char", "token_count")


FIXED_SQL = f"SELECT doc_id, idx AS index, sha256(text) AS text_hash, start_char, start_char + length(text) AS end_char, least(n - i, size)::BIGINT AS token_count FROM ({chunk_sql(512, 64)})"


def chunk_statistics(spark, d):
    return chunking.chunk_stats(_fixed(spark, d))


CHUNK_STATS_SQL = f"""SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, sum(c)::BIGINT AS tokens, min(c) AS least, round(avg(c), 2) AS mean, round(quantile_cont(c, 0.5), 2) AS p50,
  round(quantile_cont(c, 0.95), 2) AS p95, max(c) AS most FROM (SELECT doc_id, least(n - i, size)::BIGINT AS c FROM ({chunk_sql(512, 64)}))"""


def verify_chunks(spark, d):
    """Faults of chunks that were tampered with, by the chunk's index: text, offsets, document."""
    docs = _table(spark, d, "documents").select("doc_id", "text")
    chunks = _fixed(spark, d, 128, 16).join(docs.select("doc_id", X.content_hash(F.col("text")).alias("content_hash")), "doc_id")
    chunks = chunks.withColumn("chunk_id", X.chunk_id(F.col("doc_id").cast("string"), F.col("content_hash"), F.col("start_char"), F.col("end_char")))
    kind = F.col("index") % 5
    bad = chunks.withColumn("text", F.when(kind == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    bad = bad.withColumn("end_char", F.when(kind == 2, F.lit(10_000_000)).otherwise(F.col("end_char"))).withColumn("doc_id", F.when(kind == 3, -1 - F.col("doc_id")).otherwise(F.col("doc_id")))
    bad = bad.withColumn("content_hash", F.when(kind == 4, F.lit("0")).otherwise(F.col("content_hash")))
    return chunking.verify(bad, docs).groupBy("reason").agg(F.count("*").alias("n"))


VERIFY_SQL = f"""SELECT CASE idx % 5 WHEN 1 THEN 'text differs' WHEN 2 THEN 'out of bounds' WHEN 3 THEN 'unknown document' ELSE 'other content' END AS reason, count(*) AS n
  FROM ({chunk_sql(128, 16)}) WHERE idx % 5 > 0 GROUP BY 1"""


def section_crossing(spark, d):
    """Chunks of 64 tokens against paragraphs, a paragraph being a line of the document."""
    docs = _table(spark, d, "documents").select("doc_id", "text")
    lines = F.split("text", "\n")
    each = docs.select("doc_id", F.posexplode(lines).alias("nth", "line"))
    before = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("doc_id", F.coalesce(F.sum(F.length("line").cast("long") + 1).over(before), F.lit(0)).alias("start"))
    return chunking.section_crossing(_fixed(spark, d, 64, 8), starts)


def page_section_crossing(spark, d):
    """Chunks of 64 tokens of the pages' converted text against their own sections, by page language."""
    pages = parse_pages(_table(spark, d, "pages")).select(F.col("page_id").alias("doc_id"), "text", "sections")
    starts = pages.select("doc_id", F.explode("sections.start_char").alias("start"))
    return chunking.section_crossing(chunking.fixed_chunks(pages.select("doc_id", "text"), 64, 8), starts)


CROSSING_SQL = f"""SELECT count(*) AS chunks, count(*) FILTER (WHERE contains(text, E'\\n')) AS crossing, round(count(*) FILTER (WHERE contains(text, E'\\n')) / count(*), 6) AS rate FROM ({chunk_sql(64, 8)})"""


def _documents(spark, d):
    """Documents as the chunker takes them: one section, no title."""
    whole = F.array(F.struct(F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page")))
    return _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), "text", whole.alias("sections"))


def recursive_chunks(spark, d):
    return chunking.chunk_documents(_documents(spark, d), chunking.Config("recursive", 128, 16, 16)).select("doc_id", "chunk_id", "index", "start_char", "end_char", "token_count")


def structure_chunks(spark, d):
    """Pages, converted, cut along their headings."""
    pages = parse_pages(_table(spark, d, "pages")).select(F.col("page_id").cast("string").alias("doc_id"), "title", "text", "sections")
    return chunking.chunk_documents(pages).select("doc_id", "chunk_id", "index", "start_char", "end_char", "token_count", "heading_path", "context_header")


def html_pages(spark, d):
    pages = parse_pages(_table(spark, d, "pages"))
    return pages.select("page_id", "title", "language", "heading_count", F.size("sections").cast("long").alias("n_sections"), F.length("text").cast("long").alias("n_chars"), X.content_hash(F.col("text")).alias("content_hash"))


# --- lexical search --------------------------------------------------------------------------


def postings(spark, d):
    """Postings by frequency: how many (term, document) pairs hold the term so often."""
    return search.postings(search.tokenized(_docs(spark, d))).groupBy("tf").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"))


POSTINGS_SQL = f"SELECT tf, count(*) AS n, count(DISTINCT term) AS terms FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1"


def term_stats(spark, d):
    tokens = search.tokenized(_docs(spark, d))
    return search.term_stats(search.postings(tokens), search.corpus_stats(tokens)).select("term", "df", F.round("idf", 9).alias("idf"))


TERM_STATS_SQL = f"""WITH t AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents)), c AS (SELECT count(*)::DOUBLE AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM t, c GROUP BY term"""


def corpus_stats(spark, d):
    return search.corpus_stats(search.tokenized(_docs(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


CORPUS_SQL = f"SELECT count(*) AS n, round(avg(len({tok('text')})::DOUBLE), 6) AS avgdl FROM documents"


def bm25_topk(spark, d):
    return _hits(spark, d, K)


def bm25_topk_filtered(spark, d):
    return search.bm25_search(search.tokenized(_docs(spark, d)), _asked(spark, d), K, search.matches(F.col("lang"), ["de", "fr"]))


def _stored(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "lang", "text", F.col("doc_id").alias("ord"))


def bm25_after_upsert(spark, d):
    """Every tenth document is replaced by its first line."""
    old = _stored(spark, d)
    new = old.where("doc_id % 10 = 0").withColumn("text", F.substring_index("text", "\n", 1))
    kept = index.upsert(old, new, True).select("chunk_id", "lang", "text")
    return search.bm25_search(search.tokenized(kept), _asked(spark, d), K)


def bm25_after_delete(spark, d):
    old = _stored(spark, d)
    kept = index.delete(old, old.where("lang = 'es'")).select("chunk_id", "lang", "text")
    return search.bm25_search(search.tokenized(kept), _asked(spark, d), K)


# --- the index on disk -----------------------------------------------------------------------


def _written(spark, d):
    """Posting lists of all documents, written and read again."""
    path = new_path(spark, "postings")
    lists.write(lists.build(_docs(spark, d).withColumn("ord", F.monotonically_increasing_id()), "text"), path)
    rows = spark.read.parquet(path).withColumn("segment", F.lit("all"))
    n, length = lists.Postings(rows, 0, 0).heads().agg(F.sum(F.size("places")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return lists.Postings(rows, n or 0, length or 0)


def bm25_from_index(spark, d):
    return _written(spark, d).search(_asked(spark, d), K)


def bm25_pruned(spark, d):
    """As `bm25_from_index`, every block that cannot hold a hit left unread however few there are."""
    return _written(spark, d).search(_asked(spark, d), K, pruned_from=0)


def _as_chunks(docs):
    """Each document (doc_id, lang, text) that is not empty as one chunk, with a vector of two figures."""
    vector = F.array(F.length("text").cast("double"), F.lit(1.0))
    return docs.where("length(text) > 0").select("doc_id", F.col("doc_id").alias("chunk_id"), X.content_hash(F.col("text")).alias("content_hash"), F.lit(0).cast("long").alias("start_char"), F.length("text").cast("long").alias("end_char"), "text", F.col("text").alias("embedding_text"), vector.alias("embedding"))


def _versions(spark, d):
    """An index of all documents but every tenth; those come and others shrink to their first line; then Spanish ones go."""
    docs, path = _table(spark, d, "documents").select("doc_id", "lang", "text"), new_path(spark, "index")
    old = docs.where("doc_id % 10 <> 3")
    new = docs.where("doc_id % 10 in (2, 3)").withColumn("text", F.when(F.expr("doc_id % 10 = 2"), F.substring_index("text", "\n", 1)).otherwise(F.col("text")))
    first = Store.create(spark, path, _as_chunks(old), old, "none", 2)
    return first.upsert(_as_chunks(new), new).delete(docs.where("lang = 'es'"))


def index_versions(spark, d):
    """What each version holds, read from its own manifest and tables; the last is compacted."""
    last, removed = _versions(spark, d)
    compact = last.compact()
    compact.check()
    held = [Store.open(spark, last.path, v) for v in (1, 2, 3, 4)]
    rows = [s.chunks().agg(F.count("*").alias("chunks"), F.sum(F.length("text").cast("long")).alias("chars")).crossJoin(s.documents().agg(F.count("*").alias("documents"))).select(
        F.lit(s.manifest["version"]).cast("long").alias("version"), "chunks", "chars", "documents", F.lit(s.manifest["tokens"]).cast("long").alias("tokens"), F.lit(removed if s.manifest["version"] == 3 else 0).cast("long").alias("removed")) for s in held]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


_SECOND = "SELECT doc_id, lang, CASE WHEN doc_id % 10 = 2 THEN string_split(text, chr(10))[1] ELSE text END AS text FROM documents"
VERSIONS_SQL = f"""WITH second AS ({_SECOND}), third AS (SELECT * FROM second WHERE lang IS DISTINCT FROM 'es'),
v AS (SELECT 1 AS version, * FROM (SELECT doc_id, lang, text FROM documents WHERE doc_id % 10 <> 3) UNION ALL SELECT 2, * FROM second UNION ALL SELECT 3, * FROM third UNION ALL SELECT 4, * FROM third)
SELECT version::BIGINT AS version, count(*) FILTER (WHERE text <> '') AS chunks, sum(length(text))::BIGINT AS chars, count(*) AS documents, sum(len({tok('text')}))::BIGINT AS tokens,
  CASE WHEN version = 3 THEN (SELECT count(*) FROM second WHERE lang = 'es' AND text <> '') ELSE 0 END::BIGINT AS removed FROM v GROUP BY version"""


def bm25_from_versions(spark, d):
    """Search of an index whose lists stand in two segments, with chunks deleted from both."""
    store, _ = _versions(spark, d)
    return store.postings().search(_asked(spark, d), K)


def index_drift(spark, d):
    """Total lengths that an index holds, and that two tokenizers cut from its chunks; an index opens only with its own."""
    docs, path = _table(spark, d, "documents").select("doc_id", "lang", "text"), new_path(spark, "index")
    store, rows = Store.create(spark, path, _as_chunks(docs), docs, "none", 2), []
    for name, cut in (("own", X.bm25_tokens), ("blanks", lambda c: F.regexp_extract_all(c, F.lit("[^ \\n\\t\\r]+"), F.lit(0)))):
        held, now = store.drift(cut)
        try:
            Store.open(spark, path, tokenizer=cut)
            refused = False
        except index.IndexFault:
            refused = True
        rows.append((name, held, now, refused))
    return spark.createDataFrame(rows, "tokenizer string, stored long, cut long, refused boolean")


DRIFT_SQL = f"""WITH t AS (SELECT sum(len({tok('text')}))::BIGINT AS own, sum(len(regexp_extract_all(text, '[^ \n\t\r]+')))::BIGINT AS blanks FROM documents)
SELECT 'own' AS tokenizer, own AS stored, own AS cut, false AS refused FROM t UNION ALL SELECT 'blanks', own, blanks, true FROM t"""


def metadata_filter(spark, d):
    """Filters of each kind on fields of the documents' metadata as JSON."""
    fields = F.to_json(F.struct("lang", "n_chars", (F.col("doc_id") % 2 == 0).alias("even"), F.array("lang", "source").alias("tags"), F.when(F.expr("doc_id % 3 = 0"), "7").alias("seven"), F.when(F.expr("doc_id % 3 = 1"), 7.0).alias("number")))
    wanted = {"by_text": ("lang", "de"), "by_any": ("lang", ["fr", "es", 5]), "by_number": ("n_chars", [500, 600, 700, 800]), "by_truth": ("even", True), "by_overlap": ("tags", ["en", "src3"]), "not_a_number": ("seven", 7), "a_number": ("number", 7), "missing": ("nothing", "de")}
    return _table(spark, d, "documents").select("doc_id", *[metadata_matches(fields, key, value).alias(name) for name, (key, value) in wanted.items()])


METADATA_SQL = """SELECT doc_id, coalesce(lang = 'de', false) AS by_text, coalesce(lang IN ('fr', 'es'), false) AS by_any, coalesce(n_chars IN (500, 600, 700, 800), false) AS by_number, doc_id % 2 = 0 AS by_truth,
  coalesce(lang = 'en', false) OR coalesce(source = 'src3', false) AS by_overlap, false AS not_a_number, doc_id % 3 = 1 AS a_number, false AS missing FROM documents"""


# --- dense search ----------------------------------------------------------------------------


def _vectors(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", "embedding")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def dense_topk(spark, d):
    return search.dense_search(_vectors(spark, d), _vector_queries(spark, d), K)


def dense_topk_label_filter(spark, d):
    return search.dense_search(_vectors(spark, d).where(search.matches(F.col("label"), [1, 2, 3])), _vector_queries(spark, d), K)


def dense_sql(keep: str) -> str:
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS s FROM v)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS query_id, n.vec_id AS chunk_id, round(list_dot_product(q.e, n.e) / (q.s * n.s), 6) AS score FROM n AS q, n WHERE q.vec_id % 100 = 0 AND q.s > 0 AND {keep})) WHERE rank <= {K}"""


def l2_norms(spark, d):
    unit = search.l2_normalize(F.col("embedding"))
    return _vectors(spark, d).select("chunk_id", F.round(search.norm(F.col("embedding")), 5).alias("norm"), F.round(search.norm(unit), 9).alias("unit_norm"), search.valid_vector(F.col("embedding"), 64).alias("valid"))


L2_SQL = """SELECT vec_id AS chunk_id, round(s, 5) AS norm, round(sqrt(list_sum(list_transform(e, lambda x: (x / s) * (x / s)))), 9) AS unit_norm, len(e) = 64 AND list_bool_and(list_transform(e, lambda x: isfinite(x))) AS valid FROM (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))"""


def hashing_embeddings(spark, d):
    embed = embedding.hashing_embedder()
    return _docs(spark, d).select("chunk_id", embed(F.col("text")).alias("e")).select("chunk_id", F.size("e").cast("long").alias("dimension"), F.round(search.norm(F.col("e")), 4).alias("norm"))


def hybrid_search(spark, d):
    """Lexical and hashed dense lists over all documents, fused by rank."""
    embed = embedding.hashing_embedder()
    asked = _asked(spark, d)
    dense = search.dense_search(_docs(spark, d).select("chunk_id", embed(F.col("text")).alias("embedding")), asked.select("query_id", embed(F.col("text")).alias("embedding")), POOL)
    hits = fusion.reciprocal_rank_fusion({"dense": dense, "lexical": _hits(spark, d)}, K)
    return hits.select("query_id", "chunk_id", "score", "rank", "retriever")


# --- fusion and reranking --------------------------------------------------------------------


def _lists(spark, d):
    return {"bm25": _hits(spark, d), "overlap": _overlap(spark, d)}


def _flat(hits):
    return hits.select("query_id", "chunk_id", "score", "rank", F.col("ranks")["bm25"].alias("bm25_rank"), F.col("ranks")["overlap"].alias("overlap_rank"))


def rrf_fusion(spark, d):
    return _flat(fusion.reciprocal_rank_fusion(_lists(spark, d), K))


def rrf_weighted_lists(spark, d):
    return _flat(fusion.reciprocal_rank_fusion(_lists(spark, d), K, 20, {"overlap": 0.5}))


def minmax_fusion(spark, d):
    return _flat(fusion.weighted_score_fusion(_lists(spark, d), K, {"bm25": 2.0, "overlap": 0.5}))


def fused_sql(part: str) -> str:
    return f"""WITH {bm25_sql()}, {OVERLAP_SQL},
l AS (SELECT 'bm25' AS list, 0 AS place, * FROM hits UNION ALL SELECT 'overlap', 1, * FROM ov),
m AS (SELECT *, min(score) OVER (PARTITION BY query_id, list) AS lo, max(score) OVER (PARTITION BY query_id, list) AS hi FROM l),
f AS (SELECT query_id, chunk_id, round(sum({part}), 9) AS score, min(rank) AS best, min(place * 1099511627776 + rank) AS seen, max(CASE WHEN place = 0 THEN rank END) AS bm25_rank, max(CASE WHEN place = 1 THEN rank END) AS overlap_rank FROM m GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, seen) AS rank, bm25_rank, overlap_rank FROM f) WHERE rank <= {K}"""


def rerank_overlap(spark, d):
    docs, asked = _docs(spark, d).select("chunk_id", "text"), _asked(spark, d)
    hits = fusion.rerank(_hits(spark, d), fusion.overlap_scorer(docs, asked), K, POOL, "lexical")
    return hits.select("query_id", "chunk_id", "score", "rank", F.col("components")["lexical"].alias("lexical_score"), F.col("ranks")["lexical"].alias("lexical_rank"))


RERANK_SQL = f"""WITH {bm25_sql()}, nt AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
r AS (SELECT h.query_id, h.chunk_id, h.score AS lexical_score, h.rank AS lexical_rank, round(count(p.term) / any_value(nt.n), 6) AS score FROM hits h JOIN nt USING (query_id) JOIN q USING (query_id) LEFT JOIN p ON p.chunk_id = h.chunk_id AND p.term = q.term GROUP BY ALL)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical_rank) AS rank, lexical_score, lexical_rank FROM r) WHERE rank <= {K}"""

# --- evaluation ------------------------------------------------------------------------------


def _ranked(hits):
    return hits.select("query_id", F.col("chunk_id").alias("doc_id"), "rank")


def retrieval_metrics(spark, d):
    scores = evaluate.score_queries(_ranked(_hits(spark, d)), _qrels(spark, d))
    return scores.select("query_id", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in scores.columns if c != "query_id"])


def metrics_sql(hits: str) -> str:
    recall = ", ".join(f"round(count(*) FILTER (WHERE rank <= {k}) / count(*), 6) AS \"recall@{k}\", CASE WHEN count(*) FILTER (WHERE rank <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"hit@{k}\"" for k in evaluate.KS)
    return f"""SELECT query_id, {recall}, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rank <= 10), 0), 6) AS "mrr@10",
  round(coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) / sum((2 ** grade - 1) / log2(ideal + 1)) FILTER (WHERE ideal <= 10), 6) AS "ndcg@10"
FROM (SELECT qr.query_id, grade, rank, row_number() OVER (PARTITION BY qr.query_id ORDER BY grade DESC, qr.doc_id) AS ideal FROM qr LEFT JOIN {hits} h ON h.query_id = qr.query_id AND h.chunk_id = qr.doc_id) GROUP BY 1"""


def _both_modes(spark, d):
    qrels = _qrels(spark, d)
    lists = _lists(spark, d)
    both = [evaluate.long_form(evaluate.score_queries(_ranked(hits), qrels), mode) for mode, hits in lists.items()]
    return both[0].unionByName(both[1])


def metrics_macro(spark, d):
    return evaluate.macro(_both_modes(spark, d), 5)


_METRICS = ", ".join(f'"{m}@{k}"' for k in evaluate.KS for m in ("recall", "hit")) + ', "mrr@10", "ndcg@10"'
MACRO_SQL = f"""WITH {bm25_sql()}, {OVERLAP_SQL}, {QRELS_SQL}, a AS ({metrics_sql('hits')}), b AS ({metrics_sql('ov')}),
u AS (SELECT 'bm25' AS mode, * FROM a UNION ALL SELECT 'overlap', * FROM b)
SELECT mode, metric, round(avg(value), 5) AS mean, count(*) AS n FROM (UNPIVOT u ON {_METRICS} INTO NAME metric VALUE value) GROUP BY 1, 2"""


def bootstrap_ci(spark, d):
    return evaluate.bootstrap(evaluate.compare_modes(_both_modes(spark, d), "bm25", "overlap"), ["metric"], 2000)


def query_partition_counts(spark, d):
    return evaluate.query_kinds(_asked(spark, d), _qrels(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


KINDS_SQL = f"WITH tk AS (SELECT doc_id AS chunk_id, {tok('text')} AS t FROM documents), {QRELS_SQL} SELECT CASE WHEN item_id IN (SELECT query_id FROM qr) THEN 'scored' ELSE 'unlabelled' END AS kind, count(*) AS n FROM benchmark GROUP BY 1"


def overfetch_depth(spark, d):
    """Depth at which chunks of 128 tokens give ten documents, from 10 on, doubled up to 160."""
    chunks = _fixed(spark, d, 128, 16).select((F.col("doc_id") * 100_000 + F.col("index")).alias("chunk_id"), "text")
    hits = search.bm25_search(search.tokenized(chunks), _asked(spark, d), 160)
    return evaluate.enough_depth(hits.withColumn("doc_id", F.expr("chunk_id div 100000")), K, 10, 160)


OVERFETCH_SQL = f"""WITH {bm25_sql(f"SELECT doc_id * 100000 + idx AS chunk_id, text FROM ({chunk_sql(128, 16)})", k=160)},
s AS (SELECT query_id, unnest([10, 20, 40, 80, 160]) AS depth FROM (SELECT DISTINCT query_id FROM hits)),
c AS (SELECT s.query_id, depth, count(*) AS n, count(DISTINCT chunk_id // 100000) AS docs FROM s JOIN hits h ON h.query_id = s.query_id AND h.rank <= s.depth GROUP BY 1, 2),
g AS (SELECT query_id, min(depth) AS depth FROM c WHERE docs >= 10 OR n < depth OR depth = 160 GROUP BY 1)
SELECT query_id, depth::BIGINT AS depth, least(docs, 10)::BIGINT AS n_docs, docs < 10 AS short FROM g JOIN c USING (query_id, depth)"""


def latency_percentiles(spark, d):
    """The event log as a request log: nearest-rank percentiles by type."""
    return _table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), evaluate.nearest_rank("value", 0.5).alias("p50"), evaluate.nearest_rank("value", 0.95).alias("p95"))


LATENCY_SQL = "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"


def latency_windows(spark, d):
    return latency_by_window(_table(spark, d, "events")).select("start", "event_type", "n", "mean")


WINDOWS_SQL = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"


def wilson_by_group(spark, d):
    """Share of good documents by language, with its interval."""
    rows = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    counts = rows.groupBy("lang").agg(F.count("quality").alias("n"), F.sum("quality").alias("good"))
    low, high = evaluate.wilson(F.col("good"), F.col("n"))
    return counts.select("lang", "n", "good", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_Z = "1.959963984540054::DOUBLE"
WILSON_SQL = f"""SELECT lang, n, good, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * (1)) / (1 + z * z / n)), 9) AS low,
  round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high
FROM (SELECT lang, count(quality) AS n, sum(quality)::BIGINT AS good, sum(quality) / count(quality) AS p, {_Z} AS z FROM labels JOIN documents USING (doc_id) GROUP BY 1)"""

# --- answers ---------------------------------------------------------------------------------


def _read_hits(spark, d, k=5):
    return _hits(spark, d, k).join(_docs(spark, d).select("chunk_id", "text"), "chunk_id")


def extractive_answers(spark, d):
    return answer.extractive_answers(_asked(spark, d), _read_hits(spark, d))


def extractive_citations(spark, d):
    return answer.cited_sentences(_asked(spark, d), _read_hits(spark, d)).select("query_id", "place", "chunk_id", "offset", "sentence", F.round("score", 6).alias("score"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def words_sql(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(replace(lower({column}), 'ß', 'ss'), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})))"


# Sentences in SQL: pieces that begin with the white space before them, so that lengths add up to offsets.
SPLIT = "string_split(regexp_replace(text, '([.!?])(\\s+)', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
TRIMMED = "trim(s[i], E' \\n\\t\\r')"
BEGIN = "(coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0) + length(s[i]) - length(ltrim(s[i], E' \\n\\t\\r')))::BIGINT"

CITED_SQL = f"""{bm25_sql(k=5)},
qa AS (SELECT item_id AS query_id, {words_sql('text')} AS qw FROM benchmark),
se AS (SELECT query_id, chunk_id, rank, {SPLIT} AS s FROM hits JOIN docs USING (chunk_id)),
ex AS (SELECT query_id, chunk_id, rank, begin AS "offset", sentence FROM (SELECT query_id, chunk_id, rank, {BEGIN} AS begin, {TRIMMED} AS sentence FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM se)) WHERE sentence <> ''),
co AS (SELECT ex.*, len(list_intersect(qw, {words_sql('sentence')})) AS shared, len(qw) AS n FROM ex JOIN qa USING (query_id) WHERE len(qw) > 0),
fi AS (SELECT *, row_number() OVER (PARTITION BY query_id, trim(regexp_replace(replace(lower(sentence), 'ß', 'ss'), '\\s+', ' ', 'g')) ORDER BY shared / n DESC, rank, "offset") AS f FROM co WHERE shared > 0),
ci AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY shared / n DESC, rank, "offset") AS place, chunk_id, "offset", sentence, round(shared / n, 6) AS score FROM fi WHERE f = 1) WHERE place <= 5)"""
CITATIONS_SQL = f"WITH {CITED_SQL} SELECT * FROM ci"
ANSWERS_SQL = f"""WITH {CITED_SQL} SELECT item_id AS query_id, coalesce(string_agg(sentence, ' ' ORDER BY place), '') AS answer, count(place) AS n_citations, count(place) = 0 AS abstained
  FROM benchmark LEFT JOIN ci ON ci.query_id = item_id GROUP BY 1"""


def gold_removal_contexts(spark, d):
    """The first five documents that are not relevant."""
    hits = _hits(spark, d).select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank")
    return evaluate.drop_gold(hits, evaluate.relevant(_qrels(spark, d)), 5)


GOLD_SQL = f"""WITH {bm25_sql()}, {QRELS_SQL} SELECT query_id, doc_id, score, rank, rank - 1 AS context FROM (
  SELECT query_id, chunk_id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits h WHERE NOT EXISTS (SELECT 1 FROM qr WHERE qr.query_id = h.query_id AND qr.doc_id = h.chunk_id)) WHERE rank <= 5"""


def _grading(spark, d):
    """Replies made from the contexts: a true quote of the first, one too short of the second, one that is not there, an index out of range; fenced, bare or broken by the query's id."""
    hits = _read_hits(spark, d).select("query_id", F.col("chunk_id").alias("doc_id"), (F.col("rank") - 1).alias("context"), "text")
    first = hits.where("context = 0").select("query_id", F.substring("text", 1, 40).alias("quote"), F.substring("text", 1, 10).alias("short"))
    cite = lambda i, q: F.struct(F.lit(i).alias("chunk_index"), q.alias("quote"))
    body = F.to_json(F.struct(F.lit("yes").alias("answer"), (F.col("query_id") % 5 == 4).alias("abstained"), F.array(cite(0, F.col("quote")), cite(1, F.col("short")), cite(2, F.lit("\u0001 no document holds this text")), cite(99, F.col("quote"))).alias("citations")))
    content = F.when(F.col("query_id") % 7 == 3, "no reply").when(F.col("query_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    kind = F.when(F.col("query_id") % 3 == 0, "no_relevant").otherwise("answerable")
    replies = first.select("query_id", kind.alias("kind"), content.alias("content"))
    gold = hits.where("context = 0 and query_id % 4 <> 1").select("query_id", "doc_id")
    return answer.grade(replies, hits, gold)


def citation_grading(spark, d):
    return _grading(spark, d)


GRADES_SQL = f"""{bm25_sql(k=1)},
gd AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'no_relevant' ELSE 'answerable' END AS kind, query_id % 7 <> 3 AS ok, query_id % 5 = 4 AND query_id % 7 <> 3 AS abst,
  query_id % 7 <> 3 AND length(trim(substr(text, 1, 40), E' \\n\\t')) >= 20 AS v, query_id % 4 <> 1 AS g FROM hits JOIN docs USING (chunk_id)),
gr2 AS (SELECT query_id, kind, ok AS parse_ok, abst AS abstained, CASE WHEN ok THEN 4 ELSE 0 END::BIGINT AS n_raw, v::BIGINT AS n_valid, (v AND g)::BIGINT AS n_valid_gold, g::BIGINT AS gold_in_context,
  CASE WHEN g THEN v::DOUBLE END AS citation_recall, CASE WHEN v THEN g::DOUBLE END AS citation_precision, CASE WHEN kind = 'no_relevant' THEN ok AND abst WHEN g THEN ok AND NOT abst END AS abstention_correct FROM gd)"""


def grade_aggregates(spark, d):
    return answer.aggregate_grades(_grading(spark, d))


AGGREGATES_SQL = f"""WITH {GRADES_SQL} SELECT count(*) AS n_items, count(*) FILTER (WHERE kind = 'answerable') AS n_answerable, count(*) FILTER (WHERE kind = 'no_relevant') AS n_no_relevant, count(*) FILTER (WHERE parse_ok) AS n_parse_ok,
  count(*) FILTER (WHERE parse_ok) / count(*) AS parse_ok_rate, sum(n_raw)::BIGINT AS n_raw_citations, sum(n_valid)::BIGINT AS n_valid_citations, sum(n_valid) / sum(n_raw) AS citation_span_validity, count(citation_recall) AS n_recall_eligible,
  round(avg(citation_recall), 9) AS citation_recall, sum(n_valid_gold) / sum(n_valid) AS citation_precision, count(*) FILTER (WHERE kind = 'answerable' AND gold_in_context = 0) AS n_answerable_gold_missing,
  count(*) FILTER (WHERE kind = 'answerable' AND gold_in_context > 0 AND abstained) / nullif(count(*) FILTER (WHERE kind = 'answerable' AND gold_in_context > 0), 0) AS false_abstention_rate,
  count(*) FILTER (WHERE kind = 'no_relevant' AND abstained) / nullif(count(*) FILTER (WHERE kind = 'no_relevant'), 0) AS correct_abstention_rate FROM gr2"""



def sentence_places(spark, d):
    """Every sentence of every document with its exact place."""
    docs = _table(spark, d, "documents").select("doc_id", F.posexplode(X.sentence_spans(F.col("text"), F.lit(False))).alias("index", "x"))
    return docs.select("doc_id", F.col("index").cast("long").alias("index"), "x.start_char", "x.end_char", X.content_hash(F.col("x.sentence")).alias("sentence_hash"))


PLACES_SQL = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY begin) - 1 AS index, begin AS start_char, begin + length(sentence) AS end_char, sha256(sentence) AS sentence_hash FROM (
  SELECT doc_id, {BEGIN} AS begin, {TRIMMED} AS sentence FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, {SPLIT} AS s FROM documents))) WHERE sentence <> ''"""


def _contexts(spark, d):
    """The documents read for each item, as contexts that begin 1,000 characters into their documents."""
    return _read_hits(spark, d).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("chunk_id").cast("string").alias("chunk_id"), (F.col("rank") - 1).alias("context"), "text", F.lit(1000).cast("long").alias("start_char"))


def _service_replies(spark, d):
    """Service responses with replies made from the contexts, by the query's id: quotes as they are or in capitals, of other contexts, of none; abstentions, blank and broken replies."""
    first = _contexts(spark, d).where("context = 0").select("query_id", F.trim(F.substring("text", 11, 30)).alias("quote"))
    cite = lambda i, q: F.struct(i.alias("chunk_index"), q.alias("quote"))
    listed = F.array(cite(F.lit(0), F.col("quote")), cite(F.lit(0), F.upper("quote")), cite(F.lit(77), F.col("quote")), cite(F.lit(0), F.lit("\u0001 in no text")), cite(F.lit(0), F.lit("")))
    body = F.to_json(F.struct(F.when(F.col("query_id") % 6 == 5, "  ").otherwise(" yes ").alias("answer"), (F.col("query_id") % 5 == 4).alias("abstained"), listed.alias("citations")))
    content = F.when(F.col("query_id") % 7 == 3, "no reply").when(F.col("query_id") % 7 == 2, '{"answer": 5}').when(F.col("query_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    response = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    return first.select("query_id", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit('{"data":'), response, F.lit("}"))).otherwise(response).alias("body")).dropDuplicates(["query_id"])


def _replies(spark, d):
    return _service_replies(spark, d).select("query_id", X.reply_content(F.col("body")).alias("content"))


def reply_answers(spark, d):
    return answer.reply_answers(_replies(spark, d))


REPLIES_SQL = f"""{bm25_sql(k=1)},
ra AS (SELECT query_id, chunk_id, text, trim(substr(text, 11, 30), ' ') AS quote, query_id % 7 NOT IN (2, 3) AS valid, query_id % 6 = 5 OR query_id % 5 = 4 AS silent FROM hits JOIN docs USING (chunk_id))"""
REPLY_ANSWERS_SQL = f"WITH {REPLIES_SQL} SELECT query_id, valid, CASE WHEN valid THEN CASE WHEN silent THEN '' ELSE 'yes' END END AS answer, CASE WHEN valid THEN silent END AS abstained FROM ra"


def grounded_citations(spark, d):
    return answer.grounded_citations(_replies(spark, d), _contexts(spark, d)).select("query_id", "place", "chunk_id", "doc_id", "quote", "start_char", "end_char")


GROUNDED_SQL = f"""WITH {REPLIES_SQL},
sa AS (SELECT query_id, chunk_id, text, unnest([0, 1]) AS place, unnest([quote, upper(quote)]) AS said FROM ra WHERE valid AND NOT silent AND quote <> ''),
lo AS (SELECT *, CASE WHEN strpos(text, said) > 0 THEN strpos(text, said) WHEN length(replace(lower(text), 'ß', 'ss')) = length(text) AND length(replace(lower(said), 'ß', 'ss')) = length(said) THEN strpos(lower(text), lower(said)) ELSE 0 END AS spot FROM sa)
SELECT query_id, place::BIGINT AS place, chunk_id::VARCHAR AS chunk_id, chunk_id::VARCHAR AS doc_id, substr(text, spot, length(said)) AS quote, 999 + spot AS start_char, 999 + spot + length(said) AS end_char FROM lo WHERE spot > 0"""


def final_citation_consistency(spark, d):
    """Grounded citations, of which those of every third query were moved by one character."""
    cited = answer.grounded_citations(_replies(spark, d), _contexts(spark, d))
    moved = (F.col("query_id") % 3 == 1).cast("int")
    return answer.citations_consistent(cited.withColumns({"start_char": F.col("start_char") + moved, "end_char": F.col("end_char") + moved}), _contexts(spark, d))


CONSISTENT_SQL = GROUNDED_SQL.replace("SELECT query_id, place::BIGINT", ", ci AS (SELECT query_id, query_id % 3 = 1 AS moved, text, place::BIGINT") + f""")
SELECT query_id, bool_and(substr(text, (start_char - 999 + CASE WHEN moved THEN 1 ELSE 0 END)::BIGINT, length(quote)) = quote) AS consistent FROM ci GROUP BY 1"""


def _kinds(qrels):
    """Items with a relevant document: even ids are answerable, the others get what is not relevant."""
    return qrels.select("query_id").distinct().select("query_id", F.when(F.col("query_id") % 2 == 0, "answerable").otherwise("no_relevant").alias("kind"))


def answer_items(spark, d):
    """Up to three contexts of each item; fewer where the relevant documents leave fewer of its POOL hits, as those of many copies do."""
    hits = stored(_hits(spark, d).select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank"), "hits")
    qrels = stored(_qrels(spark, d), "qrels")
    items = answer_eval.answer_items(_asked(spark, d), hits, evaluate.relevant(qrels), _kinds(qrels), 3, exact=False)
    return items.select("query_id", "kind", "context", "doc_id", "rank", X.content_hash(F.col("question")).alias("question_hash"))


ITEMS_SQL = f"""WITH {bm25_sql()}, {QRELS_SQL}, ki AS (SELECT DISTINCT query_id, query_id % 2 = 0 AS answerable FROM qr),
ow AS (SELECT h.query_id, answerable, chunk_id, row_number() OVER (PARTITION BY h.query_id ORDER BY rank) AS rank FROM hits h JOIN ki USING (query_id) WHERE answerable OR NOT EXISTS (SELECT 1 FROM qr WHERE qr.query_id = h.query_id AND qr.doc_id = h.chunk_id))
SELECT query_id, CASE WHEN answerable THEN 'answerable' ELSE 'no_relevant' END AS kind, rank - 1 AS context, chunk_id AS doc_id, rank, sha256('{answer_eval.QUESTION.split("%s")[0]}' || text || '{answer_eval.QUESTION.split("%s")[1]}') AS question_hash
FROM ow JOIN benchmark ON item_id = query_id WHERE rank <= 3"""


def _cache(spark, d):
    """Replies by key, each recorded twice."""
    made = _replies(spark, d).select(X.content_hash(F.concat(F.lit("model:"), F.col("query_id").cast("string"))).alias("key"), F.lit("model").alias("model"), "content")
    return made.unionByName(made)


def cache_replay(spark, d):
    """Items of even ids replayed from a cache, all others still to be asked for."""
    requests = _asked(spark, d).select("query_id", X.content_hash(F.concat(F.lit("model:"), F.col("query_id").cast("string"))).alias("key"))
    known = _cache(spark, d).join(requests.where("query_id % 2 = 0").select("key"), "key", "left_semi")
    return answer_eval.replayed(requests, known, replay_only=False).select("query_id", "key", "cached", F.col("content").isNotNull().alias("has_content"))


REPLAY_SQL = f"WITH {bm25_sql(k=1)} SELECT item_id AS query_id, sha256('model:' || item_id) AS key, item_id % 2 = 0 AND item_id IN (SELECT query_id FROM hits) AS cached, item_id % 2 = 0 AND item_id IN (SELECT query_id FROM hits) AS has_content FROM benchmark"


def cache_append(spark, d):
    """How many of the replies are new to a cache that holds those of even ids, and how many are not."""
    requests = _asked(spark, d).where("query_id % 2 = 0").select(X.content_hash(F.concat(F.lit("model:"), F.col("query_id").cast("string"))).alias("key"))
    cache = _cache(spark, d)
    return answer_eval.appended(cache.join(requests, "key", "left_semi"), cache).select("key", "model")


APPEND_SQL = f"WITH {bm25_sql(k=1)} SELECT sha256('model:' || query_id) AS key, 'model' AS model FROM hits WHERE query_id % 2 = 1"


def _model(prompt: str) -> str:
    """A model for tests: replies that cannot be used, by the length of the question, the first time or always."""
    messages = json.loads(prompt)
    n = len(messages[1]["content"].rsplit("Question: ", 1)[1])
    if n % 5 == 0 or n % 3 == 0 and len(messages) == 2:
        return "I think so."
    return json.dumps({"answer": f"{n}", "abstained": n % 2 == 0, "citations": []})


def repair_round(spark, d):
    """Replies of a model recorded, with a round of repair, then replayed without it."""
    items = _read_hits(spark, d, 2).join(_asked(spark, d).select("query_id", F.col("text").alias("question")), "query_id").select("query_id", "question", (F.col("rank") - 1).alias("context"), "text")
    items = stored(items, "items")
    empty = spark.createDataFrame([], "key string, model string, content string")
    made = generate.generate(items, _model, empty, "test")
    again = generate.generate(items, None, made.recorded, "test", replay_only=True)
    told = lambda g, run: g.replies.select(F.lit(run).alias("run"), "query_id", F.size("contents").cast("long").alias("n_replies"), "valid", "content", "n_hits", "n_calls")
    return told(made, "recorded").unionByName(told(again, "replayed"))


REPAIR_SQL = f"""WITH {bm25_sql(k=1)}, it AS (SELECT item_id AS query_id, length(text) AS n FROM benchmark WHERE item_id IN (SELECT query_id FROM hits)),
re AS (SELECT query_id, CASE WHEN n % 5 = 0 OR n % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_replies, n % 5 <> 0 AS valid, CASE WHEN n % 5 = 0 THEN 'I think so.' ELSE '{{"answer": "' || n || '", "abstained": ' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ', "citations": []}}' END AS content FROM it)
SELECT 'recorded' AS run, *, 0::BIGINT AS n_hits, n_replies AS n_calls FROM re UNION ALL SELECT 'replayed', *, n_replies, 0 FROM re"""


def report_recheck(spark, d):
    """A report of the grades, two of its figures changed, against the grades."""
    grades = _grading(spark, d)
    names = ("parse_ok_rate", "citation_span_validity", "citation_recall", "citation_precision", "false_abstention_rate", "correct_abstention_rate")
    own = answer_eval.rechecked(grades, spark.createDataFrame([], "metric string, value double")).select("metric", "rate")
    told = own.select("metric", F.when(F.col("metric") == names[1], F.col("rate") + 0.001).when(F.col("metric") == names[0], F.lit(None)).otherwise(F.col("rate")).alias("value"))
    out = answer_eval.rechecked(grades, told)
    return out.select("metric", F.round("successes", 6).alias("successes"), "n", F.round("rate", 9).alias("rate"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "agrees")


RECHECK_SQL = f"""WITH {GRADES_SQL}, co AS (
  SELECT 'parse_ok_rate' AS metric, count(*) FILTER (WHERE parse_ok)::DOUBLE AS x, count(*)::DOUBLE AS n FROM gr2
  UNION ALL SELECT 'citation_span_validity', sum(n_valid), sum(n_raw) FROM gr2
  UNION ALL SELECT 'citation_precision', sum(n_valid_gold), sum(n_valid) FROM gr2
  UNION ALL SELECT 'citation_recall', coalesce(sum(citation_recall), 0), count(citation_recall) FROM gr2
  UNION ALL SELECT 'false_abstention_rate', count(*) FILTER (WHERE kind = 'answerable' AND gold_in_context > 0 AND abstained), count(*) FILTER (WHERE kind = 'answerable' AND gold_in_context > 0) FROM gr2
  UNION ALL SELECT 'correct_abstention_rate', count(*) FILTER (WHERE kind = 'no_relevant' AND abstained), count(*) FILTER (WHERE kind = 'no_relevant') FROM gr2),
wi AS (SELECT metric, x, n, x / nullif(n, 0) AS p, {_Z} AS z FROM co)
SELECT metric, round(x, 6) AS successes, n::BIGINT AS n, round(p, 9) AS rate,
  CASE WHEN metric <> 'citation_recall' AND n > 0 THEN CASE WHEN x = 0 THEN 0 ELSE round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) END END AS low,
  CASE WHEN metric <> 'citation_recall' AND n > 0 THEN CASE WHEN x = n THEN 1 ELSE round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) END END AS high,
  CASE metric WHEN 'parse_ok_rate' THEN p IS NULL WHEN 'citation_span_validity' THEN p IS NULL ELSE true END AS agrees FROM wi"""


QUERIES = {
    "doc_ids_hashes": (doc_ids_hashes, DOC_IDS_SQL),
    "duplicate_documents": (duplicate_documents, DUPLICATES_SQL),
    "corpus_slugs": (corpus_slugs, SLUGS_SQL),
    "normalized_text": (normalized_text, NORMALIZED_SQL),
    "token_counts": (token_counts, TOKENS_SQL),
    "broken_lines": (broken_lines, BROKEN_SQL),
    "fixed_chunks": (fixed_chunks, FIXED_SQL),
    "chunk_statistics": (chunk_statistics, CHUNK_STATS_SQL),
    "verify_chunks": (verify_chunks, VERIFY_SQL),
    "section_crossing": (section_crossing, CROSSING_SQL),
    "recursive_chunks": (recursive_chunks, None),
    "structure_chunks": (structure_chunks, None),
    "html_pages": (html_pages, None),
    "postings": (postings, POSTINGS_SQL),
    "term_stats": (term_stats, TERM_STATS_SQL),
    "corpus_stats": (corpus_stats, CORPUS_SQL),
    "bm25_topk": (bm25_topk, f"WITH {bm25_sql(k=K)} SELECT * FROM hits"),
    "bm25_topk_filtered": (bm25_topk_filtered, f"WITH {bm25_sql(keep=chr(39).join(['lang IN (', 'de', ', ', 'fr', ')']), k=K)} SELECT * FROM hits"),
    "bm25_after_upsert": (bm25_after_upsert, f"WITH {bm25_sql('SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN string_split(text, chr(10))[1] ELSE text END AS text FROM documents', k=K)} SELECT * FROM hits"),
    "bm25_after_delete": (bm25_after_delete, f"WITH {bm25_sql(chr(39).join(['SELECT doc_id AS chunk_id, text FROM documents WHERE lang IS DISTINCT FROM ', 'es', '']), k=K)} SELECT * FROM hits"),
    "bm25_from_index": (bm25_from_index, f"WITH {bm25_sql(k=K)} SELECT * FROM hits"),
    "bm25_pruned": (bm25_pruned, f"WITH {bm25_sql(k=K)} SELECT * FROM hits"),
    "bm25_from_versions": (bm25_from_versions, f"WITH {bm25_sql(f'SELECT doc_id AS chunk_id, text FROM ({_SECOND}) WHERE lang IS DISTINCT FROM {chr(39)}es{chr(39)} AND text <> {chr(39)}{chr(39)}', k=K)} SELECT * FROM hits"),
    "index_versions": (index_versions, VERSIONS_SQL),
    "index_drift": (index_drift, DRIFT_SQL),
    "metadata_filter": (metadata_filter, METADATA_SQL),
    "dense_topk": (dense_topk, dense_sql("true")),
    "dense_topk_label_filter": (dense_topk_label_filter, dense_sql("n.label IN (1, 2, 3)")),
    "l2_norms": (l2_norms, L2_SQL),
    "hashing_embeddings": (hashing_embeddings, None),
    "hybrid_search": (hybrid_search, None),
    "rrf_fusion": (rrf_fusion, fused_sql("1.0::DOUBLE / (60 + rank)")),
    "rrf_weighted_lists": (rrf_weighted_lists, fused_sql("CASE WHEN place = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / (20 + rank)")),
    "minmax_fusion": (minmax_fusion, fused_sql("CASE WHEN place = 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END")),
    "rerank_overlap": (rerank_overlap, RERANK_SQL),
    "retrieval_metrics": (retrieval_metrics, f"WITH {bm25_sql()}, {QRELS_SQL} {metrics_sql('hits')}"),
    "metrics_macro": (metrics_macro, MACRO_SQL),
    "bootstrap_ci": (bootstrap_ci, None),
    "query_partition_counts": (query_partition_counts, KINDS_SQL),
    "overfetch_depth": (overfetch_depth, OVERFETCH_SQL),
    "latency_percentiles": (latency_percentiles, LATENCY_SQL),
    "latency_windows": (latency_windows, WINDOWS_SQL),
    "wilson_by_group": (wilson_by_group, WILSON_SQL),
    "extractive_answers": (extractive_answers, ANSWERS_SQL),
    "extractive_citations": (extractive_citations, CITATIONS_SQL),
    "sentence_places": (sentence_places, PLACES_SQL),
    "reply_answers": (reply_answers, REPLY_ANSWERS_SQL),
    "grounded_citations": (grounded_citations, GROUNDED_SQL),
    "final_citation_consistency": (final_citation_consistency, CONSISTENT_SQL),
    "answer_items": (answer_items, ITEMS_SQL),
    "cache_replay": (cache_replay, REPLAY_SQL),
    "cache_append": (cache_append, APPEND_SQL),
    "repair_round": (repair_round, REPAIR_SQL),
    "page_section_crossing": (page_section_crossing, None),
    "report_recheck": (report_recheck, RECHECK_SQL),
    "gold_removal_contexts": (gold_removal_contexts, GOLD_SQL),
    "citation_grading": (citation_grading, f"WITH {GRADES_SQL} SELECT * FROM gr2"),
    "grade_aggregates": (grade_aggregates, AGGREGATES_SQL),
}
