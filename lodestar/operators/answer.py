"""Extractive answers, citations of model replies, and their grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import SPACE, answer_tokens, dedupe_key, locate_quote, parse_reply, sentence_spans

MAX_SENTENCES = 5
MIN_QUOTE = 20


#: Formats whose text has # heading lines.
WITH_HEADINGS = ("markdown", "html")
#: What a citation says of its chunk, and the types; null where a table of chunks has no such column.
PROVENANCE = {"doc_id": "string", "source": "string", "content_hash": "string", "heading_path": "array<string>", "page": "int", "page_end": "int"}


def _known(df: DataFrame, name: str, kind: str, default: object = None) -> Column:
    return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in df.columns else F.lit(default).cast(kind)


def scored_sentences(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank, offset, sentence, score) of sentences that share a word with the query.

    `queries` (query_id, text), `hits` (query_id, chunk_id, rank, text, format if there is one). The
    score is the share of the query's words that the sentence holds, the offset the character of
    the chunk's text where it begins. Heading lines of WITH_HEADINGS formats are no sentences.
    """
    asked = queries.select("query_id", answer_tokens(F.col("text")).alias("asked")).where(F.size("asked") > 0)
    marked = _known(hits, "format", "string", "").isin(*WITH_HEADINGS)
    spans = sentence_spans(F.col("text"), marked)
    parts = hits.select("query_id", "chunk_id", "rank", F.explode(spans).alias("x")).select("query_id", "chunk_id", "rank", F.col("x.start_char").alias("offset"), "x.sentence")
    both = parts.join(asked, "query_id")
    shared = F.size(F.array_intersect("asked", answer_tokens(F.col("sentence"))))
    return both.withColumn("shared", shared).where("shared > 0").select("query_id", "chunk_id", "rank", "offset", "sentence", (F.col("shared") / F.size("asked")).alias("score"))


def cited_sentences(queries: DataFrame, hits: DataFrame, most: int = MAX_SENTENCES) -> DataFrame:
    """The first `most` sentences of each query by score, hit and place, of near-identical ones the first: adds `place` from 1."""
    if most < 1:
        raise ValueError("at least one sentence must be asked for")
    order = [F.desc("score"), F.col("rank"), F.col("offset")]
    scored = scored_sentences(queries, hits).withColumn("key", dedupe_key(F.col("sentence")))
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order)) == 1
    kept = scored.withColumn("first", first).where("first")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return kept.withColumn("place", place.cast("long")).where(F.col("place") <= most).drop("key", "first")


def extractive_answers(queries: DataFrame, hits: DataFrame, most: int = MAX_SENTENCES) -> DataFrame:
    """(query_id, answer, n_citations, abstained) of every query that is not blank; one without a matching sentence abstains."""
    cited = cited_sentences(queries, hits, most)
    answers = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"))
    asked = queries.where("trim(text) <> ''").select("query_id").join(answers, "query_id", "left")
    return asked.select("query_id", F.coalesce(F.array_join("s.sentence", " "), F.lit("")).alias("answer"), F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_citations"), F.col("s").isNull().alias("abstained"))


def citations(quoted: DataFrame, chunks: DataFrame) -> DataFrame:
    """`quoted` (query_id, place, chunk_id, offset, sentence) as citations: PROVENANCE of the chunk, quote, start_char and end_char in the document."""
    base = _known(chunks, "start_char", "long", 0)
    own = chunks.select("chunk_id", base.alias("base"), *[_known(chunks, c, kind).alias(c) for c, kind in PROVENANCE.items()])
    start = F.col("base") + F.col("offset")
    return quoted.join(own, "chunk_id").select("query_id", "place", "chunk_id", *PROVENANCE, F.col("sentence").alias("quote"), start.alias("start_char"), (start + F.length("sentence")).alias("end_char"))


def reply_answers(replies: DataFrame) -> DataFrame:
    """(query_id, valid, answer, abstained) of model replies (query_id, content): null answer and abstention where a reply is not valid.

    Valid is JSON with a boolean `abstained` (or none), a string `answer` (or none) and a list of
    `citations` (or none; not looked at in abstentions). A blank answer is an abstention.
    """
    return _answers(replies).drop("v")


def _answers(replies: DataFrame) -> DataFrame:
    parsed = replies.select("query_id", F.explode(F.array(parse_reply(F.col("content")))).alias("v"))  # exploded, so that it is parsed once
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("absent"))
    text = F.regexp_replace(F.coalesce(F.try_variant_get("v", "$.answer", "string"), F.lit("")), rf"\A{SPACE}+|{SPACE}+\z", "")
    silent = F.coalesce(F.try_variant_get("v", "$.abstained", "boolean"), F.lit(False)) | (text == "")
    listed = kind("$.citations")
    valid = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)) & kind("$.abstained").isin("BOOLEAN", "absent") & kind("$.answer").isin("STRING", "absent") & (silent | listed.startswith("ARRAY") | (listed == "absent"))
    return parsed.select("query_id", valid.alias("valid"), F.when(valid, F.when(silent, "").otherwise(text)).alias("answer"), F.when(valid, silent).alias("abstained"), "v")


def grounded_citations(replies: DataFrame, contexts: DataFrame) -> DataFrame:
    """Citations of the valid replies that do not abstain and that stand in their contexts, in their order.

    `replies` (query_id, content), `contexts` (query_id, context, chunk_id, text, start_char and
    PROVENANCE if there). An entry needs a whole number that names a context and a quote found in
    its text (exactly, or with folded case where folding keeps lengths) that is not blank; the
    others are dropped. The quote is the context's own text between the two offsets.
    """
    given = _answers(replies).where("valid and not abstained")
    each = given.select("query_id", F.posexplode(F.try_variant_get("v", "$.citations", "array<variant>")).alias("place", "x"))
    is_kind = lambda path, sql: F.coalesce(F.schema_of_variant(F.try_variant_get("x", path, "variant")) == sql, F.lit(False))
    named = each.where(is_kind("$.chunk_index", "BIGINT") & is_kind("$.quote", "STRING"))
    named = named.select("query_id", F.col("place").cast("long").alias("place"), F.try_variant_get("x", "$.chunk_index", "long").alias("context"), F.try_variant_get("x", "$.quote", "string").alias("said")).where("said <> ''")
    own = contexts.select("query_id", F.col("context").cast("long").alias("context"), "chunk_id", "text", _known(contexts, "start_char", "long", 0).alias("base"), *[_known(contexts, c, kind).alias(c) for c, kind in PROVENANCE.items()])
    met = named.join(own, ["query_id", "context"]).withColumn("at", locate_quote(F.col("said"), F.col("text"))).where("at is not null")
    met = met.withColumn("quote", F.substring("text", F.col("at") + 1, F.length("said"))).where(F.regexp_replace("quote", SPACE, "") != "")
    start = (F.col("base") + F.col("at")).cast("long")
    return met.select("query_id", "place", "chunk_id", *PROVENANCE, "quote", start.alias("start_char"), (start + F.length("quote")).alias("end_char"))


def citations_consistent(cited: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, consistent) of every query with citations (query_id, chunk_id, quote, start_char, end_char): whether each is, between its offsets, the text of a context (query_id, chunk_id, text, start_char)."""
    own = contexts.select("query_id", "chunk_id", "text", _known(contexts, "start_char", "long", 0).alias("base"))
    met = cited.join(own, ["query_id", "chunk_id"], "left")
    start, end = F.col("start_char") - F.col("base"), F.col("end_char") - F.col("base")
    good = (start >= 0) & (end <= F.length("text")) & (F.substring("text", (start + 1).cast("int"), (end - start).cast("int")) == F.col("quote"))
    return met.groupBy("query_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("consistent"))


def raw_citations(replies: DataFrame) -> DataFrame:
    """(query_id, parse_ok, abstained, place, chunk_index, quote) of `replies` (query_id, content).

    The content is JSON {answer, abstained, citations: [{chunk_index, quote}]}, in a code fence or
    among other words too. Each reply has at least one row; an entry that is no object has nulls.
    """
    parsed = replies.select("query_id", parse_reply(F.col("content")).alias("v"))
    answer, abstained = F.try_variant_get("v", "$.answer", "string"), F.try_variant_get("v", "$.abstained", "boolean")
    listed = F.try_variant_get("v", "$.citations", "array<variant>")
    ok = F.coalesce(F.schema_of_variant("v").startswith("OBJECT") & answer.isNotNull(), F.lit(False))
    rows = parsed.select("query_id", ok.alias("parse_ok"), F.coalesce(ok & abstained, F.lit(False)).alias("abstained"), F.when(ok, listed).alias("c"))
    each = rows.select("query_id", "parse_ok", "abstained", F.posexplode_outer("c").alias("place", "x"))
    return each.select("query_id", "parse_ok", "abstained", F.col("place").cast("long").alias("place"), F.try_variant_get("x", "$.chunk_index", "long").alias("chunk_index"), F.try_variant_get("x", "$.quote", "string").alias("quote"))


def grade(replies: DataFrame, contexts: DataFrame, gold: DataFrame) -> DataFrame:
    """Grades of each reply.

    `replies` (query_id, kind, content), `contexts` (query_id, context, doc_id, text), `gold`
    (query_id, doc_id). A citation is valid if its index is one of the contexts and its quote, of
    MIN_QUOTE characters or more once trimmed, stands in it word for word. kind is `answerable`
    or `no_relevant`. Undefined rates are null.
    """
    raw = raw_citations(replies)
    named = contexts.join(gold.distinct().withColumn("gold", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    trimmed = F.regexp_replace("quote", r"(?U)\A\s+|\s+\z", "")
    met = raw.join(named.select("query_id", F.col("context").alias("chunk_index"), "doc_id", "text", "gold"), ["query_id", "chunk_index"], "left")
    valid = F.coalesce((F.length(trimmed) >= MIN_QUOTE) & F.contains("text", F.col("quote")), F.lit(False))
    met = met.withColumn("valid", valid)
    each = met.groupBy("query_id").agg(
        F.first("parse_ok").alias("parse_ok"),
        F.first("abstained").alias("abstained"),
        F.count("place").alias("n_raw"),
        F.count_if("valid").alias("n_valid"),
        F.count_if(F.col("valid") & F.col("gold")).alias("n_valid_gold"),
        F.countDistinct(F.when(F.col("valid") & F.col("gold"), F.col("doc_id"))).alias("cited_gold"),
    )
    held = named.groupBy("query_id").agg(F.countDistinct(F.when(F.col("gold"), F.col("doc_id"))).alias("gold_in_context"))
    out = replies.select("query_id", "kind").join(each, "query_id").join(held, "query_id", "left").withColumn("gold_in_context", F.coalesce("gold_in_context", F.lit(0)))
    right = F.when(F.col("kind") == "no_relevant", F.col("parse_ok") & F.col("abstained")).when(F.col("gold_in_context") > 0, F.col("parse_ok") & ~F.col("abstained"))
    return out.select(
        "query_id", "kind", "parse_ok", "abstained", "n_raw", "n_valid", "n_valid_gold", "gold_in_context",
        F.try_divide("cited_gold", "gold_in_context").alias("citation_recall"), F.try_divide("n_valid_gold", "n_valid").alias("citation_precision"), right.alias("abstention_correct"),
    )


def aggregate_grades(grades: DataFrame) -> DataFrame:
    """One row of micro and macro figures; null where a denominator is zero."""
    answerable, with_gold = F.col("kind") == "answerable", F.col("gold_in_context") > 0
    return grades.agg(
        F.count("*").alias("n_items"),
        F.count_if(answerable).alias("n_answerable"),
        F.count_if(F.col("kind") == "no_relevant").alias("n_no_relevant"),
        F.count_if("parse_ok").alias("n_parse_ok"),
        F.try_divide(F.count_if("parse_ok"), F.count("*")).alias("parse_ok_rate"),
        F.sum("n_raw").alias("n_raw_citations"),
        F.sum("n_valid").alias("n_valid_citations"),
        F.try_divide(F.sum("n_valid"), F.sum("n_raw")).alias("citation_span_validity"),
        F.count("citation_recall").alias("n_recall_eligible"),
        F.round(F.avg("citation_recall"), 9).alias("citation_recall"),
        F.try_divide(F.sum("n_valid_gold"), F.sum("n_valid")).alias("citation_precision"),
        F.count_if(answerable & ~with_gold).alias("n_answerable_gold_missing"),
        F.try_divide(F.count_if(answerable & with_gold & F.col("abstained")), F.count_if(answerable & with_gold)).alias("false_abstention_rate"),
        F.try_divide(F.count_if((F.col("kind") == "no_relevant") & F.col("abstained")), F.count_if(F.col("kind") == "no_relevant")).alias("correct_abstention_rate"),
    )
