"""Sentences with places, citations, model replies, answer evaluation and reply caches. The expected figures are fixed values of the specification."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions.markup import pieces
from lodestar.jobs.queries import QUERIES
from lodestar.operators import answer, answer_eval, chunking, search
from lodestar.sources import evaluation


def spans(spark, text, marked=False):
    row = spark.createDataFrame([(text,)], "t string").select(X.sentence_spans(F.col("t"), F.lit(marked)).alias("x")).first()
    return [(r["start_char"], r["end_char"], r["sentence"]) for r in row["x"]]


def test_sentences_keep_their_places(spark):
    text = "  One is here. Two\n is there!  Three?\n\nFour"
    found = spans(spark, text)
    assert [s for _, _, s in found] == ["One is here.", "Two\n is there!", "Three?", "Four"] and all(text[a:b] == s for a, b, s in found)
    assert spans(spark, "") == [] and spans(spark, " \n ") == []


def test_heading_lines_are_no_sentences(spark):
    text = "# Top. Title\nBody one. Body two\n## Next\n```\n# code. here\n```\nEnd."
    assert [s for _, _, s in spans(spark, text, True)] == ["Body one.", "Body two", "```\n# code.", "here\n```\nEnd."]
    assert spans(spark, text)[0][2] == "# Top."


def test_citations_point_into_the_document(spark):
    chunks = spark.createDataFrame([("c1", "d1", "Cats are great pets. Dogs are loyal companions.", 100, "a.md", 3)], "chunk_id string, doc_id string, text string, start_char long, source string, page int")
    hits = chunks.select(F.lit("q").alias("query_id"), "chunk_id", F.lit(1).alias("rank"), "text")
    queries = spark.createDataFrame([("q", "loyal dogs")], "query_id string, text string")
    row = answer.citations(answer.cited_sentences(queries, hits), chunks).collect()
    assert [(r["quote"], r["start_char"], r["end_char"], r["doc_id"], r["source"], r["page"], r["heading_path"]) for r in row] == [("Dogs are loyal companions.", 121, 147, "d1", "a.md", 3, None)]


REPLIES = [
    ("yes", {"answer": " It is. ", "abstained": False, "citations": [{"chunk_index": 0, "quote": "LOYAL companions"}, {"chunk_index": 1, "quote": "Second text"}, {"chunk_index": True, "quote": "Cats"}, {"chunk_index": "0", "quote": "Cats"}, {"chunk_index": 9, "quote": "Cats"}, {"chunk_index": -1, "quote": "Cats"}, {"chunk_index": 0, "quote": ""}, {"chunk_index": 0, "quote": "  "}, {"chunk_index": 0, "quote": "not there"}, 7]}),
    ("silent", {"answer": "x", "abstained": True, "citations": 3}),
    ("blank", {"answer": " ", "citations": []}),
    ("empty", {}),
    ("no text", {"answer": 5}),
    ("no truth", {"answer": "x", "abstained": "no"}),
    ("no list", {"answer": "x", "citations": "none"}),
    ("list", [1]),
]


@pytest.fixture(scope="module")
def replies(spark):
    rows = [(q, json.dumps(r)) for q, r in REPLIES] + [("broken", "{"), ("none", None)]
    return spark.createDataFrame(rows, "query_id string, content string")


def test_replies_become_answers(spark, replies):
    got = {r["query_id"]: (r["valid"], r["answer"], r["abstained"]) for r in answer.reply_answers(replies).collect()}
    assert got["yes"] == (True, "It is.", False) and got["silent"] == got["blank"] == got["empty"] == (True, "", True)
    assert all(got[q] == (False, None, None) for q in ("no text", "no truth", "no list", "list", "broken", "none"))


def test_only_grounded_citations_stay(spark, replies):
    contexts = spark.createDataFrame([("yes", 0, "c1", "Cats are great pets. Dogs are loyal companions.  ", 100, "d1"), ("yes", 1, "c2", "ß Second text", 5, "d2")], "query_id string, context long, chunk_id string, text string, start_char long, doc_id string")
    got = answer.grounded_citations(replies, contexts)
    rows = [(r["place"], r["chunk_id"], r["quote"], r["start_char"], r["end_char"]) for r in got.orderBy("place").collect()]
    assert rows == [(0, "c1", "loyal companions", 130, 146), (1, "c2", "Second text", 7, 18)]
    assert answer.citations_consistent(got, contexts).first()["consistent"]
    moved = got.withColumn("start_char", F.when(F.col("place") == 1, F.col("start_char") - 4).otherwise(F.col("start_char")))
    assert not answer.citations_consistent(moved, contexts).first()["consistent"]
    assert not answer.citations_consistent(got, contexts.where("context = 0")).first()["consistent"]


def test_service_responses_are_unwrapped(spark):
    inner = {"choices": [{"message": {"content": "hello"}}]}
    rows = [json.dumps(inner), json.dumps({"data": inner}), json.dumps({"choices": []}), json.dumps({"choices": [{"message": {"content": 5}}]}), "no json", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, body string").select("i", X.reply_content(F.col("body")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["hello", "hello", None, None, None, None]


def hits_of(spark, n=4):
    return spark.createDataFrame([(q, f"{q}{i}", i + 1) for q in ("a", "b") for i in range(n)], "query_id string, doc_id string, rank long")


def test_items_have_exactly_k_contexts(spark):
    claims = spark.createDataFrame([("a", "claim A"), ("b", "claim B")], "query_id string, text string")
    gold = spark.createDataFrame([("a", "a0"), ("b", "b1"), ("b", "b1")], "query_id string, doc_id string")
    kinds = spark.createDataFrame([("a", "answerable"), ("b", "no_relevant")], "query_id string, kind string")
    rows = answer_eval.answer_items(claims, hits_of(spark), gold, kinds, 3).orderBy("query_id", "context").collect()
    assert [(r["query_id"], r["context"], r["doc_id"]) for r in rows] == [("a", 0, "a0"), ("a", 1, "a1"), ("a", 2, "a2"), ("b", 0, "b0"), ("b", 1, "b2"), ("b", 2, "b3")]
    assert rows[0]["question"].startswith("Claim: claim A\nDo the contexts")
    with pytest.raises(Exception, match="too few contexts: b"):
        answer_eval.answer_items(claims, hits_of(spark), gold, kinds, 4).collect()
    with pytest.raises(Exception, match="in both subsets: a"):
        answer_eval.answer_items(claims, hits_of(spark), gold, kinds.union(spark.createDataFrame([("a", "no_relevant")], "query_id string, kind string")), 3).collect()


def test_items_without_enough_contexts_keep_those_left(spark, tmp_path):
    """The query over items whose relevant documents fill the pool of hits but for two, or wholly, as copies do in larger tables."""
    claims = spark.createDataFrame([("a", "claim A"), ("b", "claim B"), ("c", "claim C")], "query_id string, text string")
    gold = spark.createDataFrame([("b", "b0"), ("b", "b2"), ("c", "c0")], "query_id string, doc_id string")
    kinds = spark.createDataFrame([("a", "answerable"), ("b", "no_relevant"), ("c", "no_relevant")], "query_id string, kind string")
    got = answer_eval.answer_items(claims, hits_of(spark), gold, kinds, 5, exact=False).orderBy("query_id", "context").collect()
    assert [(r["query_id"], r["kind"], r["context"], r["doc_id"], r["rank"]) for r in got] == [*[("a", "answerable", i, f"a{i}", i + 1) for i in range(4)], ("b", "no_relevant", 0, "b1", 1), ("b", "no_relevant", 1, "b3", 2)]
    asked = {1: "one two three four five six seven eight", 2: "ten eleven twelve thirteen fourteen fifteen sixteen seventeen", 3: "red green blue white black brown yellow grey", 5: "oak ash elm birch pine beech cedar larch"}
    docs = [(q * 1000 + i, text, "en") for q, text in asked.items() for i in range({1: 48, 2: 5, 3: 60, 5: 47}[q])]
    docs += [(q * 1000 + 900 + i, f"{text.split()[0]} and nothing else of these words", "en") for q, text in asked.items() for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1000, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["answer_items"][0](spark, str(tmp_path)).orderBy("query_id", "context").collect()
    assert [(r["query_id"], r["kind"], r["context"], r["doc_id"], r["rank"]) for r in rows] == [
        (1, "no_relevant", 0, 1900, 1), (1, "no_relevant", 1, 1901, 2), *[(2, "answerable", i, 2000 + i, i + 1) for i in range(3)], *[(5, "no_relevant", i, 5900 + i, i + 1) for i in range(3)]]


def test_caches_replay_and_grow(spark, tmp_path):
    cache = spark.createDataFrame([("k1", "m", "one"), ("k1", "m", "one"), ("k2", "m", "two")], "key string, model string, content string")
    asked = spark.createDataFrame([("q1", "k1"), ("q3", "k3")], "query_id string, key string")
    assert {r["query_id"]: (r["cached"], r["content"]) for r in answer_eval.replayed(asked, cache, False).collect()} == {"q1": (True, "one"), "q3": (False, None)}
    with pytest.raises(Exception, match="no cached reply for key k3"):
        answer_eval.replayed(asked, cache).collect()
    new = spark.createDataFrame([("k2", "m", "two"), ("k3", "m", "three"), ("k3", "m", "three")], "key string, model string, content string")
    more = answer_eval.appended(cache, new)
    assert [tuple(r) for r in more.collect()] == [("k3", "m", "three")]
    with pytest.raises(Exception, match="two contents of key k1"):
        answer_eval.appended(cache, spark.createDataFrame([("k1", "m", "other")], "key string, model string, content string")).collect()
    path = str(tmp_path / "cache")
    evaluation.write_replies(cache, path)
    evaluation.write_replies(more, path)
    assert {tuple(r) for r in evaluation.read_replies(spark, path).collect()} == {("k1", "one"), ("k2", "two"), ("k3", "three")}


def test_documents_are_refused_where_ids_repeat(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "text"), ("d2", "more")], "doc_id string, text string").withColumn("content_hash", X.content_hash(F.col("text")))
    evaluation.write_documents(docs, str(tmp_path / "docs"))
    assert {r["doc_id"] for r in evaluation.read_documents(spark, str(tmp_path / "docs")).collect()} == {"d1", "d2"}
    with pytest.raises(evaluation.BadSet, match="'d1'"):
        evaluation.write_documents(docs.union(docs), str(tmp_path / "twice"))
    docs.withColumn("text", F.lit("changed")).write.json(str(tmp_path / "changed"))
    with pytest.raises(evaluation.BadSet, match="not what was hashed"):
        evaluation.read_documents(spark, str(tmp_path / "changed"))


def test_sidecars_are_aligned(spark, tmp_path):
    whole = {"schema_version": 1, "query_ids": ["q1", "q2"], "modes": {"dense": {"q1": {"mrr@10": 1.0}, "q2": {"mrr@10": 0.5}}}}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    assert {tuple(r) for r in evaluation.read_scores(spark, str(tmp_path / "a.json")).collect()} == {("dense", "q1", "mrr@10", 1.0), ("dense", "q2", "mrr@10", 0.5)}
    del whole["modes"]["dense"]["q2"]
    (tmp_path / "b.json").write_text(json.dumps(whole))
    with pytest.raises(evaluation.BadSet, match="dense"):
        evaluation.read_scores(spark, str(tmp_path / "b.json"))


def test_filters_compare_values_of_one_kind(spark):
    df = spark.createDataFrame([(1, "2", 2, 2.0, True, ["2", "x"], [2, 3]), (2, None, None, None, None, None, None)], "i int, s string, n int, f double, t boolean, ss array<string>, ns array<int>")
    hit = lambda column, value, listed=False: [r["i"] for r in df.where(search.matches(F.col(column), value, listed)).collect()]
    assert hit("s", "2") == hit("n", 2) == hit("f", 2) == hit("n", 2.0) == hit("t", True) == hit("ss", ["x", "y"], True) == hit("ns", 3, True) == hit("s", ["a", "2"]) == [1]
    assert hit("s", 2) == hit("n", "2") == hit("n", True) == hit("t", 1) == hit("ss", 2, True) == hit("ns", "3", True) == []


def test_tokens_are_compatibility_composed_and_folded(spark):
    texts = ["Straße ﬁne", "Ｆｕｌｌ ①", "ΣΊΣΥΦΟΣ", "e\u0301te\u0301", "x² İ", "plain_text 42"]
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").orderBy("i").select(X.bm25_tokens(F.col("s")).alias("t")).collect()]
    import re
    import unicodedata

    assert got == [re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold()) for t in texts]


def test_chunks_carry_what_their_documents_say(spark):
    docs = spark.createDataFrame([("d", "T", "one two three", "a.md", "markdown")] * 2, "doc_id string, title string, text string, source string, format string")
    docs = docs.withColumn("sections", F.expr("array(struct(0 AS start_char, 13 AS end_char, cast(array() AS array<string>) AS heading_path, cast(null AS int) AS page))"))
    rows = chunking.chunk_documents(docs).collect()
    assert len(rows) == 2 and {(r["source"], r["title"], r["format"], len(r["content_hash"])) for r in rows} == {("a.md", "T", "markdown", 64)}


def test_scanner_reads_what_is_there():
    page = "a<b c=\"x>y\">d</b ><!-- <i> --><script>if (a<b) {}</script>e<br/>< f <![CDATA[<g>]]>h</"
    assert [(p.kind, page[p.start : p.end], p.name) for p in pieces(page)] == [
        ("text", "a", ""), ("open", '<b c="x>y">', "b"), ("text", "d", ""), ("close", "</b >", "b"), ("open", "<script>", "script"), ("raw", "if (a<b) {}", "script"), ("close", "</script>", "script"),
        ("text", "e", ""), ("single", "<br/>", "br"), ("text", "< f ", ""), ("cdata", "<g>", ""), ("text", "h</", ""),
    ]


def test_commands_and_reports(spark, tmp_path, capsys):
    from lodestar.jobs import evaluation as runs
    from lodestar.jobs import service

    root = tmp_path / "files"
    root.mkdir()
    for i, word in enumerate(["apple", "banana", "cherry", "damson"]):
        (root / f"{word}.md").write_text(f"---\ntopic: fruit\n---\n# {word}\n\nA {word} is a fruit. It grows on tree {i}.\n\n## More\n\nNobody dislikes a {word}.\n")
    (root / "picture.bin").write_bytes(b"\0\1")
    assert service.main(["ingest", str(root), "--out", str(tmp_path / "docs")]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out.strip().splitlines()[-1]) == {"documents": 4} and "picture.bin: unsupported extension" in said.err
    docs = evaluation.read_documents(spark, str(tmp_path / "docs"))
    assert docs.count() == 4
    assert service.main(["index", str(root), "--out", str(tmp_path / "index")]) == 0
    ids = {r["source"]: r["doc_id"] for r in docs.collect()}
    spark.createDataFrame([("q1", "banana fruit"), ("q2", "cherry")], "query_id string, text string").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([("q1", ids["banana.md"], 1), ("q2", ids["cherry.md"], 1)], "query_id string, doc_id string, grade int").write.parquet(str(tmp_path / "j"))
    assert service.main(["evaluate", str(tmp_path / "index"), "--queries", str(tmp_path / "q"), "--judged", str(tmp_path / "j"), "--mode", "lexical", "--out", str(tmp_path / "report")]) == 0
    report = json.loads((tmp_path / "report" / "report.json").read_text())
    assert report["modes"]["lexical"]["mrr@10"] == 1.0 and report["modes"]["lexical"]["short_queries"] == 2 and "| lexical |" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "report" / "scores")).where("metric = 'recall@1' and value = 1").count() == 2
    with pytest.raises(ValueError):
        runs.write_report(spark, {"x": float("nan")}, str(tmp_path / "bad.json"))
    held = service.Index.load(spark, str(tmp_path / "index"))
    queries = spark.read.parquet(str(tmp_path / "q"))
    timed = runs.latencies(held, queries, "lexical")
    assert timed["n"] == 1 and timed["p50"] == timed["p95"] > 0
    from lodestar.jobs.options import Request

    told = held.provenance(held.search(queries, Request("x", 1, "lexical"))).where("query_id = 'q1'").first()["provenance"]
    assert told["source"] == "banana.md" and told["format"] == "markdown" and told["heading_path"][0] == "banana"
    assert held.search(queries, Request("x", 5, "lexical", filters={"source": "apple.md"})).select("chunk_id").distinct().count() >= 1
    assert held.search(queries, Request("x", 5, "lexical", filters={"nothing": "here"})).count() == 0
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    cited = held.cited(queries, Request("x", 3, "lexical")).collect()
    assert cited and all(text[r["doc_id"]][r["start_char"] : r["end_char"]] == r["quote"] and not r["quote"].startswith("#") for r in cited)


def test_fusion_refuses_faulty_hits(spark):
    from lodestar.operators import fusion

    schema = "query_id string, chunk_id string, score double, rank long"
    for rows in ([("q", "a", 1.0, 1), ("q", "a", 0.5, 2)], [("q", "a", float("nan"), 1)], [("q", "a", 1.0, 0)], [("q", "a", float("inf"), 1)]):
        with pytest.raises(Exception, match="a chunk twice in a list"):
            fusion.reciprocal_rank_fusion({"x": spark.createDataFrame(rows, schema)}).collect()
