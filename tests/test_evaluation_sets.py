"""Evaluation sets and a whole run over a small index."""

import json

import pytest

from lodestar.jobs import evaluation
from lodestar.jobs.service import Index
from lodestar.operators import chunking, embedding
from lodestar.sources import evaluation as sets


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


@pytest.fixture(scope="module")
def ranked(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    lines(root / "corpus.jsonl", [{"_id": "1", "title": "Cells", "text": "Cells divide. They grow."}, {"id": "2", "title": "Stars", "text": "Stars burn hydrogen."}, {"_id": "3", "title": "", "text": "Rivers carry water."}])
    lines(root / "queries.jsonl", [{"_id": "q1", "text": "how do stars burn"}, {"_id": "q2", "text": "rivers and water"}, {"_id": "q3", "text": "nobody judged this"}])
    lines(root / "qrels/test.tsv", ["query-id\tcorpus-id\tscore", "q1\t2\t0", "q1\t2\t1", "q2\t3\t1", "q2\t1\t0", "short\tline"])
    return root


def test_ranked_set_and_run(spark, ranked):
    corpus, queries, judged = sets.load_ranked_set(spark, str(ranked))
    assert {r["query_id"] for r in queries.collect()} == {"q1", "q2"}
    assert {(r["query_id"], r["doc_id"]): r["grade"] for r in judged.collect()} == {("q1", "2"): 1, ("q2", "3"): 1, ("q2", "1"): 0}
    docs = sets.as_documents(corpus, "set")
    assert {r["set_id"]: r["text"] for r in docs.collect()}["3"] == "Rivers carry water."
    embed = embedding.hashing_embedder()
    chunks = chunking.chunk_documents(docs, chunking.Config("fixed", 16, 0, 0)).withColumn("embedding", embed("embedding_text")).persist()
    metrics, report = evaluation.run(Index(chunks, "hashing"), queries, sets.on_documents(judged, docs), k=2, depth=2, timed=1)
    assert all(m["latency"]["n"] == 1 and m["latency"]["p95"] > 0 and m["seconds"] > 0 for m in report["modes"].values())
    assert report["queries"] == {"scored": 2} and all(report["modes"][m]["mrr@10"] == 1.0 for m in ("dense", "lexical", "hybrid"))
    assert metrics.count() == 3 * 2 * 8 and "| hybrid |" in evaluation.as_markdown(report)
    with pytest.raises(sets.BadSet):
        sets.on_documents(judged.unionByName(judged.limit(1).withColumn("doc_id", judged["query_id"])), docs)


def test_structured_set(spark, tmp_path):
    lines(tmp_path / "docs/a.md", ["# A", "", "Alpha."])
    lines(tmp_path / "docs/b.md", ["# B", "", "Beta."])
    lines(tmp_path / "qrels.jsonl", [{"query_id": "q", "text": "alpha", "relevant_docs": ["a"], "relevant_sections": [["A"]]}])
    docs, queries, judged = sets.load_structured_set(spark, str(tmp_path), "c")
    assert docs.count() == 2 and queries.count() == 1 and judged.first()["doc_id"] == docs.where("set_id = 'a'").first()["doc_id"]
    for bad in ([{"query_id": "q", "text": "x", "relevant_docs": ["z"]}], [{"query_id": "q", "text": "x", "relevant_docs": []}], ["{broken"], [{"query_id": "q", "text": "x", "relevant_docs": ["a"]}] * 2):
        lines(tmp_path / "qrels.jsonl", bad)
        with pytest.raises(sets.BadSet):
            sets.load_structured_set(spark, str(tmp_path), "c")


def test_reply_cache(spark, tmp_path):
    entry = {"schema_version": 1, "key": "k", "model": "m", "content": "x"}
    lines(tmp_path / "a.jsonl", [entry, entry])
    assert sets.read_replies(spark, str(tmp_path / "a.jsonl")).count() == 1
    for bad in ([entry, entry | {"content": "y"}], [entry | {"schema_version": 2}]):
        lines(tmp_path / "b.jsonl", bad)
        with pytest.raises(sets.BadSet):
            sets.read_replies(spark, str(tmp_path / "b.jsonl"))


def test_errors_name_file_and_line(spark, tmp_path):
    import json

    good = [json.dumps({"schema_version": 1, "key": f"k{i}", "model": "m", "content": "c" * (i % 50)}) for i in range(300)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # several splits in a file
    try:
        cases = {
            "broken": (good[:250] + ['{"key": '] + good[250:], "line 251 is not a JSON object"),
            "format": (good[:100] + ["", '{"schema_version": 2, "key": "x", "content": "y"}'] + good[100:], "line 102 is an entry of another format"),
            "torn": (good + ["", good[7].replace('"k7"', '"k9"')], "line 302 has another content for key 'k9'"),
        }
        for name, (lines, said) in cases.items():
            (tmp_path / name).mkdir()
            (tmp_path / name / "a.jsonl").write_text("\n".join(lines) + "\n")
            if name != "torn":
                (tmp_path / name / "b.jsonl").write_text("\n".join(good[:20]) + "\n")
            with pytest.raises(sets.BadSet, match=f"a.jsonl: {said}"):
                sets.read_replies(spark, str(tmp_path / name))
        rows = sets.numbered_lines(spark, str(tmp_path / "torn")).collect()
        assert [r["value"] for r in sorted(rows, key=lambda r: r["line"])] == cases["torn"][0] and {r["line"] for r in rows} == set(range(1, 303))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
