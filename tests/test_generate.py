"""Generation with repair, recording and replay, and the run over its items."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from lodestar.jobs.evaluation import write_report
from lodestar.operators import generate

EMPTY = "key string, model string, content string"


def client(prompt):
    """By the question: `good` at once, `mended` after a repair, `bad` never, `lost` not at all."""
    messages = json.loads(prompt)
    question = messages[1]["content"].rsplit("Question: ", 1)[1]
    if question == "lost":
        raise ValueError("no line")
    if question == "bad" or question == "mended" and len(messages) == 2:
        return "not json"
    return json.dumps({"answer": question, "abstained": False, "citations": [{"chunk_index": 0, "quote": "the words of the first context"}]})


def items_of(spark):
    rows = [(q, kind, question, c, f"d{c}", text) for q, kind, question in [("q1", "answerable", "good"), ("q2", "answerable", "mended"), ("q3", "no_relevant", "bad"), ("q4", "answerable", "lost"), ("q5", "answerable", "good")] for c, text in enumerate(["here are the words of the first context", None])]
    return spark.createDataFrame(rows, "query_id string, kind string, question string, context long, doc_id string, text string")


def test_repair_recording_and_replay(spark, tmp_path):
    items, empty = items_of(spark), spark.createDataFrame([], EMPTY)
    made = generate.generate(items, client, empty, "m")
    got = {r["query_id"]: r for r in made.replies.collect()}
    assert [len(got[q]["contents"]) for q in ("q1", "q2", "q3", "q4", "q5")] == [1, 2, 2, 0, 1]
    assert [got[q]["valid"] for q in ("q1", "q2", "q3", "q4", "q5")] == [True, True, False, False, True]
    assert got["q4"]["error"] == "no line" and got["q3"]["error"] is None and [got[q]["n_calls"] for q in ("q1", "q2", "q3", "q4")] == [1, 2, 2, 0]
    recorded = made.recorded.collect()
    assert len(recorded) == 5  # q5 has q1's prompt: one key
    cache = spark.createDataFrame(recorded, EMPTY)
    again = generate.generate(items.where("query_id <> 'q4'"), None, cache, "m", replay_only=True)
    assert {r["query_id"]: r["contents"] for r in again.replies.collect()} == {q: got[q]["contents"] for q in ("q1", "q2", "q3", "q5")}
    assert again.replies.agg(F.sum("n_calls")).first()[0] == 0 and again.recorded.count() == 0
    partly = generate.generate(items, client, cache.where("content <> 'not json'"), "m")
    assert {r["query_id"]: (r["n_hits"], r["n_calls"]) for r in partly.replies.collect()} == {"q1": (1, 0), "q2": (1, 1), "q3": (0, 2), "q4": (0, 0), "q5": (1, 0)}
    assert partly.recorded.count() == 3
    with pytest.raises(Exception, match="no cached reply"):
        generate.generate(items, None, cache, "m", replay_only=True)
    with pytest.raises(Exception, match="no cached reply"):
        generate.generate(items.where("query_id = 'q1'"), None, cache, "other", replay_only=True)
    unrepaired = {r["query_id"]: r["valid"] for r in generate.generate(items, client, empty, "m", repairs=0).replies.collect()}
    assert unrepaired == {"q1": True, "q2": False, "q3": False, "q4": False, "q5": True}
    gold = spark.createDataFrame([("q1", "d0"), ("q2", "d9")], "query_id string, doc_id string")
    records, report = generate.answer_run(items, made, gold)
    assert report["metrics"]["n_items"] == 5 and report["metrics"]["n_parse_ok"] == 3 and (report["n_api_calls"], report["n_cache_hits"], report["n_failed"]) == (6, 0, 1)
    assert {r["query_id"]: r["n_valid_gold"] for r in records.collect()}["q1"] == 1
    write_report(spark, report, str(tmp_path / "answers.json"))
    assert json.loads((tmp_path / "answers.json").read_text())["metrics"]["n_items"] == 5
    with pytest.raises(ValueError, match="no items"):
        generate.answer_run(items.limit(0), generate.Generated(made.replies.limit(0), made.recorded), gold)


def test_each_prompt_is_sent_once(spark):
    sent = spark.sparkContext.accumulator(0)

    def counted(prompt):
        sent.add(1)
        return client(prompt)

    made = generate.generate(items_of(spark).where("query_id in ('q1', 'q2', 'q5')"), counted, spark.createDataFrame([], EMPTY), "m")
    for _ in range(2):
        made.replies.count(), made.recorded.count()
    assert sent.value == 3  # q1 and q5 share theirs, q2 is repaired


def test_choice():
    assert [generate.chosen(c, f) for c, f in (("auto", None), ("auto", client), ("extractive", client), ("model", client))] == ["extractive", "model", "extractive", "model"]
    for c, f in (("model", None), ("else", client)):
        with pytest.raises(ValueError):
            generate.chosen(c, f)


def test_chat_client():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            ok = body["messages"][0]["content"] == "hi" and self.headers["Authorization"] == "Bearer k"
            data = json.dumps({"choices": [{"message": {"content": "yes"}}]} if ok else {"choices": []}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert generate.chat_client(url, "m", "k")('[{"role": "user", "content": "hi"}]') == "yes"
    for bad in (generate.chat_client(url, "m"), generate.chat_client("http://127.0.0.1:9", "m", timeout=2)):
        with pytest.raises(ValueError, match="no reply"):
            bad('[{"role": "user", "content": "hi"}]')
    server.shutdown()
