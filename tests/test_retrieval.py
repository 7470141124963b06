"""Search, fusion, evaluation and answers on hand-computed examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import answer, evaluate, fusion, index, search


def hits_of(spark, rows):
    return spark.createDataFrame([("q", c, float(s), r) for c, s, r in rows], "query_id string, chunk_id string, score double, rank long")


def order_of(df):
    return [(r["chunk_id"], round(r["score"], 6)) for r in df.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def fruit(spark):
    rows = [("d1", "apple banana apple", "en"), ("d2", "banana cherry", "de"), ("d3", "cherry date elderberry fig", None)]
    return search.tokenized(spark.createDataFrame(rows, "chunk_id string, text string, lang string"))


def asked(spark, *texts):
    return spark.createDataFrame([(t, t) for t in texts], "query_id string, text string")


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("apple", [("d1", 1.34864)]),
        ("banana", [("d2", 0.544215), ("d1", 0.470004)]),
        ("Cherry, DATE!", [("d3", 1.276733), ("d2", 0.544215)]),
        ("apple apple apple", [("d1", 1.34864)]),
        ("quince", []),
        ("?!", []),
    ],
)
def test_bm25_scores(spark, fruit, query, want):
    assert order_of(search.bm25_search(fruit, asked(spark, query), 10)) == want


def test_bm25_parameters_and_filters(spark, fruit):
    assert order_of(search.bm25_search(fruit, asked(spark, "banana"), 10, b=0.0)) == [("d1", 0.470004), ("d2", 0.470004)]
    assert order_of(search.bm25_search(fruit, asked(spark, "apple"), 10, k1=0.0)) == [("d1", 0.980829)]
    assert order_of(search.bm25_search(fruit, asked(spark, "banana"), 1, search.matches(F.col("lang"), "en"))) == [("d1", 0.470004)]
    with pytest.raises(ValueError):
        search.bm25_scores(fruit, asked(spark, "x"), k1=-1)


def test_term_statistics(spark, fruit):
    stats = search.corpus_stats(fruit)
    terms = {r["term"]: (r["df"], round(r["idf"], 6)) for r in search.term_stats(search.postings(fruit), stats).collect()}
    assert stats.first()["avgdl"] == 3.0 and terms["apple"] == (1, 0.980829) and terms["banana"] == (2, 0.470004)


def test_upsert_and_delete(spark, fruit):
    old = spark.createDataFrame([("d1", "d1", "apple banana apple", 0), ("d2", "d2", "banana cherry", 1), ("d3", "d3", "cherry date elderberry fig", 2)], "chunk_id string, doc_id string, text string, ord long")
    new = spark.createDataFrame([("a", "d1", "grape"), ("b", "d1", "kiwi lemon")], "chunk_id string, doc_id string, text string").withColumn("ord", F.lit(0).cast("long"))
    got = index.upsert(old, new.withColumn("ord", F.when(F.col("chunk_id") == "a", 0).otherwise(1).cast("long")))
    assert [(r["chunk_id"], r["ord"]) for r in got.orderBy("ord").collect()] == [("d2", 1), ("d3", 2), ("a", 3), ("b", 4)]
    tokens = search.tokenized(got)
    assert search.corpus_stats(tokens).first()["avgdl"] == 2.25 and search.bm25_search(tokens, asked(spark, "apple"), 5).count() == 0
    left = search.tokenized(index.delete(old, spark.createDataFrame([("d2",)], "doc_id string")))
    terms = {r["term"]: r["idf"] for r in search.term_stats(search.postings(left), search.corpus_stats(left)).collect()}
    assert search.corpus_stats(left).first()["avgdl"] == 3.5 and terms["cherry"] == pytest.approx(np.log(2))
    assert index.upsert(old, new.withColumn("chunk_id", F.lit("d3")).limit(1), True).where("chunk_id = 'd3'").first()["doc_id"] == "d1"


@pytest.mark.parametrize("block", [1000, 3])
def test_dense_search_matches_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 32)).astype(np.float32)
    x[50:56] = x[3]
    vectors = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, [0.0] * 32, 0), (901, None, 0)], "chunk_id long, embedding array<float>, label int")
    queries = vectors.where("chunk_id < 8 or chunk_id >= 900").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = search.dense_search(vectors.where("label = 0"), queries, 7, block).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(8):
        score = {i: round(float(unit[q] @ unit[i]), 6) for i in range(0, 200, 3)} | {900: 0.0}
        want = sorted(score, key=lambda i: (-score[i], i))[:7]
        assert [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert not [r for r in got if r["query_id"] >= 900]


DENSE, LEXICAL = [("a", 0.9, 1), ("b", 0.8, 2), ("c", 0.7, 3)], [("c", 5.5, 1), ("a", 4.5, 2), ("d", 3.5, 3)]


@pytest.mark.parametrize(
    ("k", "weights", "want"),
    [
        (60, None, [("a", 0.032522), ("c", 0.032266), ("b", 0.016129), ("d", 0.015873)]),
        (60, {"lexical": 2}, [("c", 0.04866), ("a", 0.048652), ("d", 0.031746), ("b", 0.016129)]),
        (0, None, [("a", 1.5), ("c", 1.333333), ("b", 0.5), ("d", 0.333333)]),
    ],
)
def test_rank_fusion(spark, k, weights, want):
    lists = {"dense": hits_of(spark, DENSE), "lexical": hits_of(spark, LEXICAL)}
    got = fusion.reciprocal_rank_fusion(lists, rrf_k=k, weights=weights)
    assert order_of(got) == want
    first = got.where("chunk_id = 'a'").first()
    assert first["ranks"] == {"dense": 1, "lexical": 2} and first["components"] == {"dense": 0.9, "lexical": 4.5} and first["retriever"] == "hybrid-rrf"


def test_rank_fusion_ties(spark):
    lists = {"dense": hits_of(spark, [("a", 2, 1), ("b", 1, 2)]), "lexical": hits_of(spark, [("c", 2, 1), ("b", 1, 2)])}
    assert [c for c, _ in order_of(fusion.reciprocal_rank_fusion(lists, rrf_k=0))] == ["a", "c", "b"]


@pytest.mark.parametrize(
    ("dense", "lexical", "weights", "want"),
    [
        ([("a", 0.9, 1), ("b", 0.5, 2), ("c", 0.1, 3)], [("c", 8, 1), ("a", 2, 2)], None, [("a", 1.0), ("c", 1.0), ("b", 0.5)]),
        ([("a", 0.9, 1), ("b", 0.5, 2), ("c", 0.1, 3)], [("c", 8, 1), ("a", 2, 2)], {"dense": 2.0, "lexical": 0.5}, [("a", 2.0), ("b", 1.0), ("c", 0.5)]),
        ([("a", 2, 1), ("b", 1, 2)], [("c", 2, 1), ("d", 1, 2)], None, [("a", 1.0), ("c", 1.0), ("b", 0.0), ("d", 0.0)]),
        ([("a", 3, 1), ("b", 3, 2)], [("c", 7, 1)], None, [("a", 1.0), ("c", 1.0), ("b", 1.0)]),
    ],
)
def test_score_fusion(spark, dense, lexical, weights, want):
    got = fusion.weighted_score_fusion({"dense": hits_of(spark, dense), "lexical": hits_of(spark, lexical)}, weights=weights)
    assert order_of(got) == want


def test_fusion_guards(spark):
    lists = {"dense": hits_of(spark, [("a", 1, 1), ("a", 1, 2), ("b", float("nan"), 3), ("c", 1, 0)])}
    assert {r["reason"] for r in fusion.faulty_hits(lists).collect()} == {"duplicate chunk", "non-finite score", "rank under 1"}
    for weights in ({"x": 1}, {"dense": -1}, {"dense": float("nan")}, {"dense": 0}):
        with pytest.raises(ValueError):
            fusion.check_weights(["dense"], weights)


def test_rerank(spark):
    hits = hits_of(spark, [("a", 3, 1), ("b", 2, 2), ("c", 1, 3)])
    flip = lambda df: df.withColumn("new_score", F.when(F.col("chunk_id") == "c", 9.0).otherwise(1.0))
    got = fusion.rerank(hits, flip, 2, 3)
    assert order_of(got) == [("c", 9.0), ("a", 1.0)] and got.where("chunk_id = 'c'").first()["ranks"] == {"hybrid": 3}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        fusion.rerank(got, flip, 2, 3).collect()


def metrics_of(spark, ranked, qrels, ks=(1, 2, 5)):
    a = spark.createDataFrame([("q", d, i) for i, d in enumerate(ranked, 1)], "query_id string, doc_id string, rank long")
    b = spark.createDataFrame([("q", d, g) for d, g in qrels.items()], "query_id string, doc_id string, grade int")
    return evaluate.score_queries(a, b, ks).first().asDict()


def test_metrics(spark):
    got = metrics_of(spark, ["d1", "d2", "d3", "d4", "d5"], {"d1": 0, "d2": 1, "d3": 1, "d5": 1, "d9": 1})
    assert [got[f"recall@{k}"] for k in (1, 2, 5)] == [0, 0.25, 0.75] and [got[f"hit@{k}"] for k in (1, 2, 5)] == [0, 1, 1] and got["mrr@5"] == 0.5
    assert got["ndcg@5"] == pytest.approx(0.592512031965)
    assert metrics_of(spark, ["a", "b", "c"], {"a": 3, "b": 0, "c": 2, "d": 1}, (3,))["ndcg@3"] == pytest.approx(0.904949505846)
    again = metrics_of(spark, ["x", "y", "x", "z"], {"y": 1, "z": 1}, (2, 3))
    assert (again["recall@2"], again["recall@3"], again["mrr@3"]) == (0.5, 1.0, 0.5)
    assert set(v for k, v in metrics_of(spark, ["a"], {"b": 0}).items() if k != "query_id") == {0.0}
    assert set(v for k, v in metrics_of(spark, [], {"b": 1}).items() if k != "query_id") == {0.0}


def test_intervals(spark):
    df = spark.createDataFrame([(8, 10), (0, 10), (10, 10), (29, 30), (0, 0)], "s int, n int")
    low, high = evaluate.wilson(F.col("s"), F.col("n"))
    got = [(r[0] if r[0] is None else round(r[0], 4), r[1] if r[1] is None else round(r[1], 4)) for r in df.select(low, high).collect()]
    assert got == [(0.4902, 0.9433), (0.0, 0.2775), (0.7225, 1.0), (0.8333, 0.9941), (None, None)]


def test_bootstrap(spark):
    rows = [("m", f"q{i}", 1.0, 0.0) for i in range(3)]
    got = evaluate.bootstrap(spark.createDataFrame(rows, "metric string, query_id string, a double, b double"), ["metric"], 1000).first()
    assert (got["mean_diff"], got["ci_low"], got["ci_high"], got["n_positive"], got["n_negative"]) == (1.0, 1.0, 1.0, 1000, 0)
    rng = random.Random(0)
    gaps = [0.5, -0.2, 0.1, 0.0]
    means = sorted(sum(gaps[rng.randrange(4)] for _ in range(4)) / 4 for _ in range(200))
    rows = [("m", f"q{i}", g, 0.0) for i, g in enumerate(gaps)]
    got = evaluate.bootstrap(spark.createDataFrame(rows, "metric string, query_id string, a double, b double"), ["metric"], 200).first()
    assert (got["ci_low"], got["ci_high"]) == (means[4], means[195])


@pytest.mark.parametrize(("blocks", "ahead"), [(1, 1 << 22), (7, 50), (64, 1000)])
def test_bootstrap_in_blocks(spark, monkeypatch, blocks, ahead):
    monkeypatch.setattr(evaluate, "AHEAD", ahead)
    rng = random.Random(9)
    groups = {f"m{n}": [rng.uniform(-1, 1.2) for _ in range(n)] for n in (1, 2, 37, 64, 300)}
    rows = [(m, f"q{i:04d}", g, 0.0) for m, gaps in groups.items() for i, g in enumerate(gaps)]
    rng.shuffle(rows)
    got = {r["metric"]: r for r in evaluate.bootstrap(spark.createDataFrame(rows, "metric string, query_id string, a double, b double"), ["metric"], 150, 0.9, 5, blocks).collect()}
    for m, gaps in groups.items():
        own, means = random.Random(5), []
        for _ in range(150):
            total = 0.0
            for _ in gaps:
                total += gaps[own.randrange(len(gaps))]
            means.append(total / len(gaps))
        assert (got[m]["n"], got[m]["n_positive"], got[m]["n_negative"]) == (len(gaps), sum(x > 0 for x in means), sum(x < 0 for x in means))
        means.sort()
        assert (got[m]["ci_low"], got[m]["ci_high"]) == (means[7], means[142])


def test_depth(spark):
    ranked = lambda s: spark.createDataFrame([("q", c, i) for i, c in enumerate(s, 1)], "query_id string, doc_id string, rank long")
    got = evaluate.enough_depth(ranked("aaaabcd"), 3, 2, 100).first()
    assert (got["depth"], got["n_docs"], got["short"]) == (8, 3, False)
    got = evaluate.enough_depth(ranked("aaaab"), 3, 2, 100).first()
    assert got["n_docs"] == 2 and got["short"]
    full = ranked("aaaabcd")
    again = evaluate.deepen(lambda q, n: full.where(F.col("rank") <= n), spark.createDataFrame([("q",)], "query_id string"), 3, 2, 100)
    assert again.agg(F.max("depth")).first()[0] == 8


def test_kinds_gold_and_subsets(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    qrels = spark.createDataFrame([("a", "x", 1), ("b", "x", 0)], "query_id string, doc_id string, grade int")
    assert {r["query_id"]: r["kind"] for r in evaluate.query_kinds(queries, qrels).collect()} == {"a": "scored", "b": "no-relevant", "c": "unlabelled"}
    hits = spark.createDataFrame([("a", d, r) for r, d in enumerate("xyzw", 1)], "query_id string, doc_id string, rank long")
    assert [(r["doc_id"], r["rank"], r["context"]) for r in evaluate.drop_gold(hits, evaluate.relevant(qrels), 2).orderBy("rank").collect()] == [("y", 1, 0), ("z", 2, 1)]
    assert evaluate.subset(["b", "a", "a", "c"], 2, 0) == sorted(random.Random(0).sample(["a", "b", "c"], 2))


def answers(spark, query, *chunks, most=5):
    hits = spark.createDataFrame([("q", f"c{i}", i, t) for i, t in enumerate(chunks, 1)], "query_id string, chunk_id string, rank long, text string")
    return answer.extractive_answers(spark.createDataFrame([("q", query)], "query_id string, text string"), hits, most).first()


def test_extractive_answers(spark):
    assert answers(spark, "loyal dogs", "Cats are great pets. Dogs are loyal companions.")["answer"] == "Dogs are loyal companions."
    assert answers(spark, "dogs", "Dogs bark.", "DOGS  bark. Other dogs.", most=2)["answer"] == "Dogs bark. Other dogs."
    assert answers(spark, "unicorns", "Dogs bark.")["abstained"] and answers(spark, "what is the", "What is the point?")["n_citations"] <= 1


@pytest.mark.parametrize(
    ("content", "ok", "valid"),
    [
        ('{"answer": "x", "citations": [{"chunk_index": 0, "quote": "abcdefghijklmnopqrst"}]}', True, 1),
        ('{"answer": "x", "citations": [{"chunk_index": 0, "quote": "abcdefghijklmnopqrs"}]}', True, 0),
        ('{"answer": "x", "citations": [{"chunk_index": 0, "quote": "  abcdefghijklmnopqrs"}]}', True, 0),
        ('{"answer": "x", "citations": [{"chunk_index": 3, "quote": "abcdefghijklmnopqrst"}, 7]}', True, 0),
        ('Sure:\n```json\n{"answer": "x", "citations": [{"chunk_index": 0, "quote": "abcdefghijklmnopqrst"}]}\n```', True, 1),
        ("no json", False, 0),
    ],
)
def test_grading(spark, content, ok, valid):
    replies = spark.createDataFrame([("q", "answerable", content)], "query_id string, kind string, content string")
    contexts = spark.createDataFrame([("q", 0, "d", "--abcdefghijklmnopqrstuvwxyz--")], "query_id string, context long, doc_id string, text string")
    gold = spark.createDataFrame([("q", "d")], "query_id string, doc_id string")
    got = answer.grade(replies, contexts, gold).first()
    assert (got["parse_ok"], got["n_valid"], got["citation_recall"], got["abstention_correct"]) == (ok, valid, float(valid), ok)
    total = answer.aggregate_grades(answer.grade(replies, contexts, gold)).first()
    assert total["n_items"] == 1 and total["correct_abstention_rate"] is None


def test_models_score_pairs_and_embed_in_batches(spark):
    import numpy as np

    from lodestar.operators import embedding

    texts = spark.createDataFrame([("a", "one two"), ("b", "one"), ("c", None)], "chunk_id string, text string")
    queries = spark.createDataFrame([("q", "one two")], "query_id string, text string")

    def load():
        def model(pairs):
            assert len(pairs) <= 2
            return [len(set(q.split()) & set(t.split())) for q, t in pairs]

        return model

    hits = hits_of(spark, [("c", 3, 1), ("b", 2, 2), ("a", 1, 3)])
    assert order_of(fusion.rerank(hits, fusion.pair_scorer(texts, queries, load, 2), 3)) == [("a", 2.0), ("b", 1.0), ("c", 0.0)]
    for bad in (lambda: lambda pairs: [1.0], lambda: lambda pairs: [float("nan")] * len(pairs)):
        with pytest.raises(Exception, match="number of scores"):
            fusion.rerank(hits, fusion.pair_scorer(texts, queries, bad), 3).collect()
    model = lambda: lambda rows: np.ones((len(rows), 3))
    rows = spark.createDataFrame([(1, " "), (2, None), (3, "x")], "i int, t string").repartition(3)
    got = {r["i"]: r["e"] for r in rows.select("i", embedding.model_embedder(model, dimension=3)(F.col("t")).alias("e")).collect()}
    assert got[1] == got[2] == [0, 0, 0] and got[3] == pytest.approx([3**-0.5] * 3)
    alone = rows.where("i = 1").select(embedding.model_embedder(model)(F.col("t")).alias("e")).first()["e"]
    assert alone is None
    with pytest.raises(Exception, match="wrong shape"):
        rows.select(embedding.embedder("x:y", lambda spec: model, 4)(F.col("t"))).collect()
