"""The pipeline's stages, each against brute force on what the stage before it returned."""

import random

import pytest

import corpus_pipeline
from lodestar.llm import mixing, secret_scan
from tests.llm.test_operators import TOKEN, brute_components, brute_hits, changed, odd_rows, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, prose(rng, 25)) for i in range(6)]
    junk = lambda: " ".join(w.upper() + "!!" for w in prose(rng, 30).split())
    texts = [junk() if i % 6 == 0 else prose(rng, 30 + i % 90) for i in range(240)]
    texts += [changed(rng, texts[1], 0), texts[2] + " end", texts[2].upper(), *(f"{prose(rng, 10)} {t}" for _, t in items), f"{prose(rng, 40)} {TOKEN} {prose(rng, 20)}"]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [((i or 0) + 1000 if i else None, t, None, None, None) for i, t in odd_rows(rng)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 6 == 0 else 1, 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_stages_against_brute_force(spark, folder, tmp_path):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{at}")
        out = spark.read.parquet(f"{tmp_path}/{at}")
        seen.append((docs.collect(), out.collect()))
        assert out.columns[:5] == COLUMNS and (at == 4 or out.columns == COLUMNS)
        docs = out
    ids = lambda rows: sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    (before, after) = seen[0]
    good = [r["doc_id"] for r in before if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 6]
    assert len(set(good) & set(ids(after))) > 0.97 * len(good) and len([i for i in ids(after) if i < 240 and i % 6 == 0]) <= 2
    (before, after) = seen[1]
    comps = brute_components([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
    assert ids(after) == sorted(i for i, (_, c) in comps.items() if c == i)
    (before, after) = seen[2]
    clean = []
    for r in before:
        n, hit, _ = brute_hits(r["text"], items)
        if r["doc_id"] is not None and not (hit > 0 and 20 * hit >= n):
            clean.append(r["doc_id"])
    assert ids(after) == sorted(clean)
    (before, after) = seen[3]
    assert ids(before) == ids(after) and not [r for r in after if r["text"] and secret_scan.base_spans(r["text"])]
    changed_rows = {r["doc_id"]: r for r in after}
    for r in before:
        same = not (r["text"] and secret_scan.base_spans(r["text"]))
        got = changed_rows[r["doc_id"]]
        assert (got["text"] == r["text"]) == same and (same or got["n_chars"] == len(got["text"]))
    (before, after) = seen[4]
    weighed = {r["doc_id"]: r for r in mixing.weigh(spark.read.parquet(f"{tmp_path}/3")).collect()}
    assert ids(after) == sorted(i for i, r in weighed.items() if r["kept"] and i is not None) and 0 < len(after) < len(before)


def test_run_is_the_stages_in_order(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == [*COLUMNS, "topic", "n_tokens", "weight", "probability"] and out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_rows_without_id_are_judged_like_all_others(spark, folder):
    path, items = folder
    rng = random.Random(5)
    text, other, clean = prose(rng, 60), prose(rng, 50), prose(rng, 40)
    rows = [(None, text), (None, text), (None, text + " end"), (7, other), (None, other), (7, clean), (7, clean), (None, None), (None, ""), (8, None), (None, items[0][1]), (9, items[1][1])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, path).collect()]
    assert len(left) == len(set(left)) and len([1 for _, t in left if t in (text, text + " end")]) == 1
    assert (7, other) in left and (None, other) not in left and (7, clean) in left  # one id, two texts: two documents
    assert {(None, None), (None, ""), (8, None)} <= set(left)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, docs, path).collect()]
    assert sorted(left, key=repr) == sorted([r for r in rows if r[1] not in (items[0][1], items[1][1])], key=repr)


def test_columns_of_clashing_names_are_carried(spark, folder):
    path, _ = folder
    rng = random.Random(8)
    names = ("score", "predicted", "_key", "_cell", "_chance", "carried3", "id", "component_id", "n.hit", "Text2")
    rows = [(i, prose(rng, 50), "en", f"s{i % 3}", 1, *(f"{name} {i}" for name in names)) for i in range(40)]
    docs = spark.createDataFrame(rows, [*COLUMNS, *names])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.columns[: len(docs.columns)] == docs.columns
        for r in out.collect():
            assert all(r[name] == f"{name} {r['doc_id']}" for name in names)
