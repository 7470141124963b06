"""Text functions, loaders, chunkers, the saved index and the service on small fixtures of their own."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.jobs import service
from lodestar.jobs.options import Request, Settings, parse_filters, parse_weights
from lodestar.operators import chunking, embedding, index
from lodestar.sources import files
from lodestar.streaming import ingest as streams

GUIDE = """---
title: Field Guide
tags: [rag, 2]
version: 2
---

Before any heading.

# Field Guide

About the field.

## Birds

They fly.

```python
# no heading
```

### Small birds

They fly fast.

## Fish

They swim.
"""
PAGE = """<html lang="en"><head><title>Deep   Water</title><meta name="description" content="About water."><style>b{}</style></head><body><nav>Home</nav>
<h1>Deep Water</h1><p>Water is <b>deep</b>, and
 wet.</p><h2>Cost</h2><ul><li>One.</li><li>Two.</li></ul><footer>Foot</footer></body></html>"""


@pytest.mark.parametrize(
    ("raw", "hyphens", "want"),
    [("ﬁn x\r\ny\rz", False, "fin x\ny\nz"), ("a\0b\x07c\td\ne", False, "abc\td\ne"), ("a\n\n\n\nb", False, "a\n\nb"), ("    return  1", False, "return 1"), ("x\n    return  1", False, "x\n    return 1"), ("infor-\nmation about COVID-\n19", True, "information about COVID-\n19"), ("infor-\nmation", False, "infor-\nmation")],
)
def test_normalisation(spark, raw, hyphens, want):
    assert files.normalize(raw, hyphens) == want
    assert spark.createDataFrame([(raw,)], "t string").select(X.normalize(F.col("t"), hyphens)).first()[0] == want


def test_identities(spark):
    df = spark.createDataFrame([("guide/intro.md",)], "s string")
    assert df.select(X.document_id("handbook", F.col("s"))).first()[0] == "120aa960849299ee"
    ids = {"handbook": True, "corpus-1": True, "a.b_c": True, "a" * 64: True, "": False, "Handbook": False, "a:b": False, "-x": False, "a" * 65: False, "a b": False, "é": False}
    got = spark.createDataFrame([(k,) for k in ids], "s string").select("s", X.valid_corpus_id(F.col("s"))).collect()
    assert {r[0]: r[1] for r in got} == ids
    paths = {"a/b.md": True, "": False, "/a": False, "a//b": False, "a/../b": False, "a\\b": False, "./a": False}
    got = spark.createDataFrame([(k,) for k in paths], "s string").select("s", X.valid_source(F.col("s"))).collect()
    assert {r[0]: r[1] for r in got} == paths
    assert spark.createDataFrame([("My Docs (v2)!",)], "s string").select(X.corpus_slug(F.col("s"))).first()[0] == "my-docs-v2"


def test_tokens(spark):
    df = spark.createDataFrame([("CAFÉ, naïve_test 42 Straße",)], "t string")
    assert df.select(X.bm25_tokens(F.col("t"))).first()[0] == ["café", "naïve_test", "42", "strasse"]
    assert df.select(X.bm25_tokens_exact(F.concat(F.lit("Ｆull "), F.col("t")))).first()[0] == ["full", "café", "naïve_test", "42", "strasse"]
    q = spark.createDataFrame([("Abc", "xx abC"), ("abc", "xxabc"), ("z", "abc")], "q string, t string")
    assert [r[0] for r in q.select(X.locate_quote(F.col("q"), F.col("t"))).collect()] == [3, 2, None]


def test_markdown_and_html():
    doc = files.load("guide.md", GUIDE.encode())
    assert doc["title"] == "Field Guide" and doc["metadata"]["tags"] == ["rag", "2"] and doc["metadata"]["version"] == 2
    g = "Field Guide"
    assert [s["heading_path"] for s in doc["sections"]] == [[], [g], [g, "Birds"], [g, "Birds", "Small birds"], [g, "Fish"]]
    assert doc["sections"][0]["start_char"] == 0 and doc["sections"][-1]["end_char"] == len(doc["text"])
    page = files.load("water.html", PAGE.encode())
    assert page["title"] == "Deep Water" and "Water is deep, and wet." in page["text"] and page["metadata"]["language"] == "en" and page["metadata"]["description"] == "About water."
    assert not any(x in page["text"] for x in ("Home", "Foot", "b{}")) and [s["heading_path"] for s in page["sections"]] == [["Deep Water"], ["Deep Water", "Cost"]]
    assert files.load("a.md", b"---\n[1, 2]\n---\nx")["text"].startswith("---")
    assert files.load("a.txt", "café".encode("latin-1"))["metadata"]["encoding"] == "latin-1"


def test_ingest(spark, tmp_path):
    root = tmp_path / "docs"
    (root / ".hidden").mkdir(parents=True)
    (root / ".hidden/x.md").write_text("secret")
    (root / "sub").mkdir()
    for name, body in {"guide.md": GUIDE, "water.html": PAGE, "a.txt": "Two words.", "sub/b.txt": "Two  words.", "blank.md": " \n", "image.png": "x", "big.txt": "y" * 2500, "bad.pdf": "garbage"}.items():
        (root / name).write_text(body)
    (root / "zero.txt").write_bytes(b"a\0b")
    got = {r["source"]: r for r in files.ingest(spark, str(root), "corpus", 2000).collect()}
    why = {k: v["skipped"] for k, v in got.items()}
    assert {k for k, v in why.items() if v is None} == {"guide.md", "water.html", "a.txt"} and len(got) == 9
    assert why["sub/b.txt"] == "duplicate content of a.txt" and why["big.txt"] == "too large" and why["blank.md"] == "no extractable text" and "unsupported" in why["image.png"] and why["bad.pdf"] and "binary" in why["zero.txt"]


def random_markdown(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    para = lambda: " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 25))) + "." for _ in range(rng.randint(1, 6)))
    out = ["# Title"]
    for i in range(6):
        out += [f"## Part {i}"] + [para() for _ in range(rng.randint(1, 4))] + ([f"### Sub {i}", para()] if i % 2 == 0 else [])
    return files.from_markdown("\n\n".join(out))


@pytest.mark.parametrize("strategy", ["fixed", "recursive", "structure"])
@pytest.mark.parametrize(("size", "overlap", "least"), [(16, 0, 0), (32, 8, 4), (64, 16, 16), (200, 40, 16)])
def test_chunks_cover_their_text(strategy, size, overlap, least):
    for seed in (1, 2, 3):
        doc = random_markdown(seed)
        text = doc["text"]
        tokens = chunking._Tokens(text)
        spans = chunking.spans_of(text, [(s["start_char"], s["end_char"]) for s in doc["sections"]], chunking.Config(strategy, size, overlap, least))
        covered = set()
        for s, e, n in spans:
            assert text[s:e] == text[s:e].strip() and n == tokens.count(s, e) <= size
            covered.update(i for i, (a, b) in enumerate(tokens.spans) if s <= a and b <= e)
        assert covered == set(range(len(tokens.spans))) and [s for s, _, _ in spans] == sorted(s for s, _, _ in spans)


def test_windows_and_merging(spark):
    config = lambda *a: chunking.Config(*a)
    hundred = " ".join(f"w{i}" for i in range(100))
    assert [n for _, _, n in chunking.spans_of(hundred, [], config("fixed", 30, 10, 0))] == [30, 30, 30, 30, 20]
    assert [n for _, _, n in chunking.spans_of("token " * 95, [], config("recursive", 30, 0, 0))] == [30, 30, 30, 5]
    got = chunking.fixed_chunks(spark.createDataFrame([(1, "  " + hundred + " \n"), (2, ""), (3, None)], "doc_id long, text string"), 30, 10).orderBy("index").collect()
    assert [r["token_count"] for r in got] == [30, 30, 30, 30, 20] and all(("  " + hundred)[r["start_char"] : r["end_char"]] == r["text"] for r in got)
    small = files.from_markdown("# T\n\n## A\n\none two.\n\n## B\n\nthree four.")
    rows = [("d", small["title"], small["text"], small["sections"])]
    df = spark.createDataFrame(rows, "doc_id string, title string, text string, sections array<struct<start_char:int,end_char:int,heading_path:array<string>,page:int>>")
    chunks = chunking.chunk_documents(df, config("structure", 64, 0, 16)).collect()
    assert len(chunks) == 1 and chunks[0]["heading_path"] == ["T"] and chunks[0]["context_header"] == "T" and chunks[0]["embedding_text"].startswith("T\n\n# T")


def test_hashing_embedder(spark):
    import hashlib

    embed = embedding.hashing_embedder(64)
    got = [np.array(r[0]) for r in spark.createDataFrame([("The cat sat",), ("the CAT sat!",), ("",), (None,)], "t string").select(embed(F.col("t"))).collect()]
    assert np.allclose(got[0], got[1]) and np.linalg.norm(got[0]) == pytest.approx(1) and not got[2].any() and not got[3].any()
    v = int.from_bytes(hashlib.blake2b(b"cat", digest_size=8).digest(), "little")
    one = np.array(spark.createDataFrame([("cat",)], "t string").select(embed(F.col("t"))).first()[0])
    assert one[v % 64] == (1 if v >> 63 else -1) and np.abs(one).sum() == 1
    for bad in ("hashing-4", "unknown"):
        with pytest.raises(ValueError):
            embedding.embedder(bad)


def test_service_end_to_end(spark, tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    (root / "guide.md").write_text(GUIDE)
    (root / "water.html").write_text(PAGE)
    out = str(tmp_path / "index")
    manifest = service.build(spark, str(root), out, "corpus", Settings(size=16, overlap=2, min_tokens=0))
    assert manifest["documents"] == 2 and manifest["dimension"] == 512
    held = service.Index.load(spark, out)
    queries = spark.createDataFrame([("q1", "deep wet water"), ("q2", "small birds"), ("q3", "  ")], "query_id string, text string")
    texts = {r["chunk_id"]: r["text"] for r in held.chunks.collect()}
    for mode in ("dense", "lexical", "hybrid"):
        hits = held.search(queries, Request("x", 2, mode)).where("rank = 1").collect()
        best = {r["query_id"]: texts[r["chunk_id"]] for r in hits}
        assert "wet" in best["q1"] and "irds" in best["q2"] and "q3" not in best
    assert held.search(queries, Request("x", 3, "hybrid", "weighted", rerank=True, filters={"format": "html"})).join(held.chunks, "chunk_id").select("format").distinct().collect() == [("html",)]
    assert "wet" in held.answer(queries.limit(1), Request("x")).first()["answer"]
    chunks, docs, _ = index.load(spark, out)
    broken = chunks.withColumn("text", F.concat("text", F.lit("!")))
    with pytest.raises(index.IndexFault):
        index.save(str(tmp_path / "other"), broken, docs, "hashing", 512)
    with pytest.raises(index.IndexFault):
        index.load(spark, str(tmp_path / "nothing"))
    file = tmp_path / "index/manifest.json"
    file.write_text(json.dumps(json.loads(file.read_text()) | {"chunks": 999}))
    (tmp_path / "index/.manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(index.IndexFault):
        index.load(spark, out)


@pytest.mark.parametrize("bad", [{"query": " "}, {"k": 0}, {"mode": "x"}, {"mode": "dense", "rrf_k": 3}, {"fusion": "weighted", "rrf_k": 3}, {"mode": "dense", "candidates": 5}, {"weights": {"dense": 0}}, {"weights": {"x": 1}}, {"filters": {"a": []}}])
def test_options(bad):
    with pytest.raises(ValueError):
        Request(**({"query": "q"} | bad))


def test_settings_and_parsing():
    assert Settings.from_env({"LODESTAR_SIZE": "64", "LODESTAR_EMBEDDER": " "}).size == 64
    with pytest.raises(ValueError):
        Settings.from_env({"LODESTAR_SIZE": "x"})
    assert parse_filters(["lang=en", "lang=de", "page=3"]) == {"lang": ["en", "de"], "page": 3} and parse_weights([]) is None and parse_weights(["dense=0.5"]) == {"dense": 0.5}
    with pytest.raises(ValueError):
        parse_filters(["nothing"])


def test_stream_keeps_the_index(spark, tmp_path):
    schema = "chunk_id string, doc_id string, text string, ord long"
    source = tmp_path / "in"
    path, check = str(tmp_path / "out"), str(tmp_path / "check")
    for batch, rows in enumerate([[("a", "d1", "x", 0), ("b", "d2", "y", 1)], [("c", "d1", "z", 0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        streams.keep_index(spark.readStream.schema(schema).parquet(str(source)), spark, path, check).awaitTermination()
        seen = {r["chunk_id"] for r in spark.read.parquet(f"{path}/version={batch}").collect()}
    assert seen == {"b", "c"}


def test_queries_are_registered_with_sql():
    import __spark_entry__

    from lodestar.jobs.queries import QUERIES

    assert set(QUERIES) <= set(__spark_entry__.queries()) and {k for k, (_, sql) in QUERIES.items() if sql} <= set(__spark_entry__.oracle_sql())


def test_runs_of_blanks_take_linear_time(spark):
    import time

    from lodestar.functions.text import normalize
    from lodestar.sources import files

    blanks = " " * (1 << 20)
    for text, want in ((blanks + "a", "a"), ("a" + blanks + "b" + blanks, "a b"), ("a\n" + blanks + "\nb", "a\n\nb"), (blanks, "")):
        began = time.time()
        assert files.normalize(text) == want
        assert time.time() - began < 5
        began = time.time()
        assert spark.createDataFrame([(text,)], "t string").select(normalize(F.col("t"))).first()[0] == want
        assert time.time() - began < 10


@pytest.mark.parametrize("span", [1 << 20, 7])
def test_section_crossing_against_brute_force(spark, monkeypatch, span):
    import random

    from lodestar.operators import chunking

    monkeypatch.setattr(chunking, "SPAN", span)
    rng = random.Random(span)
    sections = {d: sorted(rng.sample(range(100), rng.randrange(1, 12))) for d in range(8)}
    chunks = [(rng.randrange(9), s, s + rng.randrange(1, 30)) for s in (rng.randrange(100) for _ in range(200))]
    own = [(d, s, e) for d, s, e in chunks if d in sections]
    place = lambda d, c: sum(x <= c for x in sections[d])
    got = chunking.section_crossing(spark.createDataFrame(chunks, "doc_id long, start_char long, end_char long"), spark.createDataFrame([(d, s) for d, v in sections.items() for s in v], "doc_id long, start long")).first()
    assert (got["chunks"], got["crossing"]) == (len(own), sum(place(d, s) != place(d, e - 1) for d, s, e in own))


def test_dense_search_of_odd_vectors(spark):
    from lodestar.operators import search

    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", [1.0, None]), ("d", None), ("e", [float("nan"), 1.0]), ("f", [0.0, 0.0]), ("g", [1.0, 1.0, 1.0])], "chunk_id string, embedding array<double>")
    asked = lambda *rows: spark.createDataFrame(list(rows), "query_id string, embedding array<double>")
    assert [r["chunk_id"] for r in search.dense_search(vectors, asked(("q", [1.0, 0.0]), ("n", None), ("z", [0.0, 0.0]), ("x", [None, 1.0])), 5).orderBy("rank").collect()] == ["a", "f"]
    assert search.dense_search(vectors, asked(("n", None)), 5).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        search.dense_search(vectors, asked(("q", [1.0, 0.0]), ("p", [1.0])), 5)
