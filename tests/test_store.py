"""The stored lexical index, versions on disk, metadata filters, checks on loading."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.jobs import service
from lodestar.jobs.options import Request, Settings
from lodestar.operators import postings, search, store, tables
from lodestar.operators.index import IndexFault

WORDS = [f"w{i}" for i in range(60)] + ["the"] * 40 + ["Straße", "½", "ﬁn"]


def made(spark, n, seed, first=0, meta=True):
    rng = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 30, 200])))
        rows.append((f"d{i // 3}", f"c{i}", text, json.dumps({"topic": rng.choice(["a", "b"]), "year": rng.choice([1999, 2000, 2000.0, "2000"]), "tags": rng.choice([[], ["x"], ["x", "y"], "x"]), "ok": rng.choice([True, False, None, 1]), "a.b'c": 1})))
    df = spark.createDataFrame(rows, "doc_id string, chunk_id string, embedding_text string, metadata string")
    return df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5)))


def whole(chunks):
    """A document for each doc_id whose chunks are its lines."""
    rows = {}
    for r in chunks.orderBy("chunk_id").collect():
        rows.setdefault(r["doc_id"], []).append(r)
    docs, out = [], []
    for doc_id, own in rows.items():
        text = "\n".join(f"{r['chunk_id']} {r['embedding_text']}" for r in own)
        docs.append((doc_id, text))
        at = 0
        for r in own:
            line = f"{r['chunk_id']} {r['embedding_text']}"
            out.append((doc_id, r["chunk_id"], line, at, at + len(line), line, r["metadata"], [1.0, 0.5]))
            at += len(line) + 1
    spark = chunks.sparkSession
    docs = spark.createDataFrame(docs, "doc_id string, text string")
    cut = spark.createDataFrame(out, "doc_id string, chunk_id string, text string, start_char long, end_char long, embedding_text string, metadata string, embedding array<double>")
    return cut.join(docs.select("doc_id", X.content_hash(F.col("text")).alias("content_hash")), "doc_id"), docs


def asked(spark):
    return spark.createDataFrame([("q1", "w1 w2 the"), ("q2", "the"), ("q3", "w7 w7 strasse 1⁄2"), ("q4", "nothing here"), ("q5", " "), ("q6", "w9 w10 w11 w12 the the fin")], "query_id string, text string")


def plain(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("block", "pruned_from", "k"), [(1024, 64, 5), (8, 0, 1), (8, 0, 7), (8, 2, 40), (4, 0, 3)])
def test_stored_search_equals_the_search_of_texts(spark, tmp_path, monkeypatch, block, pruned_from, k):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "SIDE_BY_SIDE", 3)
    monkeypatch.setattr(postings, "FIRST", 1)
    chunks = made(spark, 400, 1).repartition(3).withColumn("ord", F.monotonically_increasing_id())
    tables.stored(chunks, "chunks")
    chunks.write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    postings.write(postings.build(chunks), str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).withColumn("segment", F.lit("s"))
    tokens = search.tokenized(chunks, "embedding_text")
    n, length = tokens.agg(F.count("*"), F.sum("length")).first()
    index = postings.Postings(rows, n, length)
    assert plain(index.search(asked(spark), k, pruned_from=pruned_from)) == plain(search.bm25_search(tokens, asked(spark), k))
    keep = chunks.where("chunk_id like '%3'")
    places = keep.select(F.lit("s").alias("segment"), F.expr(f"ord div {block}").alias("block"), (F.col("ord") % block).cast("int").alias("place"))
    assert plain(index.search(asked(spark), k, places, pruned_from=pruned_from)) == plain(search.bm25_search(tokens, asked(spark), k, F.col("chunk_id").like("%3")))


def test_pruning_leaves_blocks_unread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "FIRST", 1)
    rows = [(i, f"c{i}", "rare rare rare" if i == 77 else "rare " + "filler " * 50 if i % 4 == 0 else "filler") for i in range(200)]
    chunks = spark.createDataFrame(rows, "ord long, chunk_id string, embedding_text string")
    postings.write(postings.build(chunks), str(tmp_path / "p"))
    index = postings.Postings(spark.read.parquet(str(tmp_path / "p")).withColumn("segment", F.lit("s")), 200, 1000)
    read = []
    scored = postings.Postings._scored
    monkeypatch.setattr(postings.Postings, "_scored", lambda self, lists, *a: read.append(lists.select("block").distinct().count()) or scored(self, lists, *a))
    found = index.search(spark.createDataFrame([("q", "rare")], "query_id string, text string"), 1, pruned_from=0).collect()
    assert [r["chunk_id"] for r in found] == ["c77"] and read == [1, 0]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks, docs = whole(made(spark, 60, 2))
    first = store.Store.create(spark, path, chunks, docs, "hashing", 2)
    first.check()
    assert (first.manifest["version"], first.manifest["chunks"], first.manifest["documents"]) == (1, 60, 20)
    new, new_docs = whole(made(spark, 12, 3, first=51))  # d17..d20: three replaced, one new
    second = first.upsert(new, new_docs)
    second.check()
    third, removed = second.delete(spark.createDataFrame([("d1",), ("d1",), ("nobody",)], "doc_id string"))
    third.check()
    assert removed == 3 and third.manifest["chunks"] == 60 - 9 + 12 - 3
    assert third.delete(spark.createDataFrame([("nobody",)], "doc_id string")) == (third, 0)

    def searched(s):
        return plain(s.postings().search(asked(spark), 9)), plain(search.bm25_search(search.tokenized(s.chunks(), "embedding_text"), asked(spark), 9))

    for version in (1, 2, 3):
        stored, fresh = searched(store.Store.open(spark, path, version))
        assert stored == fresh and stored
    assert store.Store.open(spark, path).manifest == third.manifest
    live = {r["chunk_id"] for r in third.chunks().collect()}
    assert live == {f"c{i}" for i in range(63)} - {"c3", "c4", "c5"}
    whole_again = third.compact()
    whole_again.check()
    assert searched(whole_again) == searched(third) and len(whole_again.manifest["segments"]) == 1
    assert whole_again.vacuum() and store.Store.open(spark, path).chunks().count() == 60
    with pytest.raises(IndexFault, match="no version 2"):
        store.Store.open(spark, path, 2)
    with pytest.raises(IndexFault, match="no longer the current"):
        third.upsert(new, new_docs)


def test_texts_stand_on_disk_once_and_do_not_travel(spark, tmp_path):
    """Equal embedding texts are not written a second time, deleted keys come to the texts, a fault in any part of the documents is told."""
    path, rng = str(tmp_path / "index"), random.Random(8)
    rows = [(f"d{i}", f"c{i}", " ".join(f"{rng.getrandbits(60):x}" for _ in range(400))) for i in range(60)]
    docs = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id string, text string").repartition(1)
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, text string").repartition(1).withColumns({
        "content_hash": X.content_hash(F.col("text")), "start_char": F.lit(0).cast("long"), "end_char": F.length("text").cast("long"), "embedding": F.array(F.lit(1.0), F.lit(0.5)),
        "embedding_text": F.when(F.col("chunk_id") == "c1", F.lit(None)).when(F.col("chunk_id") == "c2", "a title").otherwise(F.col("text"))})
    first = store.Store.create(spark, path, chunks, docs, "none", 2)
    first.check()
    on_disk = lambda kind: sum(f.stat().st_size for f in (tmp_path / "index" / kind).rglob("*.parquet"))
    assert on_disk("chunks") < 1.2 * on_disk("documents")
    assert {".zstd." in f.name for f in (tmp_path / "index").rglob("*.parquet")} == {True}
    want = {c: None if c == "c1" else "a title" if c == "c2" else t for _, c, t in rows}
    assert {r["chunk_id"]: r["embedding_text"] for r in first.chunks().collect()} == want
    second, removed = first.delete(docs.where("doc_id in ('d2', 'd7')").select("doc_id"))
    assert removed == 2 and {r["chunk_id"] for r in second.chunks().collect()} == set(want) - {"c2", "c7"}
    for read in (second.chunks(), second.documents()):
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert {r["chunk_id"]: r["embedding_text"] for r in second.compact().chunks().collect()} == {c: t for c, t in want.items() if c not in ("c2", "c7")}
    for i in range(0, 60, 7):
        told = store.disagreeing(chunks.withColumn("text", F.when(F.col("chunk_id") == f"c{i}", F.reverse("text")).otherwise(F.col("text"))), docs, 3)
        assert [(r["chunk_id"], r["reason"]) for r in told] == [(f"c{i}", "text differs")]
    assert store.disagreeing(chunks.withColumn("doc_id", F.when(F.col("chunk_id") == "c5", F.lit(None)).otherwise(F.col("doc_id"))), docs, 3)[0]["reason"] == "unknown document"


@pytest.mark.parametrize("step", ["verify", "build", "id_digest", "write_json"])
def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "index")
    chunks, docs = whole(made(spark, 9, 4))
    first = store.Store.create(spark, path, chunks, docs, "hashing", 2)
    new, new_docs = whole(made(spark, 6, 5, first=6))
    calls = []

    def broken(*args, **kwargs):
        calls.append(1)
        if step == "write_json" and len(calls) == 1:
            return tables.write_json(*args, **kwargs)  # the version is written, the manifest is not swapped
        raise OSError("lost")

    where = store.P if step == "build" else store
    with monkeypatch.context() as m:
        m.setattr(where, step, broken)
        with pytest.raises(OSError):
            first.upsert(new, new_docs)
    again = store.Store.open(spark, path)
    again.check()
    assert again.manifest == first.manifest
    with pytest.raises(IndexFault):
        store.Store.open(spark, path, 2)
    assert again.upsert(new, new_docs).manifest["chunks"] == 12


def test_faulty_batches_and_stores(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks, docs = whole(made(spark, 9, 4))
    first = store.Store.create(spark, path, chunks, docs, "hashing", 2)
    for bad, why in (
        (chunks.unionByName(chunks.limit(1)), "twice"),
        (chunks.withColumn("embedding", F.array(F.lit(1.0))), "dimension"),
        (chunks.withColumn("embedding", F.array(F.lit(1.0), F.lit(float("nan")))), "dimension"),
        (chunks.withColumn("text", F.lit("other")), "agree"),
        (chunks.withColumn("more", F.lit(1)), "columns"),
    ):
        with pytest.raises(IndexFault, match=why):
            first.upsert(bad, docs)
    with pytest.raises(IndexFault, match="tokenizer"):
        store.Store.open(spark, path, tokenizer=lambda c: F.split(c, " "))
    assert first.drift()[0] == first.drift()[1] and first.drift(lambda c: F.split(F.concat(c, F.lit(" x")), " "))[1] > first.drift()[0]
    for change, why in (({"chunks": 8}, "manifest"), ({"documents": 1}, "documents"), ({"digest": [1, 2, 3, 4]}, "manifest"), ({"tokens": 1}, "length"), ({"dimension": 3}, "dimension"), ({"format": 1}, "format")):
        tables.write_json(spark, f"{path}/manifest.json", first.manifest | change)
        with pytest.raises(IndexFault, match=why):
            store.Store.open(spark, path).check()
    tables.write_json(spark, f"{path}/manifest.json", first.manifest)
    other = first.postings().rows.drop("segment").withColumn("ids", F.transform("ids", lambda x: F.concat(x, F.lit("!"))))
    postings.write(tables.stored(other, "other"), str(tmp_path / "other"))
    (tmp_path / "index" / "postings" / f"segment={first.manifest['segments'][0]}").rename(tmp_path / "old")
    (tmp_path / "other").rename(tmp_path / "index" / "postings" / f"segment={first.manifest['segments'][0]}")
    with pytest.raises(IndexFault, match="same chunks"):
        store.Store.open(spark, path).check()


def test_a_document_without_chunks_and_an_empty_store(spark, tmp_path):
    chunks, docs = whole(made(spark, 3, 4))
    empty = docs.select(F.lit("e").alias("doc_id"), F.lit("").alias("text")).limit(1)
    made_ = store.Store.create(spark, str(tmp_path / "a"), chunks.limit(0), empty, "hashing", 2)
    made_.check()
    assert made_.manifest["documents"] == 1 and made_.postings().search(asked(spark), 3).count() == 0
    more = made_.upsert(chunks, docs)
    more.check()
    assert more.documents().count() == 2 and more.postings().search(asked(spark), 3).count() >= 0


@pytest.mark.parametrize(
    ("key", "value", "test"),
    [
        ("topic", "a", lambda m: m["topic"] == "a"), ("topic", ["a", "zz"], lambda m: m["topic"] == "a"), ("year", 2000, lambda m: m["year"] == 2000), ("year", "2000", lambda m: m["year"] == "2000"),
        ("year", [1999, "2000"], lambda m: m["year"] in (1999, "2000")), ("tags", "x", lambda m: "x" in m["tags"]), ("tags", ["y", "q"], lambda m: "y" in m["tags"]), ("ok", True, lambda m: m["ok"] is True),
        ("nothing", 1, lambda m: False), ("a.b'c", 1, lambda m: True), ("year", [], lambda m: False),
    ],
)
def test_metadata_filters(spark, key, value, test):
    rows = made(spark, 80, 6)
    more = spark.createDataFrame([("z", "z1", "", None, [1.0, 0.5]), ("z", "z2", "", "no json", [1.0, 0.5]), ("z", "z3", "", "[1]", [1.0, 0.5])], rows.schema)
    found = {r["chunk_id"] for r in rows.unionByName(more).where(store.metadata_matches(F.col("metadata"), key, value)).collect()}
    assert found == {r["chunk_id"] for r in rows.collect() if test(json.loads(r["metadata"]))}


def test_filters_on_what_loaders_know(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for i, topic in enumerate(["fruit", "tree"]):
        (root / f"{topic}.md").write_text(f"---\ntopic: {topic}\nrank: {i}\ntags: [all, {topic}]\n---\n# About {topic}\n\nThe {topic} is good.\n")
    service.build(spark, str(root), str(tmp_path / "index"), "corpus", Settings(size=16, overlap=2, min_tokens=0))
    held = service.Index.load(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([("q", "good")], "query_id string, text string")
    found = lambda mode, **f: {r["source"] for r in held.search(queries, Request("x", 5, mode, filters=f)).join(held.chunks, "chunk_id").collect()}
    for mode in ("lexical", "dense", "hybrid"):
        assert found(mode) == {"fruit.md", "tree.md"} and found(mode, topic="tree") == {"tree.md"} and found(mode, tags=["fruit", "q"]) == {"fruit.md"}
        assert found(mode, tags="all", extension=".md", topic="fruit") == {"fruit.md"} and found(mode, topic="sea") == set() and found(mode, source="tree.md") == {"tree.md"}
