"""Benchmark decontamination with a positional inverted index of the training documents.

The index is dealt by document: each shard (about SHARD_WORDS words) is one stored row with the
shard's posting lists, term -> sorted word positions, for the terms the test items use. Posting
lengths summed over all shards give each term's frequency. Each window of a test item is then
looked up shard by shard: from its rarest term on, the posting lists are shifted by the term's
offset in the window and intersected, until the list is empty or all terms agree, which is an
exact phrase. Nothing but the index's own rows is shuffled: there is no key that could be hot.

One index serves up to INDEX_CHARS characters of test items; their windows are broadcast in blocks
of BLOCK_CHARS characters, as arrays of term numbers (some 13 * 5 bytes for each word).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import batches, stored, table

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # in UTF-8, after A-Z are lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
WINDOW = 13
SHARD_WORDS = 1_000_000
INDEX_CHARS, BLOCK_CHARS = 32 << 20, 2 << 20
#: Proximity: an item's NEAR_TERMS rarest terms, each within NEAR_SLOP words of one place of the rarest, all in one document.
NEAR_TERMS, NEAR_SLOP = 4, 20


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each shard: its documents (rid, doc_id, first position, words) and its posting lists."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        rids, ids, starts, lengths, at, codes, where = [], [], [], [], 0, [], []

        def shard() -> pd.DataFrame:
            code, pos = np.concatenate([*codes, np.zeros(0, np.int32)]), np.concatenate([*where, np.zeros(0, np.int32)])
            order = np.argsort(code, kind="stable")
            terms, first = np.unique(code[order], return_index=True)
            return pd.DataFrame({"rids": [rids], "ids": [ids], "starts": [starts], "lengths": [lengths], "terms": [terms], "firsts": [first.astype(np.int32)], "positions": [pos[order]]})

        for pdf in batches(it):
            for rid, doc_id, text in zip(pdf["rid"], pdf["doc_id"], pdf["text"], strict=True):
                words = words_of(text)
                code = np.array([get(w, -1) for w in words], np.int32)
                hit = np.nonzero(code >= 0)[0].astype(np.int32)
                codes.append(code[hit])
                where.append(hit + np.int32(at))
                rids.append(rid)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                starts.append(at)
                lengths.append(len(words))
                at += len(words) + 1  # a gap, so that no phrase runs on into the next document
                if at >= SHARD_WORDS:
                    yield shard()
                    rids, ids, starts, lengths, at, codes, where = [], [], [], [], 0, [], []
        if rids:
            yield shard()

    schema = "rids array<long>, ids array<long>, starts array<int>, lengths array<int>, terms array<int>, firsts array<int>, positions array<int>"
    return docs.select("rid", "doc_id", "text").mapInPandas(build, schema)


def _windows(items: list[tuple], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(item of each distinct window, terms of the windows, -1 after the last); an item of fewer words is one window."""
    out: dict[tuple, None] = {}
    for i, (_, words) in enumerate(items):
        codes = [vocabulary[w] for w in words]
        codes += [-1] * (WINDOW - len(codes))
        for s in range(len(codes) - WINDOW + 1):
            out[(i, *codes[s : s + WINDOW])] = None
    rows = np.array(list(out), np.int32).reshape(len(out), WINDOW + 1)
    return rows[:, 0], rows[:, 1:]


def _search(index: DataFrame, items: list[tuple], vocabulary: dict[bytes, int], frequency: np.ndarray) -> DataFrame:
    """For each document: n_words, merged hit spans, items with exact phrases, items nearby."""
    owner, codes = _windows(items, vocabulary)
    rare = np.where(codes >= 0, frequency[codes], np.iinfo(np.int64).max)
    order = np.argsort(rare, axis=1, kind="stable").astype(np.int8)  # offsets in a window, from the rarest term on
    near = []
    for i, (_, words) in enumerate(items):
        rarest = sorted({vocabulary[w] for w in words}, key=lambda c: (frequency[c], c))[:NEAR_TERMS]
        if len(rarest) == NEAR_TERMS:
            near.append((i, *rarest))
    nearby = np.array(near, np.int32).reshape(len(near), NEAR_TERMS + 1)
    names = [None if item_id is None else str(item_id) for item_id, _ in items]
    shared = index.sparkSession.sparkContext.broadcast((owner, codes, order, nearby, names, len(vocabulary)))

    def intersect(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, codes, order, nearby, names, n_terms = shared.value
        sizes = (codes >= 0).sum(1)
        for pdf in it:
            for row in pdf.itertuples(index=False):
                positions, starts, lengths = np.asarray(row.positions), np.asarray(row.starts), np.asarray(row.lengths)
                # bounds of each term's list; the last entry (term -1) stands for "no term here"
                lo, hi = np.zeros(n_terms + 1, np.int64), np.zeros(n_terms + 1, np.int64)
                terms = np.asarray(row.terms, np.int64)
                lo[terms], hi[terms] = row.firsts, [*row.firsts[1:], len(positions)] if len(terms) else []
                present = hi > lo
                present[-1] = True
                found: dict[int, dict] = {}

                def document(d: int, found: dict = found) -> dict:
                    return found.setdefault(d, {"spans": [], "items": set(), "near": set()})

                for w in np.flatnonzero(present[codes].all(1)).tolist():
                    begin = None
                    for offset in order[w, : sizes[w]].tolist():
                        held = positions[lo[codes[w, offset]] : hi[codes[w, offset]]]
                        if begin is None:
                            begin = held - offset
                        else:
                            want = begin + offset
                            i = np.searchsorted(held, want)
                            i[i == len(held)] = 0
                            begin = begin[held[i] == want]
                        if not len(begin):
                            break
                    for b, d in zip(begin.tolist(), (np.searchsorted(starts, begin, "right") - 1).tolist(), strict=True):
                        doc = document(d)
                        doc["spans"].append((b - int(starts[d]), b - int(starts[d]) + int(sizes[w])))
                        doc["items"].add(names[owner[w]])
                for k in np.flatnonzero(present[nearby[:, 1:]].all(1)).tolist():
                    close = positions[lo[nearby[k, 1]] : hi[nearby[k, 1]]]
                    for c in nearby[k, 2:].tolist():
                        held = positions[lo[c] : hi[c]]
                        d = np.searchsorted(starts, close, "right") - 1
                        i = np.searchsorted(held, np.maximum(close - NEAR_SLOP, starts[d]))
                        last = np.minimum(close + NEAR_SLOP, starts[d] + lengths[d] - 1)
                        close = close[(i < len(held)) & (held[np.minimum(i, len(held) - 1)] <= last)]
                    for d in set((np.searchsorted(starts, close, "right") - 1).tolist()):
                        document(d)["near"].add(names[nearby[k, 0]])
                n = len(row.rids)
                spans, hits, nears = [[]] * n, [[]] * n, [[]] * n
                for d, doc in found.items():
                    merged: list[list[int]] = []
                    for s, e in sorted(doc["spans"]):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    spans[d], hits[d], nears[d] = [{"s": s, "e": e} for s, e in merged], sorted(doc["items"] - {None}), sorted(doc["near"] - {None})
                ids = pd.array([None if x is None or x != x else int(x) for x in row.ids], dtype="Int64")
                yield pd.DataFrame({"rid": row.rids, "doc_id": ids, "n_words": row.lengths, "spans": spans, "items": hits, "near": nears})

    return index.mapInPandas(intersect, "rid long, doc_id long, n_words long, spans array<struct<s:int,e:int>>, items array<string>, near array<string>")


def match(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): rid, doc_id, n_words, n_hit, items, near.

    `benchmark` (item_id, text). Null and empty texts have no words and no hits; an item without
    words has no window; items with one id are searched each and named once; words that an item
    without id covers are hit, but it has no name. `items` are those with a window that occurs,
    `near` those whose NEAR_TERMS rarest terms (by all documents; equally rare ones in the order of
    their bytes) stand close together in the document. `rid` tells repeated rows apart. Texts are
    read whole. Other columns are ignored.
    """
    numbered = docs.withColumn("rid", F.monotonically_increasing_id())
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = []
    for items in _dealt(benchmark, chars, INDEX_CHARS):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        index = stored(_index(numbered, vocabulary), "postings")
        ends = F.concat(F.slice("firsts", 2, F.size("firsts")), F.array(F.size("positions")))
        sizes = index.where(F.size("firsts") > 0).select(F.explode(F.arrays_zip(F.col("terms").alias("t"), F.zip_with(ends, "firsts", lambda e, f: e - f).alias("n"))).alias("x"))
        frequency = np.zeros(len(vocabulary) + 1, np.int64)
        for r in sizes.groupBy("x.t").agg(F.sum("x.n")).toLocalIterator():
            frequency[r[0]] = r[1]
        block, size = [], 0
        for item in items:
            block.append(item)
            size += sum(map(len, item[1])) + len(item[1])
            if size >= BLOCK_CHARS:
                parts.append(_search(index, block, vocabulary, frequency))
                block, size = [], 0
        if block or not items:
            parts.append(_search(index, block, vocabulary, frequency))
    if len(parts) == 1:
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]))
        return parts[0].select("rid", "doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), "near")
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    hit = both.select("rid", F.explode("spans").alias("x")).select("rid", F.explode(F.sequence("x.s", F.col("x.e") - 1)).alias("w")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    rows = both.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near")).alias("near"))
    return rows.join(hit, "rid", "left").select("rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near")).alias("near"))


def _dealt(benchmark: DataFrame, chars: int, limit: int) -> Iterator[list[tuple]]:
    """The items (item_id, words) that have words, some `limit` characters at a time; one empty list if there are none."""
    parts = max(1, -(-chars // limit))
    for part in range(parts):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else benchmark
        items = [(r[0], words_of(r[1])) for r in own.select("item_id", "text").toLocalIterator()]
        yield [(item_id, words) for item_id, words in items if words]


def contaminated() -> Column:
    """Any hit, and hits on at least one word in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents`: its hits by `benchmark`, and the items nearby."""
    found = match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = lambda column: F.sha2(F.array_join(column, ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"), contaminated().alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), digest("near").alias("near_sha256"),
    )


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:i + 12] AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT rid, n, i, w[i:i + n - 1] AS win FROM (SELECT rid, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (win)),
p AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS x FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY 1),
k AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY 1),
places AS (SELECT rid, i AS pos, w[i] AS term FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d)),
used AS (SELECT rid, pos, term FROM places WHERE term IN (SELECT unnest(w) FROM b)),
freq AS (SELECT term, count(*) AS f FROM used GROUP BY 1),
bt AS (SELECT bid, item_id, term, row_number() OVER (PARTITION BY bid ORDER BY coalesce(f, 0), term) AS r, count(*) OVER (PARTITION BY bid) AS terms
       FROM (SELECT DISTINCT bid, item_id, unnest(w) AS term FROM b) LEFT JOIN freq USING (term)),
occ AS (SELECT bid, item_id, r, rid, pos FROM bt JOIN used USING (term) WHERE r <= {NEAR_TERMS} AND terms >= {NEAR_TERMS}),
np AS (SELECT x.rid, x.item_id FROM occ x JOIN occ y ON x.bid = y.bid AND x.rid = y.rid AND x.r = 1 AND y.r > 1 AND abs(x.pos - y.pos) <= {NEAR_SLOP}
       GROUP BY x.bid, x.item_id, x.rid, x.pos HAVING count(DISTINCT y.r) = {NEAR_TERMS - 1}),
nk AS (SELECT rid, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM np WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(k.names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(nk.names, '')) AS near_sha256
FROM d LEFT JOIN p USING (rid) LEFT JOIN k USING (rid) LEFT JOIN nk USING (rid)
"""
