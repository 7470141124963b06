"""Exact Jaccard self-join of word-shingle sets by universe partition and the pigeonhole principle.

Two sets of s and t shingles with 100 * overlap >= 90 * union differ in at most (s + t) / 19
shingles. Sets are banded by size; in a band whose pairs differ by at most H, the universe of
shingles is cut by hash into m segments, of which k = H + 1 - m also tolerate one difference: then
some segment of any linked pair agrees, or differs by one shingle in a segment that tolerates it.
Each set is indexed in its own band and, if a smaller partner's band can hold it, in that one, by
the hash of each segment's subset and, for tolerant segments, of the subset less each one shingle.
m is allocated by cost: rows to index against the chance agreements of sparse segments, from the
number of sets in the band. Pairs that share an index entry are verified on the words themselves.

Groups of copies never become all their pairs. Equal sets are one class (by a 64-bit hash of the
set). First each entry's sets are verified against its smallest one only, and links make
components. Then only entries that still hold two components are looked at: of the pairs across
their components that a histogram of the sets (a lower bound of their difference, so no link is
lost) lets through, first the closest of each two components, then all that are left are verified. Large entries are cut into blocks; memory is that of two blocks.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import hashing
from lodestar.llm.common import batches, connected_components, discard, small_or_shuffled, stored, table

WIDTH = 3
PERCENT = 90
BAND_RATIO = 1.3
BLOCK = 1024
U = np.uint64


def most_different(s: int, t: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of linked sets of s and t elements."""
    return (s + t) * (100 - percent) // (100 + percent)


def largest_partner(s: int, percent: int = PERCENT) -> int:
    return s * 100 // percent


def bands(largest: int) -> list[int]:
    """Smallest sizes of the bands, up to the one of `largest`."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND_RATIO)))
    return out


def allocate(counts: dict[int, int], largest: int, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size of a partner, segments m, tolerant segments k) of every band in which sets that differ can be linked.

    counts: sets in each band. A row costs 1, a pair that agrees by chance 4.
    """
    edges, plan = bands(largest), []
    for b, low in enumerate(edges[:-1]):
        high = edges[b + 1] - 1
        top = largest_partner(high, percent)
        differ = most_different(high, top, percent)
        if not differ:
            continue
        n = counts.get(b, 0) + counts.get(b + 1, 0)

        def cost(m: int, n: int = n, low: int = low, differ: int = differ) -> float:
            k, t = differ + 1 - m, low / m
            chance = math.exp(-2 * t)
            return n * (m + k * t) + 4 * n * n / 2 * (m - k + k * (1 + 2 * t)) * chance

        plan.append((low, top, min(range((differ + 2) // 2, differ + 2), key=cost) if differ < 64 else _cheapest(cost, differ), 0))
        plan[-1] = (*plan[-1][:3], differ + 1 - plan[-1][2])
    return plan


def _cheapest(cost, differ: int) -> int:
    """Of 64 evenly spread segment counts."""
    return min({(differ + 2) // 2 + (differ + 1 - (differ + 2) // 2) * i // 63 for i in range(64)}, key=cost)


def set_of(words: np.ndarray) -> np.ndarray:
    return np.unique(hashing.shingles(words, WIDTH))


def print_of(members: np.ndarray) -> int:
    """64-bit hash of a set."""
    return int(hashing.mix(np.add.reduce(hashing.mix(members ^ U(0x5851F42D4C957F2D)), keepdims=True) + U(len(members))).view(np.int64)[0])


def signatures(members: np.ndarray, plan: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Index entries of a sorted set, in each band that can hold it."""
    n, out = len(members), []
    value = None
    for b in range(bisect.bisect_right(plan, (n, math.inf)) - 1, -1, -1):
        low, top, m, k = plan[b]
        if n > top:
            break
        if value is None:
            value = hashing.mix(members ^ U(0x2545F4914F6CDD1D))
            high = members >> U(32)
        segment = ((high * U(m)) >> U(32)).astype(np.int64)  # ascending, as the set is
        ends = np.concatenate([np.zeros(1, U), np.cumsum(value)])
        cuts = np.searchsorted(segment, np.arange(m + 1))
        sums = ends[cuts[1:]] - ends[cuts[:-1]]
        tag = hashing.mix(np.arange(m, dtype=U) + (U(low) << U(32)))
        out.append(hashing.mix(tag + sums))
        if k:
            own = segment[: cuts[k]]
            out.append(np.unique(hashing.mix(tag[own] + sums[own] - value[: cuts[k]])))
    return np.concatenate(out) if out else np.zeros(0, U)


def _sets(texts) -> list[np.ndarray]:
    return [set_of(w) for w in hashing.batch_word_hashes([hashing.lowered(t) for t in texts])]


def _features(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches(it):
        sets = _sets(pdf["text"])
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "fp": pd.array([print_of(s) if len(s) else None for s in sets], dtype="Int64")})


def _words(text: str) -> frozenset:
    w = hashing.lowered(text).split()
    return frozenset(zip(*(w[i:] for i in range(WIDTH)), strict=False)) if len(w) >= WIDTH else frozenset([tuple(w)])


def _linked(a: frozenset, b: frozenset) -> bool:
    both = len(a & b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, last_set = None, frozenset()
    for pdf in batches(it):
        keep = []
        for a, text_a, text_b in zip(pdf["a"], pdf["text_a"], pdf["text_b"], strict=True):
            if a != last:
                last, last_set = a, _words(text_a)
            keep.append(_linked(last_set, _words(text_b)))
        yield pdf.loc[keep, ["a", "b"]]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of set hashes whose texts' sets are linked."""
    right = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_verify, "a long, b long")


def histogram(members: np.ndarray) -> np.ndarray:
    """Counts of a set's members by their last bits, in four bins or more for each difference that a link allows."""
    bins = 64
    while bins < min(4096, 4 * most_different(len(members), len(members))):
        bins *= 2
    return np.bincount((members & U(bins - 1)).astype(np.int64), minlength=bins).astype(np.int32)


def _histograms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches(it):
        sets = _sets(pdf["text"])
        yield pd.DataFrame({"fp": pdf["fp"], "n": [len(s) for s in sets], "bins": [histogram(s).astype("<u2" if len(s) < 65536 else "<u4").tobytes() for s in sets]})


def across(n: np.ndarray, bins: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, gap of their histograms), i of `left`, j of `right`, of different components that size and histogram let through."""
    width = min(map(len, bins))  # histograms of one width can be compared
    folded = np.stack([x if len(x) == width else x.reshape(-1, width).sum(0) for x in bins]).astype(np.int32)
    by_size = right[np.argsort(n[right], kind="stable")]
    sizes = n[by_size]
    for i in left:
        lo, hi = np.searchsorted(sizes, -(-n[i] * PERCENT // 100)), np.searchsorted(sizes, largest_partner(int(n[i])), "right")
        near = by_size[lo:hi]
        near = near[(comp[near] != comp[i]) & (near != i)]
        if len(near):
            gap = np.abs(folded[near] - folded[i]).sum(1)
            ok = gap * (100 + PERCENT) <= (n[i] + n[near]) * (100 - PERCENT)
            for j, g in zip(near[ok].tolist(), gap[ok].tolist(), strict=True):
                yield int(i), j, g


def _closest(pairs: list[tuple[int, int, int]], comp: np.ndarray) -> list[tuple[int, int, int]]:
    """Of the pairs between two components the one with the smallest gap."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, j, gap in pairs:
        at = (min(comp[i], comp[j]), max(comp[i], comp[j]))
        if at not in best or gap < best[at][2]:
            best[at] = (i, j, gap)
    return list(best.values())


def _across(it: Iterator[pd.DataFrame], closest: bool) -> Iterator[pd.DataFrame]:
    """Rows of a (key, first, second) group, which stand together: the pairs its two blocks may hold.

    A pair that meets under several keys (`keys`, those of a set) is named under the least only.
    """
    columns = ["n", "comp", "block", "fp", "bins"] + ([] if closest else ["keys"])
    held: list[list[np.ndarray]] = []
    last: tuple[int, int, int] = (0, 0, 0)

    def settle() -> tuple[np.ndarray, np.ndarray]:
        n, comp, block, fp, packed, *keys = held[0] if len(held) == 1 else [np.concatenate(x) for x in zip(*held, strict=True)]
        key, first, second = last
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if not len(left) or not len(right) or (comp == comp[0]).all():
            return fp[:0], fp[:0]
        bins = [np.frombuffer(x, "<u2" if k < 65536 else "<u4").astype(np.int64) for x, k in zip(packed, n.tolist(), strict=True)]
        pairs = [x for x in across(n, bins, comp, left, right) if first != second or x[0] < x[1]]
        if closest:
            pairs = _closest(pairs, comp)
        elif pairs:
            own = {i: frozenset(keys[0][i]) for x in pairs for i in x[:2]}
            pairs = [x for x in pairs if min(own[x[0]] & own[x[1]]) == key]
        a, b = fp[[x[0] for x in pairs]] if pairs else fp[:0], fp[[x[1] for x in pairs]] if pairs else fp[:0]
        return np.minimum(a, b), np.maximum(a, b)

    for pdf in it:
        key, first, second = (pdf[c].to_numpy() for c in ("key", "first", "second"))
        values = [pdf[c].to_numpy() for c in columns]
        new = (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)]
        found = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            at = (int(key[s]), int(first[s]), int(second[s]))
            if held and at != last:
                found.append(settle())
                held = []
            last = at
            held.append([x[s:e] for x in values])
        if found:
            yield pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])}).drop_duplicates()
    if held:
        a, b = settle()
        yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def sets_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features doc_id, n, fp of every row; components node, component of set hashes with links)."""
    source = docs.select("doc_id", "text")
    features = stored(source.mapInPandas(_features, "doc_id long, n long, fp long"), "sets")
    largest = features.agg(F.max("n")).first()[0] or 1
    edges = bands(largest)
    band = F.lit(-1)
    for low in edges:
        band = band + (F.col("n") >= low).cast("int")
    counts = {r["band"]: r["count"] for r in features.where("fp is not null").groupBy("fp").agg(F.first("n").alias("n")).groupBy(band.alias("band")).count().toLocalIterator()}
    plan = allocate(counts, largest)

    def index(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches(it):
            fps, keys = [], []
            for s in _sets(pdf["text"]):
                if len(s) and (fp := print_of(s)) not in seen:
                    seen.add(fp)
                    if len(own := signatures(s, plan)):
                        fps.append(fp)
                        keys.append(own.view(np.int64))
            if fps:
                yield pd.DataFrame({"fp": np.array(fps, np.int64), "keys": keys})

    entries = stored(source.select("text").mapInPandas(index, "fp long, keys array<long>"), "entries")
    rows = entries.select("fp", F.explode("keys").alias("key"))
    shared = stored(rows.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("key", "least"), "shared")
    entries_shared = stored(rows.join(small_or_shuffled(shared), "key").select("key", "least", "fp").distinct(), "buckets")
    discard(entries)
    discard(shared)

    members = stored(entries_shared.select("fp").distinct(), "members")

    def fetch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches(it):
            fps, texts = [], []
            for text, s in zip(pdf["text"], _sets(pdf["text"]), strict=True):
                if not len(s) or (fp := print_of(s)) in seen:
                    continue
                seen.add(fp)
                fps.append(fp)
                texts.append(text)
            if fps:
                yield pd.DataFrame({"fp": np.array(fps, np.int64), "text": texts})

    found = source.select("text").mapInPandas(fetch, "fp long, text string")
    texts = found.join(small_or_shuffled(members), "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text"))
    texts = stored(texts, "set-texts")

    stars = entries_shared.where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    links = stored(verified(stars, texts), "links")
    comps = connected_components(links, "jaccard")

    sketches = stored(texts.mapInPandas(_histograms, "fp long, n long, bins binary"), "sketches")
    for closest in (True, False):
        more = _open_pairs(entries_shared, comps, sketches, closest)
        if more is None:
            break
        more = stored(more.join(links, ["a", "b"], "left_anti"), "open-pairs")
        links = links.unionByName(stored(verified(more, texts), "links"))
        comps = connected_components(links, "jaccard")
    return features, comps


def _open_pairs(entries: DataFrame, comps: DataFrame, sketches: DataFrame, closest: bool) -> DataFrame | None:
    """Pairs (a, b) of sets that share an entry but no component yet: the closest one of each two components in each entry, or all. None if no entry holds two components."""
    placed = entries.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("comp"))
    placed = stored(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    open_keys = stored(open_keys.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "open")
    if open_keys.isEmpty():
        return None
    rest = placed.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rest = stored(rest, "rest")
    discard(placed)
    keys = rest.groupBy("fp").agg(F.collect_list("key").alias("keys"))  # as many as a set has entries
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rest.withColumn("other", other).select("key", "fp", "comp", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    dealt = dealt.join(sketches if closest else sketches.join(keys, "fp"), "fp").repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")
    return dealt.mapInPandas(lambda it: _across(it, closest), "a long, b long").distinct()


def components(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    Null and empty texts (or of white space only) have no shingles and are their own component.
    Repeated rows and equal sets share a component; component_id is the smallest doc_id in it.
    Texts are compared whole. Other columns are ignored.
    """
    features, comps = sets_and_links(docs)
    classes = features.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return features.join(named, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` with the size of its set and its component, as `components` says."""
    return components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, w[i:i + 2] AS g FROM (SELECT rid, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT rid, n, hash(list_sort(list(hash(g)))) AS h FROM s JOIN n USING (rid) GROUP BY ALL),
o AS (SELECT h, min(rid) AS rid FROM m GROUP BY 1),
t AS (SELECT s.rid, hash(g) AS g FROM s JOIN o USING (rid)),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS a ON a.rid = x JOIN n AS b ON b.rid = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l UNION SELECT m.rid, o.rid FROM m JOIN o USING (h) WHERE m.rid <> o.rid UNION SELECT o.rid, m.rid FROM m JOIN o USING (h) WHERE m.rid <> o.rid),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = b GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)
"""
