"""Alignment of two tokenizers on the same text: groups of tokens between shared cuts, and how often pairs of ids are linked.

Both tokenizers cover a document byte by byte; an offset where a token of each ends is a shared cut.
Groups are found by divide and conquer on the two sorted lists of ends: an interval is cut at a common
end near its middle, found by bisecting the other list for the middle end and, where that is none,
for ends ever further out; both halves go on alike; an interval without a common end is a group. All
intervals of a batch of documents are worked on side by side, a level at a time.

Tokenizing is remembered: where a single space stands between two other characters neither
vocabulary joins what it separates, so a text is cut there, and each distinct stretch is encoded once while a task remembers it. The
alignment does not know of these stretches; it runs over whole sections of documents.

Links are counted, not listed: a document keeps its distinct pairs of ids with their numbers. How many
documents hold a pair is one aggregation; frequent pairs come back to the documents by a broadcast
of a checked size, rare ones by a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_BYTES, discard, row_bytes, stored, table
from lodestar.llm.token_store import PLAIN, quiet_tokenizer, tokenizer_path

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches and their tokens that a task remembers; characters of a section, and of the sections that are aligned side by side.
CACHE, CACHE_TOKENS, SECTION, BATCH = 200_000, 2_000_000, 1 << 19, 1 << 19
#: Links of a group that are written out before they are counted; larger groups are counted by their distinct ids.
WIDE = 1 << 14
#: Stretches that are encoded at once.
AT_ONCE = 4096
SPACE = re.compile(r"(?<=[^ ]) (?=\S)")
UNEVEN = re.compile(r" \s")


class _Flat:
    """Lists of ids with their lengths in bytes, one for each stretch."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.ids, self.counts, self.starts = lengths, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.cumsum(self.counts) - self.counts

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches `codes` one after another, and how many each has."""
        counts = self.counts[codes]
        return self.ids[np.arange(int(counts.sum())) + np.repeat(self.starts[codes] - np.cumsum(counts) + counts, counts)], counts

    def kept(self, codes: np.ndarray) -> _Flat:
        out = _Flat(self.lengths)
        out.add(*self.gather(codes))
        return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


class Pair:
    """The two tokenizers and what a task remembers of them."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = quiet_tokenizer(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        self.a_bytes, self.b_bytes = _byte_level(self.a), _pieces(self.b)
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        if self.n_a * self.n_b >= 1 << 31:
            raise ValueError("the pairs of the two vocabularies must fit in 31 bits")
        if any(b" " in x.lstrip(b" ") for x in self.b_bytes):
            raise ValueError("a piece of the second vocabulary reaches over a space")
        self.known: dict[str, int] = {}
        self.flat_a, self.flat_b = (_Flat(np.array([len(x) for x in v], np.int32)) for v in (self.a_bytes, self.b_bytes))
        self.good, self.met = np.zeros(0, bool), np.zeros(0, np.int64)

    def codes(self, stretches: list[str]) -> np.ndarray:
        """Numbers of the stretches; they hold until the next call."""
        own = set(stretches)
        new = own.difference(self.known)
        if len(self.known) + len(new) > CACHE or len(self.flat_a.ids) > CACHE_TOKENS:
            self._forget()
            new = own.difference(self.known)
        if new:
            self._learn(sorted(new))
        codes = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        self.met += np.bincount(codes, minlength=len(self.met))
        return codes

    def _forget(self) -> None:
        """Only stretches met twice since the last time stay; none if they are over half of what may be remembered."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > CACHE // 2 or self.flat_a.counts[kept].sum() > CACHE_TOKENS // 2:
            kept = kept[:0]
        place = np.full(len(self.met), -1)
        place[kept] = np.arange(len(kept))
        self.known = {s: p for s, p in ((s, int(place[c])) for s, c in self.known.items()) if p >= 0}
        self.flat_a, self.flat_b, self.good, self.met = self.flat_a.kept(kept), self.flat_b.kept(kept), self.good[kept], np.zeros(len(kept), np.int64)

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            plain = [m and m.groups() for m in map(PLAIN.fullmatch, part)]
            other = iter(self.a.encode_batch_fast([" " + s for s, p in zip(part, plain, strict=True) if not p], add_special_tokens=False))
            # A space and ASCII letters are one piece for the steps before the model, which spell the space as U+0120; signs after them another.
            a = _flat([[t.id for x in (self.model.tokenize("\u0120" + p[0]), self.model.tokenize(p[1]) if p[1] else ()) for t in x] if p else next(other).ids for p in plain])
            b = _flat(self.b.encode(part, num_threads=1))
            raw = [(" " + s).encode("utf-8", "surrogatepass") for s in part]
            good = self._same(raw, a, self.a_bytes, self.flat_a.lengths) & self._same(raw, b, self.b_bytes, self.flat_b.lengths)
            for flat, (ids, counts) in ((self.flat_a, a), (self.flat_b, b)):
                flat.add(ids[np.repeat(good, counts)], np.where(good, counts, 0))
            self.known.update(zip(part, range(len(self.good), len(self.good) + len(part)), strict=True))
            self.good = np.concatenate([self.good, good])
            self.met = np.concatenate([self.met, np.zeros(len(part), np.int64)])

    @staticmethod
    def _same(raw: list[bytes], tokens: tuple[np.ndarray, np.ndarray], spelled: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Which stretches the tokens give back byte for byte."""
        ids, counts = tokens
        edge = np.concatenate([[0], np.cumsum(counts)])
        size = np.concatenate([[0], np.cumsum(lengths[ids])])[edge]
        if b"".join(map(spelled.__getitem__, ids.tolist())) == b"".join(raw) and (np.diff(size) == np.fromiter(map(len, raw), np.int64, len(raw))).all():
            return np.ones(len(raw), bool)
        return np.array([b"".join(map(spelled.__getitem__, ids[s:e].tolist())) == x for s, e, x in zip(edge[:-1], edge[1:], raw, strict=True)])


def _byte_level(tokenizer: object) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary: printable characters of Latin-1 stand for themselves, other bytes for characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    return [bytes(byte[c] for c in t) if t and all(c in byte for c in t) else b"" for t in map(tokenizer.id_to_token, range(tokenizer.get_vocab_size()))]


def _pieces(model: object) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


def sections(text: str) -> Iterator[list[str]]:
    """The stretches of a text, in sections of about SECTION characters."""
    if len(text) > SECTION:
        at = 0
        while at < len(text):
            m = SPACE.search(text, at + SECTION) if at + SECTION < len(text) else None
            end = m.start() if m else len(text)
            yield SPACE.split(text[at:end])
            at = end + 1
    elif text[0] != " " and text[-1] != " " and not UNEVEN.search(text):
        yield text.split(" ")
    else:
        yield SPACE.split(text)


# --- divide and conquer -----------------------------------------------------------------------


def _near_middle(ea: np.ndarray, eb: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """For intervals [a0, a1) of two tokens or more: the token nearest to the middle, not the last, whose end is one of `eb`; -1 if there is none."""
    middle = a0 + (a1 - a0 - 2) // 2
    found = np.where(_common(ea[middle], eb), middle, -1)
    left, reach = np.flatnonzero(found < 0), 1
    while len(left):
        low, high = np.maximum(a0[left], middle[left] - reach), np.minimum(a1[left] - 2, middle[left] + reach)
        size = high - low + 1
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(low - first, size)
        away = at - np.repeat(middle[left], size)
        best = np.minimum.reduceat(np.where(_common(ea[at], eb), 2 * np.abs(away) + (away > 0), np.iinfo(np.int64).max), first)
        hit = best < np.iinfo(np.int64).max
        found[left[hit]] = middle[left[hit]] + np.where(best[hit] % 2, best[hit] // 2, -(best[hit] // 2))
        left = left[~hit & ((low > a0[left]) | (high < a1[left] - 2))]
        reach *= 2
    return found


def _common(ends: np.ndarray, eb: np.ndarray) -> np.ndarray:
    return eb[np.searchsorted(eb, ends)] == ends


def divide(ea: np.ndarray, eb: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, ...]:
    """The groups (a0, a1, b0, b1), in order, of intervals of tokens that begin and end at shared cuts; `ea`, `eb` are the ends of the tokens, ascending."""
    leaves = []
    at = np.stack([a0, a1, b0, b1]).astype(np.int64)
    while at.shape[1]:
        single = (at[1] - at[0] == 1) | (at[3] - at[2] == 1)
        leaves.append(at[:, single])
        at = at[:, ~single]
        cut = _near_middle(ea, eb, at[0], at[1])
        leaves.append(at[:, cut < 0])
        at, cut = at[:, cut >= 0], cut[cut >= 0] + 1
        cut_b = np.searchsorted(eb, ea[cut - 1]) + 1
        at = np.stack([np.stack([at[0], cut, at[2], cut_b]), np.stack([cut, at[1], cut_b, at[3]])], axis=2).reshape(4, -1)  # in order
    groups = np.concatenate(leaves, axis=1) if leaves else at
    return tuple(groups[:, np.argsort(groups[0], kind="stable")])


class _Document:
    """What is known of a document so far."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.numbers, self.hash, self.good, self.pairs = doc_id, np.zeros(4, np.int64), hashlib.sha256(), True, []
        self.begun = False

    def text(self, groups: str) -> None:
        self.hash.update((";" + groups if self.begun else groups).encode())
        self.begun = True

    def result(self) -> tuple:
        if not self.good or not self.begun:
            return self.doc_id, np.zeros(4, np.int64), "", np.zeros(0, np.int32), np.zeros(0, np.int64)
        keys, times = self.pairs[0] if len(self.pairs) == 1 else _counted(np.concatenate([k for k, _ in self.pairs]), np.concatenate([t for _, t in self.pairs]))
        return self.doc_id, self.numbers, self.hash.hexdigest(), keys.astype(np.int32), times


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, place, times)
    return own, total


class Aligner:
    """Aligns batches of sections."""

    def __init__(self, pair: Pair):
        self.pair = pair
        spell = lambda n, inner, last: np.array([f"{i}{inner}" for i in range(n)] + [f"{i}{last}" for i in range(n)], object)
        self.a_words, self.b_words = spell(pair.n_a, ",", "|"), spell(pair.n_b, ",", ";")

    def align(self, batch: list[tuple[_Document, list[str]]]) -> None:
        """Adds the groups and links of each section to its document; a document's sections come in order."""
        codes = self.pair.codes([s for _, own in batch for s in own])
        good = self.pair.good[codes]
        size = np.array([len(own) for _, own in batch])
        for (doc, _), ok in zip(batch, np.logical_and.reduceat(good, np.cumsum(size) - size), strict=True):
            doc.good &= bool(ok)
        use = [doc.good for doc, _ in batch]
        codes, size, docs = codes[np.repeat(use, size)], size[use], [doc for (doc, _), ok in zip(batch, use, strict=True) if ok]
        if not docs:
            return
        ids_a, n_a = self.pair.flat_a.gather(codes)
        ids_b, n_b = self.pair.flat_b.gather(codes)
        bytes_a, bytes_b = self.pair.flat_a.lengths[ids_a], self.pair.flat_b.lengths[ids_b]
        edge = np.cumsum(size) - size
        end_a, end_b = np.cumsum(np.add.reduceat(n_a, edge)), np.cumsum(np.add.reduceat(n_b, edge))
        start_a, start_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
        a0, a1, b0, b1 = divide(np.cumsum(bytes_a), np.cumsum(bytes_b), start_a, end_a, start_b, end_b)
        first = np.searchsorted(a0, start_a)  # the first group of each section
        links = np.add.reduceat((a1 - a0) * (b1 - b0), first)
        numbers = np.stack([end_a - start_a, end_b - start_b, np.diff(first, append=len(a0)), links], axis=1)
        words = self._spelled(ids_a, ids_b, a0, a1, b0, b1)
        owner = np.searchsorted(end_a, np.arange(len(ids_a)), side="right")
        keys, times = self._linked(ids_a, ids_b, a0, a1, b0, b1, owner)
        at = np.searchsorted(keys, np.arange(len(docs) + 1) << 31)
        for i, doc in enumerate(docs):
            doc.numbers = doc.numbers + numbers[i]
            doc.text("".join(words[start_a[i] + start_b[i] : end_a[i] + end_b[i]].tolist())[:-1])
            doc.pairs.append((keys[at[i] : at[i + 1]] & ((1 << 31) - 1), times[at[i] : at[i + 1]]))
            if len(doc.pairs) > 16:
                doc.pairs = [_counted(np.concatenate([k for k, _ in doc.pairs]), np.concatenate([t for _, t in doc.pairs]))]

    def _spelled(self, ids_a: np.ndarray, ids_b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """`1,2|3;` for a group of two tokens and one, token by token."""
        out = np.empty(len(ids_a) + len(ids_b), object)
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[a1 - 1] = last_b[b1 - 1] = 1
        out[np.arange(len(ids_a)) + np.repeat(b0, a1 - a0)] = self.a_words[ids_a + self.pair.n_a * last_a]
        out[np.arange(len(ids_b)) + np.repeat(a1, b1 - b0)] = self.b_words[ids_b + self.pair.n_b * last_b]
        return out

    def _linked(self, ids_a: np.ndarray, ids_b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (section, pair) as one number, ascending, and how many links each has."""
        wide = (a1 - a0) * (b1 - b0) > WIDE
        times = np.repeat(np.where(wide, 0, b1 - b0), a1 - a0)  # links of each token of the first
        at = np.arange(int(times.sum())) + np.repeat(np.repeat(b0, a1 - a0) - np.cumsum(times) + times, times)
        key = (np.repeat(owner, times) << 31) + np.repeat(ids_a.astype(np.int64) * self.pair.n_b, times) + ids_b[at]
        keys, count = np.unique(key, return_counts=True)
        if wide.any():
            more = [(keys, count)]
            for g in np.flatnonzero(wide):
                own_a, n_a = np.unique(ids_a[a0[g] : a1[g]], return_counts=True)
                own_b, n_b = np.unique(ids_b[b0[g] : b1[g]], return_counts=True)
                more.append(((int(owner[a0[g]]) << 31) + np.add.outer(own_a.astype(np.int64) * self.pair.n_b, own_b).ravel(), np.multiply.outer(n_a, n_b).ravel()))
            keys, count = _counted(np.concatenate([k for k, _ in more]), np.concatenate([n for _, n in more]))
        return keys, count


# --- the job ----------------------------------------------------------------------------------

_FIELDS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<int>, times array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each row of `docs` (row, doc_id, text) its numbers of tokens, groups and links, the digest of its groups, and its distinct linked pairs (a * pieces of B + b) with their numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Pair(a_path, b_path))
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                found, batch, size = [], [], 0
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found.append(doc := _Document(doc_id))
                    for own in sections(text) if text else ():
                        batch.append((doc, own))
                        size += sum(map(len, own)) + len(own)
                        if size >= BATCH:
                            aligner.align(batch)
                            batch, size = [], 0
                if batch:
                    aligner.align(batch)
                rows = [d.result() for d in found]
                numbers = np.stack([r[1] for r in rows])
                edge = pa.array(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([r[0] for r in rows], pa.int64()), *[pa.array(numbers[:, i]) for i in range(4)], pa.array([r[2] for r in rows], pa.string()),
                     pa.ListArray.from_arrays(edge, pa.array(np.concatenate([r[3] for r in rows]))), pa.ListArray.from_arrays(edge, pa.array(np.concatenate([r[4] for r in rows])))],
                    names=[x.split()[0] for x in _FIELDS.split(", ")],
                )

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FIELDS)


def _frequent_from(counts: DataFrame, limit: int) -> int:
    """The least power of two so that at most `limit` bytes of pairs are held by so many documents."""
    sizes = {r["p"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    rows, total, least = limit // row_bytes(counts), 0, (1 << 63) - 1
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > rows:
            break
        least = 1 << p
    return least if set(sizes) - {p for p in sizes if 1 << p >= least} else 0


def align(docs: DataFrame, a_path: str, b_path: str, pieces: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that one of the tokenizers does not give back byte for byte (such
    as texts with U+2581), have no tokens: zeros, and an empty digest. Repeated rows, and rows that
    agree in doc_id or have none, are documents each on their own, also in the counts. Ties of a most
    frequent pair are all best. Other columns, whatever their names, take no part; an empty table
    gives no rows. `pieces` is the size of the second vocabulary, `limit` the bytes of pairs to broadcast.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    held = stored(aligned(rows, a_path, b_path), "aligned")
    counts = stored(held.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")), "pair-counts")
    most = Window.partitionBy(F.expr(f"key div {pieces}"))  # the pairs of one id: at most the other vocabulary
    marked = stored(counts.withColumn("best", (F.col("n") == F.max("n").over(most)).cast("int")), "pair-marks")
    least = _frequent_from(marked, limit)
    links = held.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    summed = lambda df: df.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.col("times") * F.col("best")).alias("n_best"))
    if least:
        often = F.broadcast(marked.where(F.col("n") >= least))
        rare = links.join(often, "key", "left_anti").join(marked.where(F.col("n") < least), "key")
        sums = summed(links.join(often, "key")).unionByName(summed(rare)).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    else:
        sums = summed(links.join(F.broadcast(marked), "key"))
    out = stored(held.drop("keys", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"), "alignment")
    for df in (held, counts, marked):
        discard(df)
    return out


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary over the whole texts of `documents`."""
    import sentencepiece

    a, b = tokenizer_path(A_VOCABULARY), tokenizer_path(B_VOCABULARY)
    return align(table(spark, sf_dir, "documents"), a, b, sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size())
