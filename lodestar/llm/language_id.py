"""Language identification with segmentation-marginalised unigrams over a fixed public vocabulary.

The vocabulary is that of a public tokenizer; it is never trained here. Each language has a
probability for each piece, learned by expectation-maximisation over all segmentations of the
training words: each round is one pass of tasks over the word counts, and only sums for each piece
reach the driver. A word's probability is the sum over all its segmentations (the forward
algorithm, scaled where a word is long); a text's is the product over its words, so each distinct
word of a task is worked out once. The language with the highest sum of logarithms wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import batches, discard, stored, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bound of the training sample: documents of each language, in expectation. All their words are learned from.
SAMPLE_DOCS = 1500
ROUNDS, SMOOTHING = 3, 0.05
#: Letters of the words that are worked out side by side; longer ones go one by one.
SIDE_BY_SIDE = 32
#: Places of a long word that are looked up at once.
STRETCH = 1 << 14
CACHE = 400_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = 0  # the piece of any character that is no piece
U = np.uint64


def pieces_of(path: str) -> list[str]:
    """Pieces of letters (and the word-start mark), shortest first; the first stands for any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return ["", *sorted(p for p in pieces if p and re.fullmatch(r"▁?[^\W\d_]*", p))]


class Lattice:
    """Finds all pieces at all places of many words at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        self.keys = np.zeros(1 << 18, U)
        self.ids = np.full(1 << 18, -1, np.int32)
        for i, p in enumerate(pieces):
            if p:
                h = U(0)
                for c in p:
                    h = self._next(np.array([h], U), np.array([ord(c)], U))[0]
                at = int(h >> U(46))
                while self.ids[at] >= 0:
                    at = (at + 1) % len(self.ids)
                self.keys[at], self.ids[at] = h, i

    @staticmethod
    def _next(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        x = (h ^ c) * U(0x9E3779B97F4A7C15)
        return (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> U(46)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], -1)
        left = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
        step = 1
        while len(left):
            a = (at[left] + step) % len(self.ids)
            hit = self.keys[a] == h[left]
            out[left[hit]] = self.ids[a[hit]]
            left = left[~hit & (self.ids[a] >= 0)]
            step += 1
        return out

    def edges(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]], int]]:
        """For the words of each length: their indices, (start, end, rows, piece ids) of all pieces, and the length with the mark."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            index = np.flatnonzero(lengths == n)
            text = "".join(["▁" + words[i] for i in index])
            chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(index), n + 1).astype(U)
            out = []
            for s in range(n + 1):
                h = np.zeros(len(index), U)
                for e in range(s + 1, min(s + self.longest, n + 1) + 1):
                    h = self._next(h, chars[:, e - 1])
                    ids = self.find(h)
                    if e == s + 1:
                        ids = np.where(ids < 0, UNKNOWN, ids)
                    rows = np.flatnonzero(ids >= 0)
                    if len(rows):
                        out.append((s, e, rows, ids[rows]))
            yield index, out, int(n + 1)

    def stretches(self, word: str) -> Iterator[np.ndarray]:
        """Piece ids of a long word, stretch by stretch: [start, length - 1], -1 where there is none."""
        chars = np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        for at in range(0, len(chars), STRETCH):
            n = min(STRETCH, len(chars) - at)
            ids = np.full((n, self.longest), -1, np.int32)
            h = np.zeros(n, U)
            for k in range(min(self.longest, len(chars) - at)):
                fit = min(n, len(chars) - at - k)
                h = self._next(h[:fit], chars[at + k : at + k + fit])
                ids[:fit, k] = self.find(h)
            ids[:, 0] = np.where(ids[:, 0] < 0, UNKNOWN, ids[:, 0])
            yield ids

    def log_long(self, word: str, prob: np.ndarray) -> np.ndarray:
        """The forward algorithm over one word of any length, as many sums of each language as the longest piece has letters at a time, scaled."""
        none = np.zeros((1, prob.shape[1]))
        table = np.concatenate([prob, none])
        ahead = np.zeros((self.longest + 1, prob.shape[1]))  # sums that reach the place itself and those after it
        ahead[0] = 1
        log = np.zeros(prob.shape[1])
        for ids in self.stretches(word):
            for row in table[ids]:
                here = np.maximum(ahead[0], 1e-300)
                ahead = np.concatenate([ahead[1:], none])
                ahead[:-1] += here * row
                scale = np.maximum(ahead.max(0), 1e-300)
                log += np.log(scale)
                ahead = ahead / scale
        return log + np.log(np.maximum(ahead[0], 1e-300))

    def log_probabilities(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability in each language (words x languages): the forward algorithm. prob: pieces x languages."""
        out = np.zeros((len(words), prob.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= SIDE_BY_SIDE]
        for index, edges, n in self.edges([words[i] for i in short]):
            alpha = np.zeros((n + 1, len(index), prob.shape[1]))
            alpha[0] = 1
            for s, e, rows, ids in edges:
                alpha[e, rows] += alpha[s, rows] * prob[ids]
            out[[short[i] for i in index]] = np.log(np.maximum(alpha[n], 1e-300))
        for i, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE:
                out[i] = self.log_long(w, prob)
        return out

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, each counted so often, under one language's probabilities."""
        total = np.zeros(len(prob))
        short = np.array([len(w) <= SIDE_BY_SIDE for w in words], bool)
        for w, count in zip(words, counts, strict=True):
            if len(w) > SIDE_BY_SIDE:
                total += count * self.expected_long(w, prob)
        kept = np.flatnonzero(short)
        for index, edges, n in self.edges([words[i] for i in kept]):
            alpha, beta = np.zeros((n + 1, len(index))), np.zeros((n + 1, len(index)))
            alpha[0] = beta[n] = 1
            for s, e, rows, ids in edges:
                alpha[e, rows] += alpha[s, rows] * prob[ids]
            for s, e, rows, ids in reversed(edges):
                beta[s, rows] += beta[e, rows] * prob[ids]
            weight = counts[kept[index]] / np.maximum(alpha[n], 1e-300)
            for s, e, rows, ids in edges:
                total += np.bincount(ids, alpha[s, rows] * prob[ids] * beta[e, rows] * weight[rows], len(prob))
        return total

    def expected_long(self, word: str, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one long word: logarithms of the sums from both ends at every place."""
        ids = np.concatenate(list(self.stretches(word)))
        n = len(ids)
        logs = np.where(ids >= 0, np.log(np.maximum(prob, 1e-300))[ids], -np.inf)
        front, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        front[0] = back[n] = 0
        for s in range(n):
            m = min(self.longest, n - s)
            front[s + 1 : s + 1 + m] = np.logaddexp(front[s + 1 : s + 1 + m], front[s] + logs[s, :m])
        for s in range(n - 1, -1, -1):
            m = min(self.longest, n - s)
            back[s] = np.logaddexp.reduce(logs[s, :m] + back[s + 1 : s + 1 + m])
        s, k = np.nonzero(ids >= 0)
        return np.bincount(ids[s, k], np.exp(front[s] + logs[s, k] + back[s + 1 + k] - front[n]), len(prob))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    words = WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else [w])]  # number signs such as ½ are no letters


def fit(docs: DataFrame, vocabulary: str = VOCABULARY) -> tuple[list[str], list[str], np.ndarray] | None:
    """(languages, pieces, probabilities) from rows of `docs` (doc_id, text, lang) with a language; None if there are none or no letter.

    At most SAMPLE_DOCS documents of each language are learned from in expectation, those whose
    hash falls under the language's rate. All their words are; the driver gets a sum for each piece
    and language.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    rates = known.groupBy("lang").count().select("lang", F.least(F.lit(1.0), SAMPLE_DOCS / F.col("count")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "text")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            tally: dict[tuple[str, str], int] = {}
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for w in words_of(text):
                    tally[lang, w] = tally.get((lang, w), 0) + 1
            yield pd.DataFrame([(*k, v) for k, v in tally.items()], columns=["lang", "word", "n"])

    tally = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    tally = stored(tally, "language-words")
    languages = sorted(r["lang"] for r in tally.select("lang").distinct().collect())
    if not languages:
        return None
    pieces = pieces_of(vocabulary)
    prob = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(ROUNDS):
        uses = _uses(tally, languages, pieces, prob) + SMOOTHING
        prob = uses / uses.sum(0)
    discard(tally)
    return languages, pieces, prob


def _uses(tally: DataFrame, languages: list[str], pieces: list[str], prob: np.ndarray) -> np.ndarray:
    """One round: expected uses of each piece in each language's words (pieces x languages)."""
    shared = tally.sparkSession.sparkContext.broadcast((languages, pieces, prob))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, pieces, prob = shared.value
        lattice, total = Lattice(pieces), np.zeros_like(prob)
        for pdf in it:
            for k, lang in enumerate(languages):
                own = pdf[pdf["lang"] == lang]
                if len(own):
                    total[:, k] += lattice.expected(own["word"].to_list(), own["n"].to_numpy().astype(float), prob[:, k])
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "lang": lang, "uses": total[piece, lang]})

    rows = tally.mapInPandas(run, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros_like(prob)
    out[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["uses"].to_numpy()
    shared.unpersist()
    return out


def identify(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray] | None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, lang_pred, score.

    `und` with score 0 if the text is null, empty or has no letter, or if there was nothing to
    learn from. The score is the language's posterior against the others, equal priors; ties go
    to the alphabetically first. Whole texts and whole words are read, however long. Repeated rows
    are each named. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        lattice = Lattice(model[1]) if model else None
        cache: dict[str, int] = {}
        logs = np.zeros((0, len(model[0]) if model else 0))
        for pdf in batches(it):
            texts = [words_of(t) for t in pdf["text"]] if model else [[] for _ in pdf["text"]]
            if len(cache) > CACHE:
                cache, logs = {}, logs[:0]
            new = list({w for ws in texts for w in ws if w not in cache})
            if new:
                cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
                logs = np.concatenate([logs, lattice.log_probabilities(new, model[2])])
            langs, scores = [], []
            for ws in texts:
                if not ws:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = logs[np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws))].sum(0)
                best = int(total.argmax())
                langs.append(model[0][best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` with its language; learned from the rows that are not held out, as `fit` and `identify` say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.where(rest != 2))
    return identify(docs, model).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
