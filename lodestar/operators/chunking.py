"""Chunks of documents: token windows in DataFrame functions; recursive and structural splitting in Arrow batches."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import chunk_id, content_hash, count_tokens

# The separators of recursive splitting, coarse to fine; a piece ends where a match ends.
SEPARATORS = (r"\n\s*\n", r"\n", r"(?<=[.!?])[\"')\]]?\s+", r"\s+")


#: Characters of a document whose sections and chunks are put in order in one group.
SPAN = 1 << 20


@dataclass(frozen=True)
class Config:
    strategy: str = "structure"
    size: int = 256
    overlap: int = 32
    min_tokens: int = 16
    headings: bool = True

    def __post_init__(self) -> None:
        if self.strategy not in ("fixed", "recursive", "structure"):
            raise ValueError(f"unknown strategy: {self.strategy}")
        if not 8 <= self.size <= 8192 or not 0 <= self.overlap < self.size or not 0 <= self.min_tokens <= self.size:
            raise ValueError("8 <= size <= 8192, 0 <= overlap < size, 0 <= min_tokens <= size")


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of `size` tokens, each starting `size - overlap` after the last: adds index, text, start_char, end_char, token_count.

    `docs` needs doc_id and text; text is replaced, other columns are dropped. Each text's tokens are
    found once and windows cut between their places, so the work is in proportion to the text.
    """
    Config("fixed", size, overlap, 0)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                tokens = _Tokens(text or "")
                spans = tokens.windows(0, len(text or ""), size, overlap)
                rows += [(doc_id, i, text[s:e], s, e, min(size, len(tokens.spans) - i * (size - overlap))) for i, (s, e) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "index", "text", "start_char", "end_char", "token_count"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, index long, text string, start_char long, end_char long, token_count long")


class _Tokens:
    """Places of a text's tokens; a span's tokens are those that start in it."""

    def __init__(self, text: str):
        self.spans = [m.span() for m in re.finditer(r"\S+", text)]
        self.starts = [s for s, _ in self.spans]

    def count(self, start: int, end: int) -> int:
        return bisect.bisect_left(self.starts, end) - bisect.bisect_left(self.starts, start)

    def windows(self, start: int, end: int, size: int, overlap: int) -> list[tuple[int, int]]:
        own = self.spans[bisect.bisect_left(self.starts, start) : bisect.bisect_left(self.starts, end)]
        last = max(len(own) - overlap, 1)  # a window that would hold old tokens only is none
        return [(own[i][0], own[min(i + size, len(own)) - 1][1]) for i in range(0, last, size - overlap)] if own else []


_SEPARATORS = [re.compile(s) for s in SEPARATORS]


def _pieces(text: str, tokens: _Tokens, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """[start, end) cut at the coarsest separators that leave at most `size` tokens in each piece."""
    out: list[tuple[int, int]] = []
    work = [(start, end, 0)]
    while work:
        a, b, level = work.pop()
        if tokens.count(a, b) <= size:
            out.append((a, b))
        elif level == len(_SEPARATORS):
            out += tokens.windows(a, b, size, 0)
        else:
            cuts = [a, *(m.end() for m in _SEPARATORS[level].finditer(text, a, b) if a < m.end() < b), b]
            work += [(s, e, level + 1) for s, e in zip(cuts[-2::-1], cuts[:0:-1], strict=True)]
    return out


def _packed(pieces: list[tuple[int, int]], tokens: _Tokens, size: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of pieces with at most `size` tokens; each begins with those last pieces of the run before that hold at most `overlap` tokens and leave room for a new one."""
    total = [0]
    for s, e in pieces:
        total.append(total[-1] + tokens.count(s, e))
    out, first = [], 0
    while first < len(pieces):
        after = max(bisect.bisect_right(total, total[first] + size) - 1, first + 1)
        out.append((pieces[first][0], pieces[after - 1][1]))
        if after >= len(pieces):
            break
        least = max(total[after] - overlap, total[after + 1] - size)
        first = max(first + 1, min(bisect.bisect_left(total, least), after))
    return out


def _merged(spans: list[tuple[int, int]], tokens: _Tokens, size: int, least: int) -> list[tuple[int, int]]:
    """Spans under `least` tokens joined to the one before, else to the one after, where the whole fits `size`."""
    if not least or len(spans) < 2:
        return spans
    out: list[tuple[int, int]] = []
    open_small = False  # whether the last span is small and waits for the next
    for s, e in spans:
        if open_small and tokens.count(out[-1][0], e) <= size:
            s = out.pop()[0]
        open_small = False
        if tokens.count(s, e) < least:
            if out and tokens.count(out[-1][0], e) <= size:
                out[-1] = (out[-1][0], e)
                continue
            open_small = True
        out.append((s, e))
    return out


def spans_of(text: str, sections: list[tuple[int, int]], config: Config) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the chunks of a text."""
    tokens = _Tokens(text)
    if config.strategy == "fixed":
        spans = tokens.windows(0, len(text), config.size, config.overlap)
    else:
        parts = sections if config.strategy == "structure" and sections else [(0, len(text))]
        spans = [x for s, e in parts for x in _packed(_pieces(text, tokens, s, e, config.size), tokens, config.size, config.overlap)]
    trimmed = []
    for s, e in spans:
        inner = text[s:e]
        s += len(inner) - len(inner.lstrip())
        e = s + len(inner.strip())
        if e > s:
            trimmed.append((s, e))
    return [(s, e, tokens.count(s, e)) for s, e in _merged(trimmed, tokens, config.size, config.min_tokens)]


def _shared_path(a: list[str], b: list[str]) -> list[str]:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


#: Columns of documents that their chunks carry, where a table has them.
CARRIED = ("source", "title", "format", "metadata")
CHUNKS = "doc_id string, index long, text string, start_char long, end_char long, token_count long, heading_path array<string>, page int, page_end int, context_header string"


def chunk_documents(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """Chunks (CHUNKS and chunk_id, content_hash, embedding_text) of `docs` (doc_id, title, text, sections).

    A chunk's heading path is what the paths of its first and last section share; its header is
    the title and that path, the title left out where it equals the first heading. The text is
    always the document's text between the two offsets.
    """
    config = config or Config()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            own = [pdf["content_hash"], *(pdf[f"doc_{c}"] for c in carried)]
            for doc_id, title, text, sections, *more in zip(pdf["doc_id"], pdf["title"], pdf["text"], pdf["sections"], *own, strict=True):
                if not text:
                    continue
                sections = [] if sections is None else list(sections)
                begins = [x["start_char"] for x in sections]

                def at(offset: int, sections: list = sections, begins: list = begins):
                    i = bisect.bisect_right(begins, offset) - 1
                    return sections[i] if i >= 0 and offset < sections[i]["end_char"] else None

                for index, (s, e, n) in enumerate(spans_of(text, [(x["start_char"], x["end_char"]) for x in sections], config)):
                    first, last = at(s), at(e - 1)
                    path = _shared_path(list(first["heading_path"]), list(last["heading_path"])) if first is not None and last is not None else []
                    page = first["page"] if first is not None else None
                    end = last["page"] if last is not None and last["page"] is not None else page
                    names = [title or "", *path]
                    header = " > ".join(x for x in (names[1:] if path and names[0] == path[0] else names) if x) if config.headings else ""
                    rows.append((doc_id, index, text[s:e], s, e, n, path, page, end, header, *more))
            out = pd.DataFrame(rows, columns=[*(c.split()[0] for c in CHUNKS.split(", ")), "content_hash", *carried])
            yield out.astype({"page": "Int64", "page_end": "Int64"})

    carried = [c for c in CARRIED if c in docs.columns]
    digested = docs.select("doc_id", "title", "text", "sections", content_hash(F.col("text")).alias("content_hash"), *[F.col(c).alias(f"doc_{c}") for c in carried])
    extra = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in carried)
    chunks = digested.mapInPandas(run, f"{CHUNKS}, content_hash string{extra}")
    embedded = F.when(F.col("context_header") != "", F.concat_ws("\n\n", "context_header", "text")).otherwise(F.col("text"))
    return chunks.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("content_hash"), F.col("start_char"), F.col("end_char"))).withColumn("embedding_text", embedded)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, and sum, least, mean, median, 95th percentile (linear) and most of token_count."""
    n = F.col("token_count")
    return chunks.agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum(n).alias("tokens"), F.min(n).alias("least"), F.round(F.avg(n), 2).alias("mean"),
        F.round(F.percentile(n, 0.5), 2).alias("p50"), F.round(F.percentile(n, 0.95), 2).alias("p95"), F.max(n).alias("most"),
    )


def section_crossing(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: chunks, crossing, rate. A chunk crosses if its first and last characters lie in different sections of its document.

    `chunks` (doc_id, start_char, end_char) of documents that have `sections` (doc_id, start). The starts of
    sections and both ends of the chunks are put in one order for each document and part of it (SPAN
    characters), and each end takes the last start before it, carried over from earlier parts by a second
    pass over one row a part: the work is that of a sort, and a document that is very long is many groups.
    """
    part = lambda at: F.floor(at / SPAN).alias("part")
    known = chunks.join(sections.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_chunk", F.monotonically_increasing_id())
    ends = known.select("doc_id", F.explode(F.array(F.struct(F.col("start_char").cast("long").alias("at"), F.lit(True).alias("first")), F.struct((F.col("end_char") - 1).cast("long").alias("at"), F.lit(False).alias("first")))).alias("x"), "_chunk")
    marks = ends.select("doc_id", "x.at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("start"), "_chunk", "x.first")
    starts = sections.select("doc_id", F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("start").cast("long").alias("start"), F.lit(None).cast("long").alias("_chunk"), F.lit(None).cast("boolean").alias("first"))
    both = marks.unionByName(starts).withColumn("part", part(F.col("at")))
    carried = starts.groupBy("doc_id", part(F.col("at"))).agg(F.max("start").alias("latest"))
    parts = both.select("doc_id", "part").distinct().join(carried, ["doc_id", "part"], "left")
    before = parts.select("doc_id", "part", F.max("latest").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    order = Window.partitionBy("doc_id", "part").orderBy("at", "kind")
    placed = both.withColumn("own", F.last("start", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("kind = 1")
    found = placed.join(before, ["doc_id", "part"]).select("_chunk", "first", F.coalesce("own", "before", F.lit(-1)).alias("section"))
    each = found.groupBy("_chunk").agg(F.min("section").alias("a"), F.max("section").alias("b"))
    return each.agg(F.count("*").alias("chunks"), F.count_if(F.col("a") != F.col("b")).alias("crossing"), F.round(F.count_if(F.col("a") != F.col("b")) / F.count("*"), 6).alias("rate"))


def verify(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks that do not agree with their documents, with a `reason`; none if all is well.

    `chunks` (chunk_id, doc_id, content_hash, start_char, end_char, text), `docs` (doc_id, text).
    """
    side = docs.select("doc_id", F.col("text").alias("whole"), content_hash(F.col("text")).alias("digest"), F.lit(True).alias("known"))
    own = chunks.select("chunk_id", "doc_id", "content_hash", "start_char", "end_char", content_hash(F.col("text")).alias("said"))  # texts of chunks don't travel
    both = own.join(side, "doc_id", "left")
    slice_ = F.substring("whole", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int"))
    reason = (
        F.when(F.col("known").isNull(), "unknown document")
        .when(F.col("digest") != F.col("content_hash"), "other content")
        .when((F.col("start_char") < 0) | (F.col("end_char") > F.length("whole")) | (F.col("end_char") <= F.col("start_char")), "out of bounds")
        .when(content_hash(slice_) != F.col("said"), "text differs")
    )
    return both.withColumn("reason", reason).where("reason is not null").select("chunk_id", "doc_id", "reason")


def tokens_per_document(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", count_tokens(F.col("text")).alias("n_tokens"))


__all__ = ["CHUNKS", "SEPARATORS", "Config", "chunk_documents", "chunk_stats", "fixed_chunks", "section_crossing", "spans_of", "tokens_per_document", "verify"]
