"""Token ids as binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is
  * frames of little-endian unsigned 32-bit ids, each up to FRAME_IDS of them: whole documents, or
    a stretch of one that is longer;
  * a skippable frame with the documents of the file: their number, then for each its id (and
    whether it has one) and its number of ids, in the order of the ids;
  * the seek table of the public seekable format of zstandard: a skippable frame with each frame's
    compressed and decompressed size and the low 32 bits of the XXH64 of its contents.
So any zstandard reader decompresses a file whole, and a reader of a few documents decompresses the
frames that hold them and nothing else.

Documents are range-partitioned by doc_id; each task writes its own files, which it names anew for
each attempt, and tells Spark what it wrote. Only files that the manifest (a table that Spark commits)
names are part of a store, so attempts that were lost or ran twice leave nothing behind that is read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import batches, shared_dir, small_or_shuffled, stored, table

VOCABULARY, END = "word_bpe_49k.json", 2
FRAME_IDS, FILE_IDS = 1 << 18, 1 << 25
LEVEL = 3
#: Distinct words whose ids a task remembers, and characters of text that it cuts into words at once.
CACHE, STRETCH = 500_000, 1 << 20
# Fixed values of the public format: skippable frames, the seek table's and this file's own; the footer.
SEEK_MAGIC, DOCS_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CHECKSUMS = 0x80


class BrokenFile(ValueError):
    """A file that is none of this format, or whose contents are not what was written."""


# --- encoding ---------------------------------------------------------------------------------


BLANK = re.compile(r"[ \n\t\r]")
#: What both vocabularies' splitters cut into letters and signs, whatever stands around it.
PLAIN = re.compile(r"([A-Za-z]+)([.,;:!?]*)")


#: The same with the letters of Latin-1, none of which any normalization changes but for lower case.
PLAIN_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: How byte-level vocabularies spell bytes over 0x7E that are not printable in Latin-1: from U+0121 on; the others are the characters of Latin-1.
SPELLED = {b: 0x121 + i for i, b in enumerate([*range(0x7F, 0xA1), 0xAD])}


def quiet_tokenizer(path: str) -> object:
    """The tokenizer of a file, in a task: without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of whole texts as little-endian bytes.

    The vocabulary drops white space and no word's ids depend on its neighbours, so each distinct
    word is encoded by the tokenizer once while it is remembered (words of ASCII letters and signs
    by its model alone, as the steps before it only cut between the two). When CACHE new words have come,
    those that were not met since the last time are forgotten.
    """

    def __init__(self, path: str):
        self.tokenizer = quiet_tokenizer(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > CACHE:
            self.known, self.before = {}, self.known
            new = words
        rest, known, before, stems, match = [], self.known, self.before, self.stems, PLAIN_LATIN.fullmatch
        if len(stems) > CACHE:
            stems.clear()
        for word in new:
            if word in before:
                known[word] = before[word]
            elif m := match(word):
                stem, signs = m.groups()
                stem = stem.lower()
                ids = stems.get(stem)
                if ids is None:
                    ids = stems[stem] = self._ids(stem)
                if signs:
                    end = stems.get(signs)
                    if end is None:
                        end = stems[signs] = self._ids(signs)
                    ids += end
                known[word] = ids
            else:
                rest.append(word)
        for word, x in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[word] = np.array(x.ids, "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(SPELLED))]).tobytes()

    def meet(self, texts: Iterable[str | None]) -> None:
        """Learn the words of several texts at once, which is faster; of long ones, of what comes first."""
        words, size = set(), 0
        for text in texts:
            if text and size < STRETCH:
                part = text[: STRETCH - size]
                words.update(_words(part)[: None if len(part) == len(text) else -1])
                size += len(part)
        self._learn(words)

    def __call__(self, text: str) -> Iterator[bytes]:
        """The ids, stretch by stretch."""
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= STRETCH else at + STRETCH
            if end < len(text):
                m = BLANK.search(text, end)
                end = m.end() if m else len(text)
            words = _words(text[at:end])
            at = end
            try:
                ids = b"".join(map(self.known.__getitem__, words))
            except KeyError:
                self._learn(set(words))
                ids = b"".join(map(self.known.__getitem__, words))
            yield ids


def _words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


@functools.lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(path)


# --- the format -------------------------------------------------------------------------------


class Writer:
    """Writes one file to `out`, a binary file that is only appended to."""

    def __init__(self, out: object):
        self.out, self.frames, self.docs, self.ids = out, [], [], 0
        self.held, self.size = [], 0
        self.codec = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, parts: Iterable[bytes]) -> tuple[int, int]:
        """Appends a document; returns its first id's place in the file and its number of ids."""
        start, n = self.ids, 0
        first = True
        for part in parts:
            if first and self.held and self.size + len(part) > 4 * FRAME_IDS:
                self._flush()  # a document that fits begins a frame rather than straddle two
            first = False
            n += len(part) // 4
            while self.size + len(part) > 4 * FRAME_IDS:
                room = 4 * FRAME_IDS - self.size
                self.held.append(part[:room])
                self.size, part = self.size + room, part[room:]
                self._flush()
            if part:
                self.held.append(part)
                self.size += len(part)
        self.docs.append((doc_id, n))
        self.ids += n
        return start, n

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.codec.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8").tobytes()
        known = np.array([d is not None for d, _ in self.docs], np.uint8).tobytes()
        body = self.codec.compress(struct.pack("<Q", len(self.docs)) + ids + known + np.array([n for _, n in self.docs], "<u8").tobytes())
        self.out.write(struct.pack("<II", DOCS_MAGIC, len(body)) + body)
        table = np.array(self.frames, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class Reader:
    """Reads one file from `source`, a binary file that can seek."""

    def __init__(self, source: object):
        self.source, self.codec = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2)
        if size < 17:
            raise BrokenFile("too short")
        count, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        where = size - 9 - 12 * count
        if magic != FOOTER_MAGIC or descriptor != CHECKSUMS or where < 8 or struct.unpack("<II", self._at(where - 8, 8)) != (SEEK_MAGIC, 12 * count + 9):
            raise BrokenFile("no seek table")
        self.frames = np.frombuffer(self._at(where, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.firsts = np.concatenate([[0], np.cumsum(self.frames[:, 1])]) // 4
        head = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if head[0] != DOCS_MAGIC or self.starts[-1] + 8 + head[1] != where - 8:
            raise BrokenFile("no table of documents")
        body = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[-1]) + 8, head[1]))
        n = struct.unpack_from("<Q", body)[0]
        self.doc_ids = np.frombuffer(body, "<i8", n, 8)
        self.has_id = np.frombuffer(body, np.uint8, n, 8 + 8 * n).astype(bool)
        self.counts = np.frombuffer(body, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.counts)])
        if self.places[-1] != self.firsts[-1]:
            raise BrokenFile("the documents do not fill the frames")
        self._kept: tuple[int, bytes] = (-1, b"")
        self.read_frames = 0

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        got = self.source.read(n)
        if len(got) != n:
            raise BrokenFile("cut off")
        return got

    def frame(self, i: int) -> bytes:
        if self._kept[0] != i:
            packed, raw, check = self.frames[i]
            try:
                data = self.codec.decompress(self._at(int(self.starts[i]), int(packed)), max_output_size=int(raw))
            except zstandard.ZstdError as e:
                raise BrokenFile(f"frame {i}: {e}") from e
            if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise BrokenFile(f"frame {i}: other contents than were written")
            self._kept = i, data
            self.read_frames += 1
        return self._kept[1]

    def parts(self, doc: int) -> Iterator[bytes]:
        """The ids of the document at place `doc` of the file, frame by frame; no other frame is read."""
        at, end = int(self.places[doc]), int(self.places[doc + 1])
        i = int(np.searchsorted(self.firsts, at, side="right")) - 1
        while at < end:
            first = int(self.firsts[i])
            upto = min(end, int(self.firsts[i + 1]))
            yield self.frame(i)[4 * (at - first) : 4 * (upto - first)]
            at, i = upto, i + 1


# --- stores -----------------------------------------------------------------------------------


def _files(path: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def write(docs: DataFrame, path: str, encoder: Callable[[], Callable[[str], Iterable[bytes]]], end: int) -> DataFrame:
    """Writes the ids of all `docs` (doc_id, text), each with `end` after its last, and returns the manifest.

    The manifest (doc_id, part, file, doc, start, n_tokens) has a row for each document: its place among
    the file's documents and the number of ids before it in the file. Files stand in order of part, then
    name. A null or empty text has the end id only; rows without doc_id come first; rows with one doc_id
    stand in order of a hash of their texts. `path` is an address that pyarrow can write to.
    """

    def put(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, attempt, roll = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        fs, root = _files(path)
        fs.create_dir(root, recursive=True)
        encode, stop = encoder(), np.array([end], "<u4").tobytes()
        out = writer = None
        name, rows = "", []
        for pdf in batches(it, 256):
            if hasattr(encode, "meet"):
                encode.meet(t for t in pdf["text"] if isinstance(t, str))
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if out is None:
                    name = f"{part:08d}-{roll:06d}-{attempt}.ids.zst"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer, roll = Writer(out), roll + 1
                known = None if pd.isna(doc_id) else int(doc_id)
                start, n = writer.add(known, _ended(encode(text) if isinstance(text, str) else (), stop))
                rows.append((known, part, name, len(writer.docs) - 1, start, n))
                if writer.ids >= FILE_IDS:
                    writer.close()
                    out.close()
                    out = None
            yield _manifest_rows(rows)
            rows = []
        if out is not None:
            writer.close()
            out.close()

    salted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_salt"))
    dealt = salted.repartitionByRange("doc_id", "_h", "_salt").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return stored(dealt.mapInPandas(put, "doc_id long, part int, file string, doc int, start long, n_tokens long"), "token-store")


def _ended(parts: Iterable[bytes], stop: bytes) -> Iterator[bytes]:
    held = b""
    for part in parts:
        if held:
            yield held
        held = part
    yield held + stop


def _manifest_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "part", "file", "doc", "start", "n_tokens"]).astype({"doc_id": "Int64"})


def file_starts(manifest: DataFrame) -> DataFrame:
    """(file, before): ids of all files before each. One row a file, that is a task of the writing job or FILE_IDS ids, is ordered in one place."""
    from pyspark.sql import Window

    sizes = manifest.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    return sizes.select("file", (F.sum("n").over(Window.orderBy("part", "file")) - F.col("n")).alias("before"))


def _read(wanted: DataFrame, path: str, make: Callable[[Iterator[bytes]], object], column: str) -> DataFrame:
    """For rows (file, docs: places of wanted documents, null for all): doc_id, doc, file, start, n_tokens and what `make` makes of the parts of the document's ids."""

    def get(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _files(path)
        for pdf in it:
            for name, docs in zip(pdf["file"], pdf["docs"], strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader, rows, held = Reader(source), [], 0
                    for i in range(len(reader.counts)) if docs is None else sorted({int(d) for d in docs}):
                        rows.append((int(reader.doc_ids[i]) if reader.has_id[i] else None, name, i, int(reader.places[i]), int(reader.counts[i]), make(reader.parts(i))))
                        held += int(reader.counts[i])
                        if len(rows) >= 4096 or held >= 1 << 20:
                            yield _read_rows(rows)
                            rows, held = [], 0
                    yield _read_rows(rows)

    return wanted.select("file", "docs").mapInPandas(get, f"doc_id long, file string, doc int, start long, n_tokens long, {column}")


def _read_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "file", "doc", "start", "n_tokens", "made"]).astype({"doc_id": "Int64"})


def _ids(parts: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<u4").astype(np.int64)


def _crc(parts: Iterator[bytes]) -> int:
    crc = 0
    for part in parts:
        crc = zlib.crc32(part, crc)
    return crc


def read_all(manifest: DataFrame, path: str, make: Callable[[Iterator[bytes]], object] = _ids, column: str = "made array<long>") -> DataFrame:
    """Every document of a store, read from its files; a file is read by one task, frame by frame."""
    spread = 4 * manifest.sparkSession.sparkContext.defaultParallelism
    files = manifest.select("file").distinct().repartition(spread, "file").withColumn("docs", F.lit(None).cast("array<int>"))
    return _read(files, path, make, column)


def fetch(manifest: DataFrame, path: str, wanted: DataFrame) -> DataFrame:
    """The documents of `wanted` (doc_id) with their `ids`: only the frames that hold them are read. Ids that the store lacks give no row, an id that it holds twice gives two."""
    rows = manifest.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("file").agg(F.collect_list("doc").alias("docs"))  # at most the documents of one file
    return _read(rows, path, _ids, "made array<long>").withColumnRenamed("made", "ids")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of all `documents` hold, read back from them."""
    path = f"{shared_dir(spark)}/lodestar/token-files-{uuid.uuid4().hex}"
    manifest = write(table(spark, sf_dir, "documents"), path, lambda: word_encoder(tokenizer_path(VOCABULARY)), END)
    found = read_all(manifest, path, _crc, "made long")
    return found.join(small_or_shuffled(file_starts(manifest)), "file").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", F.col("made").alias("ids_crc32"))
