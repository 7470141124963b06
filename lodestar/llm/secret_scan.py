"""Secret scanning over nested encodings.

Each text is the first layer. A layer is scanned, then unwrapped: URL and Unicode escapes are
decoded in place over the whole layer, with a map from its characters to the original text,
until nothing decodes (bytes that are no UTF-8 stay escaped). URL-escaped compressed streams are read. Base64 runs of every such layer are decoded one by one, whole, in
parts and from each place of a group of four, over line ends too, however wide the lines;
gzip, zlib, bzip2, xz and zstd streams in decoded bytes, at their start or behind other bytes,
are decompressed, all of their members, and what comes out is scanned and unwrapped in turn, be
it text or not. A secret in a run has the span of the run (or part), so a run is read once and
its result goes to every copy.
Only content that was seen in the same run is not read again (cycles end).
All spans are code points of the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import batches, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of fewer holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6

ESCAPE = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|(?P<pu>%u[0-9A-Fa-f]{4})|(?P<u>\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})|(?P<ref>&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)"
)
BLOB = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs over line ends (blanks may stand around them), and the lines in one.
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Characters of base64 that hold the shortest secret or stream.
SHORTEST = 16
MAYBE = re.compile(r"%u?[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}")
#: A line end between characters of base64.
BREAK = re.compile(r"\n[ \t]*[A-Za-z0-9+/_-]")
#: One of these stands in all bytes that hold a secret or another layer.
HOLDS = re.compile(
    rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%u?[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]|\x1f\x8b|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]"
)
#: Bytes held of one decompressed layer, and by how much the windows over a longer one overlap.
LAYER = 16 << 20
OVERLAP = 1 << 20
#: Decompressed bytes of one text (or 64 for each of its characters, if that is more), against bombs. A run beyond it makes the row `truncated` and is redacted whole.
MAX_DECODED = 256 << 20


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three patterns, leftmost and non-overlapping for each kind, failing matches dropped."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _unescape(text: str) -> tuple[str, list[tuple[int, int, int, int]]] | None:
    """Decoded text and its pieces (new start, new end, old start, old end); a piece of equal length maps character by character. None if nothing decodes."""
    if "%" not in text and "\\" not in text and "&#" not in text:
        return None
    parts: list[str] = []
    pieces: list[tuple[int, int, int, int]] = []
    at = new = 0

    def put(piece: str, start: int, end: int) -> None:
        nonlocal new
        if piece or end > start:
            pieces.append((new, new + len(piece), start, end))
            parts.append(piece)
            new += len(piece)

    for m in ESCAPE.finditer(text):
        raw = m[0]
        if m["url"]:
            # Bytes that are no UTF-8 come out as lone surrogates and stay escaped, each on its own.
            chars = bytes.fromhex(raw.replace("%", "")).decode("utf-8", "surrogateescape")
            if all("\udc80" <= c <= "\udcff" for c in chars):
                continue
            put(text[at : m.start()], at, m.start())
            pos = m.start()
            for c in chars:  # three characters for each byte
                size = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
                put(raw[pos - m.start() : pos - m.start() + 3] if "\udc80" <= c <= "\udcff" else c, pos, pos + 3 * size)
                pos += 3 * size
        else:
            digits = re.sub(r"[^0-9A-Fa-f]", "", raw[2:])
            code = int(digits, 10) if m["ref"] and raw[2] not in "xX" else int(digits, 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                continue
            put(text[at : m.start()], at, m.start())
            put(chr(code), m.start(), m.end())
        at = m.end()
    if not at:
        return None
    put(text[at:], at, len(text))
    return "".join(parts), pieces


def _maybe(layer: str) -> bool:
    """False if a layer holds no other one for sure."""
    return bool(("\n" in layer and BREAK.search(layer)) or MAYBE.search(layer))


class Unread(Exception):
    """A stream that nothing here can read."""


def _streams(data: bytes) -> Iterator[bytes]:
    """Pieces of what the compressed streams at the start of `data` hold, one stream after the other, then what follows them; nothing if `data` is not compressed. A broken stream ends where it breaks; all bytes behind its first two follow, as they are."""
    first = True
    while data:
        if data[:2] == b"\x1f\x8b":
            reader = zlib.decompressobj(31)
        elif data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
            reader = zlib.decompressobj()
        elif data[:3] == b"BZh":
            reader = bz2.BZ2Decompressor()
        elif data[:6] == b"\xfd7zXZ\x00":
            reader = lzma.LZMADecompressor()
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            try:
                import zstandard
            except ImportError as e:
                raise Unread from e
            source = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
            try:
                while piece := source.read(LAYER):
                    yield piece
            except zstandard.ZstdError:
                yield data[2:]
            return
        else:
            if not first:
                yield data
            return
        rest = data
        try:
            while not reader.eof:
                piece = reader.decompress(rest, LAYER)
                rest = getattr(reader, "unconsumed_tail", b"")
                if piece:
                    yield piece
                elif not rest and getattr(reader, "needs_input", True):
                    break
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            yield data[2:]
            return
        data, first = reader.unused_data, False


COMPRESSED = re.compile(rb"\x1f\x8b|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")


def _read(data: bytes) -> Iterator[bytes | None]:
    try:
        yield from _streams(data)
    except Unread:
        yield None


def _unpacked(data: bytes, room: list[int]) -> Iterator[bytes | None]:
    """`data` through as many compressed layers as there are, in overlapping windows where one is longer than LAYER; None where it was not read to the end."""
    work, seen = [data], set()
    while work:
        data = work.pop()
        key = hashlib.blake2b(data, digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        held, windows, any_piece = b"", 0, False
        for piece in _read(data):
            if piece is None:
                yield None
                continue
            any_piece = True
            room[0] -= len(piece)
            if room[0] < 0:
                yield None
                return
            held += piece
            if len(held) > LAYER:
                if (not windows and COMPRESSED.match(held)) or not re.search(rb"\s", held[-OVERLAP:]):
                    yield None  # a stream or run that no window holds
                yield held
                held, windows = held[-OVERLAP:], windows + 1
        if not any_piece:
            yield data
        elif windows:
            yield held
        else:
            work.append(held)


def _runs(layer: str) -> Iterator[tuple[str, int, int]]:
    """Base64 runs of a layer (run, start, end): on one line, and lines of one width with the line before and the line after."""
    for m in BLOB.finditer(layer):
        yield m[0], m.start(), m.end()
    for whole in LINES.finditer(layer) if "\n" in layer else ():
        lines = [m.span() for m in LINE.finditer(layer, *whole.span())]
        first = 0
        while first < len(lines):
            width, last = lines[first][1] - lines[first][0], first
            while last + 1 < len(lines) and lines[last + 1][1] - lines[last + 1][0] == width:
                last += 1
            start, end = lines[max(0, first - 1)][0], lines[min(len(lines) - 1, last + 1)][1]
            # A lone line at an end is in its neighbour's stretch already.
            alone = first == last and len(lines) > 1 and (last == len(lines) - 1 or first == 0 and len(lines) > 2)
            if end - start > SHORTEST and not alone:
                yield layer[start:end], start, end
            first = last + 1


#: What may stand in URL-escaped bytes.
ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!$'()*+,:@/;=-])+")


def _begins(data: bytes) -> bool:
    """Whether the first bytes of a compressed stream can be read."""
    try:
        if data[:3] == b"BZh":
            bz2.BZ2Decompressor().decompress(data)
        elif data[:1] == b"\xfd":
            lzma.LZMADecompressor().decompress(data)
        elif data[:1] != b"\x28":
            zlib.decompressobj(47).decompress(data)
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return False
    return True


def _escaped_streams(layer: str) -> Iterator[tuple[bytes, int, int]]:
    """Bytes of URL-escaped compressed streams of a layer (data, start, end): from where one begins to where escapes and plain URL characters end."""
    for run in ESCAPED.finditer(layer) if "%" in layer else ():
        if "%" not in run[0]:
            continue
        data = unquote_to_bytes(run[0])
        found = [m.start() for m in COMPRESSED.finditer(data) if _begins(data[m.start() : m.start() + 256])]
        if found:
            sizes = [len(x) for x in re.findall(r"%[0-9A-Fa-f]{2}|.", run[0])]
            places = np.concatenate([[0], np.cumsum(sizes)])
            for at in found:
                yield data[at:], run.start() + int(places[at]), run.end()


def _decoded(run: str) -> bytes:
    """The bytes of a base64 run; what is left over at its end is dropped."""
    raw = run.rstrip("=")
    raw = raw[: len(raw) - (len(raw) % 4 == 1)]
    return base64.b64decode(raw.replace("-", "+").replace("_", "/") + "=" * (-len(raw) % 4))


def _readings(run: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of a run read whole, between its `/`, `_` and `-`, and from each later place of a group of four on; bytes that can hold nothing are left out."""
    plain = re.sub(r"\s", "", run) if "\n" in run else run
    yield from ((0, len(run), data) for data in [_decoded(plain)] if plain is run or HOLDS.search(data))
    cuts = [m.end() for m in re.finditer("[/_-]", run)] if plain is run else []
    parts = [(a, b) for a, b in zip([0, *cuts], [*(c - 1 for c in cuts), len(run)], strict=True) if b - a >= SHORTEST] if cuts else []
    for start, end in parts:
        if HOLDS.search(data := _decoded(run[start:end])):
            yield start, end, data
    for start in (1, 2, 3):
        if HOLDS.search(data := _decoded(plain[start:])):
            yield (start if plain is run else 0), len(run), data


def _kinds(data: bytes, room: list[int]) -> tuple[set[str], int, bool]:
    """Kinds of secrets in the bytes of a run or in anything nested in them, readable layers, whether all was read. Where in the bytes a secret stands does not matter: its span is the run's."""
    kinds: set[str] = set()
    layers, whole = 0, True
    seen, work = set(), [data]
    while work:
        for inner in _unpacked(work.pop(), room):
            if inner is None:
                whole = False
                continue
            key = hashlib.blake2b(inner, digest_size=16).digest()
            if key in seen:
                continue
            seen.add(key)
            layer = inner.decode("latin-1")  # secrets are ASCII, whatever stands around them
            odd = sum(1 for c in layer[:4096] if c < " " and c not in "\t\n\r")
            layers += bool(layer) and odd * 10 <= min(len(layer), 4096)
            kinds.update(k for k, _, _ in base_spans(layer))
            if _maybe(layer):
                if plain := _unescape(layer):
                    work.append(plain[0].encode("utf-8", "surrogatepass"))
                work += [data for run, _, _ in _runs(layer) for _, _, data in _readings(run)]
                work += [data for data, _, _ in _escaped_streams(layer)]
            # The first stream that can be read; what follows it comes out behind it.
            work += islice((inner[m.start() :] for m in COMPRESSED.finditer(inner, 1) if _begins(inner[m.start() : m.start() + 256])), 1)
    return kinds, layers, whole


class _Map:
    """From spans of a layer to spans of the original text."""

    def __init__(self, parent: _Map | None, pieces: list[tuple[int, int, int, int]] | None):
        self.parent, self.pieces = parent, pieces
        self.starts = np.fromiter((p[0] for p in pieces), np.int64, len(pieces)) if pieces else None

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.pieces is not None:
            a = self.pieces[int(np.searchsorted(self.starts, start, "right")) - 1]
            b = self.pieces[int(np.searchsorted(self.starts, end - 1, "right")) - 1]
            start = a[2] + (start - a[0] if a[1] - a[0] == a[3] - a[2] else 0)
            end = b[2] + (end - b[0]) if b[1] - b[0] == b[3] - b[2] else b[3]
        return self.parent.span(start, end) if self.parent else (start, end)


def scan_parts(text: str | None) -> tuple[list[tuple[str, int, int]], set[tuple[str, int, int]], int, set[tuple[int, int]]]:
    """Base spans, all spans, layers entered besides the text, spans of runs that were not read to the end."""
    text = text or ""
    base = base_spans(text)
    spans, unread = set(base), set()
    if not _maybe(text):
        return base, spans, 0, unread
    layer, where, layers = text, _Map(None, None), 0
    room = [max(MAX_DECODED, 64 * len(text))]
    known: dict[str, list[tuple[int, int, set[str], bool]]] = {}
    while True:
        for run, at, _ in _runs(layer):
            if run not in known:
                known[run], before = [], set()
                for start, end, data in _readings(run):
                    kinds, n, whole = _kinds(data, room)
                    layers += n
                    if kinds - before or not whole:
                        known[run].append((start, end, kinds - before, whole))
                    before |= kinds
            for start, end, kinds, whole in known[run]:
                span = where.span(at + start, at + end)
                spans.update((k, *span) for k in kinds)
                if not whole:
                    unread.add(span)
        for data, start, end in _escaped_streams(layer):
            kinds, n, whole = _kinds(data, room)
            layers += n
            span = where.span(start, end)
            spans.update((k, *span) for k in kinds)
            if not whole:
                unread.add(span)
        plain = _unescape(layer)
        if plain is None:
            return base, spans, layers, unread
        layer, where, layers = plain[0], _Map(where, plain[1]), layers + 1
        spans.update((k, *where.span(s, e)) for k, s, e in base_spans(layer))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], set[tuple[str, int, int]], int, bool]:
    """Base spans, all spans, layers entered besides the text, whether a run was not read to the end."""
    base, spans, layers, unread = scan_parts(text)
    return base, spans, layers, bool(unread)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, truncated boolean"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): SCHEMA. Counts and base_sha256 are those of the base patterns.

    Null and empty texts have no spans (the digest of the empty string). Repeated rows are each
    scanned. Every text is scanned whole; rows never leave their partition.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                base, spans, layers, cut = scan(text)
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, joined(spans), layers, cut))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def redact(docs: DataFrame, marker: str = "[REDACTED]") -> DataFrame:
    """`docs` with every secret span of `text`, and every run that was not read to the end, replaced by `marker` (overlapping spans by one), `n_chars` set to the new length where the text changed. Columns as in `docs`."""
    schema = docs.schema
    has_length = "n_chars" in docs.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            texts, lengths = [], []
            for i, text in enumerate(pdf["text"]):
                _, found, _, unread = scan_parts(text)
                spans = sorted({(s, e) for _, s, e in found} | unread)
                if spans:
                    parts, at = [], 0
                    for s, e in spans:
                        if s >= at:
                            parts += [text[at:s], marker]
                        at = max(at, e)
                    text = "".join(parts) + text[at:]
                    lengths.append((i, len(text)))
                texts.append(text)
            pdf = pdf.assign(text=texts)
            if has_length and lengths:
                values = pdf["n_chars"].astype("Int64").copy()
                for i, n in lengths:
                    values.iloc[i] = n
                pdf = pdf.assign(n_chars=values)
            yield pdf

    return docs.mapInPandas(run, schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` with the secrets of its text, as `find_secrets` says; `truncated` if a run was not read to the end."""
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", F.col("text"))).drop("n_layers")
