"""Stable 64-bit hashes of words and shingles, whole batches at a time in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0xD1342543DE82EF95, U))


_POWERS = _powers(256)


def _hash_chunk(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one stretch of bytes that begins and ends between words."""
    global _POWERS
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    if (longest := int(lengths.max())) > len(_POWERS):
        _POWERS = _powers(2 * longest)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = _BYTE[data[~space]] * _POWERS[at]
    sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(U))


def lowered(text: str | None) -> bytes:
    """UTF-8 with only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words (runs without \\x20 and \\x09-\\x0D) of `text`, in order."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= _CHUNK:
        return _hash_chunk(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_hash_chunk(data[at:end]))
        at = end
    return np.concatenate(out)


def batch_word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """`word_hashes` of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            counts = np.array([len(t.split()) for t in group])
            out.extend(np.split(word_hashes(b"\n".join(group)), np.cumsum(counts)[:-1]))
            group.clear()
            size = 0

    for t in texts:
        group.append(t)
        size += len(t)
        if size >= _CHUNK:
            flush()
    flush()
    return out


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, in order; of the whole sequence if there are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    factors = mix(np.arange(1, width + 1, dtype=U)) | U(1)
    if n < width:
        return mix(np.add.reduce(words * factors[:n], keepdims=True) + U(n))
    total = words[: n - width + 1] * factors[0]
    for i in range(1, width):
        total = total + words[i : n - width + 1 + i] * factors[i]
    return mix(total + U(width))
