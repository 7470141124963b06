"""Embeddings of text: signed feature hashing, and a frame for models."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 512
_WORD = re.compile(r"[a-z0-9]+")


def _place(feature: str, dimension: int) -> tuple[int, float]:
    value = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
    return value % dimension, 1.0 if value >> 63 else -1.0


def hashing_embedder(dimension: int = DIMENSION, bigrams: bool = True) -> Callable[[Column], Column]:
    """A column function: lower-cased ASCII words (and pairs of them), hashed with sign, damped by logarithm, unit length in float32; zeros for text without words.

    Places of features are remembered within a task, up to a bound.
    """
    if dimension < 8:
        raise ValueError("the dimension must be at least 8")

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, float]] = {}

        def vector(text: str | None) -> np.ndarray:
            words = _WORD.findall((text or "").lower())
            sums = np.zeros(dimension)
            for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))] if bigrams else words:
                at = known.get(feature)
                if at is None:
                    at = _place(feature, dimension)
                    if len(known) < 200_000:
                        known[feature] = at
                sums[at[0]] += at[1]
            size = np.abs(sums)
            damped = np.where(size > 0, np.sign(sums) * (1 + np.log(np.maximum(size, 1))), 0).astype(np.float32)
            length = np.linalg.norm(damped)
            return damped / length if length else damped

        for batch in texts:
            yield batch.map(vector)

    return embed


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32, dimension: int | None = None) -> Callable[[Column], Column]:
    """A column function around a model: `load` runs once in each worker; blank text is a zero vector without a call to the model.

    `dimension` is the model's width, which it must then return; without it blank texts have the width
    that the worker has seen, and are null before it has seen any.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, width = load(), dimension
        for series in texts:
            filled = [(i, t) for i, t in enumerate(series) if t and t.strip()]
            rows: dict[int, np.ndarray] = {}
            for at in range(0, len(filled), batch):
                part = filled[at : at + batch]
                out = np.asarray(model([t for _, t in part]), np.float32)
                if out.ndim != 2 or len(out) != len(part) or not np.isfinite(out).all() or out.shape[1] != (width or out.shape[1]):
                    raise ValueError("the model returned a wrong shape or values that are not finite")
                width = out.shape[1]
                out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)
                rows.update(zip([i for i, _ in part], out, strict=True))
            blank = np.zeros(width, np.float32) if width else None
            yield pd.Series([rows.get(i, blank) for i in range(len(series))], dtype=object)

    return embed


def embedder(spec: str, loader: Callable[[str], Callable[[], Callable]] | None = None, dimension: int | None = None) -> Callable[[Column], Column]:
    """From a spec: `hashing`, `hashing-<dimension>`, with or without `-bigrams` at the end, or `<kind>:<model>` for a loader of models of width `dimension`."""
    if spec == "hashing":
        return hashing_embedder()
    if m := re.fullmatch(r"hashing-(\d+)(-bigrams)?", spec):
        return hashing_embedder(int(m[1]), bool(m[2]))
    if loader is None:
        raise ValueError(f"unknown embedder: {spec}")
    return model_embedder(loader(spec), dimension=dimension)
