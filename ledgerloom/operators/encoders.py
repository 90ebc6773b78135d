"""Text encoders behind one interface: loaded once per worker, fed with batches of cleaned texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 32


class Model(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class TextEncoder(Protocol):
    """A plug-in: picklable, cheap to ship; load() is called once in every worker that needs the model."""

    name: str
    dimension: int

    def load(self) -> Model: ...


class HashedWords:
    """The encoder that needs no model files: counts of words by the lower 64 bits of their MD5 digest."""

    def __init__(self, dimension: int = 384):
        self.name, self.dimension = f"hashed-words-{dimension}", dimension

    def load(self) -> HashedWords:
        self.places: dict[str, int] = {}
        return self

    def place(self, word: str) -> int:
        if word not in self.places:
            if len(self.places) > 1_000_000:
                self.places.clear()
            self.places[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[8:], "little") % self.dimension
        return self.places[word]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            np.add.at(row, [self.place(w) for w in text.split(" ")], 1)
        return out


_LOADED: dict[str, Model] = {}


def _model(encoder: TextEncoder) -> Model:
    if encoder.name not in _LOADED:
        _LOADED.clear()
        _LOADED[encoder.name] = encoder.load()
    return _LOADED[encoder.name]


def cleaned(text: Column) -> Column:
    """Lower case, white space to single blanks, none at the ends; blank for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D\x20]+", " ")), F.lit(""))


def with_vectors(df: DataFrame, encoder: TextEncoder, text: str = "text", out: str = "vector", batch: int = BATCH, normalize: bool = True) -> DataFrame:
    """df with a vector of each text; blank texts get zeros and never reach the model.

    Texts go to the model in batches of one Arrow batch's distinct texts, long
    ones with long ones. A batch on which the model fails gets zeros.
    """
    dimension = encoder.dimension

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in batches:
            found = np.zeros((len(texts), dimension))
            codes, distinct = pd.factorize(texts)
            kept = sorted((k for k, t in enumerate(distinct) if t), key=lambda k: len(distinct[k]))
            vectors = np.zeros((len(distinct), dimension))
            for lo in range(0, len(kept), batch):
                at = kept[lo : lo + batch]
                model = model or _model(encoder)
                try:
                    vectors[at] = np.asarray(model.encode([distinct[k] for k in at]), float).reshape(len(at), dimension)
                except Exception:  # noqa: BLE001  whatever a model raises
                    continue
            if normalize:
                size = np.sqrt(np.square(vectors).sum(axis=1, keepdims=True))
                vectors = vectors / np.where(size > 0, size, 1)
            if len(distinct):
                found = vectors[codes]
            yield pd.Series(list(found))

    return df.withColumn(out, encode(cleaned(F.col(text))))
