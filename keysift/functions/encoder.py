"""Text encoders: how a model is given, a deterministic one for use where no trained model is at hand, and encoding on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keysift.ship import ship

Encode = Callable[[Sequence[str]], np.ndarray]
BATCH = 64


class TextEncoder(Protocol):
    """A model that workers load for themselves.

    It is sent to them as it is, so it holds what a model is loaded from (a name, a path, settings), not the model; two
    equal ones are the same model.  A trained model of images and texts fits in by its own class.
    """

    dimensions: int

    def load(self) -> Encode:
        """The function that gives a row for each text."""
        ...


_loaded: dict[TextEncoder, Encode] = {}


def model(encoder: TextEncoder) -> Encode:
    """The encoder's function, loaded once in each process."""
    if encoder not in _loaded:
        _loaded.clear()  # one model at a time
        _loaded[encoder] = encoder.load()
    return _loaded[encoder]


def encode_texts(encoder: TextEncoder, texts: Sequence[str], batch: int = BATCH) -> np.ndarray:
    """A vector of length 1 for each text, ``batch`` texts at a time; null is an empty text."""
    out = np.zeros((len(texts), encoder.dimensions), np.float64)
    for i in range(0, len(texts), batch):
        part = np.asarray(model(encoder)([t or "" for t in texts[i : i + batch]]), np.float64)
        if part.shape != (len(texts[i : i + batch]), encoder.dimensions):
            raise ValueError(f"the encoder gave an array of shape {part.shape}; {(len(texts[i : i + batch]), encoder.dimensions)} is needed")
        if not np.isfinite(part).all():
            raise ValueError("the encoder gave values that aren't finite")
        out[i : i + batch] = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return out


def encoded(df: DataFrame, column: str, encoder: TextEncoder, *, out: str = "vector", batch: int = BATCH) -> DataFrame:
    """``df`` with the vectors of a column's texts, encoded where the rows are."""
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = encode_texts(encoder, b.column(b.schema.get_field_index(column)).to_pylist(), batch)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(vectors.reshape(-1)), encoder.dimensions).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], names=[*b.schema.names, out])

    ship(df.sparkSession)
    rows = df.select(*[f"`{c}`" for c in names])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class HashingEncoder:
    """Hashes a text's words and their ``grams``-letter pieces into a vector of length 1.

    Texts that share words or pieces are near each other, whatever the letters' case; it knows no meaning.  A text
    without words has a vector of its own, so that none has length 0.
    """

    dimensions: int = 512
    grams: int = 3

    def load(self) -> Encode:
        return hashing_encoder(self.dimensions, self.grams)


def hashing_encoder(dimensions: int = 512, grams: int = 3) -> Encode:
    """The function of :class:`HashingEncoder`."""

    def one(text: str) -> np.ndarray:
        out = np.zeros(dimensions)
        words = text.casefold().split()
        pieces = [w for w in words] + [f" {w} "[i : i + grams] for w in words for i in range(max(1, len(w) + 3 - grams))]
        for piece in pieces or [""]:
            h = crc32(piece.encode("utf-8", "surrogatepass"))
            out[(h >> 1) % dimensions] += 1 - 2 * (h & 1)
        norm = np.linalg.norm(out)
        if not norm:
            out[0] = norm = 1.0
        return out / norm

    return lambda texts: np.asarray([one(t or "") for t in texts]).reshape(-1, dimensions)
