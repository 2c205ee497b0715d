"""Interfaces of outside services and deterministic stand-ins that need none."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMBED_BATCH = 32


class Embedder(Protocol):
    model_key: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def model_key(info: dict) -> str:
    """Identity of an embedding model: needs its id and revision; hashes all it says."""
    if not info.get("model_id") or not info.get("model_sha"):
        raise ValueError("the service does not name its model_id and model_sha")
    return hashlib.sha256(json.dumps(sorted(info.items()), separators=(",", ":"), default=str).encode()).hexdigest()


class LetterEmbedder:
    """Counts of letters: deterministic, and similar for similar texts."""

    model_key = "letters-26"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]


def batches(texts: Iterable[str], size: int = EMBED_BATCH) -> Iterator[list[str]]:
    part: list[str] = []
    for t in texts:
        part.append(t)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def embed_column(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector") -> DataFrame:
    """Add vectors in batches, one Arrow batch of rows at a time."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(frames):
        for pdf in frames:
            vectors = [v for b in batches(pdf[text].tolist()) for v in embedder.embed(b)]
            pdf[out] = vectors
            yield pdf

    return df.mapInPandas(run, schema)


def point_rows(df: DataFrame) -> DataFrame:
    """``id, vector, payload`` as a vector database takes them."""
    payload = F.struct(*[c for c in df.columns if c not in ("point_id", "vector")])
    return df.select(F.col("point_id").alias("id"), "vector", payload.alias("payload"))
