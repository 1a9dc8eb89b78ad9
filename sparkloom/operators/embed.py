"""Embedding text of symbols; the model is a parameter."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, BODY_CHARS, BATCH = 256, 1500, 32
Model = Callable[[list[str]], np.ndarray]
_PART = re.compile(r"[A-Za-z][a-z0-9]*|[0-9]+|\w")


def embed_text(signature: Column, body: Column) -> Column:
    return F.concat_ws("\n", signature, F.substring(body, 1, BODY_CHARS))


def hashing_model(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Word parts hashed (the first 32 bits of MD5, spread evenly in any engine) to
    signed components, scaled to length 1; needs no file."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        for part in _PART.findall(text):
            h = int.from_bytes(hashlib.md5(part.lower().encode(), usedforsecurity=False).digest()[:4], "big")
            row[h % dim] += 1 if h >> 31 else -1
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def candidates(nodes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Functions, methods and classes with a body and no stored vector."""
    rows = nodes.where(F.col("kind").isin("Function", "Method", "Class") & F.col("body").isNotNull())
    return rows.join(stored.select("id"), "id", "left_anti") if stored is not None else rows


def embed(rows: DataFrame, model: Model = hashing_model) -> DataFrame:
    """(id as text, embedding) of rows (id, signature, body); a batch that the
    model fails on gives null vectors, which a caller counts as skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                part = batch.iloc[i : i + BATCH]
                try:
                    vectors = [v.tolist() for v in model(list(part["text"]))]
                except Exception:  # counted by the caller
                    vectors = [None] * len(part)
                yield pd.DataFrame({"id": part["id"], "embedding": vectors})

    text = rows.select(F.col("id").cast("string").alias("id"), embed_text(F.col("signature"), F.col("body")).alias("text"))
    return text.mapInPandas(run, "id string, embedding array<float>")
