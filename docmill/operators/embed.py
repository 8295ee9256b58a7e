"""Embedding providers, by name, as an Arrow function over a text column."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: name -> a function of settings to a function of texts to vectors; the first is called once a task.
PROVIDERS: dict[str, Callable[[dict], Callable[[list[str]], list[list[float]]]]] = {}


def provider(name: str):
    def add(f):
        PROVIDERS[name] = f
        return f

    return add


@provider("hashing")
def _hashing(settings: dict):
    """Signed word hashes, normalised: for tests and lexical likeness, no semantic quality is claimed."""
    dim = settings.get("dimensions", 256)

    def embed(texts):
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()

    return embed


@provider("openai")
def _openai(settings: dict):
    from openai import OpenAI

    client = OpenAI(api_key=settings["api_key"])
    return lambda texts: [d.embedding for d in client.embeddings.create(input=texts, model=settings["model"], dimensions=settings["dimensions"]).data]


@provider("azure")
def _azure(settings: dict):
    from openai import AzureOpenAI

    client = AzureOpenAI(api_key=settings["api_key"], azure_endpoint=settings["endpoint"], api_version=settings["api_version"])
    return lambda texts: [d.embedding for d in client.embeddings.create(input=texts, model=settings["deployment"]).data]


@provider("sentence-transformers")
def _sentence_transformers(settings: dict):
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(settings["model"])
    return lambda texts: model.encode(texts, normalize_embeddings=True).tolist()


def embedder(name: str, settings: dict | None = None, batch: int = 32):
    """A column function of texts to vectors; an unknown provider is a ValueError."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    options, make = settings or {}, PROVIDERS[name]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make(options)
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for a in range(0, len(texts), batch) for v in run(texts[a : a + batch])], dtype=object)

    return embed


def embed_chunks(chunks: DataFrame, name: str = "hashing", settings: dict | None = None, batch: int = 32, content: str | Column = "content") -> DataFrame:
    """``chunks`` with ``embedding`` of their content alone."""
    return chunks.withColumn("embedding", embedder(name, settings, batch)(content))


def join_vectors(chunks: DataFrame, vectors: DataFrame, on: str = "chunk_id") -> DataFrame:
    """``chunks`` with vectors that were made before, by id; those without one are left out."""
    return chunks.join(vectors.select(on, "embedding"), on)
