"""Embedding of chunks by a provider that the caller hands in, and what it would cost."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gives a vector a text in their order, or (index, vector) pairs in any order.
Provider = Callable[[list[str]], list]

# USD per million tokens, default dimension and batch.
PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13}
DIMENSION, BATCH = 1536, 100
CONFIRM_OVER = 0.10
YES = ("y", "yes", "s", "si", "sí")


class Retryable(RuntimeError):
    """What a provider raises for a rate limit or a broken connection."""


def hash_provider(dimension: int = DIMENSION) -> Provider:
    """A deterministic stand-in without a network: unit vectors of hashed character trigrams (CRC-32 of their UTF-8)."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            n = np.bincount(trigram_crcs(t) % dimension, minlength=dimension).astype(np.float64)
            out.append((n / (float((n * n).sum()) ** 0.5 or 1.0)).tolist())
        return out

    return embed


#: Of each byte, the CRC-32 step that it makes.
_STEPS = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], dtype=np.uint32)


def trigram_crcs(text: str) -> np.ndarray:
    """CRC-32 of the UTF-8 of each three characters in a row; a shorter text is one."""
    b = np.frombuffer(text.encode(), dtype=np.uint8)
    if len(text) <= 3:
        return np.array([zlib.crc32(b)], dtype=np.uint32)
    begins = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
    begin, size = begins[:-3], begins[3:] - begins[:-3]
    state = np.full(len(begin), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(3):
        state = _STEPS[(state & 0xFF) ^ b[begin + k]] ^ (state >> 8)
    at, k = np.flatnonzero(size > 3), 3
    while len(at):  # characters of several bytes
        s = state[at]
        state[at] = _STEPS[(s & 0xFF) ^ b[begin[at] + k]] ^ (s >> 8)
        k += 1
        at = at[size[at] > k]
    return ~state


def with_retry(provider: Provider, texts: list[str], attempts: int = 5, least: float = 2, most: float = 30, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    for k in range(attempts):
        try:
            return provider(texts)
        except Retryable:
            if k + 1 == attempts:
                raise
            sleep(min(most, least * 2**k))
    return []


def by_index(items: list) -> list[list[float]]:
    """Vectors in the order of their texts, where a provider says which text each belongs to."""
    if items and all(isinstance(x, tuple) and len(x) == 2 and hasattr(x[1], "__len__") for x in items):  # a vector may be a tuple too
        return [v for _, v in sorted(items, key=lambda x: x[0])]
    return items


def embed_texts(rows: DataFrame, provider: Provider, *, text: str = "content", dimension: int = DIMENSION, batch: int = BATCH) -> DataFrame:
    """Adds ``embedding``. Texts go to the provider in batches of a partition's rows; a wrong number or size ends the run.
    A worker holds one batch's texts and vectors as Python objects; all others are Arrow's."""

    @F.arrow_udf("array<float>")
    def embed(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in it:
            out = np.empty((len(s), dimension), dtype=np.float32)
            for k in range(0, len(s), batch):
                texts = s.slice(k, batch).to_pylist()
                got = by_index(with_retry(provider, texts))
                if len(got) != len(texts) or any(len(v) != dimension for v in got):
                    raise ValueError("the provider broke its contract: one vector of the given size a text")
                out[k : k + len(got)] = got
            yield pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * dimension, out.ravel())

    return rows.withColumn("embedding", embed(text))


def batch_plan(rows: DataFrame, batch: int = BATCH, *, order: str) -> DataFrame:
    """Sizes of the batches of a list in order: all full but the last. Only the count matters, so no row is sorted."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return n.select(F.posexplode(F.expr(f"transform(sequence(0, cast(ceil(n / {batch}) as int) - 1), b -> least({batch}, n - b * {batch}))")).alias("batch", "texts"))


def estimate_cost(total_tokens, model: str):
    """USD of so many tokens (a column or a number)."""
    if model not in PRICES:  # fixed value: the message of the contract
        raise ValueError(f"precio desconocido para el modelo {model}")
    return total_tokens / 1_000_000 * PRICES[model]


def cost_confirmed(cost: float, ask: Callable[[str], str] | None = None) -> bool:
    """Cheap runs pass silently; others need a yes; without anyone to ask they are refused."""
    return cost <= CONFIRM_OVER or (ask is not None and ask(f"cost {cost:.4f} USD, go on?").strip().lower() in YES)


def contract_breaches(chunks: DataFrame, vectors: DataFrame, dimension: int, key: list[str]) -> DataFrame:
    """Keys without a vector, and vectors without a key or of another size."""
    lacking = chunks.join(vectors, key, "left_anti").select(*key, F.lit("no vector").alias("breach"))
    extra = vectors.join(chunks, key, "left_anti").select(*key, F.lit("no chunk").alias("breach"))
    wrong = vectors.where(F.size("embedding") != dimension).select(*key, F.lit("dimension").alias("breach"))
    return lacking.union(extra).union(wrong)
