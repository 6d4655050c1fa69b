"""Language identification by a string kernel: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Lengths of the n-grams, and bits of the table that holds the presence of each length's n-grams.
ORDERS, BITS = (2, 3, 4), 14
WIDTH = len(ORDERS) << BITS
#: Bounds of the fit: sampled documents and landmarks of each language, whatever the size of the table.
SAMPLE_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 200, 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def presence(text: str, row: np.ndarray) -> bool:
    """Marks in ``row`` (bytes, WIDTH of them) which n-grams the whole text holds; False if it has no letter.

    Letters in lower case count, all else is one blank between words. Each n-gram's hash is its place in the table of its
    length.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[c]
    if not letter.any():
        return False
    keep = letter | np.concatenate([[False], letter[:-1]])
    c = np.concatenate([[32], np.where(letter, c, 32)[keep], [32]]).astype(np.uint32)
    h = c
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
        if n in ORDERS:
            row[(ORDERS.index(n) << BITS) + ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)] = 1
    return True


def normed(seen: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the blended kernel: the mean over lengths of |A and B| / sqrt(|A| |B|)."""
    x = seen.astype(np.float32)
    for k in range(len(ORDERS)):
        part = x[:, k << BITS : (k + 1) << BITS]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(ORDERS))
    return x


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # WIDTH x languages: landmarks, whitening and ridge coefficients, multiplied out
    bias: np.ndarray

    def predict(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = normed(seen) @ self.weights + self.bias
        p = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best].astype(float)


def fit_rows(rows: list[tuple[str, str]], ridge: float = 1e-2) -> Model:
    """One-versus-rest kernel ridge regression in the Nyström space of the first landmarks of each language."""
    seen, langs = [], []
    for lang, text in rows:
        row = np.zeros(WIDTH, dtype=np.uint8)
        if presence(text, row):
            seen.append(row)
            langs.append(lang)
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((WIDTH, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))
    seen, y = np.array(seen), np.array([names.index(x) for x in langs])
    marks = np.concatenate([np.flatnonzero(y == k)[:LANDMARKS_PER_LANGUAGE] for k in range(len(names))])
    u = normed(seen[marks])
    values, vectors = np.linalg.eigh((u @ u.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([normed(seen[i : i + 64]) @ u.T for i in range(0, len(seen), 64)]).astype(np.float64) @ whiten
    count = np.bincount(y, minlength=len(names))
    w = (len(y) / len(names) / count)[y][:, None]  # every language weighs alike
    target = 2.0 * (y[:, None] == np.arange(len(names))) - 1
    mean, base = (w * phi).sum(0) / w.sum(), (w * target).sum(0) / w.sum()
    centred = phi - mean
    beta = np.linalg.solve(centred.T @ (w * centred) + ridge * len(y) * np.eye(phi.shape[1]), centred.T @ (w * (target - base)))
    return Model(names, (u.T @ (whiten @ beta)).astype(np.float32), (base - mean @ beta).astype(np.float32))


def fit(docs: DataFrame, trainable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits on about ``per_language`` documents of each language, chosen by a hash of their id among the trainable rows."""
    rows = docs.where(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return fit_rows([])
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.where(draw < rate[F.col(lang_col).cast("string")]).select(draw.alias("d"), F.col(lang_col).cast("string"), F.col(text_col)).collect()
    return fit_rows([(r[1], r[2]) for r in sorted(picked, key=lambda r: (r[0], r[1], r[2]))])


def predict(texts: list[str | None], model: Model, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of whole texts; batches of presence vectors are multiplied with the model's weights."""
    names = np.array(model.languages, dtype=object)
    langs, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    seen = np.zeros((batch, WIDTH), dtype=np.uint8)
    for s in range(0, len(texts) if len(names) else 0, batch):
        part = texts[s : s + batch]
        seen[:] = 0
        ok = np.array([t is not None and presence(t, seen[k]) for k, t in enumerate(part)], dtype=bool)
        best, p = model.predict(seen[: len(part)])
        langs[s : s + len(part)][ok] = names[best][ok]
        scores[s : s + len(part)][ok] = p[ok]
    return langs, scores


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and score of every whole text. Rows: doc_id, lang_pred, score.

    Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0, and so is all if nothing could
    be learned; very long texts are read to their end; of languages that tie, the first by name is told; null and repeated ids give a row each; an empty table gives an empty result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            langs, scores = predict(rows.column(1).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified_only(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language the model can tell; decided row by row, without a shuffle."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            langs, _ = predict(rows.column(at).to_pylist(), held.value)
            yield rows.filter(pa.array(langs != "und", pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
