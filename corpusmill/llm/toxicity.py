"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Bound of the fit: labelled documents that are drawn by hash, whatever the size of the tables.
LABELLED_SAMPLE = 6_000
#: A word or stem votes if chance explains its toxic share with less than this probability (over all that are looked at).
CHANCE = 0.02
#: Lengths of the stems: a stem stands for all longer words that begin with it.
STEMS = (3, 4, 5, 6, 7)
#: Places that all words of a text share in the classifier, beside the voters: every word counts, in its place.
PLACES = 512

WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def hash_word(w: str) -> int:
    import zlib

    return zlib.crc32(w.encode("utf-8", "surrogatepass"), 0x51ED) * 2654435761 % (1 << 32)


@lru_cache(maxsize=1 << 17)
def place_of(w: str) -> int:
    return hash_word(w) >> 16 & (PLACES - 1)


def terms_of(words: set[str]) -> set[str]:
    """The words and, marked by a star, their stems."""
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    """Words and stems, each with its number."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.words = {t: k for k, t in enumerate(terms) if not t.endswith("*")}
        self.stems = {t[:-1]: k for k, t in enumerate(terms) if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.seen: set[str] = set()
        self.hits: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.terms)

    def match(self, words: set[str]) -> dict[str, int]:
        """The words that the lexicon knows, as they are or by a stem, with its number. Looked-up words are remembered."""
        new = words - self.seen
        if len(self.seen) > 1 << 18:
            self.seen, self.hits, new = set(), {}, words
        self.seen |= new
        for w in new:
            if (k := self.words.get(w)) is None:
                k = next((self.stems[w[:n]] for n in self.lengths if len(w) > n and w[:n] in self.stems), None)
            if k is not None:
                self.hits[w] = k
        return {w: self.hits[w] for w in words & self.hits.keys()}


@dataclass
class Sample:
    """Incidence of terms in documents, and the family of each document."""

    terms: list[str]
    term: np.ndarray
    doc: np.ndarray
    family: np.ndarray
    looked_at: int

    @classmethod
    def of(cls, seen: list[set[str]], toxic: np.ndarray, least: int = 3) -> Sample:
        """Terms of at least ``least`` toxic documents; rarer ones can't be evidence."""
        every = {w for s in seen for w in s}
        often = Counter(t for s, y in zip(seen, toxic) if y for t in terms_of(s))
        terms = sorted(t for t, n in often.items() if n >= least)
        number = {t: k for k, t in enumerate(terms)}
        has = {w: h for w in every if (h := [number[t] for t in terms_of({w}) if t in number])}
        held = [np.array(list({i for w in s if w in has for i in has[w]}), dtype=np.int32) for s in seen]
        # A min-hash of the word set: close copies mostly share it, so that a copied text counts once as evidence.
        hashes = {w: hash_word(w) for w in every}
        least_hash = [min((hashes[w] for w in s), default=0) for s in seen]
        _, family = np.unique(np.array(least_hash, dtype=np.int64), return_inverse=True)
        return cls(terms, np.concatenate(held) if held else np.zeros(0, dtype=np.int32), np.repeat(np.arange(len(held)), [len(h) for h in held]), family, len(often))

    def mine(self, p: np.ndarray, chance: float = CHANCE, least: int = 3) -> list[str]:
        """Terms whose families of documents are toxic far more often than chance allows. p: how toxic each document is.

        Of terms of which one is the other's beginning, the surer one stays; of two as sure, the longer one.
        """
        m, families = len(self.terms), int(self.family.max()) + 1 if len(self.family) else 1
        if not m:
            return []
        pair, at, count = np.unique(self.term.astype(np.int64) * families + self.family[self.doc], return_inverse=True, return_counts=True)
        mean = np.bincount(at, p[self.doc]) / count
        n, k = (np.bincount(pair // families, w, minlength=m) for w in (None, mean))
        rows = np.bincount(self.term, minlength=m)
        base = np.bincount(self.family, p) / np.maximum(np.bincount(self.family), 1)
        base = min(0.5, max(1e-3, float(base.mean())))
        q = np.minimum(k / np.maximum(n, 1), 1 - 1e-9)
        surprise = -n * (q * np.log(np.maximum(q, 1e-12) / base) + (1 - q) * np.log((1 - q) / (1 - base)))  # Chernoff's bound
        good = (n >= least) & (np.bincount(self.term, p[self.doc], minlength=m) > 0.5 * rows) & (k >= least * 0.8) & (q > max(0.6, 2 * base)) & (surprise < log(chance / max(1, self.looked_at)))
        sure = k / (n + 2)
        kept: list[str] = []
        beginnings: set[str] = set()
        for i in sorted(np.flatnonzero(good), key=lambda i: (-sure[i], -len(self.terms[i]), self.terms[i])):
            bare = self.terms[i].removesuffix("*")
            if bare not in beginnings and not any(f"{bare[:j]}*" in kept for j in STEMS if j <= len(bare)):
                kept.append(self.terms[i])
                beginnings.update(bare[:j] for j in range(1, len(bare) + 1))
        return sorted(kept)


def votes(text: str, found: list[str], lexicon: Lexicon, matched: dict[str, int] | None = None) -> np.ndarray:
    """One voter a lexicon term, and pattern voters: several distinct words, repeats, density, shouting, exclamation."""
    k = len(lexicon)
    out = np.zeros(k + 5, dtype=bool)
    matched = lexicon.match(set(found)) if matched is None else matched
    if matched:
        hits = sum(w in matched for w in found)
        out[list(matched.values())] = True
        out[k] = len(matched) >= 2
        out[k + 1] = hits > len(matched)
        out[k + 2] = hits * 200 >= len(found)
        out[k + 3] = any(w.upper() in text for w in matched)
        out[k + 4] = any(f"{w}!" in text for w in matched)
    return out


@dataclass
class LabelModel:
    """Two latent classes; each voter fires with its own probability in each; correlated voters share one voter's weight."""

    prior: float = 0.1
    fires: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1] / self.fires[0]) * self.weight
        off = np.log((1 - self.fires[1]) / (1 - self.fires[0])) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + v @ (on - off) + off.sum()
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @classmethod
    def fit(cls, v: np.ndarray, rounds: int = 40) -> LabelModel:
        """Expectation maximisation without labels; correlations given the class are estimated between two passes."""
        v = v.astype(float)
        m, weight = v.shape[1], np.ones(v.shape[1])
        model = cls(0.1, np.full((2, m), 0.5), weight)
        p = np.where(v.any(axis=1), 0.9, 0.01)
        for k in range(2 * rounds):
            a = (p @ v + 0.5) / (p.sum() + 2)
            b = ((1 - p) @ v + 0.01) / ((1 - p).sum() + 2)
            b = np.minimum(np.clip(b, 1e-5, 0.5), a / 5)  # a voter is better than chance
            model = cls(float(np.clip(p.mean(), 1e-3, 0.5)), np.stack([b, np.clip(a, 1e-4, 1 - 1e-4)]), weight)
            if k == rounds:
                weight = cls._shares(v, p, model.fires)
            p = model.posterior(v)
        return cls(model.prior, model.fires, weight)

    @staticmethod
    def _shares(v: np.ndarray, p: np.ndarray, fires: np.ndarray) -> np.ndarray:
        """One over the sum of a voter's positive correlations with all voters within the toxic class."""
        c = (v - fires[1]) * np.sqrt(p)[:, None]
        cov = c.T @ c / max(p.sum(), 1)
        d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        r = np.clip(cov / d[:, None] / d, 0, 1)
        np.fill_diagonal(r, 1)
        return 1 / (r * (r > 0.2)).sum(axis=1)


@dataclass
class Model:
    """A linear classifier over the voters and the places of all words."""

    terms: list[str] = field(default_factory=list)
    bias: float = -4.0
    voters: np.ndarray = field(default_factory=lambda: np.zeros(5))
    places: np.ndarray = field(default_factory=lambda: np.zeros(PLACES))

    def scores(self, texts: list[str], lexicon: Lexicon | None = None) -> np.ndarray:
        lexicon, z = lexicon or Lexicon(self.terms), np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            found = words_of(text)
            seen = set(found)
            matched = lexicon.match(seen)
            z[k] += self.places[list({place_of(w) for w in seen if w not in matched})].sum()
            if matched:
                z[k] += votes(text, found, lexicon, matched) @ self.voters
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, p: np.ndarray, w: np.ndarray, penalty: float, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method for a linear classifier on soft labels p with row weights w."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (q - p)) + ridge * beta
        h = (x * (w * q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit_rows(rows: list[tuple[str, float]]) -> Model:
    """rows: text and label. The labels show which terms may vote; what the classifier learns are posteriors of the votes.

    Without a toxic row, or a term that votes, nothing is learned and all scores are low.
    """
    y = np.array([label for _, label in rows], dtype=float)
    names: dict[str, str] = {}
    found = [[names.setdefault(w, w) for w in words_of(t)] for t, _ in rows]
    seen = [set(f) for f in found]
    sample = Sample.of(seen, y > 0)
    lexicon = Lexicon(sample.mine(y))
    if not len(lexicon):
        return Model()

    def posteriors() -> tuple[np.ndarray, np.ndarray]:
        v = np.stack([votes(t, f, lexicon) for (t, _), f in zip(rows, found)])
        return v, LabelModel.fit(v).posterior(v.astype(float))

    for _ in range(2):  # posteriors show terms that single labels hide
        v, p = posteriors()
        more = sample.mine(np.maximum(p, y), least=4)
        if set(more) <= set(lexicon.terms):
            break
        lexicon = Lexicon(sorted(set(lexicon.terms) | set(more)))
    v, p = posteriors()
    x = np.zeros((len(rows), v.shape[1] + PLACES), dtype=np.float32)
    x[:, : v.shape[1]] = v
    for k, s in enumerate(seen):
        x[k, [v.shape[1] + place_of(w) for w in s - lexicon.match(s).keys()]] = 1
    penalty = np.full(x.shape[1], 0.02)
    penalty[v.shape[1] :] = 20.0  # other words may correct, not decide
    w = 1 / np.bincount(sample.family)[sample.family]
    beta, bias = _weighted(x, p, w, penalty)
    return Model(lexicon.terms, bias, beta[: v.shape[1]], beta[v.shape[1] :])


def _weighted(x: np.ndarray, p: np.ndarray, w: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, float]:
    scale = 1 / np.sqrt(penalty)  # a penalty for each column is a scale for each column
    beta, bias = logistic((x * scale).astype(np.float32), p, w, 1.0)
    return beta * scale, bias


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED_SAMPLE) -> Model:
    """Fits on about ``labelled`` of the trainable labelled rows, drawn by a hash of their id, with their whole texts.

    The drawn labels, the one side of a join that is broadcast, are bounded by that parameter. Of several labels of one
    id, the greatest counts; null labels don't. Other columns of both tables, of whatever name, are ignored.
    """
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity")), F.lit(1 << 40)) / float(1 << 40)
    marked = labels.where(trainable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    few = marked.where(draw < min(1.0, labelled / max(1, marked.count())))
    rows = docs.where(trainable).select(F.col(id_col).alias("_d"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    picked = rows.join(F.broadcast(few), F.col("_d") == F.col("_id")).select("_t", "_y")
    return fit_rows(sorted((r[0], r[1]) for r in picked.collect()))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Score of every whole text. Rows: doc_id, score, predicted.

    Defined cases: null and empty texts get the classifier's score of no words; texts of any length are read to their
    end; rows that repeat an id or a text, and rows with a null id, give a row each, equal texts the same score; an empty
    table gives an empty result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(held.value.terms)
        for pdf in batches:
            s = held.value.scores(pdf["_text"].tolist(), lexicon)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInPandas(run, "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
