"""An index of vectors: a coarse quantiser deals them into lists, product-quantised codes pick what is compared exactly."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage
from .retrieval import cosines, ranked

#: Vectors that the quantisers are fitted on at most, rows of a list's part, codes of a subspace.
SAMPLE, PART, CODES = 20_000, 4096, 256
#: Of each list part, so many times k rows with the best codes are compared exactly.
REFINE = 20
#: Queries that meet a list's part at once, about; of these, or of rows that are given lists, so many at a time.
QUERY_BLOCK, STRIPE = 4096, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres of at most k groups; an empty group takes the vector that is furthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        far = np.argsort(-((x - centres[at]) ** 2).sum(axis=1))
        for j, e in enumerate(np.flatnonzero(n == 0)):
            sums[e], n[e] = x[far[j]], 1
        centres = sums / n[:, None]
    return centres


@dataclass
class Quantisers:
    """Centres of the lists, and of each subspace's codes for what is left of a vector without its list's centre."""

    lists: np.ndarray
    codes: np.ndarray

    @property
    def parts(self) -> int:
        return self.codes.shape[0]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the codes of unit vectors."""
        at = _nearest(x, self.lists)
        rest = (x - self.lists[at]).reshape(len(x), self.parts, -1)
        return at, np.stack([_nearest(rest[:, j], self.codes[j]) for j in range(self.parts)], axis=1).astype(np.uint8)

    def order(self, q: np.ndarray) -> np.ndarray:
        """For each query, the lists from the nearest on."""
        return np.argsort((self.lists**2).sum(axis=1)[None, :] - 2 * q @ self.lists.T, axis=1, kind="stable")

    def estimates(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Estimated products of queries and a list's vectors, from tables of products with the codes' centres."""
        tables = np.einsum("qpd,pcd->qpc", q.reshape(len(q), self.parts, -1), self.codes)
        return q @ self.lists[at][:, None] + sum(tables[:, j][:, codes[:, j]] for j in range(self.parts))


def fit_quantisers(x: np.ndarray, lists: int, parts: int) -> Quantisers:
    x = _unit(x)
    centres = k_means(x, lists)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, -1)
    return Quantisers(centres, np.stack([k_means(rest[:, j], min(CODES, len(x)), seed=j) for j in range(parts)]))


@dataclass
class VectorIndex:
    """rows: list, id, codes, vector; lists: list, n, parts. Both kept as tables; ``rows`` has a directory a list."""

    rows: DataFrame
    lists: DataFrame
    quantisers: Quantisers
    probes: int

    def write(self, path: str) -> None:
        """Keeps the index: a search of few lists reads only their directories."""
        self.rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/rows")
        self.lists.write.parquet(f"{path}/lists")
        held = json.dumps({"lists": self.quantisers.lists.tolist(), "codes": self.quantisers.codes.tolist(), "probes": self.probes})
        self.rows.sparkSession.createDataFrame([(held,)], "value string").coalesce(1).write.text(f"{path}/quantisers")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        held = json.loads(spark.read.text(f"{path}/quantisers", wholetext=True).first()[0])
        rows = spark.read.parquet(f"{path}/rows").select(F.col("list").cast("int").alias("list"), "id", "codes", "vector")
        return cls(rows, spark.read.parquet(f"{path}/lists"), Quantisers(np.array(held["lists"]), np.array(held["codes"])), held["probes"])


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is there, not empty, and finite."""
    return vectors.where(F.expr(f"size({vec_col}) > 0 and forall({vec_col}, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"))


def enough_probes(x: np.ndarray, q: Quantisers, k: int, recall: float) -> int:
    """Lists that sampled queries need for a share ``recall`` of their k nearest, which are found among the sample."""
    x = _unit(x)
    asked = x[:: max(1, len(x) // 256)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(q.order(asked), axis=1)
    needed = np.sort(np.take_along_axis(place, _nearest(x, q.lists)[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


def build_index(vectors: DataFrame, *, id_col: str, vec_col: str, lists: int | None = None, parts: int | None = None, sample: int = SAMPLE, k: int = 10, recall: float = 0.97) -> VectorIndex:
    """Fits the quantisers on at most about ``sample`` vectors, drawn by a hash of their ids, and indexes every row.

    Vectors that are null, empty or not finite are left out; all others must have one length. ``lists`` is the root of the
    rows' number unless given, ``parts`` splits a vector into pieces of four numbers if that goes. How many lists a search
    reads for a share ``recall`` of the k nearest is measured on the sample.
    """
    rows = usable(vectors, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vector"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if shape["n"] and shape["low"] != shape["high"]:
        raise ValueError("vectors of different lengths")
    n, dim = shape["n"], shape["high"] or 1
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = np.array([r[0] for r in rows.where(draw < min(1.0, sample / max(1, n))).select("vector").limit(2 * sample).collect()], dtype=np.float64).reshape(-1, dim)
    if not len(drawn):
        drawn = np.ones((1, dim))
    parts = parts or (dim // 4 if dim % 4 == 0 else 1)
    q = fit_quantisers(drawn, lists or max(1, int(np.sqrt(n))), parts)
    held = rows.sparkSession.sparkContext.broadcast(q)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (batch.iloc[low : low + STRIPE] for batch in batches for low in range(0, len(batch), STRIPE)):
            at, codes = held.value.assign(_unit(np.array(pdf["vector"].tolist(), dtype=np.float64)))
            yield pd.DataFrame({"list": at, "id": pdf["id"], "codes": [c.tobytes() for c in codes], "vector": pdf["vector"]})

    made = stage(rows.mapInPandas(assign, "list int, id long, codes binary, vector array<float>"), "indexed")
    sizes = stage(made.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "lists")
    return VectorIndex(made, sizes, q, enough_probes(drawn, q, k, recall))


def choices(index: VectorIndex, queries: DataFrame, *, vec_col: str, probes: int | None = None) -> DataFrame:
    """(query_id, vector, lists): one row a query, with the lists that it reads, the nearest first; null and odd queries have
    no row."""
    held, most = queries.sparkSession.sparkContext.broadcast(index.quantisers), probes or index.probes

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (batch.iloc[low : low + STRIPE] for batch in batches for low in range(0, len(batch), STRIPE)):
            order = held.value.order(_unit(np.array(pdf["vector"].tolist(), dtype=np.float64)))[:, :most]
            yield pdf.assign(lists=list(order.astype(np.int32)))

    asked = usable(queries, vec_col).select(F.col("query_id").cast("long").alias("query_id"), F.col(vec_col).cast("array<float>").alias("vector"))
    return asked.where(F.size("vector") == index.quantisers.lists.shape[1]).mapInPandas(choose, "query_id long, vector array<float>, lists array<int>")


def probed(index: VectorIndex, queries: DataFrame, *, vec_col: str, probes: int | None = None) -> DataFrame:
    """(query_id, list) of the lists that each query reads, the nearest first; null and odd queries read none."""
    return choices(index, queries, vec_col=vec_col, probes=probes).select("query_id", F.explode("lists").alias("list"))


def share_read(index: VectorIndex, queries: DataFrame, *, vec_col: str, probes: int | None = None) -> DataFrame:
    """(query_id, share) of all rows that are in the lists which each query reads."""
    n = index.lists.agg(F.sum("n").alias("all"))
    read = probed(index, queries, vec_col=vec_col, probes=probes).join(index.lists, "list").groupBy("query_id").agg(F.sum("n").alias("n"))
    return read.crossJoin(F.broadcast(n)).select("query_id", (F.col("n") / F.col("all")).alias("share"))  # one row


def blocks(index: VectorIndex, chosen: DataFrame) -> DataFrame:
    """What is compared with each other has one (list, part, block): the queries (ask) of ``choices`` and the rows of their
    lists. A list's rows are dealt over its parts, its queries over blocks, so that both are bounded; each block meets each part."""
    read = chosen.select("query_id", "vector", F.explode("lists").alias("list"))
    dealt = read.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks")).join(index.lists.select("list", "parts"), "list")
    dealt = stage(dealt, "dealt")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = read.join(dealt, "list").select(F.lit(True).alias("ask"), "list", each("parts").alias("part"), deal("query_id", "blocks").alias("block"), F.col("query_id").alias("id"), F.lit(None).cast("binary").alias("codes"), "vector")
    every = index.rows.join(dealt, "list").select(F.lit(False).alias("ask"), "list", deal("id", "parts").alias("part"), each("blocks").alias("block"), "id", "codes", "vector")
    return asked.union(every)


def search(index: VectorIndex, queries: DataFrame, k: int, *, vec_col: str, probes: int | None = None, refine: int = REFINE) -> DataFrame:
    """(query_id, id, score, rank) of the k vectors with the greatest cosine for each query (query_id and the vector).

    A query reads its ``probes`` nearest lists (unless given, as many as the index found to be enough). A list's rows are
    dealt over parts of bounded size, its queries over blocks; where these meet, codes estimate all products, the ``refine`` times k best are compared in
    double precision, and k come back. With as many probes as lists everything is compared exactly, and the result is that
    of a plain search. Ties go by id.
    """
    whole = (probes or index.probes) >= len(index.quantisers.lists)
    held = queries.sparkSession.sparkContext.broadcast(index.quantisers)
    met = blocks(index, stage(choices(index, queries, vec_col=vec_col, probes=probes), "choices"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["ask"]], pdf[~pdf["ask"]].sort_values("id")
        out = [pd.DataFrame({"query_id": [], "id": [], "score": []})]
        ids, codes = r["id"].to_numpy(), np.frombuffer(b"".join(r["codes"]), dtype=np.uint8).reshape(len(r), -1)
        x = r["vector"].tolist()
        for low in range(0, len(q) if len(r) else 0, STRIPE):
            part = q.iloc[low : low + STRIPE]
            vectors = part["vector"].tolist()
            if whole or len(r) <= refine * k:
                scores, at = np.round(cosines(vectors, x), 9), np.arange(len(r))[None, :].repeat(len(part), axis=0)
            else:
                guess = held.value.estimates(_unit(np.array(vectors, dtype=np.float64)), int(r["list"].iloc[0]), codes)
                at = np.sort(np.argpartition(-guess, refine * k - 1, axis=1)[:, : refine * k], axis=1)
                scores = np.stack([np.round(cosines([v], [x[j] for j in row])[0], 9) for v, row in zip(vectors, at)])
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(part["id"].to_numpy(), top.shape[1]), "id": ids[np.take_along_axis(at, top, axis=1).ravel()], "score": np.take_along_axis(scores, top, axis=1).ravel()}))
        return pd.concat(out)

    found = met.groupBy("list", "part", "block").applyInPandas(best, "query_id long, id long, score double")
    return ranked(found, k)
