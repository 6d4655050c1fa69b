"""Near duplicates by Order MinHash: ordered minima of occurrence-labelled word shingles, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, mix64, read_table, stage

#: Words of a shingle, least similarity, minima of a sketch, sketches of a document.
SHINGLE, SIMILARITY, MINIMA, SKETCHES = 5, 0.8, 4, 24
#: Buckets of at most so many documents compare all their pairs; larger ones compare with a pivot, and what differs from
#: it in blocks of so many.
SMALL_BUCKET, BLOCK = 32, 256
#: Texts of so many shingles also get exact keys: similar ones differ by one shingle at most, up to 2 / (1 - SIMILARITY).
SHORT = range(4, 10)

_FEATURES = "doc_id long, sha string, n long, h1 long, h2 long, sketch array<long>"
_BASE = 0x9E3779B97F4A7C15 | 1


_held: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; a worker keeps the longest tables that it has needed."""
    if not _held or len(_held[0]) < n:
        size = 1 << max(14, n.bit_length())
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _held[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _held[0], _held[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (runs of other characters than ASCII white space), in lower case, in text order."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mix64((sums[end] - sums[start]) * down[start])


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of k words; a shorter text that has words is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    total = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        total = (total + words[j : len(words) - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(total)


def occurrence_labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes that differ for the first, second, ... occurrence of one shingle, so that a repeat is a member of its own."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return shingles
    at = np.arange(len(ranked))
    nth = np.empty(len(ranked), dtype=np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return mix64(shingles + nth * np.uint64(_BASE))


def order_sketches(shingles: np.ndarray, minima: int = MINIMA, sketches: int = SKETCHES, seed: int = 7) -> np.ndarray:
    """For each of several hash functions: the least occurrence-labelled shingles, combined in their order in the text."""
    s = occurrence_labelled(shingles)
    at = mix64(np.arange(1, 2 * sketches + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))[:, None]
    a, b = at[:sketches] | np.uint64(1), at[sketches:]
    least = min(minima, len(s))
    v = (s[None, :] ^ b) * a
    v ^= v >> np.uint64(31)
    places = np.argpartition(v, least - 1, axis=1)[:, :least] if len(s) > least else np.tile(np.arange(len(s)), (sketches, 1))
    picked = s[np.sort(places, axis=1)]
    out = np.zeros(sketches, dtype=np.uint64)
    for j in range(least):
        out = (out + picked[:, j]) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(out + np.arange(sketches, dtype=np.uint64) * np.uint64(_BASE))


def short_keys(shingles: np.ndarray) -> np.ndarray:
    """Hashes of a short text's shingles in order, and of what is left of them without each one in turn."""
    n = len(shingles)
    if n not in SHORT:
        return np.zeros(0, dtype=np.uint64)
    left = [shingles] + [np.delete(shingles, k) for k in range(n)]
    return np.unique(np.array([np.sum(mix64(x + np.arange(1, len(x) + 1, dtype=np.uint64) * np.uint64(_BASE)), dtype=np.uint64) for x in left]))


def sequence_hashes(words: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole sequence of words."""
    at = np.arange(1, len(words) + 1, dtype=np.uint64)
    return tuple(int(np.sum(mix64(words + at * np.uint64(c)), dtype=np.uint64).view(np.int64)) for c in (_BASE, 0xC2B2AE3D27D4EB4F))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", minima: int = MINIMA, sketches: int = SKETCHES) -> DataFrame:
    """Per document: the digest of its text, its number of shingles, two hashes of its whole sequence of words, and its
    sketches and short keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, sha, text in zip(pdf["doc_id"], pdf["sha"], pdf["_text"]):
                words = word_hashes(text)
                w = shingle_hashes(words)
                rows.append((doc, sha, len(w), *sequence_hashes(words), np.concatenate([order_sketches(w, minima, sketches), short_keys(w)]).view(np.int64) if len(w) else np.zeros(0, dtype=np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "sha", "n", "h1", "h2", "sketch"])

    rows = _texts(docs, id_col, text_col).select(F.col("_id").alias("doc_id"), F.sha2("_text", 256).alias("sha"), "_text")
    return rows.mapInPandas(run, _FEATURES)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether a banded alignment of two sequences matches c members with c / (len a + len b - c) >= similarity.

    Only cells within the largest offset that such an alignment can have are looked at. A row of the band is a bit vector
    of the steps of the longest common subsequence, kept as one integer, so that a row costs a few word operations.
    """
    la, lb = len(a), len(b)
    need = int(np.ceil(similarity * (la + lb) / (1 + similarity) - 1e-9))
    if min(la, lb) < need:
        return False
    pad = min(la, lb)
    same = a[:pad] == b[:pad]
    head = pad if same.all() else int(np.argmin(same))
    back = a[la - pad + head :][::-1] == b[lb - pad + head :][::-1]
    back = back[: pad - head]
    tail = len(back) if back.all() else int(np.argmin(back))
    a, b = a[head : la - tail], b[head : lb - tail]
    need -= head + tail
    if need <= 0:
        return True
    if min(len(a), len(b)) < need:
        return False
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[ia], cb[ib]).sum()) < need:
        return False
    where: dict[int, list[int]] = {}
    common = set(va[ia].tolist())
    for j, x in enumerate(b.tolist()):
        if x in common:
            where.setdefault(x, []).append(j)
    # An alignment that matches enough leaves at most len - need of either side, so no cell is further off than that.
    reach_up, reach_down = len(b) - need, len(a) - need
    width = reach_up + reach_down + 1
    full = (1 << width) - 1
    v, found = full, 0  # bit k of row i stands for column i - reach_down + k; a zero bit is a step of the subsequence
    for i, x in enumerate(a.tolist()):
        low = i - reach_down
        if i:
            found += 1 - (v & 1) if low > 0 else 0
            v = (v >> 1) | (1 << (width - 1))
        m = 0
        for j in where.get(x, ()):
            if 0 <= j - low < width:
                m |= 1 << (j - low)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    top = min(width, len(b) - (len(a) - 1 - reach_down))
    return found + top - (v & ((1 << top) - 1)).bit_count() >= need


def shingle_table(docs: DataFrame, nodes: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, _s): shingle hashes, four bytes each, of the nodes (node, first, n, h1, h2), read from rows with the id ``first``.

    Such rows may hold other texts as well: a row counts for the node whose hashes its words have.
    """
    wanted = nodes.select(F.col("first").alias("_id")).distinct()
    rows = _texts(docs, id_col, text_col).join(wanted.hint("merge"), "_id", "left_semi")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["_id"], pdf["_text"]):
                words = word_hashes(text)
                w = shingle_hashes(words)
                out.append((doc, len(w), *sequence_hashes(words), (w >> np.uint64(32)).astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["first", "n", "h1", "h2", "_s"])

    key = ["first", "n", "h1", "h2"]
    found = rows.mapInPandas(shingles, "first long, n long, h1 long, h2 long, _s binary").dropDuplicates(key)  # equal in _s as well
    return found.join(nodes.select("node", *key), key).select("node", "_s")


def verify(pairs: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sequences align well enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [aligned(np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4"), similarity) for x, y in zip(pdf["_sa"], pdf["_sb"])]
            yield pdf.loc[good, ["a", "b"]]

    both = pairs.join(shingles.select(F.col("node").alias("a"), F.col("_s").alias("_sa")), "a").join(shingles.select(F.col("node").alias("b"), F.col("_s").alias("_sb")), "b")
    return both.mapInPandas(check, "a long, b long")


def common_members(seqs: list[np.ndarray], chunk: int = 8192) -> np.ndarray:
    """How many members, repeats counted, each two sequences have in common, whatever their order."""
    labelled = np.concatenate([occurrence_labelled(x.astype(np.uint64)) for x in seqs])
    who = np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])
    _, member, count = np.unique(labelled, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # members of one sequence alone are in common with none
    keep = count[member] > 1
    who, at = who[keep], column[member[keep]]
    total = np.zeros((len(seqs), len(seqs)), dtype=np.float32)
    for low in range(0, int(at.max()) + 1 if len(at) else 0, chunk):
        here = (at >= low) & (at < low + chunk)
        m = np.zeros((len(seqs), min(chunk, int(at.max()) + 1 - low)), dtype=np.float32)
        m[who[here], at[here] - low] = 1
        total += m @ m.T
    return total


def verify_in_blocks(members: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links among the members (key, node, c, rest) of large buckets, without giving out their pairs.

    c is the class by the links known so far; rest marks members of another class than the pivot's. A bucket's rest and
    its other members are dealt apart over parts of bounded size; each pair of parts of which one is of the rest is one
    task's, as the others are of one class. There, matrix products give the shingles that each two members share; pairs
    that share enough are aligned, those that share most first, and a pair that links known so far already tie together
    is passed over. A task gives out fewer links than it has members.
    """
    count = F.count_if("rest").alias("_r"), F.count_if(~F.col("rest")).alias("_t")
    parts = members.groupBy("key").agg(*count).where("_r > 0").select("key", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("_r", "_t")))
    deal = F.when(F.col("rest"), F.pmod(F.xxhash64("node"), F.col("_r"))).otherwise(F.col("_r") + F.pmod(F.xxhash64("node"), F.col("_t")))
    dealt = members.join(stage(parts, "parts"), "key").withColumn("p", deal.cast("int"))
    dealt = dealt.join(shingles, "node")
    meets = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("_r") + F.col("_t")).otherwise(F.col("_r")) - 1)
    sent = dealt.withColumn("q", F.explode(meets)).select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "c", "_s")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, part = pdf["node"].to_numpy(), pdf["p"].to_numpy()
        seqs = [np.frombuffer(x, dtype="<u4") for x in pdf["_s"]]
        size = np.array([len(x) for x in seqs])
        shared = common_members(seqs)
        good = np.triu(shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-6, 1)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            good &= part[:, None] != part[None, :]
        names, known = np.unique(pdf["c"].to_numpy(), return_inverse=True)
        good &= known[:, None] != known[None, :]
        a, b = np.nonzero(good)
        order = np.argsort(-shared[a, b], kind="stable")
        root, out = list(range(len(names))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a[order].tolist(), b[order].tolist()):
            if (rx := find(known[x])) != (ry := find(known[y])) and aligned(seqs[x], seqs[y], similarity):
                root[rx] = ry
                out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    return sent.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", minima: int = MINIMA, sketches: int = SKETCHES, similarity: float = SIMILARITY, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Classes of documents that are linked by near-duplicate pairs.

    Two texts are near duplicates if the alignment of their sequences of five-word shingles matches c of them with
    c / (n1 + n2 - c) >= ``similarity``, which order-blind Jaccard can only exceed. Texts with the same words are one
    node. Of each node, ``sketches`` hash functions each give the ``minima`` least occurrence-labelled shingles, in text
    order; nodes that share a sketch share a bucket. A small bucket compares all its pairs. In a larger one every member
    is compared with a pivot, the least id; links found so far are closed into classes. Members of another class than
    the pivot's are then compared with all members in blocks, inside tasks, where counts of common shingles say which
    pairs are worth an alignment; only pairs of one class are passed over, so that the result doesn't depend on a
    bucket's size. These links join the classes. Texts of 4 to 9 shingles, of which few sketches differ, also share a
    bucket with every text that has one shingle more or less.

    Defined cases: null text counts as empty; texts without words are one class; a text of one to four words has one
    shingle; very long texts are sketched and aligned whole, the latter within its band; ties of hashes go by the place in
    the text. Each row is a document: rows that repeat an id are classed by their own texts, whatever the others' are, and
    the order of rows doesn't matter. A row with a null id is a class of its own; an empty table gives an empty result;
    other columns are ignored. Returns doc_id, class_id (least doc_id of the class), class_size (rows), kept (the least
    doc_id's row; if several of a class have that id, the one with the least digest, and its repetitions), text_sha256.
    """
    made = stage(features(docs, id_col=id_col, text_col=text_col, minima=minima, sketches=sketches), "features")
    known = made.where("doc_id is not null")
    # A node is a text, not an id; equal texts have equal sketches, whichever row gives them.
    nodes = known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    shared = nodes.where("n > 0").select("node", F.explode("sketch").alias("key"))
    # Staged, as are other sums that meet their own rows again: a join of two shuffled sides can be split at a hot key.
    sizes = stage(shared.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_pivot")).where("_n > 1"), "sizes")
    buckets = stage(shared.join(sizes, "key").select("key", "node", "_n", "_pivot"), "buckets")
    small, large = buckets.where(F.col("_n") <= small_bucket), buckets.where((F.col("_n") > small_bucket) & (F.col("node") != F.col("_pivot")))
    left, right = small.select("key", F.col("node").alias("a")), small.select("key", F.col("node").alias("b"))
    pairs = left.join(right, "key").where("a < b").select("a", "b")
    pairs = stage(pairs.union(large.select("_pivot", "node")).distinct(), "pairs")
    paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = stage(nodes.drop("sketch").join(paired, "node", "left_semi"), "paired")
    shingles = stage(shingle_table(docs, asked, id_col=id_col, text_col=text_col), "shingles")
    found = stage(verify(pairs, shingles, similarity), "links")
    groups = connected_components(found)
    of = groups.withColumnRenamed("component", "c")
    pivots = of.select(F.col("node").alias("_pivot"), F.col("c").alias("_cp"))
    marked = large.join(of, "node", "left").join(pivots, "_pivot", "left").withColumn("c", F.coalesce("c", "node"))
    marked = stage(marked.select("key", "node", "c", (F.col("c") != F.coalesce("_cp", "_pivot")).alias("rest")), "marked")
    more = stage(verify_in_blocks(marked, shingles, similarity), "more")
    if not more.isEmpty():
        groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    classes = stage(nodes.join(groups, "node", "left").select("n", "h1", "h2", F.coalesce("component", "node").alias("c")), "grouped")
    tagged = stage(known.join(classes, ["n", "h1", "h2"]).select("doc_id", "sha", "c"), "tagged")
    sizes = tagged.groupBy("c").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct("doc_id", "sha")).alias("_least"))
    out = tagged.join(stage(sizes, "classes"), "c")
    out = out.select("doc_id", F.col("_least.doc_id").alias("class_id"), "class_size", (F.struct("doc_id", "sha") == F.col("_least")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = made.where("doc_id is null").select("doc_id", F.lit(None).cast("long"), F.lit(1).cast("long"), F.lit(True), "sha")
    return out.union(alone)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))
