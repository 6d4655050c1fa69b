"""Near-duplicate vectors: NN-descent over a neighbour graph, lists enlarged where they are saturated, recall audited."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, read_table, stage

log = logging.getLogger(__name__)

THRESHOLD = 0.95
#: Neighbours of a list, of an enlarged one, vectors of a block, blocks that a crowded side is, pivots handled together.
NEIGHBOURS, ENLARGED, BLOCK, CROWDED, PIVOTS = 8, 32, 256, 4, 64
#: Share of pairs at the threshold that no table brings together; a list holds what is within so many times its angle.
MISS, REACH = 0.002, 2.5
#: Vectors of a block of the exact comparison at most.
WIDE = 4096
#: Vectors that an audit asks of each kind: so many, and this part of all at most; recall that ends the search; descents
#: of a round, and rounds at most.
AUDIT, AUDIT_PART, RECALL, ROUNDS, MOST_ROUNDS = 256, 80, 0.99, 2, 4

#: Single precision is off by less than this.
_ROUNDING = 1e-5
_EDGE = "u long, v long, sim float"


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, unit, dim) of the usable vectors: of length 1 in double precision, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = []
            for v in pdf["_v"]:
                v = np.asarray(v, dtype=np.float64)
                v = v / np.abs(v).max()  # so that squares neither overflow nor vanish
                units.append((v / np.sqrt(v @ v)).tobytes())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "unit": units, "dim": [len(u) // 8 for u in units]})

    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v")).where("vec_id is not null and size(_v) > 0")
    good = good.where("forall(_v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(_v, x -> x <> 0)")
    return good.mapInPandas(run, "vec_id long, unit binary, dim int")


def _matrix(units: pd.Series, dtype: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=dtype).reshape(len(units), -1)


def floor_of(threshold: float) -> float:
    """The least similarity that a list holds."""
    return math.cos(min(math.pi / 2, REACH * math.acos(min(1.0, threshold))))


def plan_tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Planes of a table and the number of tables, so that a pair at the threshold shares a side in one but for ``miss``."""
    bits = max(0, math.ceil(math.log2(max(1, n / block_size(n)))))
    together = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, 1 if together > 1 - miss else math.ceil(math.log(miss) / math.log(1 - together))


def block_size(n: int) -> int:
    """Vectors of a block: few in small tables, so that all blocks together stay far below all pairs."""
    return min(BLOCK, max(8, n // 256))


def _best(ids: np.ndarray, sims: np.ndarray, most: np.ndarray, floor: float) -> pd.DataFrame:
    """Each row's nearest others within a block, as many as its list holds."""
    np.fill_diagonal(sims, -2)
    out = []
    for k in np.unique(most):
        who, n = np.flatnonzero(most == k), min(int(k), len(ids) - 1)
        at = np.argpartition(-sims[who], n - 1, axis=1)[:, :n]
        rows, cols = np.repeat(who, n), at.ravel()
        good = sims[rows, cols] >= floor
        out.append(pd.DataFrame({"u": ids[rows[good]], "v": ids[cols[good]], "sim": sims[rows[good], cols[good]]}))
    return pd.concat(out)


def _ties(ids: np.ndarray, sims: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links within a block that lists may be too short for: a spanning set of the certain ones, and all that are so near
    the threshold that only double precision decides."""
    a, b = np.nonzero(np.triu(sims >= threshold - _ROUNDING, 1))
    near = sims[a, b]
    root, keep = list(range(len(ids))), near < threshold + _ROUNDING

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in np.flatnonzero(~keep).tolist():
        if (ru := find(int(a[k]))) != (rv := find(int(b[k]))):
            root[ru] = rv
            keep[k] = True
    return pd.DataFrame({"u": ids[a[keep]], "v": ids[b[keep]], "sim": near[keep]})


def _tally(products: Accumulator | None, n: int) -> None:
    if products is not None:
        products.add(n)


def first_graph(nodes: DataFrame, wide: DataFrame, n: int, k: int, seed: int, threshold: float, products: Accumulator | None) -> DataFrame:
    """Nearest neighbours within blocks of vectors that lie on the same side of random planes, in several tables: k of
    each node, ENLARGED of the ``wide`` ones; and a spanning set of each block's links, however many a node has.

    A side that is crowded by far is dealt over several blocks by a hash that differs from table to table; none exceeds its
    bound by much, and what one table separates another one brings together.
    """
    bits, tables = plan_tables(n, threshold)
    most, floor = CROWDED * block_size(n), floor_of(threshold)

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = _matrix(part["unit"])
                planes = np.random.default_rng((seed, int(dim))).standard_normal((int(dim), tables * bits))
                side = (x @ planes > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(x), tables), dtype=np.int64)
                short = [u.tobytes() for u in x.astype(np.float32)]
                for t in range(tables):
                    yield pd.DataFrame({"node": part["node"].to_numpy(), "k": part["k"].to_numpy(), "t": t, "dim": dim, "side": side[:, t], "short": short})

    sized = nodes.select("node", "unit", "dim").join(wide, "node", "left").withColumn("k", F.coalesce("k", F.lit(k)))
    dealt = stage(sized.mapInPandas(sides, "node long, k int, t int, dim int, side long, short binary"), "sides")
    crowd = stage(dealt.groupBy("t", "dim", "side").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")), "crowd")
    blocks = dealt.join(crowd, ["t", "dim", "side"]).withColumn("part", F.pmod(F.xxhash64("node", "t", F.lit(seed)), F.col("parts")))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"u": [], "v": [], "sim": []})
        x, ids = _matrix(pdf["short"], np.float32), pdf["node"].to_numpy()
        _tally(products, len(x) ** 2)
        sims = x @ x.T
        return pd.concat([_ties(ids, sims, threshold), _best(ids, sims, pdf["k"].to_numpy(), floor)])

    return blocks.groupBy("t", "dim", "side", "part").applyInPandas(near, _EDGE)


def best_lists(edges: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node, or ENLARGED ones; a node has a bounded number of rows here, as each block and pivot
    gives no more than its list holds."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = one.selectExpr("u", "v", "sim", "row_number() over (partition by u order by sim desc, v) as r").where(F.col("r") <= ENLARGED)
    return ranked.join(wide.withColumnRenamed("node", "u"), "u", "left").where(F.col("r") <= F.coalesce("k", F.lit(k))).select("u", "v", "sim")


def full_lists(lists: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """(u, last similarity, size, k) of the nodes whose list is full."""
    ends = lists.groupBy("u").agg(F.min("sim").alias("_last"), F.count(F.lit(1)).alias("_n")).join(wide.withColumnRenamed("node", "u"), "u", "left")
    return ends.withColumn("k", F.coalesce("k", F.lit(k))).where(F.col("_n") >= F.col("k"))


def descend(lists: DataFrame, shorts: DataFrame, wide: DataFrame, k: int, threshold: float, products: Accumulator | None) -> DataFrame:
    """New edges between neighbours of a common neighbour (both directions of the graph).

    A pivot's neighbours meet with their vectors; a pivot that many lists name is handled in parts. Only pairs that
    would enter a list, and a spanning set of links, are given out.
    """
    floor = floor_of(threshold)
    last = full_lists(lists, wide, k).select(F.col("u").alias("m"), F.col("_last").cast("float").alias("last"))
    around = lists.select(F.col("u").alias("pivot"), F.col("v").alias("m")).union(lists.select("v", "u")).union(lists.select("u", "u")).distinct()
    degree = lists.groupBy(F.col("v").alias("pivot")).agg(F.ceil((F.count(F.lit(1)) + k) / (4 * k)).alias("parts"))
    around = around.join(degree, "pivot", "left").withColumn("part", F.pmod(F.xxhash64("m", "pivot"), F.coalesce("parts", F.lit(1)))).drop("parts")
    around = stage(around, "around")
    groups = max(1, math.ceil(around.count() / (2 * k * PIVOTS)))
    members = around.join(shorts, F.col("m") == F.col("node")).drop("node").join(last, "m", "left").withColumn("g", F.pmod(F.xxhash64("pivot", "part"), F.lit(groups)))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, dim), part in pdf.groupby(["pivot", "part", pdf["short"].map(len)]):
            if len(part) < 2:
                continue
            x, ids, low = _matrix(part["short"], np.float32), part["m"].to_numpy(), part["last"].fillna(floor).to_numpy()
            _tally(products, len(x) ** 2)
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            out.append(_ties(ids, sims, threshold))
            a, b = np.nonzero(sims > low[:, None])
            out.append(pd.DataFrame({"u": ids[a], "v": ids[b], "sim": sims[a, b]}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "sim": []})

    return members.select("g", "pivot", "part", "m", "short", "last").groupBy("g").applyInPandas(meet, _EDGE)


def links_of(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The edges whose cosine, in double precision, reaches the threshold."""
    close = edges.where(F.col("sim") >= threshold - _ROUNDING).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    both = close.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("ua")), "a").join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("ub")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sims = np.array([np.frombuffer(x) @ np.frombuffer(y) for x, y in zip(pdf["ua"], pdf["ub"])])
            yield pdf.loc[sims >= threshold, ["a", "b"]]

    return both.mapInPandas(check, "a long, b long")


def link_counts(members: DataFrame, threshold: float, products: Accumulator | None = None) -> DataFrame:
    """Exact number of links of each node of a component: the list of a saturated node is enlarged to its component.

    members: component, node, unit, dim, many (vectors that the node stands for). A component's nodes are dealt over
    parts of bounded size; each pair of parts is one task's matrix product, which gives out a count a node, not pairs.
    """
    # Staged: a join of two shuffled sides can be split at a hot key.
    sizes = stage(members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("parts")), "parts")
    dealt = members.join(sizes, "component").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sent = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("component", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "unit", "many")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = pdf[pdf["p"] == i], pdf[pdf["p"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"node": [], "links": []})
        _tally(products, len(left) * len(right))
        hit = _matrix(left["unit"]) @ _matrix(right["unit"]).T >= threshold
        if i == j:
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"node": left["node"], "links": hit @ right["many"].to_numpy()})
        return pd.DataFrame({"node": pd.concat([left["node"], right["node"]]), "links": np.concatenate([hit @ right["many"].to_numpy(), hit.T @ left["many"].to_numpy()])})

    return sent.groupBy("component", "i", "j").applyInPandas(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def with_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    return stage(nodes.join(groups, "node", "left").select("node", "unit", "dim", F.coalesce("component", "node").alias("c")), "tagged")


def exact_links(asked: DataFrame, tagged: DataFrame, n: int, threshold: float, products: Accumulator | None = None) -> DataFrame:
    """The nodes in ``asked`` compared with all nodes, block by block: (node, links, missed, a, b).

    links and missed are counts, to be summed by node: links, and those that lead out of the node's component c. a and b
    are links between components, of each block a spanning set; other rows have a = b.
    """
    block = min(WIDE, max(BLOCK, n // 16))
    lefts, parts = max(1, math.ceil(asked.count() / block)), max(1, math.ceil(n / block))
    deal = lambda k: F.pmod(F.xxhash64("node"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = tagged.join(asked, "node", "left_semi").select(F.lit(True).alias("_left"), "node", "unit", "dim", "c", deal(lefts).alias("i"), each(parts).alias("j"))
    right = tagged.select(F.lit(False), "node", "unit", "dim", "c", deal(parts).alias("j"), each(lefts).alias("i")).select(F.lit(False).alias("_left"), "node", "unit", "dim", "c", "i", "j")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, other = pdf[pdf["_left"]], pdf[~pdf["_left"]]
        out = [pd.DataFrame({"node": [], "links": [], "missed": [], "a": [], "b": []}, dtype="int64")]
        if ask.empty or other.empty:
            return out[0]
        names, c = np.unique(np.concatenate([ask["c"], other["c"]]), return_inverse=True)
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        x, y = _matrix(ask["unit"]), _matrix(other["unit"])
        _tally(products, len(x) * len(y))
        ids, others, cx, cy = ask["node"].to_numpy(), other["node"].to_numpy(), c[: len(ask)], c[len(ask) :]
        for low in range(0, len(x), BLOCK):
            at = slice(low, low + BLOCK)
            hit = (x[at] @ y.T >= threshold) & (ids[at, None] != others[None, :])
            apart = hit & (cx[at, None] != cy[None, :])
            links = hit.sum(axis=1)
            some = links > 0
            own = ids[at][some]
            out.append(pd.DataFrame({"node": own, "links": links[some], "missed": apart.sum(axis=1)[some], "a": own, "b": own}))
            a, b = np.nonzero(apart)
            _, one = np.unique(cx[at][a] * len(names) + cy[b], return_index=True)
            new = []
            for u, v in zip(a[one].tolist(), b[one].tolist()):
                if (ru := find(cx[low + u])) != (rv := find(cy[v])):
                    root[ru] = rv
                    new.append((ids[low + u], 0, 0, ids[low + u], others[v]))
            if new:
                out.append(pd.DataFrame(new, columns=["node", "links", "missed", "a", "b"]))
        return pd.concat(out)

    return stage(left.union(right).groupBy("dim", "i", "j").applyInPandas(compare, "node long, links long, missed long, a long, b long"), "exact")


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links (a, b)."""
    return connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


@dataclass
class Audit:
    """What an audit found: vectors asked, how many of them have links, and how many of these lack none."""

    asked: int
    linked: int
    whole: int

    @property
    def interval(self) -> tuple[float, float]:
        """The recall's 95 % interval (Wilson's); 0 to 1 where no vector with links was asked."""
        if not self.linked:
            return 0.0, 1.0
        n, p, z = self.linked, self.whole / self.linked, 1.96
        mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        return max(0.0, (mid - half) / (1 + z * z / n)), min(1.0, (mid + half) / (1 + z * z / n))

    def __str__(self) -> str:
        if not self.linked:
            return f"recall unmeasured: none of {self.asked} asked vectors has a link, so at most {min(1.0, 3 / max(1, self.asked)):.1%} of their kind have any"
        low, high = self.interval
        return f"{self.whole} of {self.linked} asked vectors that have links lack none: recall {low:.3f} to {high:.3f}"


def audit(tagged: DataFrame, done: DataFrame, lists: DataFrame, n: int, threshold: float, sample: int, seed: int, products: Accumulator | None) -> tuple[Audit, DataFrame, DataFrame]:
    """Asks a bounded number of vectors for all their links: the findings, links that were missed, and who was asked.

    Two draws by hash among those that were never compared with all: of vectors whose list says that something is near,
    where links may be missing, and of the others, which may have links that nothing hints at.
    """
    size = max(1, min(sample, n // AUDIT_PART))
    near = lists.select(F.col("u").alias("node")).distinct().withColumn("_near", F.lit(True))
    rest = tagged.select("node").join(done, "node", "left_anti").join(near, "node", "left")
    drawn = [rest.where(kind).orderBy(F.xxhash64("node", F.lit(f"audit {seed}")), "node").limit(size).select("node") for kind in ("_near", "_near is null")]
    drawn = stage(drawn[0].union(drawn[1]), "asked")
    got = exact_links(drawn, tagged, n, threshold, products)
    sums = got.groupBy("node").agg(F.sum("links").alias("links"), F.sum("missed").alias("missed")).where("links > 0")
    linked, whole = sums.agg(F.count(F.lit(1)), F.count_if(F.col("missed") == 0)).first()
    return Audit(drawn.count(), linked, whole), got.where("a <> b").select("a", "b"), drawn


def near_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, k: int = NEIGHBOURS,
    recall: float = RECALL, sample: int = AUDIT, exhaustive: bool = False, products: Accumulator | None = None,
) -> DataFrame:
    """Links between vectors whose cosine is at least ``threshold``, and their components.

    Equal vectors are one node that stands for all of them. A first graph comes from blocks of vectors on the same side
    of random planes, in so many tables that a pair at the threshold is missed by all of them with a probability of
    ``MISS``; NN-descent refines it: neighbours of a common neighbour meet and enter each other's lists, which hold what is
    near enough to lead to a link. Blocks and meetings also give out spanning sets of their links, however short the lists
    are. All links are verified in double precision and closed into components. A list that holds links only is saturated.
    Where its node's component is small, the list is enlarged, and the next round, with new planes, fills it. Where the
    component outgrows an enlarged list as well, the node is compared with all vectors in blocks, and the links that lead
    out of its component join the graph. When no list is to be enlarged, an audit compares a bounded number of vectors with
    all, half of them where lists are filled; what it finds missing joins the graph. While fewer of the asked vectors than
    wanted have all their links, another round runs, ``MOST_ROUNDS`` at most; each audit logs its recall with an interval.
    With ``exhaustive``, all vectors that are left are compared with all in the end. Every node of a component is compared
    with its whole component, part by part, which gives the exact number of links within it. ``products`` counts the
    products of two vectors.

    Defined cases: null vectors, empty ones, zero vectors and those with a null or non-finite component link with
    nothing, nor do vectors of different lengths; vectors of any length are used whole; rows with a null id link with
    nothing and get a null component; rows that repeat an id are vectors of their own; ties are broken by id and don't
    show in the result; an empty table gives an empty result; other columns are ignored. Returns vec_id, n_links,
    component_id, kept.
    """
    rows = stage(unit_vectors(vectors, id_col, vec_col), "units")
    nodes = stage(rows.groupBy("dim", "unit").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("many")), "nodes")
    if nodes.groupBy("node").count().where("count > 1").isEmpty():
        key = nodes
    else:  # one id with several vectors: nodes get numbers of their own
        key = stage(nodes.withColumn("first", F.col("node")).withColumn("node", F.xxhash64("unit", "dim")), "nodes")
    if "first" not in key.columns:
        key = key.withColumn("first", F.col("node"))
    nodes = key
    n = nodes.count()
    spark = vectors.sparkSession
    lists = spark.createDataFrame([], _EDGE)
    extra = spark.createDataFrame([], "a long, b long")
    done = spark.createDataFrame([], "node long")  # nodes that were compared with all
    wide = spark.createDataFrame([], "node long, k int")  # nodes with an enlarged list

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "short": [np.frombuffer(u).astype(np.float32).tobytes() for u in pdf["unit"]]})

    shorts = stage(nodes.mapInPandas(shorten, "node long, short binary"), "shorts")
    for r in range(MOST_ROUNDS):
        found = stage(first_graph(nodes, wide, n, k, r, threshold, products), "graph")
        extra = stage(extra.union(links_of(found, nodes, threshold)), "links")
        lists = stage(best_lists(lists.union(found), wide, k), "lists")
        for _ in range(0 if lists.isEmpty() else ROUNDS):
            found = stage(descend(lists, shorts, wide, k, threshold, products), "graph")
            extra = stage(extra.union(links_of(found, nodes, threshold)).distinct(), "links")
            lists = stage(best_lists(lists.union(found), wide, k), "lists")
        groups = connected_components(extra)
        full = full_lists(lists, wide, k).where(F.col("_last") >= threshold - _ROUNDING).select(F.col("u").alias("node"), "k").join(done, "node", "left_anti")
        sizes = stage(groups.groupBy("component").agg(F.count(F.lit(1)).alias("_size")), "sizes")
        full = stage(full.join(groups, "node", "left").join(sizes, "component", "left").select("node", ((F.col("k") < ENLARGED) & (F.coalesce("_size", F.lit(1)) <= ENLARGED)).alias("_grow")), "saturated")
        whole = full.where("not _grow").select("node")
        if not whole.isEmpty():
            out = exact_links(whole, with_groups(nodes, groups), n, threshold, products).where("a <> b").select("a", "b")
            groups, extra, done = joined(groups, out), stage(extra.union(out), "missed"), stage(done.union(whole), "done")
        grow = full.where("_grow").select("node", F.lit(ENLARGED).alias("k"))
        if not grow.isEmpty():
            wide = stage(wide.union(grow), "wide")
            if r + 1 < MOST_ROUNDS:
                continue
        if not exhaustive:
            told, missed, asked = audit(with_groups(nodes, groups), done, lists, n, threshold, sample, r, products)
            log.log(logging.INFO if told.whole >= recall * told.linked else logging.WARNING, "round %d: %s", r, told)
            done = stage(done.union(asked), "done")
            if not missed.isEmpty():
                groups, extra = joined(groups, missed), stage(extra.union(missed), "links")
            if told.whole < recall * told.linked:
                continue
        break
    if exhaustive:
        left = stage(nodes.select("node").join(done, "node", "left_anti"), "unasked")
        groups = joined(groups, exact_links(left, with_groups(nodes, groups), n, threshold, products).where("a <> b").select("a", "b"))
    members = groups.join(nodes, "node").select("component", "node", "unit", "dim", "many")
    counts = link_counts(members, threshold, products)
    named = groups.join(nodes.select("node", "first"), "node")
    least = stage(named.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    each = named.join(least, "component").join(counts, "node", "left").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    per_node = nodes.select("node", "unit", "dim", "many", "first").join(each, "node", "left")
    per_node = per_node.select(F.col("unit").alias("_u"), F.col("many"), F.coalesce("component_id", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    usable = rows.select("vec_id", "unit").join(per_node, F.col("unit") == F.col("_u")).select("vec_id", "n_links", "component_id")
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    odd = raw.where("not coalesce(vec_id is not null and size(_v) > 0 and forall(_v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(_v, x -> x <> 0), false)")
    out = usable.union(odd.select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT x.vec_id, (SELECT count(*) FROM l WHERE l.a = x.vec_id) AS n_links, c.component_id, x.vec_id = c.component_id AS kept
FROM embeddings x JOIN c ON x.vec_id = c.vec_id
"""
