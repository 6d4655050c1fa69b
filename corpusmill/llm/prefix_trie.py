"""A trie of conversation prefixes: node tables by minimal perfect hashes, summed through arrays of parent slots."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_sql, decimal_bytes_sql, number_in_order, read_table, stage
from .perfect_hash import PerfectHash

#: Turns of a conversation in one shard, rows of a shard about, ids that are joined to one text.
BLOCK, SHARD, JOINED = 1024, 4096, 512
# Ids that share a first conversation, and the remainders that say how many of its turns are taken.
CENTURY, TURNS = 100, 6

_TABLE = "bucket long, block long, convs array<long>, start array<int>, first array<int>, last array<int>, total array<int>, slot binary, parent binary, depth binary, g1 binary, g2 binary, n binary, least binary, chars binary"
_NODE = ["depth", "g1", "g2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, chars, n): the turns in order, as hashes of role, text and more.

    A turn's place comes from ranges of all turns, so that a very long conversation isn't one task's.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("said"), F.length(text).alias("chars"), F.monotonically_increasing_id().alias("row"))
    at = stage(number_in_order(stage(rows, "turns"), "conv_id", "turn", "said", "row"), "places")
    convs = stage(at.groupBy("conv_id").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n")), "conversations")
    lane = lambda k: F.conv(F.substring("said", k, 15), 16, 10).cast("long")
    return at.join(convs, "conv_id").select("conv_id", (F.col("_at") - F.col("_first")).alias("pos"), lane(1).alias("k1"), lane(16).alias("k2"), "chars", "n")


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, chars, total): each conversation begins with turns of its century's first one.

    Also the root of each conversation, at depth 0; total is its number of turns. k1 and k2 tell turn and place.
    """
    convs = rows.where("pos = 0").select("conv_id", "n")
    plan = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS).alias("h"), (F.col("conv_id") - F.col("conv_id") % CENTURY).alias("base"))
    plan = plan.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("nb")), "base", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("nb", F.lit(0)))).withColumn("total", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = stage(plan.select("conv_id", "base", "h", "m", "total"), "plan")
    own = rows.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "k1", "k2", "chars", "total")
    begin = rows.where(F.col("pos") < TURNS - 1).select(F.col("conv_id").alias("base"), "pos", "k1", "k2", "chars")
    taken = plan.where("m > 0").select("conv_id", "base", "m", "total").join(begin, "base").where("pos < m").select("conv_id", "pos", "k1", "k2", "chars", "total")
    both = own.union(taken).select("conv_id", (F.col("pos") + 1).cast("int").alias("depth"), F.xxhash64("k1", "pos").alias("k1"), F.xxhash64("k2", "pos").alias("k2"), "chars", F.col("total").cast("int").alias("total"))
    zero = F.lit(0).cast("long")
    return both.union(plan.select("conv_id", F.lit(0), zero, zero, F.lit(0), F.col("total").cast("int")))


def _block(depth: Column | str) -> Column:
    return F.floor((F.col(depth) if isinstance(depth, str) else depth) / BLOCK).cast("long")


def _segments(convs: np.ndarray) -> np.ndarray:
    """Where each run of equal ids starts."""
    return np.flatnonzero(np.concatenate([[True], convs[1:] != convs[:-1]]))


def _prefixes(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The combined hash of each prefix within its run: of places and turns, so that their exclusive or tells the order."""
    x = np.bitwise_xor.accumulate(keys)
    before = np.concatenate([np.zeros(1, dtype=keys.dtype), x])[starts]
    return x ^ np.repeat(before, sizes)


def _keys(depth: np.ndarray, g1: np.ndarray, g2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the hash table knows a node by: both lanes of its prefix, the first one with the depth in it."""
    return g1.view(np.uint64) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), g2.view(np.uint64)


def build_table(pdf: pd.DataFrame) -> pd.DataFrame:
    """The node table of a shard: slots of all prefixes by a minimal perfect hash, and flat arrays over slots.

    The first row of each conversation is its root or, in a later block, the prefix before the block; ``n`` counts the
    conversations of a node in this shard, not those whose prefix only stands before their block.
    """
    pdf = pdf.sort_values(["conv_id", "depth"], kind="stable")
    conv, depth, chars = pdf["conv_id"].to_numpy(), pdf["depth"].to_numpy(dtype=np.int64), pdf["chars"].to_numpy(dtype=np.int64)
    starts = _segments(conv)
    sizes = np.diff(np.append(starts, len(conv)))
    g1, g2 = (_prefixes(pdf[k].to_numpy(), starts, sizes) for k in ("k1", "k2"))
    node = np.unique(np.stack([depth, g1, g2], axis=1), axis=0)
    table = PerfectHash(*_keys(*node.T.copy()))
    slot = table.slots(*_keys(depth, g1, g2))
    order = table.slots(*_keys(*node.T.copy()))
    if len(np.unique(order)) != len(node) or (slot < 0).any():
        raise RuntimeError("two prefixes share a slot")
    m = len(node)
    at = {k: np.empty(m, dtype=np.int64) for k in ("depth", "g1", "g2")}
    for k, v in zip(at, node.T):
        at[k][order] = v
    inner = np.ones(len(conv), dtype=bool)
    inner[starts] = False
    parent = np.full(m, -1, dtype=np.int64)
    parent[slot[inner]] = slot[np.flatnonzero(inner) - 1]
    counted = inner | (depth == 0)
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, slot[counted], conv[counted])
    letters = np.zeros(m, dtype=np.int64)
    letters[slot[counted]] = chars[counted]
    row = {
        "bucket": pdf["bucket"].iloc[0], "block": pdf["block"].iloc[0], "convs": conv[starts].tolist(), "start": starts.tolist(), "first": depth[starts].tolist(),
        "last": depth[starts + sizes - 1].tolist(), "total": pdf["total"].to_numpy()[starts].tolist(), "slot": slot.tobytes(), "parent": parent.tobytes(),
        **{k: v.tobytes() for k, v in at.items()}, "n": np.bincount(slot[counted], minlength=m).tobytes(), "least": least.tobytes(), "chars": letters.tobytes(),
    }
    return pd.DataFrame([row])


def node_tables(rows: DataFrame) -> DataFrame:
    """Node tables of shards: conversations are dealt by a hash, long ones are cut into blocks of turns as well.

    A later block starts with a row for the prefix before it, whose hash is that of the earlier blocks together.
    """
    rows = stage(rows.withColumn("block", _block("depth")), "rebuilt")
    buckets = max(1, rows.count() // SHARD)
    whole = rows.where(f"total >= {BLOCK}").groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"), F.max("total").alias("total"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv_id", "block", F.bit_xor("x1").over(before).alias("k1"), F.bit_xor("x2").over(before).alias("k2"), "total").where("block > 0")
    carried = carried.select("conv_id", (F.col("block") * BLOCK - 1).cast("int").alias("depth"), "k1", "k2", F.lit(0).alias("chars"), "total", "block")
    dealt = rows.unionByName(carried).withColumn("bucket", _bucket("conv_id", buckets))
    return stage(dealt.groupBy("bucket", "block").applyInPandas(build_table, _TABLE), "tables"), buckets


def _bucket(conv: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(buckets)).cast("long")


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.int64)


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each shard knows of its nodes."""
    for pdf in batches:
        for r in pdf.itertuples():
            parent, n = _ints(r.parent), _ints(r.n)
            out = pd.DataFrame({"depth": _ints(r.depth), "g1": _ints(r.g1), "g2": _ints(r.g2), "n": n, "least": _ints(r.least), "chars": _ints(r.chars)})
            out["p1"], out["p2"] = out["g1"].to_numpy()[parent], out["g2"].to_numpy()[parent]
            yield out[n > 0]


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The node that each conversation ends at."""
    for pdf in batches:
        for r in pdf.itertuples():
            start, first, last, total = (np.array(x) for x in (r.start, r.first, r.last, r.total))
            done = last == total
            slot = _ints(r.slot)[(start + last - first)[done]]
            yield pd.DataFrame({"conv_id": np.array(r.convs)[done], "depth": last[done], "g1": _ints(r.g1)[slot], "g2": _ints(r.g2)[slot]})


def sum_up(tables: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
    """Adds what conversations own (conv_id, depth, w, leaf) to the slots of their nodes, and from the deepest level up to
    the slots of their parents."""
    empty = pd.DataFrame({k: np.zeros(0, dtype=np.int64) for k in [*_NODE, "w", "leaf"]})
    if tables.empty or owned.empty:
        return empty
    r = next(tables.itertuples())
    slot, parent, depth = _ints(r.slot), _ints(r.parent), _ints(r.depth)
    where = np.searchsorted(np.array(r.convs), owned["conv_id"].to_numpy())
    to = slot[np.array(r.start)[where] + owned["depth"].to_numpy() - np.array(r.first)[where]]
    sums = {}
    levels = np.argsort(-depth, kind="stable")
    levels = np.split(levels, np.flatnonzero(np.diff(depth[levels])) + 1)
    for k in ("w", "leaf"):
        total = np.zeros(len(depth), dtype=np.int64)
        np.add.at(total, to, owned[k].to_numpy(dtype=np.int64))
        for at in levels:
            at = at[parent[at] >= 0]
            np.add.at(total, parent[at], total[at])
        sums[k] = total
    out = pd.DataFrame({"depth": depth, "g1": _ints(r.g1), "g2": _ints(r.g2), **sums})
    return out[(_ints(r.n) > 0) & ((out["w"] != 0) | (out["leaf"] != 0))]


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ends as texts of ids, in their order."""
    for pdf in batches:
        key = pdf[_NODE].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(pdf) else []
        ids, rows = pdf["conv_id"].tolist(), []
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            rows += [(*key[a].tolist(), ids[k], ",".join(map(str, ids[k : min(b, k + JOINED)]))) for k in range(a, b, JOINED)]
        yield pd.DataFrame(rows, columns=[*_NODE, "first", "ids"])


def _hashed_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each node's texts, one after the other as they come."""
    now, state = None, None
    for pdf in batches:
        rows = []
        for *node, ids in pdf[[*_NODE, "ids"]].itertuples(index=False, name=None):
            if node != now:
                rows += [] if now is None else [(*now, state.hexdigest())]
                now, state = node, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(rows, columns=[*_NODE, "ends"])
    if now is not None:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=[*_NODE, "ends"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all prefixes of the rebuilt conversations.

    Turns become hashes; a prefix is known by two lanes of the exclusive or of its turns' hashes, each with its place in it,
    and its depth. Conversations are dealt to shards, long ones in blocks of turns. A shard enumerates its prefixes, gives
    each a slot by a minimal perfect hash whose slots remember their keys, and keeps counts and parents in flat arrays by
    slot. Counts of one node in several shards are added. Each node belongs to its smallest conversation; in that one's
    shard its weight is put into its slot and summed through the parents' slots, deepest first; what lies in deeper blocks
    of a conversation is added at its block's last turn. So neither depth nor the number of conversations that share a
    prefix makes a round or a task longer; only the ids that end at one node are hashed one after the other, as their
    digest wants it, in joined texts.

    Defined cases: rows without a conv_id belong to no conversation and go; null role and text are empty, a null turn is
    the first; ties of a turn go by a digest of role and text, repeated rows are turns of their own; very long texts are
    hashed where they lie and not shuffled; conversations without a turn left are members of the root alone; an empty table
    gives an empty result, without a root; other columns are ignored.
    """
    tables, buckets = node_tables(rebuilt(stage(turns(conversations), "ordered")))
    known = tables.mapInPandas(_nodes, "depth long, g1 long, g2 long, n long, least long, chars long, p1 long, p2 long")
    nodes = stage(known.groupBy(*_NODE).agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2")]
    children = nodes.where("depth > 0").select(*up).groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("w"), (F.col("n_children") == 0).cast("long").alias("leaf")).withColumn("block", _block("depth"))
    owned = stage(owned.where("w <> 0 or leaf <> 0"), "owned")
    deeper = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = tables.where("block > 0").select(F.explode("convs").alias("conv_id"), "block")
    blocks = blocks.union(blocks.where("block = 1").select("conv_id", F.lit(0).cast("long")))
    sums = owned.groupBy("conv_id", "block").agg(F.sum("w").alias("w"), F.sum("leaf").alias("leaf"))
    deep = blocks.join(sums, ["conv_id", "block"], "left").select("conv_id", "block", F.sum("w").over(deeper).alias("w"), F.sum("leaf").over(deeper).alias("leaf")).where("w <> 0 or leaf <> 0")
    deep = deep.select("conv_id", ((F.col("block") + 1) * BLOCK - 1).alias("depth"), F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "block")
    given = owned.unionByName(deep).withColumn("bucket", _bucket("conv_id", buckets))
    partly = tables.groupBy("bucket", "block").cogroup(given.groupBy("bucket", "block")).applyInPandas(sum_up, "depth long, g1 long, g2 long, w long, leaf long")
    summed = stage(partly.groupBy(*_NODE).agg(F.sum("w").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")), "sums")

    ends = tables.mapInPandas(_ends, "conv_id long, depth long, g1 long, g2 long")
    order = [*_NODE, "conv_id"]
    texts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_joined_ids, "depth long, g1 long, g2 long, first long, ids string")
    ended = texts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInPandas(_hashed_ids, "depth long, g1 long, g2 long, ends string")

    parents = nodes.select(*(F.col(c).alias(f"_{c}") for c in _NODE), F.col("conv_id").alias("parent_conv_id"))
    above = (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_g1")) & (F.col("p2") == F.col("_g2"))
    out = nodes.join(summed, _NODE, "left").join(stage(ended, "ends"), _NODE, "left").join(parents, above, "left")
    none = F.lit(sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


_SAID = "sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))"
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, {_SAID} AS said, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_SAID}) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS c, {crc_sql(decimal_bytes_sql("conv_id"))} % {TURNS} AS h, conv_id - conv_id % {CENTURY} AS b FROM (SELECT DISTINCT conv_id FROM t)),
base AS (SELECT c.c, t.pos, t.said, t.chars FROM c JOIN t ON t.conv_id = c.b AND t.pos < c.h),
m AS (SELECT c.c, c.h, count(base.c) AS m FROM c LEFT JOIN base ON base.c = c.c GROUP BY c.c, c.h),
turns AS (SELECT * FROM base UNION ALL SELECT m.c, t.pos - m.h + m.m, t.said, t.chars FROM m JOIN t ON t.conv_id = m.c AND t.pos >= m.h),
p AS (
  SELECT c, pos + 1 AS d, chars, sha256(string_agg(said, '') OVER (PARTITION BY c ORDER BY pos)) AS key FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM c),
paths AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS last FROM p),
nodes AS (SELECT d, key, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars, any_value(up) AS up FROM paths GROUP BY d, key),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS k FROM nodes WHERE d > 0 GROUP BY d, up),
own AS (SELECT n.*, coalesce(k.k, 0) AS k FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.key = k.key),
below AS (SELECT p.d, p.key, sum((o.k = 0)::BIGINT) AS leaves, sum((o.n - 1) * o.chars) AS saved FROM own o JOIN paths p ON p.c = o.conv_id AND p.d <= o.d GROUP BY p.d, p.key),
ends AS (SELECT d, key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM paths WHERE d = last GROUP BY d, key)
SELECT o.conv_id, o.d::BIGINT AS depth, a.conv_id AS parent_conv_id, o.n AS n_convs, o.k::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM own o JOIN below b ON b.d = o.d AND b.key = o.key LEFT JOIN ends e ON e.d = o.d AND e.key = o.key LEFT JOIN own a ON a.d = o.d - 1 AND a.key = o.up
"""
