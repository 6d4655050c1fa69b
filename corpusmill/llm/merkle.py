"""Merkle manifest of a dataset: leaves find their places by ranks in bitmaps of ids, slot arrays reduce the levels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_sql, decimal_bytes_sql, number_in_order, read_table, stage

#: Levels that one slot array reduces: it holds 2 ** LEVELS nodes at most.
LEVELS = 8
#: Bits of an id within its bitmap, and those of the two directories above it.
CHUNK, LOW, HIGH = 12, 18, 17

_SEGMENT = "g string, seg long, m long, digests binary, root binary"
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, tampered, row): the group by language, digests of the row and of what tampering makes of it.

    g is empty for a null language and ``=`` with the language otherwise, so that its bytes keep the order.
    """
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars")
    digest = lambda n: F.unhex(F.sha2(F.concat(*(_field(c) for c in (doc_id, F.col("source"), F.col("lang"), n, F.col("text")))), 256))
    asked = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"),
        doc_id.alias("doc_id"),
        digest(n_chars).alias("leaf"),
        F.when(asked, digest(n_chars.cast("decimal(20,0)") + 1)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(rows, "leaves")


def _ones_below(bit: Column) -> Column:
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))


def placed(rows: DataFrame) -> DataFrame:
    """Adds id's parts: chunk (its bitmap; -1 for a null id), word and bit. The sign is flipped, so that order is kept."""
    flipped = F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))
    null = F.col("doc_id").isNull()
    bits = lambda down, n: F.when(null, 0).otherwise(F.shiftrightunsigned(flipped, down).bitwiseAND(F.lit((1 << n) - 1))).cast("int")
    return rows.select("*", F.when(null, -1).otherwise(F.shiftrightunsigned(flipped, CHUNK)).cast("long").alias("chunk"), bits(6, 6).alias("word"), bits(0, 6).alias("bit"))


def bitmaps(rows: DataFrame) -> DataFrame:
    """Per group and chunk: a bitmap of ids with a popcount directory and the number of the group's rows before it.

    Bits are merged word by word before they are shuffled; empty words aren't kept: ``top`` tells which there are. ``dir``
    counts the rows before each word, repeats included; ``crowded`` marks words with repeated ids. Rows before a chunk are
    summed within directories of bounded size, two levels of them, and then within the group. m is the group's size.
    """
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    words = rows.groupBy("g", "chunk", "word").agg(F.bit_or(one(F.col("bit"))).alias("bits"), F.count(F.lit(1)).alias("n"))
    chunks = words.groupBy("g", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits", "n"))).alias("_w"),
        F.bit_or(one(F.col("word"))).alias("top"),
        F.bit_or(F.when(F.col("n") > F.bit_count("bits"), one(F.col("word"))).otherwise(F.lit(0).cast("long"))).alias("crowded"),
        F.sum("n").alias("n"),
    )
    start = F.array(F.lit(0).cast("long"))
    chunks = chunks.withColumn("dir", F.aggregate("_w", start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["n"]))))
    chunks = chunks.withColumn("words", F.transform("_w", lambda x: x["bits"])).drop("_w")
    chunks = stage(chunks.withColumn("low", F.shiftright("chunk", LOW)).withColumn("high", F.shiftright("chunk", LOW + HIGH)), "bitmaps")

    def before(table: DataFrame, key: list[str], by: str, name: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(by)
        return table.withColumn(name, F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))

    highs = stage(before(chunks.groupBy("g", "high").agg(F.sum("n").alias("n")), ["g"], "high", "_h"), "high")
    lows = before(chunks.groupBy("g", "high", "low").agg(F.sum("n").alias("n")), ["g", "high"], "low", "_l").drop("n")
    sizes = highs.groupBy("g").agg(F.sum("n").alias("m"))
    lows = lows.join(highs.drop("n"), ["g", "high"]).join(sizes, "g").select("g", "low", (F.col("_h") + F.col("_l")).alias("_above"), "m")
    within = before(chunks.select("g", "low", "chunk", "n"), ["g", "low"], "chunk", "_c").select("g", "low", "chunk", "_c")
    base = within.join(lows, ["g", "low"]).select("g", "chunk", "m", (F.col("_above") + F.col("_c")).alias("base"))
    return stage(chunks.select("g", "chunk", "top", "crowded", "dir", "words").join(base, ["g", "chunk"]), "ranked")


def ranked(rows: DataFrame) -> DataFrame:
    """Adds slot, the place of each row in its group by doc_id, and m, the group's size, by rank queries; nothing is sorted.

    Rows that share a bitmap word with a repeated id, if there are any, are numbered by id and digest instead, range by range.
    """
    maps = bitmaps(placed(rows))
    i = F.bit_count(F.col("top").bitwiseAND(_ones_below(F.col("word"))))
    crowd = F.expr("shiftrightunsigned(crowded, word) & 1L")
    found = placed(rows).join(maps, ["g", "chunk"]).withColumn("_i", i)
    start = F.col("base") + F.expr("dir[_i]")
    plain = found.select("g", "doc_id", "leaf", "tampered", "m", (start + F.bit_count(F.expr("words[_i]").bitwiseAND(_ones_below(F.col("bit"))))).alias("slot"), (crowd == 1).alias("_crowded"), start.alias("_start"), "chunk", "word", "row")
    out = ["g", "doc_id", "leaf", "tampered", "m", "slot"]
    if maps.where("crowded <> 0").isEmpty():
        return plain.select(out)
    crowded = number_in_order(plain.where("_crowded"), "g", "chunk", "word", "doc_id", "leaf", "row")
    first = stage(crowded.groupBy("g", "chunk", "word").agg(F.min("_at").alias("_first")), "first")
    numbered = crowded.join(first, ["g", "chunk", "word"]).withColumn("slot", F.col("_start") + F.col("_at") - F.col("_first"))
    return plain.where("not _crowded").select(out).union(numbered.select(out))


def _height(m: int) -> int:
    """Levels that a slot array of a group of m nodes reduces."""
    return min(LEVELS, max(0, math.ceil(math.log2(m))))


def _digest(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def _levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes and all levels above them; a last run may hold one node."""
    out = [nodes]
    for _ in range(height):
        nodes = [_digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _hexes(digests: bytes) -> list[str]:
    return [digests[k : k + 32].hex() for k in range(0, len(digests), 32)]


def slot_arrays(nodes: DataFrame, payload: bool = False) -> DataFrame:
    """Nodes (g, slot, digest, m) dealt by the high bits of their slot: each array is filled by slot and reduced to its root.

    With ``payload``, it also holds the nodes' doc_id and tampered digests (the digest itself where there is none).
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        slot, m = pdf["slot"].to_numpy(), int(pdf["m"].iloc[0])
        at = np.empty(len(pdf), dtype=np.int64)
        at[slot - slot.min()] = np.arange(len(pdf))
        digests = [pdf["digest"].iloc[k] for k in at]
        row = {"g": pdf["g"].iloc[0], "seg": int(slot[0]) >> LEVELS, "m": m, "digests": b"".join(digests), "root": bytes.fromhex(_levels([d.hex() for d in digests], _height(m))[-1][0])}
        if payload:
            ids, changed = pdf["doc_id"].tolist(), pdf["tampered"].tolist()
            row |= {"ids": [None if pd.isna(ids[k]) else int(ids[k]) for k in at], "tampered": b"".join(changed[k] or pdf["digest"].iloc[k] for k in at)}
        return pd.DataFrame([row])

    schema = _SEGMENT + (", ids array<long>, tampered binary" if payload else "")
    return stage(nodes.withColumn("_seg", F.shiftright("slot", LEVELS)).groupBy("g", "_seg").applyInPandas(fill, schema), "slots")


def reduce_groups(arrays: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of all rounds, of which ``arrays`` is the first, and (g, root) of all groups."""
    rounds, most = [arrays], arrays.agg(F.max("m")).first()[0] or 0
    while most > 1 << LEVELS:
        nodes = rounds[-1].where(F.col("m") > 1 << LEVELS).select("g", F.col("seg").alias("slot"), F.col("root").alias("digest"), F.expr(f"(m + {(1 << LEVELS) - 1}) div {1 << LEVELS}").alias("m"))
        rounds.append(slot_arrays(nodes))
        most = -(-most >> LEVELS)
    tops = [r.where(F.col("m") <= 1 << LEVELS).select("g", "root") for r in rounds]
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.union(t)
    return rounds, stage(roots, "roots")


def _siblings(levels: list[list[str]], k: int) -> Iterator[tuple[int, str]]:
    """For each level that a node's way to the array's root passes: 0 and nothing, 1 and the left, or 2 and the right sibling."""
    for nodes in levels[:-1]:
        other = k ^ 1
        yield (0, "") if other >= len(nodes) else (1 if other < k else 2, nodes[other])
        k >>= 1


def _pack(way: list[tuple[int, str]]) -> bytes:
    return b"".join(bytes([side]) + bytes.fromhex(d) for side, d in way)


def _unpack(way: bytes) -> list[tuple[int, str]]:
    out, k = [], 0
    while k < len(way):
        n = 32 if way[k] else 0
        out.append((way[k], way[k + 1 : k + 1 + n].hex()))
        k += 1 + n
    return out


def with_ways(rounds: list[DataFrame], up: DataFrame) -> DataFrame:
    """The first round's arrays with the way from each one's root to the end (``way``) and the columns that go with it.

    up: g, way of the group's root, and other columns. From the last round down, each array hands every node its own way.
    """
    more = [c for c in up.columns if c != "g"]
    other = ", ".join(f"{n} {t}" for n, t in up.dtypes if n not in ("g", "way"))

    def hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                levels = _levels(_hexes(r.digests), _height(r.m))
                ways = [_pack(list(_siblings(levels, k))) + r.way for k in range(len(levels[0]))]
                yield pd.DataFrame({"g": r.g, "seg": (r.seg << LEVELS) + np.arange(len(ways)), "way": ways} | {c: getattr(r, c) for c in more if c != "way"})

    handed = None
    for arrays in reversed(rounds):
        known = arrays.where(F.col("m") <= 1 << LEVELS).join(up, "g")
        if handed is not None:
            known = known.unionByName(arrays.where(F.col("m") > 1 << LEVELS).join(handed, ["g", "seg"]))
        if arrays is not rounds[0]:
            handed = stage(known.mapInPandas(hand_down, "g string, seg long, way binary" + (", " + other if other else "")), "ways")
    return known


def _proofs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            above = _unpack(r.way)
            levels = _levels(leaves := _hexes(r.digests), _height(r.m))
            tail = "".join(d for _, d in above)
            root, rows = r.root_all.hex(), []
            for k, (doc_id, leaf, now) in enumerate(zip(r.ids, leaves, _hexes(r.tampered))):
                own = list(_siblings(levels, k))
                for side, d in own + above:
                    now = _digest(d, now) if side == 1 else _digest(now, d)
                rows.append((doc_id, leaf, r.subroot.hex(), root, _digest("".join(d for _, d in own), tail), now, now == root))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _RESULT.split(", ")])
            yield out.astype({"doc_id": "Int64"})


def manifest(docs: DataFrame) -> DataFrame:
    """A Merkle tree over the rows of ``docs``, and for each row its proof, checked on a copy that may have been tampered with.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Per lang, bitmaps of ids with popcount directories give
    each leaf its place by a rank query; leaves are dealt into slot arrays of 256, filled by slot and reduced to a root, and
    so on until one node, the subroot, is left. The languages' subroots, in the order of their bytes and null first, make
    the last tree. Ways to the root are handed down from array to array.

    Defined cases: null fields are ``-``; a null id comes first in its language, a null language is the first one; an
    empty text differs from a null one; texts are hashed whole in the JVM and not shuffled; rows that repeat an id in a
    language are leaves of their own, in the order of their digests; a tie of equal rows can't be told apart; null n_chars
    and ids aren't tampered with; an empty table gives an empty result; other columns are ignored. Returns doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified.
    """
    leaves = leaf_rows(docs)
    arrays = slot_arrays(ranked(leaves).withColumnRenamed("leaf", "digest"), payload=True)
    rounds, subroots = reduce_groups(arrays)
    k = subroots.count()
    top = number_in_order(subroots, "g", name="slot").select(F.lit("").alias("g"), "slot", F.col("root").alias("digest"), F.lit(k).cast("long").alias("m"), F.col("g").alias("lang"))
    top = stage(top, "languages")
    top_rounds, root = reduce_groups(slot_arrays(top.drop("lang")))
    starts = with_ways(top_rounds, root.select("g", F.unhex(F.lit("")).alias("way"), F.col("root").alias("root_all")))

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                levels = _levels(_hexes(r.digests), _height(r.m))
                n = len(levels[0])
                yield pd.DataFrame({"slot": (r.seg << LEVELS) + np.arange(n), "way": [_pack(list(_siblings(levels, k))) + r.way for k in range(n)], "root_all": [r.root_all] * n})

    up = stage(starts.mapInPandas(ways, "slot long, way binary, root_all binary"), "starts")
    up = top.join(up, "slot").select(F.col("lang").alias("g"), "way", "root_all", F.col("digest").alias("subroot"))
    return with_ways(rounds, up).mapInPandas(_proofs, _RESULT)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, {crc_sql(decimal_bytes_sql("doc_id"))} % 7 = 0 AS asked FROM documents),
leaves AS (SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, CASE WHEN asked THEN {_sql_leaf("(n_chars + 1)")} ELSE {_sql_leaf("n_chars")} END AS changed FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m FROM leaves),
tree AS (
  SELECT coalesce('=' || lang, '') AS g, 0 AS level, pos, leaf AS node, m FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((m + 1) // 2) FROM tree WHERE m > 1 GROUP BY g, level, pos // 2),
subroots AS (SELECT g, level AS height, node AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS k FROM tree WHERE m = 1),
top AS (
  SELECT 0 AS level, place AS pos, subroot AS node, k AS m FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((m + 1) // 2) FROM top WHERE m > 1 GROUP BY level, pos // 2),
l AS (SELECT p.*, coalesce('=' || p.lang, '') AS g, s.subroot, s.height, s.place, row_number() OVER () AS row FROM placed p JOIN subroots s ON coalesce('=' || p.lang, '') = s.g),
steps AS (
  SELECT l.row, t.level, t.level AS step, (l.pos >> t.level) & 1 = 1 AS on_left, n.node AS sibling
  FROM l JOIN (SELECT DISTINCT g, level FROM tree) t ON t.g = l.g AND t.level < l.height
  LEFT JOIN tree n ON n.g = l.g AND n.level = t.level AND n.pos = xor(l.pos >> t.level, 1)
  UNION ALL
  SELECT l.row, t.level, l.height + t.level, (l.place >> t.level) & 1 = 1, n.node
  FROM l JOIN (SELECT DISTINCT level FROM top WHERE m > 1) t ON true LEFT JOIN top n ON n.level = t.level AND n.pos = xor(l.place >> t.level, 1)),
ways AS (SELECT row, list(struct_pack(l := on_left, s := coalesce(sibling, '')) ORDER BY step) AS way FROM steps GROUP BY row),
told AS (
  SELECT l.doc_id, l.leaf, l.subroot, (SELECT node FROM top WHERE m = 1) AS root, sha256(coalesce(list_reduce(list_transform(w.way, lambda x: x.s), lambda a, b: a || b, ''), '')) AS proof_sha256,
    coalesce(list_reduce(list_transform(w.way, lambda x: CASE WHEN x.l THEN '<' || x.s ELSE '>' || x.s END), lambda now, x: CASE WHEN x[1] = '<' THEN sha256(x[2:] || now) ELSE sha256(now || x[2:]) END, l.changed), l.changed) AS folded_root
  FROM l LEFT JOIN ways w ON w.row = l.row)
SELECT *, folded_root = root AS verified FROM told
"""
