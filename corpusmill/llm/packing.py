"""Best-fit packing planned on a histogram of lengths; documents take planned slots by their rank within a length."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage
from .tokens import default_vocabulary, token_ids

#: Pieces are ranked in groups of about this many; in as many groups as a group has pieces, if those would be more.
ROWS_PER_GROUP = 2_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the rest in front."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)] if n else []


def plan(counts: dict[int, int], size: int) -> pd.DataFrame:
    """Best-fit decreasing over counts: which ranks of each length go where.

    ``counts`` has at most ``size`` entries, however large the table. Sequences that are filled alike are handled as one
    range. For each length from the longest down, ranges with the least sufficient room are used first; what is left
    opens new sequences, each with as many pieces of that length as fit. Placing one piece after the other where it fits
    best gives the same rooms. A row (length, rank, count, each, sequence, offset) says: pieces of that length with ranks
    from ``rank`` on, ``count`` in all, go ``each`` to a sequence, from ``sequence`` on, the first at ``offset``.
    """
    rooms: list[int] = []  # rooms that some range has, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)
    rows, opened = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in ranges:
                insort(rooms, room)
                ranges[room] = []
            if ranges[room] and sum(ranges[room][-1]) == first:
                first, many = ranges[room][-1][0], many + ranges[room].pop()[1]
            ranges[room].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(each: int, first: int, many: int) -> None:
            nonlocal rank, left
            if each and many:
                rows.append((length, rank, each * many, each, first, size - room))
                put(room - each * length, first, many)
                rank, left = rank + each * many, left - each * many

        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, many = size, opened, math.ceil(left / (size // length))
                opened += many
            # Best fit fills one sequence before it takes the next of the same room; the last one gets what is left.
            each = room // length
            full = min(many, left // each)
            fill(each, first, full)
            used = full
            if full < many and left:
                fill(left, first + full, 1)
                used += 1
            put(room, first + used, many - used)
    return pd.DataFrame(rows, columns=["length", "rank", "count", "each", "sequence", "offset"], dtype="int64")


def pieces(docs: DataFrame, size: int, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """The documents' pieces of at most ``size`` tokens, with the CRC-32 of their ids."""
    import zlib

    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = token_ids(vocabulary)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["_text"]):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), size))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInPandas(run, _PIECES)


def pack(docs: DataFrame, size: int = 1024, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary: str | None = None, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` tokens, as few as best-fit decreasing finds.

    The plan works on the histogram of lengths (``size`` numbers, the only thing that reaches the driver). A piece's rank
    within its length is the number of such pieces in earlier hash groups plus its place in its own group, so that a
    length which a third of the pieces have is ranked in many tasks. The rank then says which planned slot is the
    piece's; the plan, whose size depends on ``size`` alone, travels with the tasks.

    Defined cases: null text counts as empty and gives a piece of the closing id alone; a very long text is cut into
    pieces of ``size`` tokens, the first of which may be shorter; a null id is an id like others; rows that repeat an id
    are packed each; ties (pieces alike in id, number and content) take either slot; an empty table gives an empty result; other columns are ignored. Returns
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    cuts = stage(pieces(docs, size, id_col=id_col, text_col=text_col, end_id=end_id, vocabulary=vocabulary), "pieces")
    total = cuts.count()
    # Neither a group nor the list of groups, over which a length's earlier pieces are summed, outgrows the root of all.
    groups = max(1, math.ceil(min(total / rows_per_group, math.sqrt(total))))
    cuts = cuts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = stage(cuts.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = plan(counts, size)

    before = sizes.selectExpr("length", "_group", "sum(_n) over (partition by length order by _group) - _n as _before")
    ranked = cuts.selectExpr("*", "row_number() over (partition by length, _group order by doc_id, piece, start, ids_crc32) - 1 as _place")
    ranked = ranked.join(before, ["length", "_group"]).withColumn("_rank", F.col("_place") + F.col("_before"))
    by_length = {int(k): g.reset_index(drop=True) for k, g in slots.groupby("length")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            for length, at in pdf.groupby("length").indices.items():
                rows, rank = by_length[int(length)], pdf["_rank"].to_numpy()[at]
                k = np.searchsorted(rows["rank"].to_numpy(), rank, side="right") - 1
                nth, each = rank - rows["rank"].to_numpy()[k], rows["each"].to_numpy()[k]
                sequence[at] = rows["sequence"].to_numpy()[k] + nth // each
                offset[at] = rows["offset"].to_numpy()[k] + nth % each * length
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, f"{_PIECES}, sequence_id long, offset long")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
