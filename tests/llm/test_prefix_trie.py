"""The prefix trie against one that is built turn by turn, and its hash table."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import prefix_trie as pt
from corpusmill.llm.perfect_hash import PerfectHash

SCHEMA = "conv_id long, turn long, role string, text string, pos string, depth string"


def rem(a, b):
    return a - int(a / b) * b


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    said = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {c: said.get(c - rem(c, 100), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in said.items()}
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    ]


def check(spark, rows):
    got = [tuple(r) for r in pt.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert len(check(spark, [(*r, None, None) for r in rows])) > 20


def test_odd_rows(spark):
    rows = [(None, 1, "a", "b", None, None), (0, None, None, None, "x", "y"), (0, 0, "u", "é🎉", None, None), (0, 0, "u", "é🎉", None, None), (0, 0, "a", "x" * 50_000, None, None)]
    rows += [(-k, t, "u", f"t{t % 2}", None, None) for k in (5, 100, 150) for t in range(4)] + [(2**63 - 1, 0, "u", "last", None, None), (-(2**63), 0, "u", "least", None, None)]
    rows += [(c, t, "u" if t % 2 else "a", f"turn {t if t < 3 else t * (c % 3)}", None, None) for c in range(100, 180) for t in range(c % 7)]
    check(spark, rows)
    assert check(spark, []) == []


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 8)
    monkeypatch.setattr(pt, "SHARD", 50)
    monkeypatch.setattr(pt, "JOINED", 3)
    rows = [(c, t, "u", "same" if t < c else f"{c} {t}", None, None) for c in (0, 5, 20, 24, 30, 61, 62, 170) for t in range(8 * (c % 9))]
    rows += [(c, t, "u", "copy", None, None) for c in range(200, 240) for t in range(17)]
    check(spark, rows)


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=300, unique=True))
@settings(max_examples=60, deadline=None)
def test_slots_are_minimal_and_verified(keys):
    a, b = (np.array([k[i] for k in keys], dtype=np.uint64) for i in (0, 1))
    table = PerfectHash(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(len(keys)))
    assert (table.slots(a, b + np.uint64(4)) == -1).all()


def test_shared_slots_are_an_error(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(pt, "_keys", lambda d, a, b: (np.zeros(len(d), dtype=np.uint64), np.zeros(len(d), dtype=np.uint64)))
    rows = pd.DataFrame({"conv_id": [1, 1], "depth": [0, 1], "k1": [0, 5], "k2": [0, 6], "chars": [0, 2], "total": [1, 1], "bucket": [0, 0], "block": [0, 0]})
    with pytest.raises(RuntimeError):
        pt.build_table(rows)
