"""The Merkle manifest against a tree that is built node by node."""

import zlib
from hashlib import sha256

from corpusmill.llm import merkle
from corpusmill.llm.merkle import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def ways_of(nodes):
    """The root and, for each node, (sibling on the left, sibling on the right) level by level."""
    ways, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        pairs = [list(range(k, min(k + 2, len(nodes)))) for k in range(0, len(nodes), 2)]
        for p in pairs:
            for x in p:
                for w in at[x]:
                    ways[w].append(([nodes[y] for y in p if y < x], [nodes[y] for y in p if y > x]))
        at = [[w for x in p for w in at[x]] for p in pairs]
        nodes = [digest(*(nodes[x] for x in p)) for p in pairs]
    return nodes[0], ways


def brute(rows):
    groups = {}
    for r in rows:
        doc_id, text, lang, source, n = r[:5]
        leaf = leaf_of(doc_id, source, lang, n, text)
        bad = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, leaf_of(doc_id, source, lang, n + 1, text) if bad else leaf))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: x[0])
        trees[g] = ways_of([x[2] for x in groups[g]])
    root, above = ways_of([trees[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, up in zip(langs, above):
        subroot, ways = trees[g]
        for (_, doc_id, leaf, now), way in zip(groups[g], ways):
            for left, right in way + up:
                now = digest(*left, now, *right)
            out.append((doc_id, leaf, subroot, root, digest(*(s for left, right in way + up for s in left + right)), now, now == root))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


def check(spark, rows):
    got = [tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [tuple(r) for r in manifest(docs).collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(got) == sorted(brute(rows))
    assert {r[6] for r in got} == {True, False}


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, "x", "y"), (None, "", None, "s", 3, "x", "y"), (5, "a" * 100_000, "", None, 1, None, None), (-9, "é", "zz", "s", None, None, None)]
    rows += [(k * 2**40 - 2**62, "t", "en", "s", k, None, None) for k in range(40)] + [(-(2**63), "t", "en", "s", 1, None, None), (2**63 - 1, "t", "en", "s", 2**63 - 1, None, None)]
    rows += [(7, f"text {k % 30}", "en", "s", 1, None, None) for k in range(600)] + [(8, "t", "en", "s", 1, None, None), (6, "t", "en", "s", 1, None, None)]
    rows += [(k, "t", "é" if k % 2 else "z", "s", k, None, None) for k in range(515)]
    check(spark, rows)


def test_one_and_none(spark):
    assert len(check(spark, [(1, "t", "en", "s", 1, None, None)])) == 1
    assert check(spark, []) == []


def test_many_languages(spark):
    check(spark, [(k, "t", f"l{k}", "s", k, None, None) for k in range(300)])


def test_texts_are_not_shuffled_and_nothing_is_sorted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = merkle.ranked(merkle.leaf_rows(docs))._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
