"""Near duplicates where ids repeat: each row is classed by its text, in any order of rows."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import corpus_pipeline
from corpusmill.llm import near_dedup

WORDS = {k: [f"{k}{i}" for i in range(60)] for k in "abc"}


def text(name):
    """A base text, or, with digits behind its letter, one with words added."""
    return " ".join(WORDS[name[0]] + [f"more{d}" for d in name[1:]])


def brute(rows):
    """(doc_id, text, class, kept) by all pairs of rows."""
    s = [near_dedup.shingle_hashes(near_dedup.word_hashes(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and near_dedup.aligned(s[i], s[j]):
                root[find(i)] = find(j)
    classes = {}
    for k, r in enumerate(rows):
        classes.setdefault(find(k), []).append(r)
    sha = __import__("hashlib").sha256
    least = {k: min((d, sha(t.encode()).hexdigest()) if d is not None else (None, "") for d, t in v) for k, v in classes.items()}
    return sorted((str(d), sha(t.encode()).hexdigest(), str(least[find(k)][0]), d is None or (d, sha(t.encode()).hexdigest()) == least[find(k)]) for k, (d, t) in enumerate(rows))


def result(spark, rows):
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((str(r["doc_id"]), r["text_sha256"], str(r["class_id"]), r["kept"]) for r in out)


def test_an_id_with_two_texts(spark):
    rows = [(3, text("a")), (5, text("a1")), (5, text("b")), (7, text("b1"))]
    want = brute(rows)
    assert [w[2] for w in want] == [str(x) for x in (3, *([3, 5] if want[1][2] == "3" else [5, 3]), 5)]
    for order in (rows, rows[::-1], [rows[0], rows[2], rows[1], rows[3]]):
        assert result(spark, order) == want


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.sampled_from(["a", "a1", "a12", "b", "b1", "c"])), max_size=10), st.randoms())
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_order(spark, named, rng):
    rows = [(d, text(n)) for d, n in named]
    want = brute(rows)
    rng.shuffle(rows)
    assert result(spark, rows) == want


def test_the_pipeline_loses_no_text_without_a_copy(spark):
    rows = [(3, "a"), (5, "a1"), (5, "b"), (7, "b1"), (7, "c"), (None, "a"), (9, "a12")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(d, text(n), "en", "s", 1, "x", 1) for d, n in rows], "doc_id long, text string, lang string, source string, n_chars long, _sha string, _keep long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(kept, key=str) == sorted([(3, text("a")), (5, text("b")), (7, text("c")), (None, text("a"))], key=str)
