"""Edit-aware token counts: a table of segment trees, one a document; only regions that edits touch are encoded anew."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage
from .tokens import Borders, borders_of, default_vocabulary, token_ids

#: Characters after which a leaf ends at the next certain border.
STRIDE = 512
#: Borders that need no vocabulary.
BORDERS = Borders()


def leaves_of(text: str, stride: int = STRIDE, border: Borders = BORDERS) -> list[str]:
    """The text in leaves: each ends at the first border behind ``stride`` characters."""
    out, start, at = [], 0, stride
    while at < len(text):
        if border(text, at):
            out.append(text[start:at])
            start, at = at, at + stride
        else:
            at += 1
    return [*out, text[start:]]


class TokenTree:
    """A binary tree over a text's leaves that keeps the sums of characters and tokens."""

    def __init__(self, text: str, count: Callable[[str], int], stride: int = STRIDE, border: Borders = BORDERS):
        self.count, self.stride, self.border = count, stride, border
        self.encoded_leaves = self.encoded_chars = 0
        self._build(leaves_of(text, stride, border), None)

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], count: Callable[[str], int], stride: int = STRIDE, border: Borders = BORDERS) -> TokenTree:
        """A tree as it was kept: nothing is encoded."""
        tree = cls.__new__(cls)
        tree.count, tree.stride, tree.border, tree.encoded_leaves, tree.encoded_chars = count, stride, border, 0, 0
        tree.width, tree.chars, tree.tokens, tree.texts = len(chars) // 2, list(chars), list(tokens), []
        at = 0
        for n in tree.chars[tree.width :]:
            tree.texts.append(text[at : at + n])
            at += n
        while len(tree.texts) > 1 and not tree.texts[-1]:
            tree.texts.pop()
        return tree

    @property
    def leaves(self) -> int:
        return sum(map(bool, self.texts)) or 1

    def _build(self, texts: list[str], tokens: list[int] | None) -> None:
        self.texts = texts
        self.width = 1 << max(0, (len(texts) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, t in enumerate(texts):
            self.chars[self.width + k], self.tokens[self.width + k] = len(t), self.count(t) if tokens is None else tokens[k]
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def __len__(self) -> int:
        return self.chars[1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and the position within it; the last leaf with text holds the end."""
        k = 1
        while k < self.width:
            k *= 2
            if position >= self.chars[k] and self.chars[k + 1]:
                position -= self.chars[k]
                k += 1
        return k - self.width, position

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        k = self.width + leaf
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replaces ``deleted`` characters from ``start`` on; what lies outside the text is cut off."""
        start = min(max(start, 0), len(self))
        end = min(start + max(deleted, 0), len(self))
        if start == end and not inserted:
            return
        a, at = self.leaf_at(start)
        b, to = self.leaf_at(max(start, end - 1)) if end > start else (a, at - 1)
        to += 1
        text = self.texts[a][:at] + inserted + self.texts[b][to:]
        # A border stands if nothing near it has changed; else the leaf on its other side takes part.
        head, tail = at, len(self.texts[b]) - to
        while a > 0 and head < self.border.context:
            a -= 1
            head += len(self.texts[a])
            text = self.texts[a] + text
        while b + 1 < len(self.texts) and tail < self.border.context:
            b += 1
            tail += len(self.texts[b])
            text += self.texts[b]
        self.encoded_leaves += sum(bool(self.texts[k]) for k in range(a, b + 1)) or 1
        for k in range(a + 1, b + 1):
            self._set(k, "", 0)
        self._set(a, text, self.count(text))
        self.encoded_chars += len(text)
        if len(text) > 8 * self.stride:  # a leaf that has grown is split, the others keep their counts
            texts, tokens = [], []
            for k, t in enumerate(self.texts):
                parts = leaves_of(t, self.stride, self.border) if k == a else [t] if t else []
                texts += parts
                tokens += [self.count(x) for x in parts] if k == a else [self.tokens[self.width + k]] * len(parts)
            self._build(texts or [""], tokens or [0])

    def text(self) -> str:
        return "".join(self.texts)


_TREE = "doc_id long, text string, chars array<int>, tokens array<int>"
_COUNTS = "tokens_before long, tokens_after long, chars_after long, edits long, leaves long, leaves_encoded long, chars_encoded long"
_EDITS = "array<struct<start:long,deleted:long,inserted:string>>"


def build_trees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, stride: int = STRIDE) -> DataFrame:
    """A tree a row: doc_id, text, and the characters and tokens of its nodes (the root at 1, the children of k at 2k and
    2k + 1, leaves last). To be kept as a table: later edits encode no leaf that they don't touch."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, border = token_ids(vocabulary), borders_of(vocabulary)
        for pdf in batches:
            trees = [TokenTree(t, lambda x: len(encode(x)) if x else 0, stride, border) for t in pdf["text"]]
            yield pdf.assign(chars=[t.chars for t in trees], tokens=[t.tokens for t in trees])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, _TREE)


def edit_trees(trees: DataFrame, edits: str | Column = "edits", *, vocabulary: str | None = None, stride: int = STRIDE, keep: bool = True) -> DataFrame:
    """The trees after each row's edits (an array of start, deleted, inserted; each on the text so far), with what was done.

    With ``keep`` the rows are trees again, to be kept in place of the old ones; else only the counts come back. Rows
    without edits never leave the JVM.
    """
    vocabulary = vocabulary or default_vocabulary()
    head = _TREE if keep else "doc_id long"
    columns = [c.split()[0] for c in head.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, border = token_ids(vocabulary), borders_of(vocabulary)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                tree = TokenTree.stored(r.text, r.chars, r.tokens, lambda t: len(encode(t)) if t else 0, stride, border)
                before, leaves = tree.total, tree.leaves
                for e in r.changes:
                    tree.edit(int(e["start"] or 0), int(e["deleted"] or 0), e["inserted"] or "")
                made = (r.doc_id, tree.text(), tree.chars, tree.tokens) if keep else (r.doc_id,)
                rows.append((*made, before, tree.total, len(tree), len(r.changes), leaves, tree.encoded_leaves, tree.encoded_chars))
            yield pd.DataFrame(rows, columns=columns + [c.split()[0] for c in _COUNTS.split(", ")])

    rows = trees.select("doc_id", "text", "chars", "tokens", (F.col(edits) if isinstance(edits, str) else edits).cast(_EDITS).alias("changes"))
    some = F.coalesce(F.size("changes") > 0, F.lit(False))
    total, leaves = F.col("tokens")[1].cast("long"), F.greatest(F.size(F.filter(F.slice("chars", F.size("chars") / 2 + 1, F.size("chars") / 2), lambda n: n > 0)), F.lit(1)).cast("long")
    none = F.lit(0).cast("long")
    same = [total.alias("tokens_before"), total.alias("tokens_after"), F.col("chars")[1].cast("long").alias("chars_after"), none.alias("edits"), leaves.alias("leaves"), none.alias("leaves_encoded"), none.alias("chars_encoded")]
    return rows.where(some).mapInPandas(run, f"{head}, {_COUNTS}").union(rows.where(~some).select(*columns, *same))


def with_edits(trees: DataFrame, edits: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Attaches an edit log (doc_id, seq, start, deleted, inserted) as the column ``edits``, in the order of ``seq``."""
    log = edits.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "deleted", "inserted"))).alias("edits"))
    log = log.select("_id", F.expr("transform(edits, e -> struct(cast(e.start as long) as start, cast(e.deleted as long) as deleted, e.inserted as inserted))").alias("edits"))
    return trees.join(log, F.col(id_col) == F.col("_id"), "left").drop("_id")


def count_tokens(docs: DataFrame, edits: Column, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, stride: int = STRIDE) -> DataFrame:
    """Tokens of every document before and after its edits, which ``edits`` makes of its doc_id and text.

    Every document gets a tree over leaves that end at places that no token crosses for certain (``tokens.Borders``); the trees are kept as a table. An edit
    changes the leaves that it touches, and neighbours where it may have moved their border; those are encoded again and
    sums are updated up to the root. Nothing is shuffled; an edit log of its own is joined by ``with_edits``, and later
    logs go to the trees that ``edit_trees`` gives back.

    Defined cases: a null text counts as empty (0 tokens), null edits as none; very long texts have as many leaves as they
    need, and only a run of letters, digits or signs in which merges may cross everywhere makes a leaf longer than usual; positions outside the text are cut to it; null and repeated ids give a row each, and equal rows equal counts; an
    empty table gives an empty result; other columns are ignored. Returns doc_id, tokens_before, tokens_after,
    chars_after, edits, leaves, leaves_encoded, chars_encoded (again, by edits).
    """
    trees = stage(build_trees(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, stride=stride), "trees")
    return edit_trees(trees, edits, vocabulary=vocabulary, stride=stride, keep=False)


def derived_edits() -> Column:
    """The query's edits: every document has words put in, a stretch taken out and one replaced, at places that depend on
    its id and length, the last at its very end."""
    n, h = "length(text)", "pmod(hash(doc_id), 1000)"
    return F.expr(f"""array(
        named_struct('start', cast({n} * {h} / 1000 as long), 'deleted', 0L, 'inserted', concat(' revision ', cast({h} as string), ' of this')),
        named_struct('start', cast({n} * pmod({h} * 7, 1000) / 1000 as long), 'deleted', 40L, 'inserted', ''),
        named_struct('start', cast({n} * pmod({h} * 13, 1000) / 1000 as long), 'deleted', 11L, 'inserted', 'replaced'),
        named_struct('start', cast({n} as long) + 100L, 'deleted', 0L, 'inserted', ' End.'))""")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), derived_edits())
