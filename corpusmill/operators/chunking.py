"""Structure-aware chunking: sections of headings, oversized ones split, small ones merged, dense indexes."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.tokens import APPROXIMATE, TokenCounter

# Budgets in tokens, and separators from the coarsest to the finest.
TARGET, OVERLAP, LEAST = 900, 120, 50
SEPARATORS = ["\n\n", "\n", ". ", " "]


def cut_sections(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row a section: the documents' columns but for the body, pos, content, and the heading's level (0: none) and
    title.

    Headings are lines of one to three ``#`` and a blank, or nothing, behind them; the heading line stays in the content.
    Lines before the first heading are a section of their own. The places of headings cut the array of lines within the
    row, without a shuffle.
    """
    rows = docs.withColumn("_lines", F.split(F.col(body), "\n"))
    rows = rows.withColumn("_levels", F.expr("transform(_lines, x -> length(regexp_extract(x, '^(#{1,3})( |$)', 1)))"))
    rows = rows.withColumn("_heads", F.expr("filter(sequence(0, size(_lines) - 1), i -> _levels[i] > 0 or i = 0)"))
    section = """transform(_heads, (i, k) -> named_struct(
        'level', _levels[i], 'title', trim(substr(_lines[i], _levels[i] + 1)),
        'content', array_join(slice(_lines, i + 1, coalesce(try_element_at(_heads, k + 2), size(_lines)) - i), '\\n')))"""
    keep = [c for c in docs.columns if c != body]
    # (The outer explode keeps the optimizer from adding a filter that would compute the sections twice.)
    out = rows.withColumn("_sections", F.expr(section)).select(*keep, F.posexplode_outer("_sections").alias("pos", "_s")).where("pos is not null")
    return out.selectExpr(*keep, "pos", "_s.level as _level", "_s.title as _title", "_s.content as content")


def heading_paths(sections: DataFrame, *, key: list[str]) -> DataFrame:
    """Sections, or their parts, with heading_path in place of level and title. Which headings are open comes from windows
    over a document's sections, by the key that all later windows and merges share. A key stands for one document."""
    keep = [c for c in sections.columns if c not in ("_level", "_title")]
    by = f"over (partition by {', '.join(key)} order by pos{', part' if 'part' in keep else ''} rows between unbounded preceding and current row)"
    last = [f"last(case when _level = {n} then struct(pos as at, _title as title) end, true) {by} as _h{n}" for n in (1, 2, 3)]
    out = sections.selectExpr(*keep, *last)
    # A heading closes its own and deeper levels: a deeper one counts if it came later.
    after = lambda c, *above: f"case when {' and '.join(f'{c}.at > coalesce({a}.at, -1)' for a in above)} then {c}.title end"
    path = f"array(_h1.title, {after('_h2', '_h1')}, {after('_h3', '_h1', '_h2')})"
    return out.selectExpr(*keep, f"nullif(array_join(filter({path}, x -> x is not null and x <> ''), ' > '), '') as heading_path")


def split_by_headers(docs: DataFrame, *, key: list[str], body: str = "body") -> DataFrame:
    """One row a section: the documents' columns but for the body, pos, content, heading_path (null without a heading)."""
    return heading_paths(cut_sections(docs, body), key=key)


def recursive_split(text: str, size: int, overlap: int, count: Callable[[str], int], separators: list[str] = SEPARATORS, starts: Callable[[str], list[int]] | None = None) -> list[str]:
    """Pieces of at most ``size`` tokens where a separator allows it, each starting with up to ``overlap`` tokens of the
    one before. The separator stays in front of the part that follows it. With ``starts`` the text is cut into tokens once;
    parts are spans of it, whose tokens are those that begin there."""
    if starts is None:
        within = lambda low, high: count(text[low:high])
    else:
        begins = starts(text)
        within = lambda low, high: bisect_left(begins, high) - bisect_left(begins, low)
    out: list[str] = []

    def split(low: int, high: int, separators: list[str], n: int) -> None:
        here = next((k for k, s in enumerate(separators) if text.find(s, low, high) >= 0), None)
        if n <= size or here is None:
            out.append(text[low:high])
            return
        sep, cuts, at = separators[here], [low], text.find(separators[here], low, high)
        while at >= 0:
            cuts.append(at)
            at = text.find(sep, at + len(sep), high)
        window: deque[tuple[int, int]] = deque()  # where parts begin, and their tokens
        total, end = 0, low

        def flush() -> None:
            if window and (joined := text[window[0][0] : end].strip()):
                out.append(joined)

        for a, b in zip(cuts, [*cuts[1:], high]):
            if a == b:
                continue
            m = within(a, b)
            if m > size:
                flush()
                window.clear()
                total = 0
                split(a, b, separators[here + 1 :], m)
                continue
            if window and total + m > size:
                flush()
                while window and (total > overlap or total + m > size):
                    total -= window.popleft()[1]
            window.append((a, m))
            total, end = total + m, b
        flush()

    split(0, len(text), separators, within(0, len(text)))
    return out


def subsplit_oversized(sections: DataFrame, *, target: int = TARGET, overlap: int = OVERLAP, counter: TokenCounter = APPROXIMATE) -> DataFrame:
    """Splits sections over the budget; (pos, part) orders the pieces. Python sees the text of oversized rows only."""
    tally, starts = counter.count, counter.starts

    @F.pandas_udf("array<string>")
    def split(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda t: recursive_split(t, target, overlap, tally, starts=starts) if isinstance(t, str) else None)

    keep = [c for c in sections.columns if c != "content"]
    rows = sections.withColumn("_large", split(F.when(counter.column("content") > target, F.col("content"))))
    return rows.select(*keep, F.posexplode(F.coalesce("_large", F.array("content"))).alias("part", "content"))


def fixed_windows(sections: DataFrame, *, key: list[str], target: int = TARGET, counter: TokenCounter = APPROXIMATE) -> DataFrame:
    """A split that stays in the JVM: runs of lines whose running token count falls into one multiple of the budget."""
    keep = [c for c in sections.columns if c not in ("content", "pos", *key)]
    by = f"partition by {', '.join(key)}, pos"
    lines = sections.select(*key, "pos", *keep, F.posexplode(F.split("content", "\n")).alias("_i", "_line")).withColumn("_n", counter.column("_line"))
    bins = lines.selectExpr("*", f"floor((sum(_n) over ({by} order by _i) - _n) / {target}) as _bin")
    runs = bins.groupBy(*key, "pos", "_bin").agg(F.sort_array(F.collect_list(F.struct("_i", "_line"))).alias("_lines"), *[F.first(c).alias(c) for c in keep])
    content = F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n")
    return runs.selectExpr("*", f"cast(row_number() over ({by} order by _bin) - 1 as int) as part").select(*key, "pos", *keep, "part", content.alias("content"))


def strip_and_drop(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("content", strip("content")).where("content <> ''")


def _fold(rows: DataFrame, key: list[str], group: str) -> DataFrame:
    """Joins the contents of each group in order, with the first path and the sum of the tokens ``_t``."""
    item = F.struct("pos", "part", "content", "heading_path")
    out = rows.groupBy(*key, group).agg(F.sort_array(F.collect_list(item)).alias("_items"), F.sum("_t").cast("int").alias("_t"))
    content = F.array_join(F.transform("_items", lambda x: x["content"]), "\n\n")
    return out.select(*key, group, content.alias("content"), F.get("_items", F.lit(0))["heading_path"].alias("heading_path"), "_t")


def _recounted(rows: DataFrame, counter: TokenCounter) -> DataFrame:
    """Rows whose ``_t``, a sum over what was joined, is the count of their contents."""
    return rows if counter.additive else rows.withColumn("_t", counter.column("content"))


def _merged_small(pieces: DataFrame, key: list[str], least: int, counter: TokenCounter) -> DataFrame:
    by = f"partition by {', '.join(key)} order by pos, part"
    rows = pieces.withColumn("_t", counter.column("content"))
    rows = rows.selectExpr("*", f"row_number() over ({by}) as _k")
    starts = f"case when _k = 1 or _t >= {least} then 1 else 0 end"
    rows = rows.selectExpr("*", f"sum({starts}) over ({by} rows between unbounded preceding and current row) as grp")
    return _recounted(_fold(rows, key, "grp"), counter)


def merge_small(pieces: DataFrame, *, key: list[str], least: int = LEAST, counter: TokenCounter = APPROXIMATE) -> DataFrame:
    """A piece under ``least`` tokens joins the chunk before it, which keeps its path; islands instead of a loop."""
    return _merged_small(pieces, key, least, counter).drop("_t")


def _merged_leading(chunks: DataFrame, key: list[str], least: int, counter: TokenCounter) -> DataFrame:
    by = f"over (partition by {', '.join(key)} order by grp)"
    # Groups are numbered from 1 without gaps: the second one looks back, the first one ahead.
    rows = chunks.selectExpr("*", f"case when grp = 2 then lag(struct(content, _t)) {by} end as _before", f"coalesce(grp = 1 and _t < {least} and lead(grp) {by} = 2, false) as _moves")
    rows = rows.where("not _moves")
    joined = f"_before._t < {least}"
    cols = [f"case when {joined} then concat(_before.content, '\\n\\n', content) else content end as content", f"case when {joined} then _before._t + _t else _t end as _t"]
    return _recounted(rows.selectExpr(*key, "grp", cols[0], "heading_path", cols[1]), counter)


def merge_leading(chunks: DataFrame, *, key: list[str], least: int = LEAST, counter: TokenCounter = APPROXIMATE) -> DataFrame:
    """A first chunk under ``least`` tokens goes in front of the second, which keeps its own path; done once."""
    return _merged_leading(chunks.withColumn("_t", counter.column("content")), key, least, counter).drop("_t")


def chunk_documents(
    docs: DataFrame, *, key: list[str], body: str = "body", target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST,
    splitter: str = "recursive", counter: TokenCounter = APPROXIMATE,
) -> DataFrame:
    """Chunks of every document: key, chunk_index from 0, content, heading_path, token_count.

    splitter: ``recursive`` (overlapping pieces, Arrow), ``windows`` (fixed windows in the JVM) or ``none``. One shuffle
    deals the pieces by the key; all windows and merges share it. The recursive split comes before it, where documents are
    read.
    """
    sections = cut_sections(docs.select(*key, F.col(body).alias("_body")), "_body")
    if splitter == "recursive":
        pieces = subsplit_oversized(sections, target=target, overlap=overlap, counter=counter)
    elif splitter == "windows":
        pieces = fixed_windows(sections, key=key, target=target, counter=counter)
    else:
        pieces = sections.withColumn("part", F.lit(0))
    small = _merged_small(strip_and_drop(heading_paths(pieces, key=key)), key, least, counter)
    merged = _merged_leading(small, key, least, counter)
    index = f"cast(row_number() over (partition by {', '.join(key)} order by grp) - 1 as int) as chunk_index"
    return merged.selectExpr(*key, index, "content", "heading_path", "_t as token_count")
