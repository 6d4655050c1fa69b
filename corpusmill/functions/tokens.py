"""Token counters: an approximation without a vocabulary, which stays in the JVM, or the count of a vocabulary file."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import approx_tokens


@dataclass(frozen=True)
class TokenCounter:
    """One count in two shapes: of a text, and of a column. Splitting, merging, counting and cost use the same counter.

    ``starts`` gives the places at which a text's tokens begin, where a cut before white space or a full stop changes none.
    ``additive``: texts joined by line ends have the tokens of all, so that what is joined needn't be counted again.
    """

    count: Callable[[str], int]
    column: Callable[[Column | str], Column]
    starts: Callable[[str], list[int]] | None = None
    additive: bool = False


#: ``functions.text.TOKEN`` in Python's own notation.
_TOKEN = re.compile(r"\w+|[^\w \t\n\r\f]")
#: Runs of letters, digits and underscores, and single other signs.
APPROXIMATE = TokenCounter(lambda text: len(_TOKEN.findall(text)), approx_tokens, lambda text: [m.start() for m in _TOKEN.finditer(text)], True)


#: Characters of the texts that the vocabulary encodes at once: an encoding holds about a hundred bytes a token.
SLICE = 1 << 18


def slices(texts: pa.Array, size: int | None = None) -> Iterator[list[str]]:
    """The texts of an Arrow array in order (null: empty), in lists of at most about ``size`` characters, or of one text."""
    size = size or SLICE
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield [t or "" for t in texts.slice(low, high - low).to_pylist()]
        low = high


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_counter(path: str) -> TokenCounter:
    """Counts by a tokenizer file, which each worker reads once; texts go there in Arrow batches, of which a slice at a time
    is encoded, so that a worker holds the encodings of few texts."""

    @F.arrow_udf("int")
    def counts(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in it:
            yield pa.array([len(e) for part in slices(s) for e in _tokenizer(path).encode_batch_fast(part, add_special_tokens=False)], pa.int32())

    return TokenCounter(lambda text: len(_tokenizer(path).encode(text, add_special_tokens=False).ids), lambda c: counts(F.col(c) if isinstance(c, str) else c))
