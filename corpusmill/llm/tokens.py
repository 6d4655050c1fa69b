"""Public byte-level BPE ids, from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte: itself, or one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE whose ids follow its merges; None for any other model."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        return None
    signs, special = _byte_signs(), {t["content"] for t in spec.get("added_tokens", [])}
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(w) for w in joined]
    if None in ids or ids != sorted(ids) or (ids and ids[0] < 256):
        return None
    return {bytes(signs[c] for c in w): i for w, i in model["vocab"].items() if w not in special}


@lru_cache(maxsize=4)
def token_ids(vocabulary: str) -> Callable[[str], list[int]]:
    """text -> ids, those of ``Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False)``.

    By ranks, a byte-level BPE gives the same ids four times as fast as by merges; a file of another kind is read by its
    own library. The string of a special token is that token.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    if (ranks := byte_ranks(spec)) is not None:
        import public_tokenizers
        import tiktoken

        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        made = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: made.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return lambda text: t.encode(text, add_special_tokens=False).ids


class Borders:
    """Places where a text can be cut so that the tokens of both parts are those of the whole, whatever else it holds.

    That is known of byte-level BPE with the usual pattern: (1) before white space, as no pre-token goes on from anything
    else into it; (2) between a letter, a digit and a sign, but not behind an apostrophe, which may begin a contraction;
    (3) within a run of one kind where no token has the last byte of one character and the first byte of the next side by
    side, so that no merge can cross. ``pairs`` are the pairs of bytes that tokens have; without them (3) is not known. No
    place within the string of a special token is a border. Only ``context`` characters on either side matter.
    """

    def __init__(self, pairs: frozenset[tuple[int, int]] | None = None, special: tuple[str, ...] = ()):
        self.pairs, self.special = pairs, special
        self.context = max(3, *(len(s) for s in special), 3)

    def __call__(self, text: str, at: int) -> bool:
        if not 0 < at < len(text):
            return False
        a, b = text[at - 1], text[at]
        if a.isspace() or (b.isspace() and b not in " \t\n\r"):  # of other blanks not all engines think alike
            return False
        if not b.isspace():
            x, y = unicodedata.category(a)[0], unicodedata.category(b)[0]
            if "C" in (x, y) or "'" in (a, b) and (a == "'" or x not in "LN"):
                return False
            if (x if x in "LN" else "S") == (y if y in "LN" else "S"):
                if self.pairs is None or text[max(0, at - 2)] == "'":
                    return False
                if (a.encode("utf-8", "replace")[-1], b.encode("utf-8", "replace")[0]) in self.pairs:
                    return False
        return not any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in self.special)


@lru_cache(maxsize=4)
def borders_of(vocabulary: str) -> Borders:
    """The borders that a vocabulary file allows; of a file of another kind only those before white space are used."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = tuple(t["content"] for t in spec.get("added_tokens", []))
    if (ranks := byte_ranks(spec)) is None:
        return BlankBorders(None, special)
    return Borders(frozenset(p for w in ranks for p in zip(w, w[1:])), special)


class BlankBorders(Borders):
    """One blank between others."""

    def __call__(self, text: str, at: int) -> bool:
        return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace() and super().__call__(text, at)
