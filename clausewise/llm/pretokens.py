"""Vectorised pre-token boundaries of the byte-level BPE vocabularies.

The split pattern of these vocabularies takes, in turn, contractions, runs of letters, of
numbers and of other visible characters (each with one leading space), and white space, whose
last character before a visible one is left to what follows. Each of these is a matter of
where the class of a character differs from its neighbour's, so one numpy pass finds all
boundaries of many texts.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import regex

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that an apostrophe splits off.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _newer() -> dict[int, int]:
    """Letters and numbers that Python's Unicode tables lack and the tokenizer libraries know."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    found = {}
    for m in regex.finditer(r"[\p{L}\p{N}]", "".join(chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) == "Cn")):
        for lead, kind in (("a", LETTER), ("1", NUMBER)):
            if len(split(lead + m[0])) == 1:
                found[ord(m[0])] = kind
    return found


@cache
def classes() -> np.ndarray:
    """Class of every code point, as the tokenizer libraries have it."""
    table = np.full(0x110000, OTHER, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for i in range(0x110000):
        k = kind.get(unicodedata.category(chr(i))[0])
        if k:
            table[i] = k
    for i, k in _newer().items():
        table[i] = k
    table[WHITE_SPACE] = SPACE
    return table


def boundaries(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts whose code points `cp` follow each other.

    `first` has the start of each non-empty text.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    text_start[n] = True
    run = text_start[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    visible = kind != SPACE
    blank = cp == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~text_start[:n]
    start = run & ~(visible & after_blank)
    # the last white-space character before a visible one starts a token: its own, or the visible one's
    lead = np.zeros(n, bool)
    lead[:-1] = ~visible[:-1] & visible[1:] & ~text_start[1:n]
    start |= lead
    for i in np.flatnonzero((cp == 0x27) & run & ~after_blank):
        if i + 1 >= n or text_start[i + 1] or kind[i + 1] != LETTER:
            continue
        for end in ENDINGS:
            to = i + 1 + len(end)
            if to <= n and not text_start[i + 1 : to].any() and all(cp[i + 1 + j] == ord(c) for j, c in enumerate(end)):
                start[i + 1] = False
                if to < n and kind[to] == LETTER and not text_start[to]:
                    start[to] = True
                break
    return np.flatnonzero(start)


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of the texts in order, and the number of each text's."""
    whole = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    starts = boundaries(cp, (ends - sizes)[sizes > 0])
    counts = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - sizes)
    at = starts.tolist()
    return [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)])], counts
