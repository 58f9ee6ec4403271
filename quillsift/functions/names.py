"""Folding and closeness of names, for the driver and for Python workers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

# Confusions of optical character recognition, applied in this order.
OCR_CONFUSIONS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("1", "l"), ("0", "o"), ("5", "s"))

_MARKS = regex.compile(r"\p{M}+")
_ASCII_REST = regex.compile(r"[^a-z0-9]+")
_BREAKS = regex.compile(r"[^\p{L}\p{N}]+")


def normalise(text: str) -> str:
    """Lower case without accents and apostrophes; every other run of non-alphanumerics is one space."""
    bare = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().replace("'", "").replace("’", "")
    return _BREAKS.sub(" ", bare)


def squeeze(text: str) -> str:
    if text.isascii():  # nothing to decompose
        low = text.lower()
        return low if low.isalnum() else _ASCII_REST.sub("", low)
    return normalise(text).replace(" ", "")


#: Letters of the longest words that are remembered, so that memories are bounded in bytes too.
REMEMBERED = 64


def ocr_fold(text: str) -> str:
    """The squeezed text as a careless reader sees it: Kirn and Kim are one."""
    return _remembered_fold(text) if len(text) <= REMEMBERED else _fold(text)


def _fold(text: str) -> str:
    out = squeeze(text)
    for seen, meant in OCR_CONFUSIONS:
        out = out.replace(seen, meant)
    return out


_remembered_fold = lru_cache(maxsize=50_000)(_fold)


def within(a: str, b: str, most: int) -> bool:
    """Whether the optimal string alignment distance is at most ``most``: only the band that can matter is computed."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    far = most + 1
    two: list[int] = []
    one = [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, two[j - 2] + 1)
            row[j] = min(cost, far)
        if min(row) > most:
            return False
        two, one = one, row
    return one[len(b)] <= most


def reach(name: str) -> int:
    """Edits that a name may be off where matching is loose."""
    return 1 if len(name) < 5 else 2


def utf8(text: str) -> str:
    """A letter for each byte of the text's UTF-8."""
    return text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("latin-1")


def near(word: str, name: str, in_bytes: bool = False) -> bool:
    """``in_bytes``: edits are counted in bytes of UTF-8, as DuckDB's distances do, instead of letters."""
    return within(utf8(word), utf8(name), reach(name)) if in_bytes else within(word, name, reach(name))


def alike(word: str, name: str, beside_exact: bool = False) -> bool:
    """Equal, or one edit off a name of 4 letters; beside an exactly matched part, of 3 letters too."""
    if word == name:
        return True
    if len(name) >= 4:
        return within(word, name, 1)
    return beside_exact and len(name) == 3 and len(word) >= 2 and within(word, name, 1)


def deletions(word: str, depth: int) -> set[str]:
    """All strings left by deleting at most ``depth`` characters."""
    reached = {word}
    latest = {word}
    for _ in range(depth):
        latest = {w[:i] + w[i + 1 :] for w in latest for i in range(len(w))} - reached
        reached |= latest
    return reached
