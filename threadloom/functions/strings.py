"""Columns over strings: byte view, letter codes, bounded edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.params import ALPHABETS


def as_bytes(s: Column) -> Column:
    """The string with one character for each of its UTF-8 bytes, so that lengths and edits count bytes."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def letter_code(c: Column, alphabet: int) -> Column:
    """Code of a one-character string; 0 for the first letter and for whatever the alphabet lacks."""
    return F.greatest(F.instr(F.lit(ALPHABETS[alphabet]), c) - 1, F.lit(0))


def letter_codes(s: Column, alphabet: int) -> Column:
    """Codes of all characters; none for an empty string."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: letter_code(c, alphabet))


def edit_distance(a: Column, b: Column, k: int) -> Column:
    """Unit-cost edit distance of two strings, -1 if it exceeds ``k``; null if one is null."""
    return F.levenshtein(a, b, k)


def once(c: Column) -> Column:
    """An integer column that a filter on it does not compute a second time: it counts as not deterministic."""
    return c + (F.monotonically_increasing_id() < 0).cast("int")


def bit_distance(a: str, b: str, k: int) -> int:
    """The same distance of two Python strings, a column of the table at a time as the bits of integers (Myers, in
    Hyyrö's form), so long strings take a step for each letter; -1 if it exceeds ``k``."""
    if abs(len(a) - len(b)) > k:
        return -1
    if not a or not b:
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    size = len(a)
    full, high = (1 << size) - 1, 1 << (size - 1)
    more, less, score, left = full, 0, size, len(b)
    for c in b:
        left -= 1
        same = places.get(c, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up = less | (full & ~(across | more))
        fall = more & across
        if up & high:
            score += 1
        elif fall & high:
            score -= 1
        if score - left > k:
            return -1
        up = (up << 1 | 1) & full
        more = (fall << 1 & full) | (full & ~(down | up))
        less = up & down
    return score if score <= k else -1
