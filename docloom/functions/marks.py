"""Combining marks without Python workers: column expressions from tables of unicodedata."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_L, _V, _T = 19, 21, 28  # Hangul syllables are counted by three letters


def plain(text: str) -> str:
    """``strip_combining`` of one text."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")


@cache
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, int]]:
    """Characters that become one other, those that become several, and marks beyond
    U+0300 to U+036F with their class."""
    one, many, marks = {}, {}, {}
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            to = plain(c)
            (one if len(to) == 1 else many)[c] = to
        if unicodedata.combining(c) and not "̀" <= c <= "ͯ":
            marks[c] = unicodedata.combining(c)
    return one, many, marks


def _class(chars) -> str:
    """Characters as the inside of a class of a pattern."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _hangul(c: Column) -> Column:
    n = F.ascii(c) - 0xAC00
    of = lambda first, size, at: F.element_at(F.array(*[F.lit(chr(first + i)) for i in range(size)]), at.cast("int") + 1)
    last = F.when(n % _T == 0, "").otherwise(of(0x11A7, _T, n % _T))
    parts = F.concat(of(0x1100, _L, F.floor(n / (_V * _T))), of(0x1161, _V, F.floor(n % (_V * _T) / _T)), last)
    return F.when((c >= "가") & (c <= "힣"), parts)


def strip_combining(text: Column) -> Column:
    """As ``text.strip_combining`` of texts that are not null, in the JVM: most characters
    are one table, and only texts with others (Hangul, marks of other scripts,
    which stand in the order of their classes) are taken apart."""
    one, many, marks = _tables()
    many_class, mark_class = _class(many) + r"\x{AC00}-\x{D7A3}", _class(marks)
    gone = "".join(map(chr, range(0x300, 0x370)))
    most = F.translate(text, "".join(one) + gone, "".join(one.values()))
    apart = F.array_join(F.transform(_letters(most), lambda c: F.coalesce(F.when(c.rlike(f"[{many_class}]"), F.coalesce(_hangul(c), F.element_at(_map(many), c))), c)), "")
    runs = F.regexp_extract_all(apart, F.lit(f"(?s)([{mark_class}]+|[^{mark_class}]+)"), F.lit(1))
    ranked = lambda run: F.array_sort(F.transform(_letters(run), lambda c, i: F.struct(F.element_at(_map(marks), c).alias("rank"), i.alias("i"), c.alias("c"))))
    order = lambda run: F.when(run.rlike(f"^[{mark_class}]{{2}}"), F.array_join(F.transform(ranked(run), lambda x: x["c"]), "")).otherwise(run)
    whole = F.array_join(F.transform(runs, order), "")
    return F.when(F.octet_length(text) == F.length(text), text).when(text.rlike(f"[{many_class}{mark_class}]"), whole).otherwise(most)
