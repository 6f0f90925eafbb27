"""Periodic runs of words, by Lyndon roots under both orders.

A run with period q is at least twice as long as q; under one of the two orders of
the words, each of its Lyndon roots but a first one is the longest Lyndon word that
begins at its place. A stack scanned from right to left finds these words;
suffixes are compared, and roots extended, by the length of common extensions: some
words one by one, then a binary search over rolling hashes. Runs are verified word by
word.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.textops import batches
from docloom.session import prepare

MIN_WORDS, MIN_EXPONENT = 24, 3
#: Words compared one by one before hashes are asked.
DIRECT = 8
_PRIME = (1 << 61) - 1
# Bases of the rolling hash, one after another if a run fails its check.
_BASES = (1_000_003_579_201, 760_231_057_432_109, 31_415_926_535_897, 2_718_281_828_459)


class Words:
    """A text's words as numbers, with common extensions in both directions."""

    def __init__(self, ids: list[int], base: int):
        self.ids, self.n, self.base, self.run = ids, len(ids), base, None

    def _hashes(self) -> None:
        base = self.base
        self.run = list(accumulate(self.ids, lambda h, x: (h * base + x + 1) % _PRIME, initial=0))
        self.power = list(accumulate(range(self.n), lambda p, _: p * base % _PRIME, initial=1))

    def ahead(self, i: int, j: int) -> int:
        """The words that the suffixes from i and from j > i on have in common."""
        ids, most, k = self.ids, self.n - j, 0
        some = min(most, DIRECT)
        while k < some and ids[i + k] == ids[j + k]:
            k += 1
        if k < some or k == most:
            return k
        if self.run is None:
            self._hashes()
        run, power, low, step = self.run, self.power, k, DIRECT
        # all of ``low`` are common; steps double, then halve
        high = most + 1
        while low + 1 < high:
            mid = min(low + step, high - 1) if step else (low + high) // 2
            p = power[mid]
            if (run[i + mid] - run[i] * p - run[j + mid] + run[j] * p) % _PRIME == 0:
                low, step = mid, 2 * step
            else:
                high, step = mid, 0
        return low

    def behind(self, i: int, j: int) -> int:
        """The words that the prefixes before i and before j > i end with in common."""
        ids, k = self.ids, 0
        some = min(i, DIRECT)
        while k < some and ids[i - k - 1] == ids[j - k - 1]:
            k += 1
        if k < some or k == i:
            return k
        if self.run is None:
            self._hashes()
        run, power, low, step = self.run, self.power, k, DIRECT
        high = i + 1
        while low + 1 < high:
            mid = min(low + step, high - 1) if step else (low + high) // 2
            p = power[mid]
            if (run[i] - run[i - mid] * p - run[j] + run[j - mid] * p) % _PRIME == 0:
                low, step = mid, 2 * step
            else:
                high, step = mid, 0
        return low


def lyndon_ends(words: Words, rising: bool) -> list[int]:
    """Past-the-end places of the longest Lyndon word from each place on, in the order
    of the numbers or its reverse: the next place whose suffix is smaller; what ends
    first is smaller in both. The ends of the words that follow are the stack."""
    ids, n, ahead = words.ids, words.n, words.ahead
    end = [n] * (n + 1)
    for i in range(n - 2, -1, -1):
        x, j = ids[i], i + 1
        while j < n:
            y = ids[j]
            if x == y:
                k = ahead(i, j)
                if j + k == n:
                    break
                if (ids[i + k] < ids[j + k]) != rising:
                    break
            elif (x < y) != rising:
                break
            j = end[j]
        end[i] = j
    return end


def runs_with(words: Words, min_words: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """start, length and period of the runs of ``min_words`` words and ``min_exponent``
    periods at least (two or more)."""
    n, found = words.n, set()
    ids = np.array([*words.ids, -1])
    for rising in (True, False):
        end = lyndon_ends(words, rising)
        upto: dict[int, int] = {}  # where the last run of each period ends
        to = np.array(end[: n - 1])
        # a run of two periods goes on at one side of its root at least
        goes = ids[: n - 1] == ids[to]
        goes[1:] |= ids[: n - 2] == ids[to[1:] - 1]
        for i in np.flatnonzero(goes).tolist():
            j = end[i]
            q = j - i
            if upto.get(q, 0) >= j:  # a root of a run that is known
                continue
            back = words.behind(i, j)
            length = back + q + (words.ahead(i, j) if j < n else 0)
            if length >= 2 * q:
                upto[q] = i - back + length
                if length >= max(min_words, min_exponent * q):
                    found.add((i - back, length, q))
    return found


def is_run(ids: list[int], start: int, length: int, period: int) -> bool:
    """Whether words so far apart are equal in a stretch, and no longer beside it."""
    end = start + length
    return (
        ids[start : end - period] == ids[start + period : end]
        and (start == 0 or ids[start - 1] != ids[start - 1 + period])
        and (end == len(ids) or ids[end] != ids[end - period])
    )


def runs(tokens: list, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """The runs of a list of words, by start, then period."""
    numbers: dict = {}
    ids = [numbers.setdefault(t, len(numbers)) for t in tokens]
    if len(ids) < max(min_words, 2):
        return []
    for base in _BASES:
        found = sorted(runs_with(Words(ids, base), min_words, min_exponent), key=lambda r: (r[0], r[2]))
        if all(is_run(ids, *r) for r in found):
            return found
    raise ValueError("rolling hashes of all bases collide")


def collapsed(tokens: list, found: list[tuple[int, int, int]]) -> list:
    """The words but those that a run holds after its first period."""
    drop = bytearray(len(tokens))
    for start, length, period in found:
        drop[start + period : start + length] = b"\1" * (length - period)
    return [t for t, d in zip(tokens, drop) if not d] if found else tokens


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then
    period) and collapsed (the kept words, joined by single blanks) of each document
    of ``docs`` (doc_id, text).

    A run is a longest stretch of words (maximal runs of bytes outside
    ``\\x20\\x09-\\x0D``) with a smallest period, of ``min_words`` words and
    ``min_exponent`` periods at least; collapsing leaves its first period.
    Null and empty texts have no words; repeated rows and rows without an id are
    documents each. Texts are whole: one is held at a time beside its words' hashes, and
    work is some steps a word, with a logarithm where the text repeats. No rows
    move. An empty table gives no rows, other columns are left out.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    prepare(docs.sparkSession)

    def run(arrow_batches):
        for batch in arrow_batches:
            pairs = ((i, (t.as_py() or "").encode("utf-8", "surrogatepass")) for i, t in enumerate(batch.column(1)))
            for some in batches(pairs, lambda p: len(p[1]), 4 << 20):
                sizes, spans, texts = [], [], []
                for _, raw in some:
                    tokens = raw.split()  # of bytes: blanks are those six
                    found = runs(tokens, min_words, min_exponent)
                    sizes.append(len(tokens))
                    spans.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    texts.append(b" ".join(collapsed(tokens, found)).decode("utf-8", "surrogatepass"))
                at = pa.array([i for i, _ in some], pa.int64())
                columns = [batch.column(0).take(at), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(_RUN)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
