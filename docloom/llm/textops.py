"""Vectorised word and shingle hashing shared by the text operators.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; ``bytes.lower``
folds A-Z only. Hashes are 64 bit, equal on every machine and run.
"""

from __future__ import annotations

import numpy as np

_RATIO = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_RATIO), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PLACE = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        for i, base in enumerate((_RATIO, _INVERSE)):
            have = _powers[i]
            step = np.uint64(pow(int(base), len(have), 1 << 64))
            _powers[i] = np.concatenate([have, have * step])
    return _powers[0], _powers[1]


def hash_words(texts: list[bytes], separators: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``; where each text's words begin (len + 1
    entries); and each word's first and past-the-end byte in the joined texts.
    ``separators`` tells for each byte whether it ends a word; a line feed does.
    With ``prefixes``, the words' hashes have the hashes of their first so many
    bytes below, a row for each size; 0 where a word is not longer."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    space = separators[joined]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(joined))
    run = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[joined] * power[: len(joined)], out=run[1:])
    words = mix64((run[end] - run[begin]) * inverse[begin])
    if prefixes:
        rows = [words]
        for n in prefixes:
            at = np.minimum(begin + n, end)
            some = mix64((run[at] - run[begin]) * inverse[begin] + np.uint64(n))
            rows.append(np.where(begin + n < end, some, np.uint64(0)))
        words = np.stack(rows)
    first = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    return words, first, begin, end


def hash_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; k - 1 fewer than words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = words[:n] * _PLACE[0]
    for i in range(1, k):
        total += words[i : i + n] * _PLACE[i]
    return mix64(total)


def hash_sequence(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words, of any length."""
    place = _PLACE[np.arange(len(words)) % 64]
    total = np.uint64((words * place).sum(dtype=np.uint64))
    return mix64(np.array([total + np.uint64(len(words))], dtype=np.uint64))[0]


def shingle_sets(texts: list[bytes], k: int = 5):
    """Yields each text's distinct shingle hashes, ascending. A text of fewer
    than k words has its whole sequence as its one shingle, one without words
    has none."""
    words, first, _, _ = hash_words(texts)
    every = hash_shingles(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield np.array([hash_sequence(words[a:b])], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def batches(rows, size_of, limit: int):
    """Lists of rows of about ``limit`` bytes each; a larger row comes alone."""
    some, held = [], 0
    for row in rows:
        n = size_of(row)
        if some and held + n > limit:
            yield some
            some, held = [], 0
        some.append(row)
        held += n
    if some:
        yield some
