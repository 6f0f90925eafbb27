"""Quality rules: base counts and tokeniser fertility with bands per language."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.textops import batches, hash_shingles, hash_words
from docloom.llm.tokens import piece_bpe
from docloom.session import Scratch, prepare

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A measure is outside its band beyond so many interquartile ranges.
SPREAD = 2.5
#: A range is taken as at least this wide, so that uniform groups reject nothing near.
LEAST_RANGE = {"chars_per_token": 0.1, "letters_per_token": 0.14, "byte_share": 0.01, "token_entropy": 0.02}
MEASURES = tuple(LEAST_RANGE)
_SPACES = " \t\n\v\f\r"
_OTHER = np.array([i < 128 and not chr(i).isalpha() and chr(i) not in _SPACES for i in range(256)])
SCHEMA = (
    "doc_id long, lang string, h long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, letters_per_token double, byte_share double, token_entropy double"
)
_ARROW = pa.schema([
    pa.field(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t])
    for n, t in (c.split() for c in SCHEMA.split(", "))
])


@functools.lru_cache(maxsize=65536)
def _script(char: str) -> str:
    return unicodedata.name(char, "NONE").split(" ")[0] if char.isalpha() else ""


def script(text: str) -> str:
    """The script most letters of a text are of, as Unicode names begin; ties go
    to the first in order; NONE without letters."""
    chars, counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)
    found: dict[str, int] = {}
    for c, n in zip(chars.tolist(), counts.tolist()):
        if name := _script(chr(c)):
            found[name] = found.get(name, 0) + n
    return min(found, key=lambda s: (-found[s], s)) if found else "NONE"


def repeated_words(words: np.ndarray, window: int = 3) -> int:
    """Words inside windows that occur at least twice."""
    every = hash_shingles(words, window)
    if len(every) < 2:
        return 0
    s = np.sort(every)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    covered = np.zeros(len(words), dtype=bool)
    at = np.flatnonzero(np.isin(every, twice))
    for i in range(window):
        covered[at + i] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def other_characters(data: bytes) -> int:
    """ASCII digits, signs and controls, white space aside."""
    return int(_OTHER[np.frombuffer(data, dtype=np.uint8)].sum())


def fertility(ids: np.ndarray, chars: int, letters: int, is_byte: np.ndarray) -> tuple[float, float, float, float]:
    """Characters and letters per token, share of byte-fallback tokens, and the
    entropy of tokens as a share of its most for so many tokens; zeros without
    tokens."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    if n > 4000:
        counts = np.bincount(ids)
        counts = counts[counts > 0]
    else:
        s = np.sort(ids)
        counts = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])))
    p = counts / n
    entropy = float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 0.0
    return chars / n, letters / n, float(is_byte[ids].sum() / n), entropy


def measures(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Counts and fertility measures of each document (doc_id, text, lang)."""
    prepare(docs.sparkSession)
    path = public_tokenizers.path(model)

    def run(arrow_batches):
        encoder = piece_bpe(path)
        for batch in arrow_batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            out = []
            for some in batches(rows, lambda r: len(r[1] or ""), 1 << 20):
                texts = [(r[1] or "") for r in some]
                raw = [t.encode() for t in texts]
                hashes, first, _, _ = hash_words(raw)
                for (doc_id, _, lang, h), text, data, a, b in zip(some, texts, raw, first[:-1].tolist(), first[1:].tolist()):
                    words = data.decode().translate(_TO_SPACE).split(" ")
                    words = [w for w in words if w]
                    chars = len(text) - sum(map(text.count, _SPACES))
                    ids = encoder.ids(words)
                    out.append((
                        doc_id, lang, h, lang if lang is not None else "script " + script(text), b - a, chars,
                        sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(hashes[a:b]), len(ids),
                        *fertility(ids, chars, chars - other_characters(data), encoder.is_byte),
                    ))
            columns = zip(*out) if out else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return docs.select(
        docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["lang"].cast("string"), F.xxhash64(docs["text"]).alias("h")
    ).mapInArrow(run, SCHEMA)


_TO_SPACE = {ord(c): " " for c in _SPACES}


def judge(measured: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Adds base_failed and kept. A band of a language (of a script where the
    language is null) is the quartiles of its documents that pass the base rules,
    widened by ``spread`` interquartile ranges; it counts every document."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    known = measured.withColumn("base_failed", base)
    bands = None
    for m in MEASURES:
        counts = known.where("NOT base_failed").groupBy("band", F.round(m, 3).alias("m")).count()
        q = counts.groupBy("band").agg(F.percentile("m", F.array(F.lit(0.25), F.lit(0.75)), F.col("count")).alias("q"))
        wide = spread * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_RANGE[m]))
        one = q.select("band", (F.col("q")[0] - wide).alias(f"{m}_low"), (F.col("q")[1] + wide).alias(f"{m}_high"))
        bands = one if bands is None else bands.join(one, "band")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    return known.join(bands, "band", "left").withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False)))


def quality(docs: DataFrame, spread: float = SPREAD, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang), with counts, the
    fertility measures, their band and ``kept``.

    Words are runs outside ``\\x20\\x09-\\x0D`` and are tokenised each on its own
    with a byte-fallback vocabulary. A null text is empty: no words, so
    base_failed. An empty table gives no rows; repeated rows are judged each.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    return judge(scratch.keep(measures(docs), "measures"), spread)
