"""Order MinHash fingerprints, sensitive to edit distance."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.textops import mix64
from docloom.session import Scratch, prepare

#: Code points of a k-mer, buckets of the signature, and k-mers kept in each.
K, BUCKETS, KEPT = 8, 64, 2
_POSITION = np.uint64((1 << 26) - 1)
_BELOW = np.uint64((1 << 58) - 1)
_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(58)
_ORDER = mix64(np.arange(11, 11 + KEPT, dtype=np.uint64)) | np.uint64(1)
_BASE = [np.uint64(pow(0xD1342543DE82EF95, 1 << i, 1 << 64)) for i in range(8)]


def kmer_hashes(text: str, k: int = K) -> np.ndarray:
    """Hash of the k code points (k a power of two) from each position; a shorter
    text has one k-mer, itself filled with zeros, an empty text none."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h += np.uint64(1)
    if len(h) < k:
        h = np.concatenate([h, np.zeros(k - len(h), dtype=np.uint64)])
    step, level = 1, 0
    while step < k:
        h = h[:-step] * _BASE[level] + h[step:]
        step, level = 2 * step, level + 1
    return mix64(h)


def number_occurrences(h: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence number: the first keeps its hash,
    the same k-mer's later ones get one of their own each."""
    if len(h) > int(_POSITION):
        order = np.argsort(h & ~_POSITION, kind="stable")
        packed = h[order]
    else:
        order, packed = None, (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        packed.sort()
    again = np.flatnonzero((packed[1:] ^ packed[:-1]) <= _POSITION)
    if not len(again):
        return h
    run = np.concatenate([[True], np.diff(again) != 1])
    number = np.arange(len(again)) - np.flatnonzero(run)[np.cumsum(run) - 1] + 1
    at = (packed[again + 1] & _POSITION).astype(np.int64) if order is None else order[again + 1]
    out = h.copy()
    out[at] = mix64(h[at] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def signature(h: np.ndarray) -> np.ndarray:
    """64 numbers of 16 bits from the hashes of a text's k-mers. Each k-mer,
    numbered by occurrence, falls by its hash into one bucket; a bucket's two
    least are hashed as a tuple in the order they stand in the text. 0 marks a
    bucket without k-mers. Positions that do not fit below a hash are kept apart."""
    if not len(h):
        return np.zeros(BUCKETS, dtype=np.uint16)
    value = number_occurrences(h)
    packed = order = None
    if len(h) > int(_POSITION):
        order = np.argsort(value & ~_POSITION, kind="stable")
        packed = value[order]
        start = np.searchsorted(packed >> np.uint64(58), np.arange(BUCKETS, dtype=np.uint64))
    elif len(h) > 1500:
        # the least values are enough where every bucket has its two among them
        at = np.flatnonzero((value & _BELOW) < np.uint64(8 * BUCKETS * KEPT / len(h) * 2**58))
        packed = np.sort((value[at] & ~_POSITION) | at.astype(np.uint64))
        start = np.searchsorted(packed, _BOUNDS)
        if (np.diff(np.append(start, len(packed))) < KEPT).any():
            packed = None
    if packed is None:
        packed = np.sort((value & ~_POSITION) | np.arange(len(h), dtype=np.uint64))
        start = np.searchsorted(packed, _BOUNDS)
    sizes = np.diff(np.append(start, len(packed)))
    chosen = start[:, None] + np.arange(KEPT)
    real = np.arange(KEPT) < sizes[:, None]
    chosen = np.where(real, chosen, 0)
    place = (packed[chosen] & _POSITION).astype(np.int64) if order is None else order[chosen]
    turn = np.argsort(np.where(real, place, 1 << 60), axis=1, kind="stable")
    values = np.take_along_axis(np.where(real, value[place], np.uint64(0)), turn, axis=1)
    out = np.maximum(mix64((values * _ORDER).sum(axis=1, dtype=np.uint64)) >> np.uint64(48), np.uint64(1))
    out[sizes == 0] = 0
    return out.astype(np.uint16)


def edited_hashes(text: str, h: np.ndarray, following: str, following_h: np.ndarray, k: int = K) -> np.ndarray:
    """``kmer_hashes(edited(text, following))`` out of the two texts' own."""
    cut = len(text) // 3
    keep, more = len(text) - cut, min(cut, len(following))
    if keep < k or more < k:
        return kmer_hashes(edited(text, following), k)
    seam = kmer_hashes(text[keep - k + 1 : keep] + following[: k - 1], k)
    return np.concatenate([h[: keep - k + 1], seam, following_h[: more - k + 1]])


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal buckets among those that either text fills; 1 for two
    empty texts."""
    filled = int(((a != 0) | (b != 0)).sum())
    return float(((a == b) & (a != 0)).sum() / filled) if filled else 1.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the following text's
    beginning, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ARROW = pa.schema([
    pa.field(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t])
    for n, t in (c.split() for c in SCHEMA.split(", "))
])


def _row(doc_id, text, h, sig, following, following_h, following_sig):
    changed = edited(text, following)
    changed_sig = sig if changed == text else signature(edited_hashes(text, h, following, following_h))
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_text(sig),
        to_text(changed_sig), likeness(sig, changed_sig), likeness(sig, following_sig),
    )


_EDGES = "part long, edge int, text string"
_FULL = _ARROW.append(pa.field("part", pa.int64())).append(pa.field("edge", pa.int32())).append(pa.field("text", pa.string()))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _inside(arrow_batches):
    """Rows of one part in order: the result of all but the last, and the first
    (edge 1) and last row (edge 2) themselves."""
    part, before, empty = TaskContext.get().partitionId(), None, (None,) * (len(_ARROW) - 1)
    for batch in arrow_batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            h = kmer_hashes(text)
            sig = signature(h)
            if before is None:
                out.append((doc_id, *empty, part, 1, text))
            else:
                out.append((*_row(*before, text, h, sig), part, 0, None))
            before = (doc_id, text, h, sig)
        yield _batch(out, _FULL)
    if before is not None:
        yield _batch([(before[0], *empty, part, 2, before[1])], _FULL)


def _across(arrow_batches):
    for batch in arrow_batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
        some = [(i, a, kmer_hashes(a), b, kmer_hashes(b)) for i, a, b in rows]
        yield _batch([_row(i, a, p, signature(p), b, q, signature(q)) for i, a, p, b, q in some], _ARROW)


def fingerprints(docs: DataFrame, rows_per_part: int = 2000, most_parts: int = 100_000, scratch: Scratch | None = None) -> DataFrame:
    """Fingerprint of each document (doc_id, text) and of its edited text.

    Documents follow one another by descending doc_id, after the last the first;
    equal ids by a hash of the text, null ids last. A null text is empty; the
    edited text of a single document takes from itself. Texts are shuffled once,
    by ranges of the order; a part's last row meets the first row of the part
    after it in a table of two rows for each part. An empty table gives no rows,
    repeated rows one each.
    """
    spark = prepare(docs.sparkSession)
    scratch = scratch or Scratch(spark, "fingerprint")
    parts = max(1, min(most_parts, math.ceil(docs.count() / rows_per_part)))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = scratch.keep(dealt.select("doc_id", "text").mapInArrow(_inside, f"{SCHEMA}, {_EDGES}"), "inside")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    last = found.where("edge = 2").select("part", "doc_id", "text")
    whole = Window.orderBy("part")
    turn = last.select("part").select(
        "part", F.coalesce(F.lead("part").over(whole), F.first("part").over(whole)).alias("into")
    )
    first = found.where("edge = 1").select(F.col("part").alias("into"), F.col("text").alias("following"))
    edges = last.join(turn, "part").join(first, "into").select("doc_id", "text", "following")
    return found.where("edge = 0").select(*names).unionByName(edges.mapInArrow(_across, SCHEMA))
