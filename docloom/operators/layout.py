"""Grouping of word boxes into visual lines, one document at a time.

Each grouping is a fold whose next step needs the lines so far, so documents
are grouped maps; a document is a page of words.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from docloom.functions import geometry as G
from docloom.operators.grouped import fold_groups

LINE_SCHEMA = StructType([
    StructField("sample_id", StringType()), StructField("line_no", LongType()), StructField("text", StringType()),
    StructField("bbox", ArrayType(DoubleType())), StructField("confidence", DoubleType()), StructField("words", ArrayType(LongType())),
])


def first_fit(center: np.ndarray, height: np.ndarray, share: float = 0.55) -> list[int]:
    """Line of each word: the first line whose running mean centre is near."""
    lines: list[list[float]] = []  # sum of centres, words, height
    out = []
    for c, h in zip(center, height):
        at = next((i for i, (s, n, tall) in enumerate(lines) if abs(c - s / n) <= max(h, tall) * share), None)
        if at is None:
            at = len(lines)
            lines.append([0.0, 0, 0.0])
        s, n, tall = lines[at]
        lines[at] = [s + c, n + 1, max(tall, h)]
        out.append(at)
    return out


def last_line(center: np.ndarray, height: np.ndarray) -> list[int]:
    """Line of each word: the last one or a new one."""
    out, total, n = [], 0.0, 0
    for c, h in zip(center, height):
        if n == 0 or abs(c - total / n) > min(30, max(10, h * 0.65)):
            out.append(out[-1] + 1 if out else 0)
            total, n = 0.0, 0
        else:
            out.append(out[-1])
        total, n = total + c, n + 1
    return out


#: Lines of a page up to which they are looked through one by one.
FEW_LINES = 40


def _best(c: float, h: float, a: float, b: float, low: list[float], high: list[float]) -> int:
    at, best = -1, -1.0
    for i, (top, end) in enumerate(zip(low, high)):
        tall = max(1.0, end - top)
        least = min(h, tall)
        shared = max(0.0, min(b, end) - max(a, top)) / max(1.0, least)
        away = abs(c - (top + end) / 2)
        near = min(max(least * 0.55, 8.0), 28.0)
        if away <= near or (shared >= 0.55 and away <= max(near, tall * 0.45)):
            score = shared - away / tall * 0.1
            if score > best:
                at, best = i, score
    return at


def _best_of_many(c: float, h: float, a: float, b: float, low: np.ndarray, high: np.ndarray) -> int:
    tall = np.maximum(1, high - low)
    least = np.minimum(h, tall)
    shared = np.maximum(0, np.minimum(b, high) - np.maximum(a, low)) / np.maximum(1, least)
    away = np.abs(c - (low + high) / 2)
    near = np.clip(least * 0.55, 8, 28)
    fits = (away <= near) | ((shared >= 0.55) & (away <= np.maximum(near, tall * 0.45)))
    score = np.where(fits, shared - away / tall * 0.1, -1.0)
    return int(np.argmax(score)) if (score > -1).any() else -1


def best_overlap(center, height, y1, y2) -> list[int]:
    """Line of each word: the one it overlaps best, distance counting against."""
    low: list[float] = []
    high: list[float] = []
    space, n, out = np.zeros((2, 0)), 0, []  # the same lines for numpy, once they are many
    for c, h, a, b in zip(*(np.asarray(v, dtype=float).tolist() for v in (center, height, y1, y2))):
        if n <= FEW_LINES:
            at = _best(c, h, a, b, low, high)
        else:
            at = _best_of_many(c, h, a, b, space[0, :n], space[1, :n])
        if at < 0:
            at, n = n, n + 1
            low.append(a)
            high.append(b)
            if n > FEW_LINES and n > space.shape[1]:
                space = np.zeros((2, 2 * n))
                space[:, :n] = low, high
        else:
            low[at], high[at] = min(low[at], a), max(high[at], b)
        if n > FEW_LINES:
            space[0, at], space[1, at] = low[at], high[at]
        out.append(at)
    return out


def _lines(how: str, rows: list[tuple]) -> list[tuple]:
    """Lines of one sample's words (sample_id, idx, text, confidence, x1, y1, x2,
    y2) in order of centre and x."""
    if not rows:
        return []
    x1, y1, x2, y2 = ([r[i] for r in rows] for i in range(4, 8))
    center, tall = [(a + b) / 2 for a, b in zip(y1, y2)], [max(1.0, b - a) for a, b in zip(y1, y2)]
    if how == "best_overlap":
        line = best_overlap(center, tall, y1, y2)
    else:
        line = (first_fit if how == "first_fit" else last_line)(center, tall)
    own: dict[int, list[int]] = {}
    for i, at in enumerate(line):
        own.setdefault(at, []).append(i)
    out = []
    for words in own.values():
        words.sort(key=lambda i: x1[i])
        known = [rows[i][3] for i in words if rows[i][3] is not None]
        enough = len(known) == len(words) if how == "first_fit" else bool(known)
        text = " ".join(rows[i][2].strip() if how == "last_line" else rows[i][2] for i in words)
        hull = [min(x1[i] for i in words), min(y1[i] for i in words), max(x2[i] for i in words), max(y2[i] for i in words)]
        out.append((text, hull, sum(known) / len(known) if enough else None, [rows[i][1] for i in words]))
    if how == "best_overlap":
        out.sort(key=lambda r: (r[1][1], r[1][0]))
    return [(rows[0][0], i, *r) for i, r in enumerate(out)]


def group_lines(words: DataFrame, how: str = "first_fit") -> DataFrame:
    """Lines of each sample of words (sample_id, idx, text, bbox, confidence) by
    ``first_fit``, ``last_line`` or ``best_overlap``. Words without text or box
    are left out. A line has its words' text from left to right, their hull and
    mean confidence: null if any word lacks one (first_fit), or over those that
    have one. last_line drops blanks before , . ; and :."""
    if how not in ("first_fit", "last_line", "best_overlap"):
        raise ValueError(how)
    rows = words.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("idx").cast("long").alias("idx"), "text", "bbox", F.col("confidence").cast("double").alias("confidence"))
    rows = rows.where((F.trim(F.coalesce("text", F.lit(""))) != "") & G.is_numeric(F.col("bbox")))
    sides = [F.get("bbox", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    rows, order = rows.select("sample_id", "idx", "text", "confidence", *sides), [(F.col("y1") + F.col("y2")) / 2, "x1", "idx"]
    out = fold_groups(rows, ["sample_id"], order, lambda group: _lines(how, list(group)), LINE_SCHEMA)
    return out.withColumn("text", F.regexp_replace("text", r"\s+([,.;:])", "$1")) if how == "last_line" else out


def _before(a: tuple, b: tuple) -> float:
    near = max(a[3] - a[1], b[3] - b[1], 1) * 0.5
    ca, cb = (a[1] + a[3]) / 2, (b[1] + b[3]) / 2
    return a[0] - b[0] if abs(ca - cb) <= near else ca - cb


def sort_spatial(words: DataFrame) -> DataFrame:
    """``pos`` of each word in rows: same row by x, else by centre. The relation
    is not transitive; words come in order of centre, x and idx first."""
    idx, bbox = words.columns.index("idx"), words.columns.index("bbox")

    def run(group) -> list[tuple]:
        rows = list(group)
        boxes = [tuple(r[bbox]) if r[bbox] is not None and len(r[bbox]) == 4 else (0.0, 0.0, 0.0, 0.0) for r in rows]
        start = sorted(range(len(rows)), key=lambda i: ((boxes[i][1] + boxes[i][3]) / 2, boxes[i][0], rows[i][idx]))
        order = sorted(start, key=functools.cmp_to_key(lambda i, j: _before(boxes[i], boxes[j])))
        return [(*rows[i], pos) for pos, i in enumerate(order)]

    return fold_groups(words, ["sample_id"], ["idx"], run, StructType([*words.schema.fields, StructField("pos", LongType())]))


def reading_order_text(words: Column) -> Column:
    """Texts of an array of words (bbox, text) by y and x, one a line."""
    keyed = F.transform(words, lambda w: F.struct(F.get(w["bbox"], F.lit(1)).alias("y"), F.get(w["bbox"], F.lit(0)).alias("x"), w["text"].alias("text")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda w: w["text"]), "\n")
