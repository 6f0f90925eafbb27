"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import Scratch, prepare

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
#: Documents that one task rounds together, and the most sources of one mix.
GROUP, MAX_SOURCES = 20_000, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Words to take from each source: ``share`` of all words by weight, at most
    ``limit`` times a source's own, the excess reshared by weight among the rest."""
    left = share * sum(sizes)
    out: list[float | None] = [0.0 if s <= 0 else None for s in sizes]
    while open_ := [i for i, t in enumerate(out) if t is None]:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = limit * sizes[i]
        left -= sum(out[i] for i in over)
    return out


def pivot(sizes: np.ndarray, shares: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int | None]:
    """Rounds ``shares`` (each from 0 to 1) to 0 or 1 but for one residual, whose
    index is returned. Pairs of fractional shares exchange words, up or down at
    random with equal expectation, until one of the two is integral: the sum of
    size times share stays as it is, and so does each share's expectation."""
    p = shares.astype(float).copy()
    draw = rng.random(len(p))
    held = None
    for j in range(len(p)):
        if sizes[j] <= 0 or p[j] <= 0.0 or p[j] >= 1.0:
            p[j] = round(p[j]) if sizes[j] > 0 else 0.0
            continue
        if held is None:
            held = j
            continue
        i, a, b = held, float(sizes[held]), float(sizes[j])
        up, down = min(a * p[i], b * (1 - p[j])), min(b * p[j], a * (1 - p[i]))
        if draw[j] * (up + down) < down:
            j_ends = a * p[i] > b * (1 - p[j])
            p[i], p[j] = (p[i] - b * (1 - p[j]) / a, 1.0) if j_ends else (0.0, p[j] + a * p[i] / b)
        else:
            j_ends = b * p[j] < a * (1 - p[i])
            p[i], p[j] = (p[i] + b * p[j] / a, 0.0) if j_ends else (1.0, p[j] - a * (1 - p[i]) / b)
        held = i if j_ends else j
        if p[held] < 1e-12 or p[held] > 1 - 1e-12:
            p[held] = round(p[held])
            held = None
    return p, held


def _round_group(last: bool, seed: int):
    """Rounds the shares of one group, null ids last; Arrow keeps 64-bit ids as they are."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("h", "ascending")])
        rng = np.random.Generator(np.random.PCG64([seed, int(last), key[0].as_py(), key[1].as_py()]))
        p, held = pivot(rows["size"].to_numpy(), rows["p"].to_numpy(), rng)
        open_ = np.zeros(len(rows), dtype=bool)
        if held is not None and not last:
            open_[held] = True
        for name, values in (("p", p), ("open", open_)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
        return rows

    return run


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """How often the mix takes each document: one row per row of ``docs`` (doc_id,
    text, source) with size (words; a null text has none), source_size, target,
    copies (whole ones), taken (words) and h (a hash of the text).

    Sources stand in code-point order, null last, and weigh ``weights`` in turn.
    Each document gets the whole part of target / source_size copies and the
    fraction by pivotal rounding: within groups of documents, by a hash of the
    id, then over the groups' residuals in a tree. The one document of a source
    that is still fractional at the tree's root is taken in part, its first
    words, so a source's taken words equal its target but for rounding. Equal rows
    exchange words among themselves first, which leaves one fractional row of them
    for the groups, however many there are. Runs over the same rows agree, however
    they are partitioned. Of an empty table the result is empty; documents
    without words are taken 0 times; texts of any length are counted whole, and other columns
    are ignored. Sources, at most ``MAX_SOURCES``, are gathered on the driver,
    documents never.
    """
    spark = prepare(docs.sparkSession)
    scratch = scratch or Scratch(spark, "mixing")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(docs["text"]).alias("h"),
    )
    sized = scratch.keep(rows.groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("m")), "sized")
    found = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    found = found.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["source_size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, limit)
    rows = []
    for sid, (r, t) in enumerate(zip(found, goal)):
        ratio = t / r["source_size"] if r["source_size"] else 0.0
        rows.append((sid, r["source"], r["source_size"], float(t), int(ratio), ratio - int(ratio), math.ceil(r["n"] / GROUP)))
    sources = spark.createDataFrame(rows, "sid long, source string, source_size long, target double, whole long, ratio double, groups long")
    known = sources.withColumnRenamed("source", "source_")
    known = F.broadcast(known) if len(rows) <= 10_000 else known
    # of m equal rows, ``full`` are taken once more and one has the fraction left
    full = F.floor(F.col("m") * F.col("ratio"))
    now = sized.join(known, F.col("source").eqNullSafe(F.col("source_"))).select(
        "sid", "doc_id", "h", "size", "m", full.alias("full"), (F.col("m") * F.col("ratio") - full).alias("p"),
        F.lit(False).alias("open"), F.pmod(F.xxhash64("doc_id", "h"), F.col("groups")).alias("g"),
    )
    schema = "sid long, doc_id long, h long, size long, m long, full long, p double, open boolean, g long"
    most, done = max([r[-1] for r in rows], default=1), None
    while True:
        last = most <= 1
        rounded = scratch.keep(now.groupBy("sid", "g").applyInArrow(_round_group(last, seed), schema), "rounded")
        closed = rounded.where(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        most = math.ceil(most / GROUP)
        now = rounded.where("open").withColumn("g", F.pmod("g", F.lit(most)))
    whole = F.broadcast(sources) if len(rows) <= 10_000 else sources
    # a row again for each of m equal ones, by blocks that bound what one row explodes to
    done = done.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / GROUP))))
    end = F.least(F.col("m"), (F.col("block") + 1) * GROUP) - 1
    done = done.withColumn("nth", F.explode(F.sequence(F.col("block") * GROUP, end)))
    p = F.when(F.col("nth") < F.col("full"), 1.0).when(F.col("nth") == F.col("full"), F.col("p")).otherwise(0.0)
    done = done.select("sid", "doc_id", "h", "size", F.when(F.col("size") > 0, p).otherwise(0.0).alias("p"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.floor("r.p")).otherwise(F.lit(0))
    taken = F.col("size") * F.col("whole") + F.round(F.col("size") * F.col("r.p")).cast("long")
    return (
        done.alias("r")
        .join(whole.alias("s"), "sid")
        .select("doc_id", "source", "h", "size", "source_size", "target", copies.alias("copies"), taken.alias("taken"))
    )
