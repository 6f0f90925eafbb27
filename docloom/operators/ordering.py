"""Positions in a global order: numbers, pages and circular searches.

Rows are dealt to ranges of the order and sorted there; what is known of each
range (a row for each) then makes local positions global. No window has all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import Scratch

_BITS = 33  # of monotonically_increasing_id, for the place in a partition


def ranged(rows: DataFrame, order: list, scratch: Scratch) -> DataFrame:
    """``rows`` in a written table with range and place: places count from 0 in each
    range, and ranges follow one another in ``order`` (columns; ties in any order)."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    place = F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1))
    kept = scratch.keep(dealt.withColumn("range", F.shiftright("__at", _BITS)).withColumn("place", place).drop("__at"), "ranged")
    return kept


def row_numbers(rows: DataFrame, order: list, name: str = "n", scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with their number in ``order``, from 1: a range's rows follow those of
    the ranges before it. The counts of ranges, one for each task, are summed on the driver."""
    spark = rows.sparkSession
    kept = ranged(rows, order, scratch or Scratch(spark, "numbers"))
    before, total = [], 0
    for at, n in sorted(map(tuple, kept.groupBy("range").count().collect())):
        before.append((at, total))
        total += n
    starts = spark.createDataFrame(before, "range long, __before long")
    return kept.join(F.broadcast(starts), "range").withColumn(name, F.col("__before") + F.col("place") + 1).drop("range", "place", "__before")


def first_rows(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in ``order``; all of them if ``n`` is not positive."""
    return rows.orderBy(*order).limit(n) if n > 0 else rows.orderBy(*order)


def pages(rows: DataFrame, order: list, size: int, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with n (number in ``order``), page (from 0) and line (from 0 in the page)."""
    if size < 1:
        raise ValueError("a page has a row at least")
    numbered = row_numbers(rows, order, "n", scratch)
    return numbered.withColumn("page", F.floor((F.col("n") - 1) / size)).withColumn("line", (F.col("n") - 1) % size)


def page_tokens(paged: DataFrame, keys: list[str]) -> DataFrame:
    """page, rows, and token: the keys of the page's last row, from which the next
    one goes on (``rows_after``); the last page has none."""
    ends = paged.groupBy("page").agg(F.count("*").alias("rows"), F.max_by(F.struct(*keys), "n").alias("token"))
    return ends.join(ends.select((F.col("page") - 1).alias("page"), F.lit(True).alias("__more")), "page", "left").select(
        "page", "rows", F.when(F.col("__more"), F.col("token")).alias("token")
    )


def rows_after(rows: DataFrame, keys: list[str], token: tuple | None, size: int) -> DataFrame:
    """The page of ``size`` rows behind a token, by ascending keys, nulls first; the
    first one without a token. The comparison is a filter on the keys, so that files
    are pruned by the first of them; a token and its page are as small as ``size``."""
    kinds = dict(rows.dtypes)
    later, equal = F.lit(token is None), F.lit(True)
    for k, v in zip(keys, token or ()):
        value = F.lit(v).cast(kinds[k])
        above = F.col(k).isNotNull() if v is None else F.coalesce(F.col(k) > value, F.lit(False))
        later, equal = later | (equal & above), equal & F.col(k).eqNullSafe(value)
    return rows.where(later).orderBy(*keys).limit(size)


def next_open(rows: DataFrame, order: list, key: str, is_open: Column, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ``next``: the ``key`` of the first open row behind each in ``order``,
    going on from the first row after the last; a row comes last for itself. Null
    where no row is open. Inside a range a running last value, in descending order, finds it; beyond
    it, the first open row of the ranges that follow."""
    spark = rows.sparkSession
    kept = ranged(rows.withColumn("__open", F.when(is_open, F.struct(F.col(key).alias("key")))), order, scratch or Scratch(spark, "open"))
    heads = kept.groupBy("range").agg(F.min_by("__open", F.when(F.col("__open").isNotNull(), F.col("place"))).alias("head"))
    heads = sorted(((at, head) for at, head in heads.collect()), key=lambda r: r[0])
    following = next((head for _, head in heads if head), None)
    found = []
    for at, head in reversed(heads):
        found.append((at, following))
        following = head or following
    kind = rows.schema[key].dataType.simpleString()
    beyond = spark.createDataFrame(found, f"range long, __beyond struct<key: {kind}>")
    behind = Window.partitionBy("range").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last("__open", ignorenulls=True).over(behind)
    out = kept.withColumn("__inside", inside).join(F.broadcast(beyond), "range")
    return out.withColumn("next", F.coalesce("__inside", "__beyond")["key"]).drop("range", "place", "__open", "__inside", "__beyond")


def neighbours(rows: DataFrame, order: list, mark: str, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with before and after: the nearest values of the column ``mark`` that are
    not null, in front of each row and behind it in ``order``. Running last values find
    them inside a range, and the ranges' first and last ones beyond it."""
    spark = rows.sparkSession
    kept = ranged(rows, order, scratch or Scratch(spark, "neighbours"))
    at = F.when(F.col(mark).isNotNull(), F.col("place"))
    ends = sorted(kept.groupBy("range").agg(F.min_by(mark, at).alias("a"), F.max_by(mark, at).alias("b")).collect(), key=lambda r: r["range"])
    last, before, following, after = None, {}, None, {}
    for r in ends:
        before[r["range"]], last = last, r["b"] if r["b"] is not None else last
    for r in reversed(ends):
        after[r["range"]], following = following, r["a"] if r["a"] is not None else following
    kind = rows.schema[mark].dataType.simpleString()
    beyond = spark.createDataFrame([(k, before[k], after[k]) for k in before], f"range long, __before {kind}, __after {kind}")
    running = lambda o: F.last(mark, ignorenulls=True).over(Window.partitionBy("range").orderBy(o).rowsBetween(Window.unboundedPreceding, -1))
    out = kept.withColumn("__b", running("place")).withColumn("__a", running(F.desc("place"))).join(F.broadcast(beyond), "range")
    out = out.withColumn("before", F.coalesce("__b", "__before")).withColumn("after", F.coalesce("__a", "__after"))
    return out.drop("range", "place", "__a", "__b", "__before", "__after")


def running_sums(rows: DataFrame, order: list, columns: list[str], scratch: Scratch | None = None) -> tuple[DataFrame, dict]:
    """``rows`` with ``<column>_upto``, the sum of each column over all rows up to and
    with the row in ``order``, and the totals."""
    spark = rows.sparkSession
    kept = ranged(rows, order, scratch or Scratch(spark, "sums"))
    sums = {c: 0 for c in columns}
    before = []
    for at, *some in sorted(map(tuple, kept.groupBy("range").agg(*[F.sum(c) for c in columns]).collect())):
        before.append((at, *sums.values()))
        sums = {c: sums[c] + (x or 0) for c, x in zip(columns, some)}
    kinds = {f.name: f.dataType.simpleString() for f in kept.agg(*[F.sum(c).alias(c) for c in columns]).schema}
    starts = spark.createDataFrame(before, "range long, " + ", ".join(f"__{c} {kinds[c]}" for c in columns))
    upto = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = kept.join(F.broadcast(starts), "range")
    for c in columns:
        out = out.withColumn(f"{c}_upto", F.col(f"__{c}") + F.coalesce(F.sum(c).over(upto), F.lit(0)))
    return out.drop("range", "place", *[f"__{c}" for c in columns]), sums


def dictionary_order(names: DataFrame, count: str, name: str, collation: str = "UNICODE", scratch: Scratch | None = None) -> DataFrame:
    """``names`` with ``position``: by descending ``count``, then by ``name`` as a
    dictionary of the collation has them (accents after plain letters, case last)."""
    rows = names.withColumn("__order", F.collate(F.col(name), collation))
    return row_numbers(rows, [F.desc(count), F.col("__order"), F.col(name)], "position", scratch).drop("__order")
