"""Deterministic dataset splits and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sha1_rank(col: Column) -> Column:
    """The first 8 hexadecimal digits of the SHA-1, as a number."""
    return F.conv(F.substring(F.sha1(col.cast("string")), 1, 8), 16, 10).cast("long")


def rank_split(samples: DataFrame, id_col: str = "sample_id", tie_col: str | None = None, train=0.70, validation=0.15) -> DataFrame:
    """``split`` by rank of the SHA-1: shares are rounded half up. Ranks come from
    counts of 4096 ranges of the hash, so no task sees more than one range."""
    rows = samples.withColumn("__r", sha1_rank(F.col(id_col))).withColumn("__b", F.shiftrightunsigned("__r", 20))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__b", before.alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    inside = Window.partitionBy("__b").orderBy("__r", *( [tie_col] if tie_col else []), id_col)
    rows = rows.join(F.broadcast(counts), "__b").withColumn("__rank", F.col("__before") + F.row_number().over(inside))
    first = F.floor(F.col("__total") * train + 0.5)
    second = first + F.floor(F.col("__total") * validation + 0.5)
    split = F.when(F.col("__rank") <= first, "train").when(F.col("__rank") <= second, "validation").otherwise("test")
    return rows.withColumn("split", split).drop("__r", "__b", "__before", "__total", "__rank")


def fnv1a(col: Column) -> Column:
    """32-bit FNV-1a over the code units of a text of the basic plane."""
    units = F.transform(F.filter(F.split(col.cast("string"), ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def hash_split(col: Column, train: int = 700, validation: int = 850) -> Column:
    """By the last three digits of the FNV-1a hash."""
    at = fnv1a(col) % 1000
    return F.when(at < train, "train").when(at < validation, "validation").otherwise("test")


def suffixed_ids(rows: DataFrame, id_col: str, file_col: str, index_col: str) -> DataFrame:
    """Ids unique: all but the first of an id get 12 digits of the SHA-1 of file
    and index."""
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(file_col, index_col))
    mark = F.substring(F.sha1(F.concat_ws(":", F.col(file_col), F.col(index_col).cast("string"))), 1, 12)
    return rows.withColumn(id_col, F.when(nth > 1, F.concat_ws("_", F.col(id_col), mark)).otherwise(F.col(id_col)))
