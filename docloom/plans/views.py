"""The driver's tables in the shapes of the document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return rows.withColumn("idx", F.row_number().over(order).cast("long"))


def boxes(spark: SparkSession, sf_dir: str, predicted: bool) -> DataFrame:
    """Orders as pages: a word for each line item, labelled by its return flag.
    Predicted boxes are shifted by quantity, and items of discount 0 are missing."""
    rows = _lines(spark, sf_dir)
    n, q = F.col("idx"), F.col("l_quantity")
    x, y = n * 20.0, n % 3 * 12.0
    dx, dy = (q % 5) * 2.0, (q % 3) * 1.0
    box = F.array(x + dx, y + dy, x + dx + 30, y + dy + 10) if predicted else F.array(x, y, x + 30.0, y + 10.0)
    text = F.concat(F.lit("Item "), F.col("l_partkey") % 7, F.when((q % 4 == 0) & F.lit(predicted), F.lit("x")).otherwise(F.lit("")))
    rows = rows.where("l_discount > 0") if predicted else rows
    return rows.select(F.col("l_orderkey").alias("sample_id"), "idx", F.col("l_returnflag").alias("label"), text.alias("text"), box.alias("bbox"))


BOXES_SQL = """
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS idx FROM lineitem
), gold AS (
  SELECT l_orderkey AS sample_id, idx, l_returnflag AS label, 'Item ' || (l_partkey % 7) AS text,
    idx * 20.0::DOUBLE AS x1, (idx % 3) * 12.0::DOUBLE AS y1, idx * 20.0::DOUBLE + 30 AS x2, (idx % 3) * 12.0::DOUBLE + 10 AS y2 FROM lines
), predicted AS (
  SELECT l_orderkey AS sample_id, idx, l_returnflag AS label,
    'Item ' || (l_partkey % 7) || CASE WHEN CAST(l_quantity AS BIGINT) % 4 = 0 THEN 'x' ELSE '' END AS text,
    idx * 20.0::DOUBLE + (CAST(l_quantity AS BIGINT) % 5) * 2 AS x1, (idx % 3) * 12.0::DOUBLE + CAST(l_quantity AS BIGINT) % 3 AS y1,
    idx * 20.0::DOUBLE + (CAST(l_quantity AS BIGINT) % 5) * 2 + 30 AS x2, (idx % 3) * 12.0::DOUBLE + CAST(l_quantity AS BIGINT) % 3 + 10 AS y2
  FROM lines WHERE l_discount > 0
), meets AS (
  SELECT g.sample_id, g.label, p.label AS p_label, g.idx AS g, p.idx AS p, g.text AS gt, p.text AS pt,
    greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i
  FROM gold g JOIN predicted p ON g.sample_id = p.sample_id
), pairs AS (
  SELECT *, i / (600.0::DOUBLE - i) AS iou FROM meets WHERE i / (600.0::DOUBLE - i) >= 0.5
)
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("drug_database_id"),
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("brand_name"),
        F.array().cast("array<string>").alias("generic_names"),
        F.array().cast("array<string>").alias("aliases"),
        F.array(F.struct(F.col("p_size").cast("double").alias("value"), F.lit("mg").alias("unit"))).alias("strengths"),
    )


def noisy_line():
    """A part as an OCR line: m read as rn, and every third unit as rng."""
    unit = F.when(F.col("p_partkey") % 3 == 0, "rng").otherwise("mg")
    return F.concat(F.lit("3) "), F.replace("p_name", F.lit("m"), F.lit("rn")), F.lit(" "), F.col("p_size").cast("string"), unit)


NOISY_SQL = "'3) ' || replace(p_name, 'm', 'rn') || ' ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN 'rng' ELSE 'mg' END"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as annotation documents: an entity for each line item, the first a
    drug by its flag, with ids that repeat where line numbers do, and a relation
    from the first entity to each other."""
    rows = _lines(spark, sf_dir)
    label = F.when(F.col("idx") == 1, F.when(F.col("l_returnflag") == "N", "DRUG").otherwise("FORM")).when(F.col("l_returnflag") == "A", "STRENGTH").when(F.col("l_returnflag") == "R", "DOSE").otherwise("TIMING")
    right = F.when(F.col("l_tax") == 0, F.col("l_linenumber") * 10.0).otherwise(F.col("l_linenumber") * 10.0 + 5.0)
    entity = F.struct(
        "idx", F.concat(F.lit("e"), F.col("l_linenumber")).alias("id"), label.alias("label"),
        F.when(F.col("l_discount") == 0, F.lit(" ")).otherwise(F.col("l_linestatus")).alias("text"),
        F.array(F.col("l_linenumber") * 10.0, F.lit(0.0), right, F.lit(8.0)).alias("bbox"), F.lit(False).alias("needs_review"),
    )
    docs = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    docs = docs.withColumn("relations", F.transform(
        F.filter("entities", lambda e: e["idx"] > 1),
        lambda e: F.struct(
            F.concat(F.lit("r"), e["idx"]).alias("id"), F.concat(F.lit("HAS_"), e["label"]).alias("type"),
            F.col("entities")[0]["id"].alias("source_entity_id"), e["id"].alias("target_entity_id"), F.lit(False).alias("needs_review"),
        ),
    ))
    status = F.when(F.col("l_orderkey") % 3 == 0, "complete").when(F.col("l_orderkey") % 3 == 1, "partial").otherwise("open")
    privacy = F.struct(F.lit(True).alias("de_identified"), (F.col("l_orderkey") % 2 == 0).alias("reviewed"), F.lit(True).alias("approved_for_research"))
    return docs.select(F.col("l_orderkey").cast("string").alias("sample_id"), "entities", "relations", status.alias("annotation_status"), privacy.alias("privacy"))
