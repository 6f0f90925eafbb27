"""Source records to canonical annotation documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.operators.profile import field_label, normalize_label, with_label
from docloom.session import Scratch


def needs_review(flag: Column, text: Column, bbox: Column) -> Column:
    return flag | (F.coalesce(text, F.lit("")) == "") | bbox.isNull()


def _labelled(rows: DataFrame, scratch: Scratch | None) -> DataFrame:
    """``rows`` with the normalised label ``to`` of each distinct ``label``."""
    return with_label(rows, ["label"], normalize_label("label"), scratch or Scratch(rows.sparkSession, "labels"))


def word_boxes(words: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Documents of words (sample_id, idx, label, text, box): known labels become
    entities, which drugs and instructions always leave for review; others are
    counted in notes. There are no relations."""
    rows = _labelled(words, scratch)
    review = needs_review(F.col("to").isin("DRUG", "INSTRUCTION"), F.col("text"), F.col("box")).alias("needs_review")
    item = F.when(F.col("to").isNotNull(), F.struct("idx", F.col("to").alias("label"), "text", F.col("box").alias("bbox"), review))
    docs = rows.groupBy("sample_id").agg(F.count(F.when(F.col("to").isNull(), 1)).alias("unmapped"), F.sort_array(F.collect_list(item)).alias("all"))
    numbered = F.transform("all", lambda e, i: F.struct(
        (i + 1).alias("n"), F.concat(F.lit("entity_"), (i + 1).cast("string")).alias("id"), *[e[c].alias(c) for c in ("label", "text", "bbox", "needs_review")]
    ))
    return docs.select("sample_id", "unmapped", F.when(F.size("all") > 0, numbered).alias("entities"))


def annotation_records(entities: DataFrame, relations: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Re-numbers the entities (sample_id, ord, id, label, text, bbox) of known
    labels, points relations (sample_id, ord, type, source, target) at the new ids,
    and returns both with the dangling relations."""
    kept = _labelled(entities, scratch).where("to IS NOT NULL").drop("label").withColumnRenamed("to", "label").select(*entities.columns)
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("sample_id").orderBy("ord")))
    kept = kept.withColumn("new_id", F.concat(F.lit("entity_"), F.col("n")))
    last = kept.groupBy("sample_id", "id").agg(F.max_by("new_id", "n").alias("new_id"))
    end = lambda c: last.select("sample_id", F.col("id").alias(c), F.col("new_id").alias(f"new_{c}"))
    rows = relations.join(end("source"), ["sample_id", "source"], "left").join(end("target"), ["sample_id", "target"], "left")
    whole = F.col("new_source").isNotNull() & F.col("new_target").isNotNull()
    good = rows.where(whole).select("sample_id", "ord", "type", F.col("new_source").alias("source"), F.col("new_target").alias("target"))
    return kept, good, rows.where(~whole).select(*relations.columns)


def fields(records: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of flat records: each known, filled field is an
    entity in column order; the last drug is the source of a relation to every
    other entity (a second drug too)."""
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns)])
    rows = records.select(F.col(id_col).alias("sample_id"), F.explode(pairs).alias("f")).select("sample_id", "f.*")
    rows = rows.withColumn("label", field_label("field")).withColumn("text", T.clean_text("text")).where("label IS NOT NULL AND text <> ''")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("sample_id").orderBy("ord"))).withColumn("id", F.concat(F.lit("entity_"), F.col("n")))
    head = rows.where("label = 'DRUG'").groupBy("sample_id").agg(F.max_by("id", "n").alias("source"))
    links = rows.join(head, "sample_id").where("id <> source").select("sample_id", F.concat(F.lit("HAS_"), F.col("label")).alias("type"), "source", F.col("id").alias("target"))
    return rows.select("sample_id", "id", "label", "text"), links


def coco(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Documents of COCO tables: images (id, file_name), annotations (id, image_id,
    category_id, bbox as x, y, w, h) and categories (id, name). Annotations of no
    image are left out; labels unknown become null."""
    a = annotations.select("image_id", "category_id", F.col("id").alias("ann_id"), F.col("bbox").alias("xywh"))
    rows = a.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")
    rows = rows.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    item = F.struct("ann_id", normalize_label("name").alias("label"), G.from_xywh(F.col("xywh")).alias("bbox"), F.lit(True).alias("needs_review"))
    return rows.groupBy("image_id", "file_name").agg(F.array_sort(F.collect_list(item)).alias("entities"))


def label_studio(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of tasks (sample_id, annotations of result): the
    first annotation only; boxes in percent of the original size."""
    r = tasks.select("sample_id", F.posexplode(F.get("annotations", F.lit(0))["result"]).alias("ord", "r"))
    label, value = F.coalesce(F.get("r.value.labels", F.lit(0)), F.lit("")), F.col("r.value")
    box = G.from_percent(value["x"], value["y"], value["width"], value["height"], F.col("r.original_width"), F.col("r.original_height"))
    e = r.where(~F.coalesce(F.col("r.type") == "relation", F.lit(False))).select("sample_id", "ord", F.col("r.id").alias("id"), label.alias("label"), value["text"].alias("text"), box.alias("bbox"))
    links = r.where("r.type = 'relation'").select(
        "sample_id", "ord", F.coalesce(F.get("r.labels", F.lit(0)), F.lit("RELATED_TO")).alias("type"), F.col("r.from_id").alias("source"), F.col("r.to_id").alias("target")
    )
    kept, good, _ = annotation_records(e, links)
    return kept.select("sample_id", F.col("new_id").alias("id"), "label", "text", "bbox"), good
