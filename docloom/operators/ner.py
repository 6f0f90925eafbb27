"""Sequence labels of words from entity boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators.vocabulary import LABELS


def word_entities(words: DataFrame, entities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Words (sample_id, idx, bbox, ...) with the best entity (id, label, ord,
    bbox) that covers them: IoU or coverage of the threshold at least, ties by
    entity order. A word has one entity at most, an entity many words."""
    e = entities.where(F.col("label").isin(*LABELS) & (F.size("bbox") == 4)).select(
        "sample_id", F.col("id").alias("entity_id"), "label", F.col("ord").alias("entity_ord"), F.col("bbox").alias("e")
    )
    pairs = words.select("sample_id", "idx", "bbox").join(e, "sample_id")
    if threshold > 0:
        pairs = pairs.where(G.overlaps(F.col("bbox"), F.col("e")))
    score = F.greatest(G.iou(F.col("bbox"), F.col("e"), True), G.overlap_coverage(F.col("bbox"), F.col("e")))
    # the threshold stands in the aggregate: as a filter its long expression would
    # keep the optimizer busy with what follows from it
    good = F.when(F.col("score") >= threshold, F.struct("entity_id", "label"))
    rank = F.when(F.col("score") >= threshold, F.struct("score", -F.col("entity_ord")))
    best = pairs.withColumn("score", score).groupBy("sample_id", "idx").agg(F.max_by(good, rank).alias("m"))
    return words.join(best.select("sample_id", "idx", "m.entity_id", "m.label"), ["sample_id", "idx"], "left")


def bio_tags(words: DataFrame, entities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Words (sample_id, idx, pos, text, bbox) with entity_id and tag: I- where the
    word before has the same entity, else B-, O without one."""
    rows = word_entities(words, entities, threshold)
    before = F.lag("entity_id").over(Window.partitionBy("sample_id").orderBy("pos"))
    tag = F.when(F.col("entity_id").isNull(), "O").otherwise(
        F.concat(F.when(before == F.col("entity_id"), F.lit("I-")).otherwise(F.lit("B-")), F.col("label"))
    )
    return rows.withColumn("tag", tag).drop("label")


def unmatched_entities(tagged: DataFrame, entities: DataFrame) -> DataFrame:
    usable = entities.where(F.col("label").isin(*LABELS) & (F.size("bbox") == 4)).select("sample_id", F.col("id").alias("entity_id"))
    return usable.join(tagged.select("sample_id", "entity_id").distinct(), ["sample_id", "entity_id"], "left_anti")


def bio_examples(words: DataFrame, entities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each sample: tokens, unmatched_entity_ids, ready_for_training
    (no entity unmatched and one word at least)."""
    tagged = bio_tags(words, entities, threshold)
    tokens = tagged.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "idx", "text", "entity_id", "tag"))).alias("tokens"))
    usable = entities.where(F.col("label").isin(*LABELS) & (F.size("bbox") == 4))
    ids = usable.groupBy("sample_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    matched = F.coalesce(F.transform("tokens", lambda t: t["entity_id"]), F.array().cast("array<string>"))
    matched = F.filter(matched, lambda i: i.isNotNull())
    left = F.filter(F.coalesce("ids", F.array().cast("array<string>")), lambda i: ~F.array_contains(matched, i))
    rows = tokens.join(ids, "sample_id", "full").withColumn("unmatched_entity_ids", left).drop("ids")
    return rows.withColumn("ready_for_training", (F.size("unmatched_entity_ids") == 0) & (F.coalesce(F.size("tokens"), F.lit(0)) > 0))
