"""Joins of manifests, predictions, references and drafts, and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.metrics import box_pairs, greedy_match
from docloom.sources.files import last_by_key

#: Raw labels of word boxes that are entities (fixed values), and labels of people.
WORD_ENTITIES = {"drugname": "DRUG", "usage": "INSTRUCTION"}
SENSITIVE_LABELS = ("diagnose", "date", "other")


def manifest_predictions(manifest: DataFrame, predictions: DataFrame, order: str) -> DataFrame:
    """Every manifest row with the last prediction of its sample_id, nulls where there is none."""
    return manifest.join(last_by_key(predictions, "sample_id", order).drop(order), "sample_id", "left")


def reference_pairs(references: DataFrame, hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    """``references`` (keys, reference) with their ``hypothesis``, empty where missing."""
    found = references.join(hypotheses.select(*keys, "hypothesis"), keys, "left")
    return found.withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))


def labelled_manifest(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """Manifest rows that have labels."""
    return manifest.join(labels, "sample_id")


def word_entities(words: DataFrame) -> DataFrame:
    """sample_id, idx, label, text and bbox of the words that are entities."""
    label = F.coalesce(*[F.when(F.col("label") == a, F.lit(b)) for a, b in WORD_ENTITIES.items()])
    rows = words.where(F.col("label").isin(*WORD_ENTITIES))
    return rows.select("sample_id", "idx", label.alias("label"), F.coalesce("text", F.lit("")).alias("text"), "bbox")


def ocr_words(words: DataFrame) -> DataFrame:
    """Words without their labels; a missing text is empty."""
    return words.select("sample_id", "idx", F.coalesce("text", F.lit("")).alias("text"), "bbox")


def public_samples(samples: DataFrame) -> DataFrame:
    """Samples without the raw labels of their words."""
    return samples.drop("source_labels")


def sensitive_counts(labels: DataFrame) -> DataFrame:
    """label and n of the labels (label, n) that may tell of a person."""
    return labels.where(F.col("label").isin(*SENSITIVE_LABELS)).groupBy("label").agg(F.sum("n").alias("n"))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """key and n of several tables of counts (key, n), summed."""
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy("key").agg(F.sum("n").alias("n"))


def split_summary(samples: DataFrame) -> DataFrame:
    """One row for each split of samples (split, word_box_count, target_box_count,
    valid_box_count), and one (split null) for all, with the sums."""
    sums = [F.sum(c).alias(c) for c in ("word_box_count", "target_box_count", "valid_box_count")]
    rows = samples.groupBy("split").agg(F.count("*").alias("samples"), *sums)
    rows = rows.unionByName(samples.agg(F.lit(None).cast("string").alias("split"), F.count("*").alias("samples"), *sums))
    return rows.withColumn("invalid_box_count", F.col("word_box_count") - F.col("valid_box_count"))


def label_totals(samples: DataFrame) -> DataFrame:
    """key and n over the samples' label_counts (map of label to count)."""
    return samples.select(F.explode("label_counts").alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def array_totals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The number of rows, and of the entries of each array column; null ones have none."""
    sizes = [F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("long").alias(c) for c in columns]
    return rows.agg(F.count("*").alias("rows"), *sizes)


def viewer_stats(records: DataFrame) -> DataFrame:
    """One row: images, lines and words of records (lines of words with a confidence),
    and the mean of the confidences that are numbers, null without one."""
    words = F.flatten(F.filter(F.transform("lines", lambda x: x["words"]), lambda w: w.isNotNull()))
    finite = F.filter(F.transform(words, lambda w: w["confidence"]), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    rows = records.select(size("lines").alias("lines"), F.coalesce(F.aggregate("lines", F.lit(0), lambda n, x: n + F.greatest(F.coalesce(F.size(x["words"]), F.lit(0)), F.lit(0))), F.lit(0)).alias("words"), finite.alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda n, x: n + x)
    sums = rows.agg(
        F.count("*").alias("images"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("words"),
        F.sum(total).alias("__sum"), F.sum(size("c")).alias("__n"),
    )
    return sums.withColumn("mean_confidence", F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n"))).drop("__sum", "__n")


def annotator_stats(samples: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row: samples, and those with a draft, complete, in need of review, and
    the relations of all drafts (sample_id, annotation_status, relations)."""
    d = drafts.select("sample_id", F.lit(True).alias("saved"), "annotation_status", F.coalesce(F.size("relations"), F.lit(0)).alias("n"))
    of = lambda status: F.count(F.when(F.col("annotation_status") == status, 1)).alias(status)
    joined = samples.select("sample_id").join(d, "sample_id", "left")
    return joined.agg(
        F.count("*").alias("total_samples"), F.count("saved").alias("saved"), of("complete"), of("needs_review"),
        F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).cast("long").alias("relations"),
    )


def relation_list(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the text of both entities; an id that is none stands for itself."""
    e = entities.select("sample_id", F.col("id").alias("__id"), F.col("text").alias("__text"))
    out = relations
    for side in ("source", "target"):
        one = e.withColumnsRenamed({"__id": f"{side}_entity_id", "__text": f"{side}_text"})
        out = out.join(one, ["sample_id", f"{side}_entity_id"], "left")
        out = out.withColumn(f"{side}_text", F.coalesce(f"{side}_text", f"{side}_entity_id"))
    return out


def error_analysis(manifest: DataFrame, gold: DataFrame, predicted: DataFrame, ocr: DataFrame, linking: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each manifest row (sample_id, word_box_count, drug_count): counts
    of gold and predicted boxes, scores of ``ocr`` and ``linking`` where known, and how many
    gold boxes with digits are matched, agree, disagree or are unmatched."""
    keys = ["sample_id"]
    taken = greedy_match(box_pairs(gold, predicted, threshold, keys), keys)
    agree = T.numeric_signature("gold_text") == T.numeric_signature("pred_text")
    met = taken.select("sample_id", F.col("gold_idx").alias("idx"), F.when(agree, 1).otherwise(0).alias("agree"))
    numbers = gold.where(F.size(T.numeric_signature("text")) > 0).select("sample_id", "idx").join(met, ["sample_id", "idx"], "left")
    numeric = numbers.groupBy("sample_id").agg(
        F.count("*").alias("numeric_gold_boxes"), F.count("agree").alias("numeric_matched_boxes"),
        F.coalesce(F.sum("agree"), F.lit(0)).alias("numeric_exact_matches"),
    )
    said = predicted.groupBy("sample_id").agg(F.count("*").alias("__said"))
    o = ocr.select("sample_id", F.col("gold_count").alias("__gold"), F.col("predicted_count").alias("__predicted"), F.col("f1").alias("ocr_f1"))
    k = linking.select("sample_id", "gold_drug_count", "correct_links")
    rows = manifest
    for side in (o, k, numeric, said):
        rows = rows.join(side, "sample_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    exact, matched, every = (F.coalesce(f"numeric_{c}", F.lit(0)) for c in ("exact_matches", "matched_boxes", "gold_boxes"))
    recall = F.when(F.col("gold_drug_count") > 0, F.coalesce("correct_links", F.lit(0)) / F.col("gold_drug_count"))
    return rows.select(
        "sample_id", F.coalesce("__gold", "word_box_count", F.lit(0)).alias("gold_word_boxes"),
        F.coalesce("__predicted", "__said", F.lit(0)).alias("predicted_word_boxes"), "ocr_f1",
        F.coalesce("gold_drug_count", "drug_count").alias("link_gold_drugs"), zero("correct_links"), recall.alias("link_recall"),
        zero("numeric_gold_boxes"), zero("numeric_matched_boxes"), zero("numeric_exact_matches"),
        (matched - exact).alias("numeric_disagreements"), (every - matched).alias("numeric_unmatched_gold_boxes"),
    )


def error_totals(rows: DataFrame) -> DataFrame:
    """Totals of ``error_analysis``: samples with too many and too few boxes, the
    sums of the numeric counts, and the share of matched numbers that agree."""
    sums = ["gold_boxes", "matched_boxes", "exact_matches", "disagreements", "unmatched_gold_boxes"]
    more = F.col("predicted_word_boxes") > F.col("gold_word_boxes")
    fewer = F.col("predicted_word_boxes") < F.col("gold_word_boxes")
    out = rows.agg(
        F.count("*").alias("samples"), F.count(F.when(more, 1)).alias("over_detection_samples"),
        F.count(F.when(fewer, 1)).alias("under_detection_samples"), *[F.sum(f"numeric_{c}").alias(f"numeric_{c}") for c in sums],
    )
    share = F.when(F.col("numeric_matched_boxes") > 0, F.col("numeric_exact_matches") / F.col("numeric_matched_boxes"))
    return out.withColumn("numeric_exact_rate", share)
