"""Labels, names and kinds in records of unknown shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.vocabulary import FIELD_KEYS, LABEL_KEYS, LABELS
from docloom.session import Scratch

# Extensions by kind of file.
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".bmp")
ANNOTATIONS = (".json", ".jsonl", ".ndjson", ".csv", ".txt")
ARCHIVES = (".zip", ".tar", ".gz", ".7z", ".rar")
# What the key of personal data contains.
SENSITIVE = re.compile(
    "patient|fullname|name|dob|birth|phone|address|insurance|diagnos|doctor|physician|hospital|email|idcard|identity"
)


def file_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*ANNOTATIONS), "annotation_candidate").when(ext.isin(*ARCHIVES), "archive").otherwise("other")


def source_format(value: Column) -> Column:
    """The kind of a parsed (VARIANT) document, first match first."""
    has = lambda v, p, t="variant": F.try_variant_get(v, p, t).isNotNull()
    items = F.try_variant_get(value, "$", "array<variant>")
    boxes = F.forall(items, lambda x: has(x, "$.label") & has(x, "$.box"))
    return (
        F.when(has(value, "$.images", "array<variant>") & has(value, "$.annotations", "array<variant>"), "coco")
        .when((F.size(items) > 0) & boxes, "word_boxes")
        .when(F.exists(items, lambda x: has(x, "$.annotations", "array<variant>")), "label_studio")
        .when(has(value, "$.entities", "array<variant>"), "annotation")
        .when(F.exists(items, lambda x: has(x, "$.entities", "array<variant>")), "annotation")
        .otherwise("generic_json")
    )


def relation_types(value: Column) -> Column:
    """Types of a document's relations, UNSPECIFIED where none is given; of
    labelling results too."""
    kind = lambda r: F.coalesce(
        F.try_variant_get(r, "$.type", "string"), F.try_variant_get(r, "$.labels[0]", "string"),
        F.try_variant_get(r, "$.label", "string"), F.lit("UNSPECIFIED"),
    )
    none = F.array().cast("array<variant>")
    own = F.transform(F.coalesce(F.try_variant_get(value, "$.relations", "array<variant>"), none), kind)
    results = F.flatten(
        F.transform(
            F.coalesce(F.try_variant_get(value, "$.annotations", "array<variant>"), none),
            lambda a: F.coalesce(F.try_variant_get(a, "$.result", "array<variant>"), none),
        )
    )
    linked = F.filter(results, lambda r: F.coalesce(F.try_variant_get(r, "$.type", "string") == "relation", F.lit(False)))
    named = F.transform(linked, lambda r: F.coalesce(F.try_variant_get(r, "$.labels[0]", "string"), F.lit("UNSPECIFIED")))
    return F.concat(own, named)


def _map(keys: Column, table: dict) -> Column:
    # one look-up, so that the key stands in the expression once
    return F.try_element_at(F.create_map(*[F.lit(x) for label, names in table.items() for name in names for x in (name, label)]), keys)


def normalize_label(col) -> Column:
    """One of the labels, by name or alias, else null."""
    raw = T.clean_text(col)
    upper = F.regexp_replace(F.upper(raw), r"[\s-]+", "_")
    known = F.when(upper.isin(*LABELS, "ACTIVE_INGREDIENT"), upper)
    return F.when(raw != "", F.coalesce(known, _map(T.normalize_key(raw), LABEL_KEYS)))


def field_label(name) -> Column:
    return _map(T.normalize_key(name), FIELD_KEYS)


def with_label(rows: DataFrame, columns: list[str], label: Column, scratch: Scratch) -> DataFrame:
    """``rows`` with ``to``, a ``label`` of some ``columns``. It is computed once for each distinct value,
    and these are written first: a condition on it would else go below the step that finds them."""
    known = scratch.keep(rows.select(*columns).distinct().withColumn("to", label), "labels").where("to IS NOT NULL")
    return rows.join(known, columns, "left")


def clean_sample_id(col) -> Column:
    base = F.regexp_replace(col, r"\.[^.]+$", "")
    return F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")


def image_ref(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^(.*?)/label/", "$1/image/"), r"\.json$", ".png")


def count_labels(words: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    return words.groupBy(*(by or []), F.coalesce(F.col(label), F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))


def inspect(files: DataFrame) -> DataFrame:
    """kind, extension and number of files (path)."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.groupBy(file_kind(F.col("path")).alias("kind"), ext.alias("extension")).agg(F.count("*").alias("files"))


def char_dictionary(texts: DataFrame, col: str = "text") -> DataFrame:
    """Distinct characters but tab, line feed and carriage return."""
    chars = texts.select(F.explode(F.array_distinct(F.split(col, ""))).alias("char")).where(~F.col("char").isin("", "\t", "\n", "\r"))
    return chars.distinct()
