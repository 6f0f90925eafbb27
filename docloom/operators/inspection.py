"""Reports on JSON documents of unknown shape, walked in the JVM as VARIANT.

Every level of nesting is one lateral ``variant_explode`` over the level above;
documents are never parsed in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.text import let
from docloom.operators.evaluation import SENSITIVE_LABELS
from docloom.operators.profile import SENSITIVE, file_kind, normalize_label, relation_types, source_format
from docloom.session import Scratch

_NONE = "array<variant>"


def given(value: Column, *paths: str) -> Column:
    """The first of some paths that a VARIANT has and that is not JSON's null."""
    found = [F.try_variant_get(value, p, "variant") for p in paths]
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in found])


def items(value: Column, path: str = "$") -> Column:
    """The elements of an array, none of anything else."""
    return F.coalesce(F.try_variant_get(value, path, _NONE), F.array().cast(_NONE))


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<text:variant>").isNotNull()


def as_text(value: Column) -> Column:
    """A VARIANT as trimmed text: an array's elements with blanks between, an
    object's text or else its value, and nothing for null."""
    plain = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))

    def text(v: Column) -> Column:
        many = F.array_join(F.transform(F.try_variant_get(v, "$", _NONE), plain), " ")
        one = F.when(is_object(v), plain(given(v, "$.text", "$.value")))
        return F.coalesce(many, one, plain(v))

    return T.clean_text(let(value, text))


def text_at(value: Column, *paths: str) -> Column:
    """``as_text`` of the first given of some paths, empty where there is none; only
    what may be an array or an object by its first sign is taken apart."""
    plain = F.coalesce(*[F.try_variant_get(value, p, "string") for p in paths])
    nested = F.coalesce(plain.startswith("[") | plain.startswith("{"), F.lit(False))
    return F.when(nested, as_text(given(value, *paths))).otherwise(T.clean_text(plain))


def json_nodes(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """file, path, key, depth, top and value of every node of the documents (file,
    document): the document itself has the path '' and depth 0, an element the place
    [i], a member its key behind a dot. ``top`` tells that only arrays are above it.
    Each level is written and the next read from it; work ends with the deepest one."""
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "nodes")
    level = documents.where("document IS NOT NULL").select(
        "file", F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(True).alias("top"), F.col("document").alias("value")
    )
    levels: list[DataFrame] = []
    while True:
        level = scratch.keep(level, f"level{len(levels)}")
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(len(levels))))
        below = level.withColumnRenamed("value", "__value").withColumnRenamed("key", "__key").lateralJoin(spark.tvf.variant_explode(F.col("__value").outer()))
        member = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(member)
        level = below.select("file", path.alias("path"), "key", (F.col("top") & F.col("key").isNull()).alias("top"), "value")
    return reduce(DataFrame.unionByName, levels) if levels else level.withColumn("depth", F.lit(0))


def _labels(rows: DataFrame, by: list[str], raw: str) -> DataFrame:
    """``by``, label and n of raw labels; each distinct one is normalised once."""
    counted = rows.where(F.col(raw).isNotNull()).groupBy(*by, raw).agg(F.count("*").alias("n"))
    names = counted.select(raw).distinct().withColumn("label", normalize_label(raw)).where("label IS NOT NULL")
    return counted.join(names, raw).groupBy(*by, "label").agg(F.sum("n").alias("n"))


def entity_labels(nodes: DataFrame) -> DataFrame:
    """file, label and n: known labels that records name themselves, and those of their
    entities, categories and labelling results. Records are the objects with only
    arrays above them."""
    v = F.col("value")
    named = F.array(as_text(given(v, "$.label", "$.category", "$.type")))
    entities = F.transform(items(v, "$.entities"), lambda e: as_text(given(e, "$.label", "$.category", "$.type")))
    categories = F.transform(items(v, "$.categories"), lambda c: as_text(given(c, "$.name", "$.label")))
    results = F.flatten(F.transform(items(v, "$.annotations"), lambda a: items(a, "$.result")))
    marks = F.flatten(F.transform(results, lambda r: F.transform(items(given(r, "$.value.labels", "$.labels")), as_text)))
    rows = nodes.where(F.col("top") & is_object(v)).select("file", F.explode(F.concat(named, entities, categories, marks)).alias("raw"))
    return _labels(rows.where("raw <> ''"), ["file"], "raw")


def raw_label_counts(nodes: DataFrame) -> DataFrame:
    """label and n of the members ``label`` at any depth, whatever their values; null by that name."""
    text = F.coalesce(F.try_variant_get("value", "$", "string"), F.when(F.is_variant_null("value"), "null"), F.to_json("value"))
    return nodes.where(F.col("key") == "label").groupBy(text.alias("label")).agg(F.count("*").alias("n"))


def relation_type_counts(nodes: DataFrame) -> DataFrame:
    """file, type and n of the records' relations and labelling results that are some."""
    kinds = nodes.where(F.col("top") & is_object(F.col("value"))).select("file", F.explode(relation_types(F.col("value"))).alias("type"))
    return kinds.groupBy("file", "type").agg(F.count("*").alias("n"))


def sensitive_members(nodes: DataFrame) -> DataFrame:
    """file and path of the members whose key looks like personal data; each distinct
    key is judged once."""
    keys = nodes.where("key IS NOT NULL").select("key").distinct()
    odd = keys.where(T.normalize_key("key").rlike(SENSITIVE.pattern))
    return nodes.join(odd, "key", "left_semi").select("file", "path")


def sensitive_fields(nodes: DataFrame) -> DataFrame:
    """path and n of ``sensitive_members``."""
    return sensitive_members(nodes).groupBy("path").agg(F.count("*").alias("n"))


def record_count(value: Column) -> Column:
    """Elements of an array, or of an object's records, items or data; 1 for another object."""
    some = lambda p: F.size(F.try_variant_get(value, p, _NONE))
    known = [F.when(F.try_variant_get(value, p, _NONE).isNotNull(), some(p)) for p in ("$", "$.records", "$.items", "$.data")]
    return F.coalesce(*known, F.when(is_object(value), 1), F.lit(0)).cast("long")


def profiles(documents: DataFrame) -> DataFrame:
    """file, format, record_count and top_level_keys (sorted) of the documents that can be read."""
    v = F.col("document")
    keys = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))
    rows = documents.where(v.isNotNull())
    return rows.select("file", source_format(v).alias("format"), record_count(v).alias("record_count"), F.array_sort(keys).alias("top_level_keys"))


def inspect(files: DataFrame, documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The report on ``files`` (path) and their ``documents`` (file, document; null
    where a text is no JSON) as rows (section, name, n).

    Sections: kind and extension (files), format (documents), records, entity_label,
    raw_label, relation_type, sensitive_field (its path), sensitive_label (of
    ``raw_label``) and warning.
    """
    nodes = json_nodes(documents, scratch)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    known = profiles(documents)
    raw, fields = raw_label_counts(nodes), sensitive_fields(nodes)
    people = raw.where(F.col("label").isin(*SENSITIVE_LABELS))
    count = lambda rows, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    total = lambda rows, name, n="n": rows.groupBy(name.alias("name")).agg(F.sum(n).alias("n"))
    none = lambda kind: files.agg(F.count(F.when(file_kind(F.col("path")) == kind, 1)).alias("n")).where("n = 0")
    warn = lambda rows, name: rows.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("name"), "n")
    parts = {
        "kind": [count(files, file_kind(F.col("path")))],
        "extension": [count(files, F.when(extension == "", "<none>").otherwise(extension))],
        "format": [count(known, F.col("format"))],
        "records": [total(known, F.lit("records"), "record_count")],
        "entity_label": [total(entity_labels(nodes), F.col("label"))],
        "raw_label": [total(raw, F.col("label"))],
        "relation_type": [total(relation_type_counts(nodes), F.col("type"))],
        "sensitive_field": [fields.select(F.col("path").alias("name"), "n")],
        "sensitive_label": [people.select(F.col("label").alias("name"), "n")],
        "warning": [
            warn(documents.where("document IS NULL"), "unreadable files"), warn(fields, "fields that may identify a person"),
            warn(people, "labels that may tell of a person"),
            none("annotation_candidate").select(F.lit("no annotation files").alias("name"), F.lit(1).cast("long").alias("n")),
            none("image").select(F.lit("no images").alias("name"), F.lit(1).cast("long").alias("n")),
        ],
    }
    rows = [part.select(F.lit(section).alias("section"), "name", "n") for section, some in parts.items() for part in some]
    return reduce(DataFrame.unionByName, rows)


def inspect_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``inspect`` of a folder: JSON files are a document each, JSON lines one a line."""
    from docloom.sources.files import json_documents, walk

    files = walk(spark, path)
    found = [json_documents(spark, path, glob="*.json"), json_documents(spark, path, lines=True, glob="*.{jsonl,ndjson}")]
    return inspect(files, reduce(DataFrame.unionByName, found))
