"""JSON documents of any known shape to canonical annotations, in one pass.

Documents are told apart by shape; every shape gives samples, entities and links in
the same columns, so labels, ids and relations are settled once for all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators.convert import needs_review
from docloom.operators.inspection import given, is_object, items, let, text_at
from docloom.operators.profile import clean_sample_id, field_label, image_ref, normalize_label, with_label
from docloom.operators.splits import suffixed_ids
from docloom.session import Scratch

_SAMPLE = ["file", "idx", "shape", "sample_id", "fallback", "image", "split"]
_ENTITY = ["file", "idx", "ord", "source_id", "kind", "raw", "text", "normalized_text", "bbox", "flag"]
_LINK = ["file", "idx", "ord", "type", "source", "target"]
_TEXT_MAP = "map<string,string>"


class Converted(NamedTuple):
    """annotations; notes on what was left out (file, idx, note, n); and the files
    that could not be read (file, problem)."""

    annotations: DataFrame
    notes: DataFrame
    skipped: DataFrame


def name_of(value: Column, *paths: str) -> Column:
    """The first given of some paths as text, null where none is or it is empty."""
    return F.nullif(text_at(value, *paths), F.lit(""))


def number(value: Column, *paths: str) -> Column:
    """The first given of some paths as a finite number, else null."""
    n = F.try_variant_get(given(value, *paths), "$", "double")
    return let(n, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))


def bbox_of(value: Column, xywh: bool = False, width: Column | None = None, height: Column | None = None) -> Column:
    """Corners of a VARIANT box: the first four numbers of an array (``xywh``: a
    corner and sizes), or an object's x or left, y or top, width or w, and height or
    h, in percent of ``width`` and ``height`` where these are known."""
    scale = lambda size: F.lit(1.0) if size is None else F.coalesce(size / 100, F.lit(1.0))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    known = lambda box: F.when((F.size(box) >= 4) & F.forall(box, finite), F.slice(box, 1, 4))
    listed = known(F.try_variant_get(value, "$", "array<double>"))
    listed = let(listed, G.from_xywh) if xywh else listed
    # a side is the first name that is given, be it a number or not
    side = lambda a, b: F.when(F.try_variant_get(value, a, "string").isNotNull(), F.try_variant_get(value, a, "double")).otherwise(F.try_variant_get(value, b, "double"))
    sides = F.array(*[side(*p) for p in (("$.x", "$.left"), ("$.y", "$.top"), ("$.width", "$.w"), ("$.height", "$.h"))])
    scales = F.array(scale(width), scale(height))
    corners = let(
        F.struct(sides.alias("s"), scales.alias("by")),
        lambda b: F.array(b["s"][0] * b["by"][0], b["s"][1] * b["by"][1], (b["s"][0] + b["s"][2]) * b["by"][0], (b["s"][1] + b["s"][3]) * b["by"][1]),
    )
    return F.coalesce(listed, F.when(is_object(value), let(corners, known)))


def shape_of(document: Column) -> Column:
    """coco, word_boxes or records; null for what is no document."""
    has = lambda v, p: F.try_variant_get(v, p, "variant").isNotNull()
    every = items(document)
    boxes = (F.size(every) > 0) & F.forall(every, lambda x: is_object(x) & has(x, "$.label") & has(x, "$.box"))
    coco = F.try_variant_get(document, "$.images", "array<variant>").isNotNull() & F.try_variant_get(document, "$.annotations", "array<variant>").isNotNull()
    return F.when(document.isNotNull(), F.when(coco, "coco").when(boxes, "word_boxes").otherwise("records"))


def _name(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def _rows(documents: DataFrame) -> DataFrame:
    """file, idx, record and names (its keys as the text has them) of ``records``
    documents: the elements of an array, or of an object's records or items, or the
    object itself. VARIANT sorts keys, so their order comes from the text."""
    v, text = F.col("document"), F.col("value")
    own = lambda p: F.try_variant_get(v, p, "array<variant>")
    rows = documents.where("shape = 'records'").select("file", "value", "document", own("$").alias("own"), own("$.records").alias("inner"), own("$.items").alias("items"))
    marked = lambda r: F.try_variant_get(r, "$.entities", "array<variant>").isNotNull()
    tasks = lambda r: F.try_variant_get(r, "$.annotations", "array<variant>").isNotNull()
    shape = lambda r: F.when(marked(r), "annotation").when(tasks(r), "label_studio").otherwise("fields")
    records = F.coalesce("own", "inner", "items", F.when(~F.is_variant_null(v), F.array(v)))
    rows = rows.select("file", "value", "own", "inner", "items", F.transform(records, lambda r: F.struct(r.alias("record"), shape(r).alias("shape"))).alias("records"))
    inside = lambda name: F.from_json(text, f"{name} array<{_TEXT_MAP}>")[name]
    ordered = F.when(F.col("own").isNotNull(), F.from_json(text, f"array<{_TEXT_MAP}>")).when(F.col("inner").isNotNull(), inside("records"))
    ordered = ordered.when(F.col("items").isNotNull(), inside("items")).otherwise(F.array(F.from_json(text, _TEXT_MAP)))
    # names go with their record: a row that had those of the whole document would be as long as that
    names = F.when(F.exists("records", lambda r: r["shape"] == "fields"), F.transform(ordered, F.map_keys))
    rows = rows.select("file", F.arrays_zip("records", F.slice(F.coalesce(names, F.array().cast("array<array<string>>")), F.lit(1), F.size("records")).alias("names")).alias("r"))
    rows = rows.select("file", F.posexplode("r").alias("idx", "r")).select("file", F.col("idx").cast("long").alias("idx"), "r.records.record", "r.records.shape", F.col("r.names").alias("names"))
    known = F.map_keys(F.try_variant_get("record", "$", "map<string,variant>"))
    names = F.when(F.col("shape") == "fields", F.coalesce("names", known, F.array().cast("array<string>")))
    return rows.select("file", "idx", "record", names.alias("names"), "shape")


def _record_parts(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, r = scratch.keep(_rows(documents), "records"), F.col("record")
    of = lambda shape: rows.where(F.col("shape") == shape)
    image = text_at(r, "$.image", "$.image_path", "$.file_name", "$.filename", "$.file", "$.data.image")
    task, has = F.col("shape") == "label_studio", lambda p: F.try_variant_get(r, p, "string").isNotNull()
    named = has("$.id") | (~task & has("$.sample_id"))
    name = F.when(named, F.when(task, text_at(r, "$.id")).otherwise(text_at(r, "$.sample_id", "$.id"))).when(F.col("shape") == "annotation", "").otherwise(image)
    fallback = F.concat(_name(F.col("file")), F.lit("_"), (F.col("idx") + 1).cast("string"))
    samples = rows.select("file", "idx", "shape", name.alias("sample_id"), fallback.alias("fallback"), image.alias("image"), F.try_variant_get(r, "$.split", "string").alias("split"))

    e = F.col("e")
    marked = of("annotation").select("file", "idx", F.posexplode(items(r, "$.entities")).alias("ord", "e"))
    first = lambda p: text_at(e, *p)
    entities = marked.select(
        "file", "idx", "ord", F.coalesce(name_of(e, "$.id"), F.col("ord").cast("string")).alias("source_id"), F.lit("label").alias("kind"),
        first(("$.label", "$.category", "$.type")).alias("raw"), first(("$.text", "$.raw_text")).alias("text"),
        first(("$.normalized_text", "$.normalizedText")).alias("normalized_text"), bbox_of(F.try_variant_get(e, "$.bbox", "variant")).alias("bbox"),
        F.coalesce(F.try_variant_get(e, "$.needs_review", "boolean"), F.lit(False)).alias("flag"),
    )
    links = of("annotation").select("file", "idx", F.posexplode(items(r, "$.relations")).alias("ord", "e")).select(
        "file", "idx", "ord", F.coalesce(name_of(e, "$.type"), F.lit("RELATED_TO")).alias("type"),
        name_of(e, "$.source", "$.source_entity_id").alias("source"), name_of(e, "$.target", "$.target_entity_id").alias("target"),
    )

    # a task's first annotation, in percent of the image's size
    results = F.coalesce(items(given(r, "$.annotations[0]"), "$.result"), F.array().cast("array<variant>"))
    tasks = of("label_studio").select("file", "idx", *[number(r, f"$.meta.{d}").alias(d) for d in ("width", "height")], F.posexplode(results).alias("ord", "e"))
    value = F.coalesce(given(e, "$.value"), F.parse_json(F.lit("{}")))
    width, height = (F.coalesce(number(e, f"$.original_{d}", f"$.value.original_{d}"), F.col(d)) for d in ("width", "height"))
    relation = F.coalesce(F.try_variant_get(e, "$.type", "string") == "relation", F.lit(False))
    entities = entities.unionByName(
        tasks.where(~relation).select(
            "file", "idx", "ord", F.coalesce(name_of(e, "$.id"), F.col("ord").cast("string")).alias("source_id"), F.lit("label").alias("kind"),
            first(("$.value.labels[0]", "$.value.label[0]", "$.label")).alias("raw"), first(("$.value.text", "$.text")).alias("text"),
            F.lit("").alias("normalized_text"), bbox_of(value, False, width, height).alias("bbox"), F.lit(False).alias("flag"),
        )
    )
    links = links.unionByName(
        tasks.where(relation).select(
            "file", "idx", "ord", F.coalesce(name_of(e, "$.labels[0]"), F.lit("RELATED_TO")).alias("type"),
            name_of(e, "$.from_id", "$.from").alias("source"), name_of(e, "$.to_id", "$.to").alias("target"),
        )
    )

    members = of("fields").where(is_object(r)).select("file", "idx", "names", F.try_variant_get(r, "$", "map<string,variant>").alias("members"))
    member = F.transform("names", lambda name: F.struct(name.alias("raw"), F.try_element_at("members", name).alias("member")))
    members = members.select("file", "idx", F.posexplode(member).alias("ord", "m")).select("file", "idx", "ord", "m.raw", "m.member")
    text = text_at(F.col("member"), "$")
    fields = members.select(
        "file", "idx", "ord", F.lit(None).cast("string").alias("source_id"), F.lit("field").alias("kind"), "raw", text.alias("text"),
        F.lit("").alias("normalized_text"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(True).alias("flag"),
    )
    return samples, entities.unionByName(fields.where("text <> ''")), links


def _word_box_parts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows, e = documents.where("shape = 'word_boxes'"), F.col("e")
    test = F.contains(F.replace("file", F.lit("\\"), F.lit("/")), F.lit("/public_test/"))
    fallback = F.concat(F.lit("sample_"), F.substring(F.sha1("file"), 1, 12))
    zero = F.lit(0).cast("long").alias("idx")
    samples = rows.select(
        "file", zero, "shape", _name(F.col("file")).alias("sample_id"), fallback.alias("fallback"), image_ref(F.col("file")).alias("image"),
        F.when(test, "test").otherwise("train").alias("split"),
    )
    words = rows.select("file", zero, F.posexplode(items(F.col("document"))).alias("ord", "e"))
    text = text_at(e, "$.text")
    entities = words.select(
        "file", "idx", "ord", F.lit(None).cast("string").alias("source_id"), F.lit("label").alias("kind"), text_at(e, "$.label").alias("raw"),
        text.alias("text"), text.alias("normalized_text"), bbox_of(F.try_variant_get(e, "$.box", "variant")).alias("bbox"), F.lit(None).cast("boolean").alias("flag"),
    )
    return samples, entities


def _coco_parts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A sample for each image with annotations, numbered as these come."""
    rows, e = documents.where("shape = 'coco'").select("file", "document"), F.col("e")
    part = lambda name: rows.select("file", F.posexplode(items(F.col("document"), f"$.{name}")).alias("ord", "e"))
    # of equal ids the last one counts, as in a map
    last = lambda df, *keys: df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (*keys, "ord")]), "ord").alias("x"))
    images = part("images").select("file", "ord", text_at(e, "$.id").alias("image_id"), text_at(e, "$.file_name").alias("image"))
    names = part("categories").select("file", "ord", text_at(e, "$.id").alias("category"), text_at(e, "$.name").alias("raw"))
    a = part("annotations").select(
        "file", "ord", text_at(e, "$.image_id").alias("image_id"), text_at(e, "$.category_id").alias("category"),
        text_at(e, "$.text", "$.transcription").alias("text"), text_at(e, "$.normalized_text").alias("normalized_text"),
        bbox_of(F.try_variant_get(e, "$.bbox", "variant"), xywh=True).alias("bbox"),
    )
    a = a.join(last(images, "file", "image_id"), ["file", "image_id"]).withColumn("image", F.col("x.image")).drop("x")
    first = a.groupBy("file", "image_id").agg(F.min("ord").alias("__first"), F.first("image").alias("image"))
    first = first.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("__first")).cast("long") - 1)
    fallback = F.concat(_name(F.col("file")), F.lit("_"), (F.col("idx") + 1).cast("string"))
    samples = first.select(
        "file", "idx", F.lit("coco").alias("shape"), F.when(F.col("image") != "", F.col("image")).otherwise(F.col("image_id")).alias("sample_id"),
        fallback.alias("fallback"), "image", F.lit(None).cast("string").alias("split"),
    )
    a = a.drop("image").join(first.select("file", "image_id", "idx"), ["file", "image_id"]).join(last(names, "file", "category"), ["file", "category"], "left")
    entities = a.select(
        "file", "idx", "ord", F.lit(None).cast("string").alias("source_id"), F.lit("label").alias("kind"), F.coalesce("x.raw", F.lit("")).alias("raw"),
        "text", "normalized_text", "bbox", F.lit(True).alias("flag"),
    )
    return samples, entities


def convert_dataset(documents: DataFrame, scratch: Scratch | None = None) -> Converted:
    """Annotations of ``documents`` (file, value: text, document: VARIANT or null).

    annotations: file, idx, shape, sample_id (unique), image, split, entities (id,
    label, text, normalized_text, bbox, needs_review) and relations (type,
    source_entity_id, target_entity_id). Entities of unknown labels are left out and
    the others numbered; relations whose ends are left out go too; a record of plain fields links
    its last drug to all other fields. A document that is JSON's null has no records.
    Of equal sample ids all but the first by file and place get a hash behind them.
    Broken files are in ``skipped``, and the rest goes on. Documents are parsed once,
    and their parts written once for the steps that read them several times.
    """
    scratch = scratch or Scratch(documents.sparkSession, "conversion")
    rows = scratch.keep(documents.select("file", "value", "document").withColumn("shape", shape_of(F.col("document"))), "documents")
    record_samples, record_entities, links = _record_parts(rows, scratch)
    samples, entities = record_samples.select(*_SAMPLE), record_entities.select(*_ENTITY)
    for more_samples, more_entities in (_word_box_parts(rows), _coco_parts(rows)):
        samples, entities = samples.unionByName(more_samples.select(*_SAMPLE)), entities.unionByName(more_entities.select(*_ENTITY))
    samples, entities, links = (scratch.keep(df, name) for df, name in ((samples, "samples"), (entities, "entities"), (links.select(*_LINK), "links")))
    # a raw label or field name is normalised once
    label = F.when(F.col("kind") == "field", field_label("raw")).otherwise(normalize_label("raw"))
    entities = with_label(entities, ["kind", "raw"], label, scratch).withColumnRenamed("to", "label")
    flag = F.coalesce("flag", F.col("label").isin("DRUG", "INSTRUCTION"))
    normal = F.when(F.col("normalized_text") != "", F.col("normalized_text")).when(F.col("text") != "", F.col("text"))
    entity = F.struct("ord", "label", "text", normal.alias("normalized_text"), "bbox", needs_review(flag, F.col("text"), F.col("bbox")).alias("needs_review"), "source_id", "kind")
    known = entities.where("label IS NOT NULL").groupBy("file", "idx").agg(F.sort_array(F.collect_list(entity)).alias("__entities"))
    number_ = lambda i: F.concat(F.lit("entity_"), (i + 1).cast("string")).alias("id")
    fields = ["label", "text", "normalized_text", "bbox", "needs_review"]
    numbered = F.transform("__entities", lambda e, i: F.struct(number_(i), *[e[c].alias(c) for c in (*fields, "source_id", "kind")]))
    known = scratch.keep(known.withColumn("__entities", numbered), "known")
    drug = F.try_element_at(F.filter("__entities", lambda e: (e["kind"] == "field") & (e["label"] == "DRUG")), F.lit(-1))["id"]
    grouped = known.withColumn("__drug", drug)
    ends = known.select("file", "idx", F.posexplode("__entities").alias("n", "e")).select("file", "idx", "n", "e.id", "e.source_id").where("source_id IS NOT NULL")
    ends = ends.groupBy("file", "idx", "source_id").agg(F.max_by("id", "n").alias("id"))
    end = lambda c: ends.select("file", "idx", F.col("source_id").alias(c), F.col("id").alias(f"{c}_entity_id"))
    links = links.join(end("source"), ["file", "idx", "source"], "left").join(end("target"), ["file", "idx", "target"], "left")
    whole = F.col("source_entity_id").isNotNull() & F.col("target_entity_id").isNotNull()
    relation = F.struct("ord", "type", "source_entity_id", "target_entity_id")
    linked = links.where(whole).groupBy("file", "idx").agg(F.array_sort(F.collect_list(relation)).alias("__relations"))
    base = F.when(F.col("sample_id") != "", F.col("sample_id")).otherwise(F.col("fallback"))
    clean = clean_sample_id(base)
    samples = samples.withColumn("sample_id", F.when(clean != "", clean).otherwise(F.col("fallback"))).drop("fallback")
    samples = suffixed_ids(samples, "sample_id", "file", "idx")
    out = samples.join(grouped, ["file", "idx"], "left").join(linked, ["file", "idx"], "left")
    entities_ = F.coalesce(F.transform("__entities", lambda e: F.struct(*[e[c].alias(c) for c in ("id", *fields)])), F.array().cast(_ENTITIES))
    head = F.transform(
        F.filter("__entities", lambda e: F.col("__drug").isNotNull() & (e["id"] != F.col("__drug"))),
        lambda e: F.struct(F.concat(F.lit("HAS_"), e["label"]).alias("type"), F.col("__drug").alias("source_entity_id"), e["id"].alias("target_entity_id")),
    )
    listed = F.transform("__relations", lambda r: r.dropFields("ord"))
    relations = F.coalesce(F.when(F.col("shape") == "fields", head).otherwise(listed), F.array().cast(_RELATIONS))
    annotations = out.select(
        "file", "idx", "shape", "sample_id", F.when(F.col("image") != "", F.col("image")).alias("image"), "split", entities_.alias("entities"), relations.alias("relations")
    )
    lost = entities.where((F.col("kind") == "label") & F.col("label").isNull()).groupBy("file", "idx", F.lit("unknown label").alias("note"))
    cut = links.where(~whole).groupBy("file", "idx", F.lit("relation without an entity").alias("note"))
    bare = annotations.where("shape = 'fields' AND size(entities) = 0").select("file", "idx", F.lit("no known field").alias("note"), F.lit(1).cast("long").alias("n"))
    notes = lost.agg(F.count("*").alias("n")).unionByName(cut.agg(F.count("*").alias("n"))).unionByName(bare)
    skipped = rows.where("shape IS NULL").select("file", F.lit("not JSON").alias("problem"))
    return Converted(annotations, notes, skipped)


_ENTITIES = "array<struct<id: string, label: string, text: string, normalized_text: string, bbox: array<double>, needs_review: boolean>>"
_RELATIONS = "array<struct<type: string, source_entity_id: string, target_entity_id: string>>"


def write_conversion(converted: Converted, path: str, license_: str = "Unknown", status: str = "unverified") -> dict:
    """Writes annotations, notes and skipped files below ``path`` and returns the
    manifest; what it counts is observed while the annotations are written."""
    seen, lost = Observation("annotations"), Observation("skipped")
    count = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(f"{c}_written")
    converted.annotations.observe(seen, F.count(F.lit(1)).alias("annotations_written"), count("entities"), count("relations")).write.mode("overwrite").json(f"{path}/annotations")
    converted.skipped.observe(lost, F.count(F.lit(1)).alias("skipped_files")).write.mode("overwrite").json(f"{path}/skipped")
    converted.notes.write.mode("overwrite").json(f"{path}/notes")
    return {"source_license": license_, "source_status": status} | seen.get | lost.get
