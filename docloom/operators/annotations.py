"""Validation, summaries, queues and merging of annotation documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators.vocabulary import LABELS, RELATIONS, ROLES, STATUSES


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""



def _items(c: Column, rules) -> Column:
    """Messages of an array's items, item by item and rule by rule."""
    per = F.transform(c, lambda x, i: F.filter(F.array(*rules(x, i)), lambda m: m.isNotNull()))
    return F.flatten(F.coalesce(per, F.array().cast("array<array<string>>")))


def _seen_before(ids: Column, item: Column, i: Column) -> Column:
    return F.coalesce(F.array_position(ids, item) <= i, F.lit(False)) & (F.array_position(ids, item) > 0)


def errors() -> Column:
    """All broken rules of a document (sample_id, annotation_status, entities,
    relations), in order. A null item is one error and nothing else of it is
    looked at."""
    entities, relations = F.col("entities"), F.col("relations")
    ids = F.transform(entities, lambda e: F.coalesce(e["id"], F.lit("undefined")))
    relation_ids = F.transform(relations, lambda r: F.coalesce(r["id"], F.lit("undefined")))

    def entity(e, i):
        at = F.concat(F.lit("entities["), i.cast("string"), F.lit("]"))
        is_ = e.isNotNull()
        return [
            F.when(e.isNull(), F.concat(at, F.lit(" must be an object"))),
            F.when(is_ & _blank(e["id"]), F.concat(at, F.lit(".id is required"))),
            F.when(is_ & _seen_before(ids, F.coalesce(e["id"], F.lit("undefined")), i), F.concat(F.lit("duplicate entity id: "), F.coalesce(e["id"], F.lit("undefined")))),
            F.when(is_ & ~F.coalesce(e["label"].isin(*LABELS), F.lit(False)), F.concat(F.lit("invalid entity label: "), F.coalesce(e["label"], F.lit("undefined")))),
            F.when(is_ & _blank(e["text"]), F.concat(at, F.lit(".text is required"))),
            F.when(is_ & ~G.is_proper(e["bbox"]), F.concat(at, F.lit(".bbox is invalid"))),
        ]

    def label_of(wanted):
        # the last entity of an id counts
        own = F.filter(entities, lambda e: e["id"] == wanted)
        return F.when(F.size(own) > 0, F.element_at(own, -1)["label"])

    def known(wanted):
        return F.coalesce(F.exists(entities, lambda e: e["id"] == wanted), F.lit(False))

    def relation(r, i):
        at = F.concat(F.lit("relations["), i.cast("string"), F.lit("]"))
        name = F.concat(F.lit("relation "), F.coalesce(r["id"], F.lit("undefined")))
        is_, source, target = r.isNotNull(), r["source_entity_id"], r["target_entity_id"]
        want = F.when(r["type"].isin(*RELATIONS), F.replace(r["type"], F.lit("HAS_"), F.lit("")))
        return [
            F.when(r.isNull(), F.concat(at, F.lit(" must be an object"))),
            F.when(is_ & _blank(r["id"]), F.concat(at, F.lit(".id is required"))),
            F.when(is_ & _seen_before(relation_ids, F.coalesce(r["id"], F.lit("undefined")), i), F.concat(F.lit("duplicate relation id: "), F.coalesce(r["id"], F.lit("undefined")))),
            F.when(is_ & ~F.coalesce(r["type"].isin(*RELATIONS), F.lit(False)), F.concat(F.lit("invalid relation type: "), F.coalesce(r["type"], F.lit("undefined")))),
            F.when(is_ & ~known(source), F.concat(name, F.lit(" references missing source entity"))),
            F.when(is_ & ~known(target), F.concat(name, F.lit(" references missing target entity"))),
            F.when(is_ & known(source) & ~F.coalesce(label_of(source) == "DRUG", F.lit(False)), F.concat(name, F.lit(" source must be DRUG"))),
            F.when(
                is_ & known(target) & (F.coalesce(r["type"], F.lit("")) != "") & ~label_of(target).eqNullSafe(want),
                F.concat(name, F.lit(" target label must be "), F.coalesce(want, F.lit("undefined"))),
            ),
        ]

    status = F.coalesce(F.col("annotation_status").isin(*STATUSES), F.lit(False))
    head = F.array(
        F.when(_blank(F.col("sample_id")), F.lit("sample_id is required")),
        F.when(entities.isNull(), F.lit("entities must be an array")),
        F.when(relations.isNull(), F.lit("relations must be an array")),
        F.when(~status, F.lit("annotation_status must be partial, complete, or needs_review")),
    )
    none = F.coalesce(F.size(relations), F.lit(0)) <= 0
    tail = F.array(F.when((F.col("annotation_status") == "complete") & none, F.lit("complete annotation requires at least one medication relation")))
    keep = lambda a: F.filter(a, lambda m: m.isNotNull())
    return F.concat(keep(head), _items(entities, entity), _items(relations, relation), keep(tail))


def warnings() -> Column:
    none = F.coalesce(F.size("relations"), F.lit(0)) <= 0
    drug = F.coalesce(F.exists("entities", lambda e: F.coalesce(e["label"] == "DRUG", F.lit(False))), F.lit(False))
    found = F.array(
        F.when(none, F.lit("no medication relations; relation extraction cannot be evaluated")), F.when(~drug, F.lit("no DRUG entity"))
    )
    return F.filter(found, lambda m: m.isNotNull())


def validate(records: DataFrame) -> DataFrame:
    return records.withColumn("errors", errors()).withColumn("warnings", warnings()).withColumn("valid", F.size("errors") == 0)


def count_by(c: str, field: str, names) -> list[Column]:
    n = lambda name: F.coalesce(F.size(F.filter(c, lambda x: F.coalesce(x[field] == name, F.lit(False)))), F.lit(0))
    return [F.greatest(n(name), F.lit(0)).cast("long").alias(name) for name in names]


def summarize(records: DataFrame) -> DataFrame:
    """One row of counts, with every label, type and status; ``invalid_samples`` has
    the ids of invalid records."""
    rows = validate(records).select(
        "*", F.struct(*count_by("entities", "label", LABELS)).alias("__e"), F.struct(*count_by("relations", "type", RELATIONS)).alias("__r")
    )
    when = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))), F.lit(0)).cast("long")
    return rows.agg(
        F.count("*").alias("samples"), when(F.col("valid")).alias("valid_samples"), when(~F.col("valid")).alias("invalid_samples"),
        *[when(F.col("annotation_status") == s).alias(f"{s}_samples") for s in STATUSES],
        total("entities").alias("entities"), total("relations").alias("relations"),
        *[F.coalesce(F.sum(f"__e.{x}"), F.lit(0)).alias(f"entities_{x}") for x in LABELS],
        *[F.coalesce(F.sum(f"__r.{x}"), F.lit(0)).alias(f"relations_{x}") for x in RELATIONS],
        total("errors").alias("errors"), total("warnings").alias("warnings"),
    )


def invalid_samples(records: DataFrame) -> DataFrame:
    """sample_id and errors of the records that break a rule."""
    return validate(records).where("NOT valid").select("sample_id", "errors")


def inferred_status(status: Column, review: Column) -> Column:
    """Of a document without a status: complete and draft reviews, else needs_review."""
    return F.coalesce(status, F.when(review == "complete", "complete").when(review == "draft", "partial").otherwise("needs_review"))


def queue(records: DataFrame) -> DataFrame:
    """Work items: sample_id, counts by label, existing relations and actions."""
    counts = F.struct(*count_by("entities", "label", LABELS))
    relations = F.greatest(F.coalesce(F.size("relations"), F.lit(0)), F.lit(0)).cast("long")
    rows = records.withColumn("entity_counts", counts).withColumn("existing_relation_count", relations)
    actions = F.array(
        F.lit("review_privacy_and_de_identification"),
        F.lit("verify_entity_spans_against_image"),
        F.when(F.col("entity_counts.INSTRUCTION") > 0, F.lit("split_instruction_into_typed_medication_fields")),
        F.lit("annotate_medication_relations_after_entity_review"),
        F.lit("adjudicate_before_marking_complete"),
        F.when(F.col("existing_relation_count") > 0, F.lit("verify_existing_relations")),
    )
    return rows.withColumn("actions", F.filter(actions, lambda a: a.isNotNull()))


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def gold_eligible() -> Column:
    """Of a validated record: complete, cleared, related and all reviewed."""
    reviewed = lambda c: ~F.coalesce(F.exists(c, lambda x: F.coalesce(x["needs_review"], F.lit(False))), F.lit(False))
    privacy = _true("privacy.de_identified") & _true("privacy.reviewed") & _true("privacy.approved_for_research")
    done = F.coalesce((F.col("annotation_status") == "complete") & (F.size("relations") > 0), F.lit(False))
    return F.col("valid") & done & privacy & reviewed("entities") & reviewed("relations")


def experiment_ready() -> Column:
    """The weaker gate of experiments: no de-identification, no review flags."""
    done = F.coalesce((F.col("annotation_status") == "complete") & (F.size("relations") > 0), F.lit(False))
    return F.col("valid") & done & _true("privacy.reviewed") & _true("privacy.approved_for_research")


def entity_fingerprint(e: Column) -> Column:
    box = F.transform(F.coalesce(e["bbox"], F.array().cast("array<double>")), lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string")))
    text = F.regexp_replace(F.trim(F.coalesce(e["text"], F.lit(""))), r"\s+", " ")
    return F.array_join(F.concat(F.array(F.coalesce(e["label"], F.lit("")), text), box), "|")


def fingerprint() -> Column:
    """SHA-256 of a record's form without ids: sorted entities, sorted relations
    by their entities, status and privacy flags."""
    entities, relations = F.col("entities"), F.col("relations")

    def of(wanted):
        own = F.filter(entities, lambda e: e["id"] == wanted)
        return F.coalesce(F.when(F.size(own) > 0, entity_fingerprint(F.element_at(own, -1))), F.concat(F.lit("missing:"), F.coalesce(wanted, F.lit(""))))

    triples = F.transform(relations, lambda r: F.concat_ws("|", F.coalesce(r["type"], F.lit("")), of(r["source_entity_id"]), of(r["target_entity_id"])))
    flags = [_true(f"privacy.{f}").alias(f) for f in ("de_identified", "reviewed", "approved_for_research")]
    form = F.struct(
        F.array_sort(F.transform(entities, entity_fingerprint)).alias("entities"), F.array_sort(triples).alias("relations"),
        F.col("annotation_status"), F.struct(*flags).alias("privacy"),
    )
    return F.sha2(F.to_json(form), 256)


def merge_roles(records: DataFrame) -> DataFrame:
    """One row for each sample of records with a role: agreement of the two
    annotators (agree, conflict, not_comparable) and whether the reviewer's record
    is gold. Conflicts are never resolved here."""
    rows = validate(records).withColumn("fp", fingerprint()).withColumn("gold", gold_eligible())
    wide = rows.groupBy("sample_id").pivot("role", list(ROLES)).agg(F.first(F.struct("fp", "gold", "valid")))
    a, b, r = (F.col(f"`{x}`") for x in ROLES)
    agreement = F.when(a.isNull() | b.isNull(), "not_comparable").when(a["fp"] == b["fp"], "agree").otherwise("conflict")
    return wide.select(
        "sample_id", agreement.alias("agreement"), F.coalesce(r["gold"], F.lit(False)).alias("gold"), r.isNotNull().alias("reviewed"),
        F.filter(F.array(*[F.when(F.col(f"`{x}`").isNotNull(), F.lit(x)) for x in ROLES]), lambda x: x.isNotNull()).alias("roles"),
    )


def merge_report(merged: DataFrame) -> DataFrame:
    when = lambda c: F.count(F.when(c, 1))
    return merged.agg(
        F.count("*").alias("samples"), when(F.col("agreement") == "agree").alias("agreements"),
        when(F.col("agreement") == "conflict").alias("conflicts"), when(F.col("agreement") == "not_comparable").alias("not_comparable"),
        when(F.col("gold")).alias("gold"),
    )


def agreement_items(records: DataFrame, kind: str = "entities") -> DataFrame:
    """Agreement of two annotators by label or type: a as gold, b as predicted."""
    field = "label" if kind == "entities" else "type"
    item = (lambda x: entity_fingerprint(x)) if kind == "entities" else (lambda x: F.concat_ws("|", x["type"], x["source_entity_id"], x["target_entity_id"]))
    rows = records.select("sample_id", "role", F.explode(F.transform(kind, lambda x: F.struct(x[field].alias("k"), item(x).alias("v")))).alias("x"))
    rows = rows.groupBy("sample_id", "x.k", "x.v").agg(F.max((F.col("role") == ROLES[0]).cast("int")).alias("a"), F.max((F.col("role") == ROLES[1]).cast("int")).alias("b"))
    both = F.sum(F.col("a") * F.col("b"))
    return rows.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), both.alias("both"), (2 * both / (F.sum("a") + F.sum("b"))).alias("f1"))


def policy(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``decision`` by a field's thresholds (field, accept, review): ACCEPT,
    REVIEW or ABSTAIN."""
    joined = rows.join(thresholds, "field", "left")
    decision = F.when(F.col("confidence") >= F.col("accept"), "ACCEPT").when(F.col("confidence") >= F.col("review"), "REVIEW").otherwise("ABSTAIN")
    return joined.withColumn("decision", decision).drop("accept", "review")


def kept_draft(entities: Column, relations: Column, excluded: Column) -> Column:
    """Entities not excluded and the relations whose ends are among them."""
    left = F.filter(entities, lambda e: ~F.array_contains(excluded, e["id"]))
    ids = F.transform(left, lambda e: e["id"])
    whole = F.filter(relations, lambda r: F.array_contains(ids, r["source_entity_id"]) & F.array_contains(ids, r["target_entity_id"]))
    return F.struct(left.alias("entities"), whole.alias("relations"))


def saved_draft(entities: Column, relations: Column, excluded: Column, complete: Column) -> Column:
    """``kept_draft`` with its status: a complete one needs no review of anything,
    and others that of what is not marked as reviewed."""
    flag = F.lit(False)
    mark = lambda x: x.withField("needs_review", F.when(complete, flag).otherwise(F.coalesce(x["needs_review"], F.lit(True))))
    kept = kept_draft(entities, relations, excluded)
    status = F.when(complete, "complete").otherwise("needs_review")
    return F.struct(F.transform(kept["entities"], mark).alias("entities"), F.transform(kept["relations"], mark).alias("relations"), status.alias("annotation_status"))


def working_copy(entities: Column, relations: Column) -> Column:
    """Candidates as a draft to work on: entities numbered in order, of label
    INSTRUCTION where theirs is unknown and with a unit box where they have none;
    relations between their new ids, the last of an id, or else the ids they
    name. All need review; relations without an end go."""
    unit = F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])
    name = lambda kind, i: F.concat(F.lit(f"{kind}_"), (i + 1).cast("string"))
    drafts = F.transform(
        entities,
        lambda e, i: F.struct(
            name("entity", i).alias("id"), F.when(e["label"].isin(*LABELS), e["label"]).otherwise("INSTRUCTION").alias("label"),
            F.coalesce(e["text"], F.lit("")).alias("text"), F.coalesce(e["bbox"], unit).alias("bbox"), F.lit(True).alias("needs_review"), e["id"].alias("candidate_id"),
        ),
    )

    def to(wanted: Column) -> Column:
        own = F.filter(drafts, lambda e: e["candidate_id"] == wanted)
        return F.coalesce(F.try_element_at(own, F.lit(-1))["id"], wanted)

    links = F.transform(
        relations, lambda r: F.struct(r["type"].alias("type"), to(r["source_entity_id"]).alias("source_entity_id"), to(r["target_entity_id"]).alias("target_entity_id"))
    )
    whole = F.filter(links, lambda r: ~_blank(r["source_entity_id"]) & ~_blank(r["target_entity_id"]))
    numbered = F.transform(whole, lambda r, i: r.withField("id", name("relation", i)).withField("needs_review", F.lit(True)))
    none = F.array().cast("array<struct<id: string, label: string, text: string, bbox: array<double>, needs_review: boolean, candidate_id: string>>")
    return F.struct(F.coalesce(drafts, none).alias("entities"), numbered.alias("relations"))
