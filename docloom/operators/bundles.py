"""Annotation bundles of several roles, checked against their manifests on import."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docloom.operators.annotations import validate
from docloom.operators.vocabulary import ROLES

#: Columns of a record as a bundle has it.
RECORD = (
    "sample_id string, annotation_status string, entities array<struct<id: string, label: string, text: string, bbox: array<double>, needs_review: boolean>>, "
    "relations array<struct<id: string, type: string, source_entity_id: string, target_entity_id: string, needs_review: boolean>>, "
    "privacy struct<de_identified: boolean, reviewed: boolean, approved_for_research: boolean>"
)


class Imported(NamedTuple):
    """records (role, sample_id, body) to write, and what was not taken (role,
    sample_id, problem, errors)."""

    records: DataFrame
    invalid: DataFrame


def check_bundles(bodies: DataFrame, manifest: DataFrame, schema: str = RECORD) -> Imported:
    """Records of ``bodies`` (role, sample_id, body: JSON) that the ``manifest`` (role, sample_id,
    sha256) lists with the same checksum and that are valid; of a listed record that is there several times
    one with the right checksum counts.

    Problems, the first that holds: unknown role, missing (listed, not there), not in
    the manifest, checksum, not JSON, another sample_id inside, invalid (with the
    broken rules).
    """
    text = bodies.select("role", "sample_id", "body", F.sha2(F.col("body").cast("binary"), 256).alias("found"))
    listed = manifest.select("role", "sample_id", "sha256").distinct()
    same = text.join(listed.withColumnRenamed("sha256", "found").withColumn("right", F.lit(True)), ["role", "sample_id", "found"], "left")
    once = same.groupBy("role", "sample_id").agg(F.max(F.coalesce("right", F.lit(False))).alias("right"), F.max_by("body", F.struct(F.coalesce("right", F.lit(False)), "found")).alias("body"))
    keys = listed.select("role", "sample_id").distinct().withColumn("listed", F.lit(True))
    rows = once.withColumn("there", F.lit(True)).join(keys, ["role", "sample_id"], "full")
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    known = F.try_variant_get(F.try_parse_json("body"), "$", "map<string,variant>").isNotNull()
    rows = rows.select("*", F.when(known, parsed).alias("r"))
    problem = (
        F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown role").when(F.col("there").isNull(), "missing")
        .when(F.col("listed").isNull(), "not in the manifest").when(~F.col("right"), "checksum").when(F.col("r").isNull(), "not JSON")
        .when(~F.col("r.sample_id").eqNullSafe(F.col("sample_id")), "another sample_id")
    )
    rows = rows.select("role", F.col("sample_id").alias("__id"), "body", problem.alias("problem"), F.coalesce("r", F.from_json(F.lit("{}"), schema)).alias("r"))
    judged = validate(rows.select("role", "__id", "body", "problem", "r.*"))
    wrong = F.coalesce("problem", F.when(~F.col("valid"), "invalid"))
    judged = judged.select("role", F.col("__id").alias("sample_id"), "body", wrong.alias("problem"), "errors")
    errors = F.when(F.col("problem") == "invalid", F.col("errors")).otherwise(F.array().cast("array<string>"))
    return Imported(judged.where("problem IS NULL").select("role", "sample_id", "body"), judged.where("problem IS NOT NULL").select("role", "sample_id", "problem", errors.alias("errors")))


def import_bundles(bodies: DataFrame, manifest: DataFrame, path: str, parts: int = 16) -> dict:
    """Writes the records that pass below ``path``/records, a folder for each role,
    and the others to ``path``/invalid; returns how many of each, counted on the way. Roles that
    come again replace their folder and no other, records are dealt by a hash of their ids and sorted, so a second run
    with the same input leaves the same texts in the same files but for their names."""
    found = check_bundles(bodies, manifest)
    kept, lost = Observation("records"), Observation("invalid")
    dealt = found.records.observe(kept, F.count(F.lit(1)).alias("imported"))
    dealt = dealt.repartition(parts, "role", F.pmod(F.xxhash64("sample_id"), F.lit(parts))).sortWithinPartitions("role", "sample_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("role").json(f"{path}/records")
    found.invalid.observe(lost, F.count(F.lit(1)).alias("invalid")).write.mode("overwrite").json(f"{path}/invalid")
    return kept.get | lost.get
