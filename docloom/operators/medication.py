"""Drafts of medication plans from lines of a prescription."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.linking import MARGIN, THRESHOLD, link_drugs

#: Notes of a draft (fixed values): of a medication to confirm, and of a plan without any.
CONFIRM, NOTHING = "Medication {} cần người dùng xác nhận tên thuốc/hàm lượng.", "Không phát hiện thuốc đủ bằng chứng để tạo draft."


def medication_lines(lines: DataFrame, catalog: DataFrame, trusted: bool = False, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """One row for each line (prescription_id, ord, text) whose name of 3 characters
    at least is in the catalog, or nearly: medication_id by the order of lines,
    drug_database_id (linked ones only), drug_name, raw_text, strength (the first,
    or null), status, verification_status and fields_to_verify: always the drug,
    and the strength unless one was read, the link is sure and the catalog trusted."""
    split = lines.select("prescription_id", "ord", "text", T.split_drug_name("text").alias("d"))
    read = split.where(F.length("d.drug_name") >= 3).select(
        F.concat_ws("/", F.col("prescription_id").cast("string"), F.col("ord").cast("string")).alias("query_id"),
        "prescription_id", "ord", "text", F.col("d.drug_name").alias("name"), F.get("d.strengths", F.lit(0)).alias("strength"),
    )
    asked = read.select("query_id", F.col("text").alias("raw_text"), F.col("name").alias("drug_name"), "strength")
    found = link_drugs(asked, catalog, threshold, margin).where("status <> 'not_found'")
    rows = read.join(found, "query_id")
    number = F.row_number().over(Window.partitionBy("prescription_id").orderBy("ord"))
    linked = F.col("status") == "linked"
    sure = F.col("strength").isNotNull() & linked & F.lit(trusted)
    fields = F.when(sure, F.array(F.lit("drug"))).otherwise(F.array(F.lit("drug"), F.lit("strength")))
    return rows.select(
        "prescription_id", "ord", number.alias("number"),
        F.concat(F.col("prescription_id").cast("string"), F.lit("-med-"), number.cast("string")).alias("medication_id"),
        "drug_database_id", F.when(linked, F.col("normalized_name")).otherwise(F.col("name")).alias("drug_name"),
        F.col("text").alias("raw_text"), "strength", "status", F.lit("needs_review").alias("verification_status"),
        fields.alias("fields_to_verify"), (~(linked & F.lit(trusted))).alias("confirm"),
    )


def medication_drafts(lines: DataFrame, catalog: DataFrame, trusted: bool = False, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """One plan for each prescription of ``lines``: plan_id, status, medications in
    the order of lines, and notes on what to confirm, or that nothing was found."""
    found = medication_lines(lines, catalog, trusted, threshold, margin)
    names = ["number", *[c for c in found.columns if c not in ("prescription_id", "ord", "number", "confirm")]]
    before, after = CONFIRM.split("{}")
    note = F.when(F.col("confirm"), F.concat(F.lit(before), F.col("number").cast("string"), F.lit(after)))
    plans = found.groupBy("prescription_id").agg(
        F.array_sort(F.collect_list(F.struct(*names))).alias("medications"),
        F.transform(F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct("number", note.alias("note"))))), lambda x: x["note"]).alias("notes"),
    )
    rows = lines.select("prescription_id").distinct().join(plans, "prescription_id", "left")
    notes = F.when(F.coalesce(F.size("notes"), F.lit(0)) > 0, F.col("notes")).otherwise(F.array(F.lit(NOTHING)))
    empty = F.array().cast(plans.schema["medications"].dataType)
    return rows.select(
        F.concat(F.col("prescription_id").cast("string"), F.lit("-plan")).alias("plan_id"), "prescription_id",
        F.lit("needs_verification").alias("status"), F.coalesce("medications", empty).alias("medications"), notes.alias("notes"),
    )
