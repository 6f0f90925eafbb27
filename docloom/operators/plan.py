"""Medication plans: creation, and the state after a sequence of commands."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.dates import TIME
from docloom.operators.grouped import fold_groups
from docloom.operators.vocabulary import VERIFIABLE


def creation_error() -> Column:
    """The first broken rule of a plan (plan_id, prescription_id, medications)."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    meds = F.col("medications")
    first = lambda test: F.exists(meds, test)
    return F.coalesce(
        F.when(blank(F.col("plan_id")), F.lit("plan_id is required")),
        F.when(blank(F.col("prescription_id")), F.lit("prescription_id is required")),
        F.when(F.coalesce(F.size(meds), F.lit(0)) <= 0, F.lit("medications must not be empty")),
        F.when(first(lambda m: blank(m["medication_id"])), F.lit("medication_id is required")),
        F.when(first(lambda m: blank(m["drug_name"])), F.lit("drug_name is required")),
        F.when(first(lambda m: m["prescribed"].isNull()), F.lit("prescribed is required")),
        F.when(first(lambda m: m["verification"].isNull()), F.lit("verification is required")),
        F.when(
            first(lambda m: F.coalesce(F.exists(m["verification"]["fields_to_verify"], lambda f: ~F.coalesce(f.isin(*VERIFIABLE), F.lit(False))), F.lit(False))),
            F.lit("fields_to_verify has an unknown field"),
        ),
    )


def create_plans(plans: DataFrame) -> DataFrame:
    """Adds error, normalised medications and status: any status but verified
    needs review, and a plan is verified when nothing of it is left to verify."""
    med = F.transform(
        "medications",
        lambda m: F.struct(
            m["medication_id"].alias("medication_id"), m["drug_name"].alias("drug_name"),
            m["prescribed"].withField("raw_text", F.coalesce(m["prescribed"]["raw_text"], m["drug_name"])).alias("prescribed"),
            F.struct(
                F.when(m["verification"]["status"] == "verified", "verified").otherwise("needs_review").alias("status"),
                F.array_distinct(F.coalesce(m["verification"]["fields_to_verify"], F.array().cast("array<string>"))).alias("fields_to_verify"),
            ).alias("verification"),
            F.array().cast("array<string>").alias("reminder_schedule"),
        ),
    )
    rows = plans.withColumn("error", creation_error()).withColumn("medications", F.when(F.col("error").isNull(), med))
    open_ = F.exists("medications", lambda m: (m["verification"]["status"] != "verified") | (F.size(m["verification"]["fields_to_verify"]) > 0))
    return rows.withColumn("status", F.when(open_, "needs_verification").when(F.col("error").isNull(), "verified"))


STATE = "plan_id string, status string, applied long, rejected long, last_error string, medications string"


class Plan:
    """The state of one plan: fields left and times of each medication."""

    def __init__(self, meds: dict[str, tuple[bool, list[str]]]):
        self.left = {m: list(fields) for m, (_, fields) in meds.items()}
        self.verified = {m: bool(ok) for m, (ok, _) in meds.items()}
        self.times: dict[str, list[str]] = {m: [] for m in meds}
        self.status = self._derived()

    def _derived(self) -> str:
        done = all(self.verified[m] and not self.left[m] for m in self.left)
        return "verified" if done else "needs_verification"

    def apply(self, op: str, med: str, args: list[str]) -> str | None:
        """Applies a command, or returns why it may not be."""
        if med not in self.left:
            return f"unknown medication: {med}"
        if op == "verify":
            if any(a not in VERIFIABLE for a in args):
                return "unknown field"
            self.left[med] = [f for f in self.left[med] if f not in args]
            self.verified[med] = not self.left[med]
            self.status = self._derived()
        elif op == "schedule":
            if self.status != "verified":
                return "plan is not verified"
            if not self.verified[med]:
                return "medication is not verified"
            if not args or not all(re.match(TIME, a) for a in args):
                return "times must be HH:mm"
            self.times[med] = sorted(set(args))
            self.status = "scheduled"
        else:
            return f"unknown command: {op}"
        return None

    def text(self) -> str:
        return ";".join(f"{m}={','.join(self.left[m])}@{','.join(self.times[m])}" for m in sorted(self.left))


def fold_commands(plans: DataFrame, commands: DataFrame) -> DataFrame:
    """State of each plan (plan_id, medications of medication_id, verified and
    fields) after its commands (plan_id, seq, op, medication_id, args) in order.
    Commands that may not be applied are counted with the last reason."""

    kind = "plan_id string, seq long, op string, medication_id string, args array<string>, medications array<struct<medication_id:string,verified:boolean,fields:array<string>>>"
    types = StructType.fromDDL(kind)
    first = plans.select("plan_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("medication_id"), F.lit(None).cast("array<string>").alias("args"), "medications")
    rest = commands.select("plan_id", F.col("seq").cast("long").alias("seq"), "op", "medication_id", "args", F.lit(None).cast(types["medications"].dataType).alias("medications"))

    def run(rows) -> list[tuple]:
        head = next(rows)
        if head[5] is None:
            return []
        plan = Plan({m["medication_id"]: (m["verified"], list(m["fields"])) for m in head[5]})
        applied, rejected, last = 0, 0, None
        for _, seq, op, med, args, _ in rows:
            problem = plan.apply(op, med, list(args or [])) if seq is not None else None
            applied += seq is not None and problem is None
            rejected += problem is not None
            last = problem or last
        return [(head[0], plan.status, applied, rejected, last, plan.text())]

    both = first.unionByName(rest.where("seq IS NOT NULL"))
    return fold_groups(both, ["plan_id"], [F.asc_nulls_first("seq")], run, StructType.fromDDL(STATE))


def latest_drafts(drafts: DataFrame) -> DataFrame:
    """The last version of each annotator's draft of a sample."""
    cols = [c for c in drafts.columns if c not in ("role", "sample_id")]
    return drafts.groupBy("role", "sample_id").agg(F.max_by(F.struct(*cols), "version").alias("d")).select("role", "sample_id", "d.*")
