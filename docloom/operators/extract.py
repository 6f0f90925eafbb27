"""Rule-based candidates from labelled words and structured lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.operators.ordering import neighbours
from docloom.session import Scratch


def nearest(rows: DataFrame, targets: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows (sample_id, idx, y) with the target (idx, y) of their sample whose y is
    nearest either way, ties to the first target: target_idx, null without one.
    A row without y takes the first target; a target without y is at no distance.

    Rows and targets stand in one order of sample and y, dealt by ranges, and each
    row looks at the targets beside it; a sample of any size is never met by pairs."""
    at = targets.groupBy("sample_id", "y").agg(F.min("idx").alias("target_idx"))
    anywhere = targets.groupBy("sample_id").agg(F.min("idx").alias("__first"), F.min(F.when(F.col("y").isNull(), F.col("idx"))).alias("__loose"))
    mark = F.struct("sample_id", "y", "target_idx")
    marks = at.where("y IS NOT NULL").select("sample_id", F.lit(None).cast(rows.schema["idx"].dataType).alias("idx"), "y", F.lit(0).alias("__kind"), mark.alias("__mark"))
    asked = rows.select("sample_id", "idx", "y", F.lit(1).alias("__kind")).withColumn("__mark", F.lit(None).cast(marks.schema["__mark"].dataType))
    beside = neighbours(asked.where("y IS NOT NULL").unionByName(marks), ["sample_id", "y", "__kind"], "__mark", scratch).where("__kind = 1")
    near = lambda c: F.when(F.col(f"{c}.sample_id") == F.col("sample_id"), F.struct(F.abs(F.col("y") - F.col(f"{c}.y")).alias("d"), F.col(f"{c}.target_idx").alias("target_idx")))
    met = beside.join(anywhere, "sample_id", "left")
    loose = F.when(F.col("__loose").isNotNull(), F.struct(F.lit(0.0).alias("d"), F.col("__loose").alias("target_idx")))
    found = met.withColumn("m", F.array_min(F.filter(F.array(near("before"), near("after"), loose), lambda x: x.isNotNull())))
    known = found.select("sample_id", "idx", "y", F.col("m.target_idx").alias("target_idx"))
    rest = rows.where("y IS NULL").select("sample_id", "idx", "y").join(anywhere, "sample_id", "left")
    best = known.unionByName(rest.select("sample_id", "idx", "y", F.col("__first").alias("target_idx"))).groupBy("sample_id", "idx").agg(F.first("target_idx").alias("target_idx"))
    return rows.join(best, ["sample_id", "idx"], "left")


def medication_candidates(words: DataFrame, boundary: str = T.B, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and quantities proposed from words (sample_id, idx, id,
    label, text, box): a drug and its strengths from drug names; the first timing,
    first dose and a meal instruction from usage words, tied to the nearest drug.
    Ids count in order of emission; all need review."""
    scratch = scratch or Scratch(words.sparkSession, "candidates")
    words = scratch.keep(words.select("sample_id", "idx", "label", "text", "box", G.center_y(F.col("box")).alias("y")), "words")
    drugs = words.where("label = 'drugname'").withColumn("d", T.split_drug_name("text")).where("d.drug_name <> ''")
    key = lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), ",", "."), r"\s+", "")
    first = F.filter(
        F.transform(F.col("d.strengths"), lambda s, i: F.struct(s.alias("s"), (F.array_position(F.transform(F.col("d.strengths"), key), key(s)) == i + 1).alias("new"))),
        lambda x: x["new"],
    )
    drugs = scratch.keep(drugs.select("sample_id", "idx", "box", F.col("d.drug_name").alias("name"), first.alias("strengths")), "drugs")
    names = drugs.select("sample_id", "idx", F.lit(0).alias("part"), F.lit("DRUG").alias("label"), F.col("name").alias("text"), "box", F.col("idx").alias("drug_idx"))
    strengths = drugs.select("sample_id", "idx", F.posexplode("strengths").alias("p", "s"), "box").select(
        "sample_id", "idx", (F.col("p") + 1).alias("part"), F.lit("STRENGTH").alias("label"), F.col("s.s").alias("text"), "box", F.col("idx").alias("drug_idx")
    )
    meal = T.meal_timing("text")
    used = words.where((F.col("label") == "usage") | ((F.col("label") == "other") & meal.isNotNull()))
    near = nearest(used, words.where("label = 'drugname'"))
    note = T.clean_text(F.regexp_replace("text", r"(?iu)^Ghi chú\s*", ""))
    found = near.join(names.select("sample_id", F.col("idx").alias("target_idx"), F.lit(True).alias("has")), ["sample_id", "target_idx"])
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("TIMING").alias("label"), T.timing("text", boundary).alias("text")),
        F.struct(F.lit(1).alias("part"), F.lit("DOSE").alias("label"), T.dose("text", boundary).alias("text")),
        F.struct(F.lit(2).alias("part"), F.lit("INSTRUCTION").alias("label"), F.when(meal.isNotNull(), note).alias("text")),
    )
    rest = found.select("sample_id", "idx", F.explode(parts).alias("e"), "box", F.col("target_idx").alias("drug_idx")).where("e.text IS NOT NULL")
    rest = rest.select("sample_id", "idx", "e.part", "e.label", "e.text", "box", "drug_idx").withColumn("stage", F.lit(1))
    every = names.unionByName(strengths).withColumn("stage", F.lit(0)).unionByName(rest)
    number = Window.partitionBy("sample_id").orderBy("stage", "idx", "part")
    every = every.withColumn("n", F.row_number().over(number)).withColumn("id", F.concat(F.lit("candidate_entity_"), F.col("n")))
    every = scratch.keep(every, "entities")
    entities = every.select("sample_id", "id", "label", "text", F.col("box").alias("bbox"), F.col("idx").alias("source_idx"), F.lit(True).alias("needs_review"))
    heads = every.where("label = 'DRUG'").select("sample_id", "drug_idx", F.col("id").alias("source_entity_id"))
    links = every.where("label <> 'DRUG'").join(heads, ["sample_id", "drug_idx"])
    links = links.withColumn("id", F.concat(F.lit("candidate_relation_"), F.row_number().over(Window.partitionBy("sample_id").orderBy("n"))))
    target = F.concat(F.lit("candidate_entity_"), F.col("n"))
    relations = links.select("sample_id", "id", F.concat(F.lit("HAS_"), F.col("label")).alias("type"), "source_entity_id", target.alias("target_entity_id"), F.lit(True).alias("needs_review"))
    amounts = words.where("label = 'quantity'").withColumn("q", T.parse_quantity("text")).where("q IS NOT NULL")
    amounts = nearest(amounts, words.where("label = 'drugname'"))
    quantities = amounts.select("sample_id", "idx", "q.value", "q.unit", F.col("q.text").alias("text"), F.col("target_idx").alias("source_drug_idx"))
    return entities, relations, quantities


def carry_forward(rows: DataFrame, value, keys: list[str], order: list[str]) -> DataFrame:
    """``carried``: the last non-null value up to each row."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(run))


def structure(lines: DataFrame) -> DataFrame:
    """Lines (sample_id, line_no, text) as one row a sample: patient_and_header
    (first 7), diagnoses, dates and medicines with their notes. A note belongs to
    the last medicine above it; diagnoses and dates are looked for elsewhere.

    Lines are shuffled and sorted once and read once: each medicine knows how many notes
    stand above it, so its own are a slice of the sample's."""
    rows = lines.where(F.col("text").cast("string").rlike(f"[^{T.WS[1:-1]}]")).select("sample_id", "line_no", T.collapse("text").alias("line"))
    rows = rows.withColumn("is_m", T.is_medicine("line"))
    rows = rows.withColumn("is_note", ~F.col("is_m") & F.col("line").rlike("(?iu)ghi ch"))
    rows = rows.withColumn("said", F.when(F.col("is_note"), T.collapse(F.regexp_replace("line", r"(?iu)^ghi ch[^ ]*\s*", ""))))
    rows = rows.withColumn("has_note", F.coalesce(F.col("said") != "", F.lit(False)))
    upto = Window.partitionBy("sample_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"i": F.row_number().over(upto) - 1, "above": F.count_if("is_m").over(upto), "notes": F.count_if("has_note").over(upto).cast("int")})
    other = ~F.col("is_m") & ~(F.col("is_note") & (F.col("above") > 0))
    listed = lambda when, **parts: F.sort_array(F.collect_list(F.when(when, F.struct("i", *[c.alias(k) for k, c in parts.items()]))))
    rows = rows.select("*", F.when(other, T.line_date("line")).alias("date"), F.when(F.col("is_m"), T.parse_medicine(F.col("line"), F.col("i") + 1)).alias("m"))
    out = rows.groupBy("sample_id").agg(
        listed(F.col("i") < 7, v=F.col("line")).alias("head"), listed(other & T.is_diagnosis("line"), v=F.col("line")).alias("diagnoses"),
        listed(F.col("date").isNotNull(), v=F.col("date")).alias("dates"), listed(F.col("has_note"), v=F.col("said")).alias("said"),
        listed(F.col("is_m"), m=F.col("m"), notes=F.col("notes")).alias("found"),
    )
    texts = lambda c: F.col(c)["v"]
    end = lambda j: F.coalesce(F.get(F.col("found"), j + 1)["notes"], F.size("said"))
    medicine = lambda x, j: F.struct(x["i"].alias("carried"), x["m"].alias("m"), F.slice(texts("said"), x["notes"] + 1, end(j) - x["notes"]).alias("instructions"))
    return out.select(
        "sample_id", texts("head").alias("patient_and_header"), texts("diagnoses").alias("diagnoses"), F.array_distinct(texts("dates")).alias("dates"),
        F.when(F.size("found") > 0, F.transform("found", medicine)).alias("medicines"),
    )
