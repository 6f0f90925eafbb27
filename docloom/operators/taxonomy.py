"""Kinds of errors of extracted fields, by a cascade of matches on what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import marks
from docloom.functions import text as T

# Fields whose wrong values have a code of their own, and those whose errors count as critical.
WRONG = ("DRUG", "STRENGTH", "DOSE", "FREQUENCY", "ROUTE", "DURATION", "TIMING")
CRITICAL = ("DRUG", "STRENGTH", "DOSE", "FREQUENCY", "ROUTE")
CODES = (
    "WRONG_DRUG", "WRONG_STRENGTH", "WRONG_DOSE", "WRONG_FREQUENCY", "WRONG_ROUTE", "WRONG_RELATION", "OMISSION", "HALLUCINATED_FIELD",
    "WRONG_DURATION", "WRONG_TIMING", "NORMALIZATION_ONLY",
)

#: Equal rows that one array holds at most.
BLOCK = 4096


def same_meaning(value: Column) -> Column:
    """A value without what only its writing tells: case, marks, blanks between number
    and unit, a decimal comma, and short forms of unit words. No row passes Python."""
    spaced = F.regexp_replace(F.translate(marks.strip_combining(F.lower(T.clean_text(value))), "đ", "d"), r"(\d),(\d)", "$1.$2")
    out = T.collapse(F.regexp_replace(spaced, r"(\d)\s*([a-z])", "$1 $2"))
    for short, word in T.UNIT_WORDS.items():
        if short != (plain := marks.plain(word).replace("đ", "d")):
            out = F.regexp_replace(out, rf"(?<![a-z0-9]){short}(?![a-z0-9])", plain)
    return out


def _met(rows: DataFrame, step: int, keys: list[str], only: Column) -> DataFrame:
    """``rows`` of both sides with those matched that are open, ``only`` true, and the nth
    of their side of equal ``keys`` where the other side has an nth; these get the
    step, its keys and n. Rows that are not open stand together, whatever their keys."""
    rows = rows.withColumn("__open", ~F.col("done") & F.col("step").isNull() & only)
    rows = rows.withColumns({f"__{k}": F.when(F.col("__open"), F.col(k)) for k in keys})
    group = Window.partitionBy("sample_id", "field", "__open", *[f"__{k}" for k in keys]).orderBy("said_side", "drug", "value")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"__n": F.row_number().over(group), "__gold": F.count_if(~F.col("said_side")).over(whole), "__all": F.count(F.lit(1)).over(whole)})
    nth = F.col("__n") - F.when(F.col("said_side"), F.col("__gold")).otherwise(0)
    rows = rows.withColumn("__nth", nth).withColumn("__met", F.col("__open") & (F.col("__nth") <= F.least(F.col("__gold"), F.col("__all") - F.col("__gold"))))
    found = {"step": F.lit(step), "nth": F.col("__nth"), **{f"met_{k}": F.col(k) if k in keys else F.lit(None).cast("string") for k in ("drug", "norm")}}
    rows = rows.withColumns({c: F.when(F.col("__met"), v).otherwise(F.col(c)) for c, v in found.items()})
    return rows.drop("__open", "__n", "__gold", "__all", "__nth", "__met", *[f"__{k}" for k in keys])


def classify(gold: DataFrame, said: DataFrame) -> DataFrame:
    """``classify_sides`` of two tables (sample_id, drug, field, value)."""
    side = lambda rows, is_said: rows.select(*[F.col(c).cast("string") for c in ("sample_id", "drug", "field", "value")], F.lit(is_said).alias("said_side"))
    return classify_sides(side(gold, False).unionByName(side(said, True)))


def classify_sides(rows: DataFrame) -> DataFrame:
    """One row for each field of gold and each said one (sample_id, drug, field, value,
    said_side) that has no partner there: sample_id, field, drug, value, said_drug, said, code
    (null where the value is right) and critical.

    Partners are looked for among what is left, in this order: the same value of the
    same drug's field; the same but for its writing (NORMALIZATION_ONLY); the same
    meaning at another drug (WRONG_RELATION); another value of the same field
    (WRONG_ and its name). What then has no partner is an OMISSION or a
    HALLUCINATED_FIELD, so each field has one code. Equal fields are matched one by one;
    null samples, drugs and fields are those of the name ''.

    Partners have one sample and field, so both sides are shuffled by these once. Equal
    values are counted, not sorted; the other steps sort what is there, and
    only values left by the first are normalised.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows.select(*map(named, ("sample_id", "drug", "field", "value")), "said_side").repartition("sample_id", "field")
    rows = rows.groupBy("sample_id", "field", "drug", "value").agg(F.count_if(~F.col("said_side")).alias("of_gold"), F.count_if("said_side").alias("of_said"))
    rows = rows.withColumn("same", F.least("of_gold", "of_said")).withColumn("all", F.greatest("of_gold", "of_said")).withColumn("said_side", F.col("of_said") > F.col("of_gold"))
    rows = rows.withColumn("norm", same_meaning(F.when(F.col("same") < F.col("all"), F.col("value"))))
    # a row for each again, in blocks, so that no array is long
    rows = rows.withColumn("from", F.explode(F.when(F.col("all") > BLOCK, F.sequence(F.lit(0), F.col("all") - 1, F.lit(BLOCK))).otherwise(F.array(F.lit(0).cast("long")))))
    part = lambda upto: F.least(F.greatest(upto - F.col("from"), F.lit(0)), F.lit(BLOCK)).cast("int")
    right = part(F.col("same"))
    rows = rows.withColumn("done", F.explode(F.concat(F.array_repeat(F.lit(True), right), F.array_repeat(F.lit(False), part(F.col("all")) - right))))
    rows = rows.select("sample_id", "field", "drug", "value", "norm", (F.col("said_side") & ~F.col("done")).alias("said_side"), "done")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in {"step": "int", "nth": "int", "met_drug": "string", "met_norm": "string"}.items()})
    steps = [(["drug", "norm"], F.lit(True)), (["norm"], F.col("field") != "DRUG"), (["drug"], F.col("field").isin(*WRONG))]
    for i, (keys, only) in enumerate(steps):
        rows = _met(rows, i, keys, only)
    partner = F.max(F.when(F.col("said_side") & F.col("step").isNotNull(), F.struct("drug", "value"))).over(Window.partitionBy("sample_id", "field", "step", "met_drug", "met_norm", "nth"))
    rows = rows.withColumn("partner", F.when(F.col("done"), F.struct("drug", "value")).when(F.col("step").isNotNull(), partner))
    rows = rows.where(~(F.col("said_side") & F.col("step").isNotNull()))
    code = F.when(F.col("step") == 0, "NORMALIZATION_ONLY").when(F.col("step") == 1, "WRONG_RELATION").when(F.col("step") == 2, F.concat(F.lit("WRONG_"), F.col("field")))
    of_gold = lambda c: F.when(~F.col("said_side"), F.col(c))
    of_said = lambda c: F.when(F.col("said_side"), F.col(c)).otherwise(F.col("partner")[c])
    lost = F.when(F.col("said_side"), "HALLUCINATED_FIELD").otherwise("OMISSION")
    rows = rows.select(
        "sample_id", "field", of_gold("drug").alias("drug"), of_gold("value").alias("value"), of_said("drug").alias("said_drug"), of_said("value").alias("said"),
        F.when(F.col("step").isNotNull(), code).when(~F.col("done"), lost).alias("code"),
    )
    return rows.withColumn("critical", F.col("code").isNotNull() & (F.col("code") != "NORMALIZATION_ONLY") & F.col("field").isin(*CRITICAL))


def error_counts(rows: DataFrame) -> DataFrame:
    """code (CORRECT where it is null), n and critical of ``classify``."""
    return rows.groupBy(F.coalesce("code", F.lit("CORRECT")).alias("code")).agg(F.count("*").alias("n"), F.count_if("critical").alias("critical"))
