"""Rows of the medication app's contract. A broken rule is a row's ``error``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import dates as D
from docloom.functions import text as T


def _positive(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(v.isNotNull() & ~((v > 0) & (v == F.floor(v))), F.lit(f"{c} must be a positive integer"))


def parsed_medication(rows: DataFrame) -> DataFrame:
    """Adds error, frequency, frequencySource, recognized, timesPerDay, timeSlots
    and frequencyRequiresReview; null columns count as not given."""
    f = T.normalize_frequency(F.col("frequency"), F.col("frequencySource"))
    out = rows.withColumn("__f", f).withColumn("__slots", D.time_slots(F.col("timeSlots")))
    times = F.coalesce(F.col("timesPerDay").cast("long"), T.default_times_per_day(F.col("__f.frequency")).cast("long"))
    error = F.coalesce(
        F.when(T.clean_text("medicineName") == "", F.lit("medicineName is required")),
        D.time_slots_error(F.col("timeSlots")), _positive("timesPerDay"), _positive("doseQuantity"), _positive("durationDays"),
    )
    open_ = F.col("__slots").isNull() | F.col("__times").isNull() | (F.size("__slots") != F.col("__times"))
    needs = ~F.col("__f.frequency").eqNullSafe(F.lit("AS_NEEDED")) & open_
    out = out.withColumn("error", error).withColumn("__times", times)
    out = out.withColumn("frequencyRequiresReview", F.coalesce(F.col("frequencyRequiresReview"), F.lit(False)) | ~F.col("__f.recognized") | needs)
    out = out.withColumn("recognized", F.col("__f.recognized")).withColumn("frequencySource", F.col("__f.frequency_source"))
    out = out.withColumn("frequency", F.col("__f.frequency")).withColumn("timesPerDay", F.col("__times")).withColumn("timeSlots", F.col("__slots"))
    return out.withColumn("medicineName", T.clean_text("medicineName")).drop("__f", "__slots", "__times")


def create_request_error() -> Column:
    """The first broken rule of a request to create a medication, else null."""
    start, end = D.strict_date(F.col("startDate")), D.strict_date(F.col("endDate"))
    slots, times = F.col("timeSlots"), F.col("timesPerDay").cast("double")
    n = F.size(slots)
    need = F.col("frequency") != "AS_NEEDED"
    differ = F.lit("timesPerDay must equal the number of timeSlots")
    return F.coalesce(
        F.when(T.clean_text("medicineName") == "", F.lit("medicineName is required")),
        F.when(~F.coalesce(F.col("frequency").isin(*T.FREQUENCIES), F.lit(False)), F.lit("frequency is not valid")),
        F.when(start.isNull(), F.lit("startDate is not valid")),
        F.when(F.col("endDate").isNotNull() & end.isNull(), F.lit("endDate is not valid")),
        F.when(end < start, F.lit("endDate is before startDate")),
        _positive("timesPerDay"),
        D.time_slots_error(slots),
        F.when(~need & slots.isNotNull() & times.isNotNull() & (n != times), differ),
        F.when(need & (slots.isNull() | (n == 0)), F.lit("timeSlots are required")),
        F.when(need & times.isNull(), F.lit("timesPerDay is required")),
        F.when(need & (times != n), differ),
        F.when((F.col("frequency") == "TWICE_DAILY") & ~((n == 2) & (times == 2)), F.lit("TWICE_DAILY needs 2 times")),
    )
