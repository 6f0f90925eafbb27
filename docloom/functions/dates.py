"""Dates and times of day of a medication plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: hours and minutes.
TIME = "^(?:[01][0-9]|2[0-3]):[0-5][0-9]$"


def strict_date(col: Column) -> Column:
    """A date of the form YYYY-MM-DD that exists, else null."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col, "yyyy-MM-dd"))


def inclusive_end_date(start: Column, days: Column) -> Column:
    """Null unless start is a date and days a whole number above 0."""
    return F.when((days > 0) & (days == F.floor(days)), F.date_add(strict_date(start), days.cast("int") - 1))


def time_slots_error(slots: Column) -> Column:
    trimmed = F.transform(slots, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.when(~F.forall(trimmed, lambda x: x.rlike(TIME)), "timeSlots must be HH:mm").when(
        F.size(F.array_distinct(trimmed)) != F.size(trimmed), "timeSlots must not repeat"
    )


def time_slots(slots: Column) -> Column:
    """Sorted; null where a slot is no time of day or repeats."""
    return F.when(time_slots_error(slots).isNull(), F.array_sort(F.transform(slots, lambda x: F.trim(x))))


def reminder_schedule(times: Column) -> Column:
    """Sorted without repeats; null unless all are times of day and there is one."""
    good = (F.size(times) > 0) & F.forall(times, lambda x: F.coalesce(x.rlike(TIME), F.lit(False)))
    return F.when(good, F.array_sort(F.array_distinct(times)))
