"""Boxes [x1, y1, x2, y2] as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(v: Column) -> Column:
    v = v.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def is_numeric(box: Column, exactly: bool = False) -> Column:
    size = F.size(box) == 4 if exactly else F.size(box) >= 4
    return F.coalesce(box.isNotNull() & size & F.forall(F.slice(box, 1, 4), _finite), F.lit(False))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), F.get(box, F.lit(2)) - F.get(box, F.lit(0))) * F.greatest(F.lit(0.0), F.get(box, F.lit(3)) - F.get(box, F.lit(1)))


def intersection(a: Column, b: Column) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(F.get(a, F.lit(2)), F.get(b, F.lit(2))) - F.greatest(F.get(a, F.lit(0)), F.get(b, F.lit(0))))
    return wide * F.greatest(F.lit(0.0), F.least(F.get(a, F.lit(3)), F.get(b, F.lit(3))) - F.greatest(F.get(a, F.lit(1)), F.get(b, F.lit(1))))


def _guarded(a: Column, b: Column, exactly: bool, value: Column) -> Column:
    return F.coalesce(F.when(is_numeric(a, exactly) & is_numeric(b, exactly), value), F.lit(0.0))


def iou(a: Column, b: Column, exactly: bool = False) -> Column:
    """0 where a box is not numeric or nothing is covered."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return _guarded(a, b, exactly, F.when(union > 0, both / union))


def overlap_coverage(a: Column, b: Column) -> Column:
    """The intersection for each unit of the smaller area."""
    least = F.least(area(a), area(b))
    return _guarded(a, b, True, F.when(least > 0, intersection(a, b) / least))


def overlaps(a: Column, b: Column) -> Column:
    """A cheap necessary condition of a positive IoU."""
    return (F.get(a, F.lit(0)) < F.get(b, F.lit(2))) & (F.get(b, F.lit(0)) < F.get(a, F.lit(2))) & (F.get(a, F.lit(1)) < F.get(b, F.lit(3))) & (F.get(b, F.lit(1)) < F.get(a, F.lit(3)))


def center_y(box: Column) -> Column:
    return (F.get(box, F.lit(1)) + F.get(box, F.lit(3))) / 2


def height(box: Column) -> Column:
    return F.greatest(F.lit(1.0), F.get(box, F.lit(3)) - F.get(box, F.lit(1)))


def valid_in_image(box: Column, width: Column, height_: Column) -> Column:
    inside = (F.get(box, F.lit(0)) >= 0) & (F.get(box, F.lit(1)) >= 0) & (F.get(box, F.lit(0)) <= F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) <= F.get(box, F.lit(3))) & (F.get(box, F.lit(2)) <= width) & (F.get(box, F.lit(3)) <= height_)
    return is_numeric(box) & (width.isNull() | height_.isNull() | F.coalesce(inside, F.lit(False)))


def is_proper(box: Column) -> Column:
    """Four finite numbers and a positive area."""
    return is_numeric(box, True) & F.coalesce((F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1))), F.lit(False))


def from_polygon(points: Column) -> Column:
    """The hull of points [[x, y], ...]."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def from_xywh(box: Column) -> Column:
    return F.array(F.get(box, F.lit(0)), F.get(box, F.lit(1)), F.get(box, F.lit(0)) + F.get(box, F.lit(2)), F.get(box, F.lit(1)) + F.get(box, F.lit(3)))


def from_percent(x: Column, y: Column, w: Column, h: Column, width: Column, height_: Column) -> Column:
    return F.array(x / 100 * width, y / 100 * height_, (x + w) / 100 * width, (y + h) / 100 * height_)


def crop(box: Column, padding: int, width: Column, height_: Column) -> Column:
    """Rounded half to even, padded and held inside the image; null if empty."""
    low = [F.greatest(F.lit(0), F.bround(F.get(box, F.lit(i))) - padding) for i in (0, 1)]
    high = [F.least(s, F.bround(F.get(box, F.lit(i))) + padding) for i, s in ((2, width), (3, height_))]
    return F.when((high[0] > low[0]) & (high[1] > low[1]), F.array(*low, *high).cast("array<long>"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def ratio_or_empty(part: Column, whole: Column, other: Column) -> Column:
    """part / whole; of an empty whole 1 if the other side is empty too, else 0."""
    return F.when(whole == 0, F.when(other == 0, 1.0).otherwise(0.0)).otherwise(part / whole)
