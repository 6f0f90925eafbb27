import pytest
from pyspark.sql import functions as F

from docloom.functions import dates as D
from docloom.functions import geometry as G
from docloom.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("zero")).select(column).first()[0]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.normalize_drug_text, "Augrnentin 625rng", "augrnentin 625 mg"),
        (T.normalize_drug_text, "Đau 5 µg", "dau 5 g"),
        (T.normalize_ocr_text, "Sáng 1 Viên, đau", "sang 1 vien au"),
        (T.normalize_comparable_text, "  Đau Đầu! ", "dau dau!"),
        (T.normalize_key, "Đường dùng", "đuongdung"),
        (T.normalize_ocr_text, None, ""),
        (T.timing, "Uống sáng 1 viên", "sáng"),
        (T.timing, "đêm uống", None),
        (T.dose, "ngày 1,5 vien", "1,5 viên"),
        (T.meal_timing, "Uống sau khi ăn", "Uống sau khi ăn"),
        (T.frequency_from_text, "Uống ngày 2 lần", "TWICE_DAILY"),
        (T.frequency_from_text, "12 lần", "TWICE_DAILY"),
        (T.frequency_from_text, "không rõ", None),
        (T.repair_mojibake, "uá»‘ng", "uống"),
        (T.collapse, " a  b ", "a b"),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


def test_split_and_parse(spark):
    got = one(spark, T.split_drug_name(F.col("t")), t="2) NOVOXIM-500 0,5g")
    assert (got.drug_name, got.strengths) == ("NOVOXIM-500", ["0,5g"])
    got = one(spark, T.parse_strength(F.col("t")), t="0,625 g")
    assert (got.value, got.unit, got.comparable_mg) == (0.625, "g", 625.0)
    assert one(spark, T.parse_strength(F.col("t")), t="5 µg") is None
    assert one(spark, T.split_drug_name(F.col("t")), t="X 5 µg").strengths == ["5 μg"]
    got = one(spark, T.parse_quantity(F.col("t")), t="SL: 1,5 Vien, x")
    assert (got.value, got.unit, got.text) == (1.5, "viên", "SL: 1,5 Vien")
    got = one(spark, T.parse_medicine(F.col("t"), F.lit(4)), t="1) ALPHA 5 mg SL: 20 viên")
    assert (got.order, got.name, got.strength, got.quantity, got.unit, got.source_line) == (1, "ALPHA", "5 mg", "20", "viên", 4)
    assert one(spark, T.parse_medicine(F.col("t"), F.lit(4)), t="no number") is None
    assert one(spark, T.numeric_signature(F.col("t")), t="1,5 x 20") == ["1.5", "20"]


def test_error_rates(spark):
    many = " ".join(f"w{i}" for i in range(300))
    pairs = [("Sáng 1 Viên", "sang 1 vien"), ("", "x"), ("one two three", "one too three four"), (many, many.replace("w7 ", "x "))]
    rows = spark.createDataFrame(pairs, "a string, b string").select(T.normalize_ocr_text("a").alias("a"), T.normalize_ocr_text("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    got = rows.select(T.character_error_rate(a, b).alias("c"), T.wer_legacy(a, b).alias("w"), T.word_edits(a, b).alias("e")).collect()
    assert [(r.c, r.w) for r in got[:2]] == [(0.0, 0.0), (1.0, 1.0)]
    assert [r.e for r in got] == [0, 1, 2, 1]


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10))) == 1
    assert one(spark, G.iou(box(0, 0, 10, 10), box(10, 0, 20, 10))) == 0
    assert one(spark, G.iou(box(0, 0, 10), box(0, 0, 10, 10))) == 0
    assert one(spark, G.overlap_coverage(box(0, 0, 10, 10), box(0, 0, 20, 20))) == 1
    assert one(spark, G.from_xywh(box(10, 20, 30, 40))) == [10, 20, 40, 60]
    assert one(spark, G.is_proper(box(0, 0, 0, 5))) is False
    assert one(spark, G.valid_in_image(box(0, 0, 0, 5), F.lit(10), F.lit(10))) is True
    assert one(spark, G.crop(box(2.5, 3.5, 8, 9), 4, F.lit(10), F.lit(10))) == [0, 0, 10, 10]


def test_dates(spark):
    assert str(one(spark, D.inclusive_end_date(F.lit("2026-09-28"), F.lit(15)))) == "2026-10-12"
    assert str(one(spark, D.inclusive_end_date(F.lit("2026-09-28"), F.lit(1)))) == "2026-09-28"
    assert one(spark, D.strict_date(F.lit("2026-02-30"))) is None
    slots = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, D.reminder_schedule(slots("20:00", "08:00", "08:00"))) == ["08:00", "20:00"]
    assert one(spark, D.time_slots(slots("20:00", "08:00", "08:00"))) is None
    assert one(spark, D.time_slots(slots("20:00", "08:00"))) == ["08:00", "20:00"]
    assert one(spark, D.time_slots(slots("24:00"))) is None


def test_repair_own_letters(spark):
    """Letters that are signs themselves: as many before as after."""
    texts = ["SCHÄIE", "Å, Æ und Ä", "Ä – “x”", "Жук", "ein �", "plain", None]
    broken = F.decode(F.encode("t", "UTF-8"), "ISO-8859-1")
    for t in texts:
        assert one(spark, T.repair_mojibake(broken, True), t=t) == t
    assert one(spark, T.repair_mojibake(broken), t="SCHÄIE") == "SCHÃ\x84IE"
    for t in ("SCHÄIE", "café\xa0»", "NÃO"):
        assert one(spark, T.repair_mojibake(F.col("t"), True), t=t) == t


@pytest.mark.parametrize(("f", "most"), [(lambda c: T.parse_medicine(c, F.lit(1)), 30), (T.parse_strength, 8)])
def test_patterns_once(spark, f, most):
    """Parts that others are made of are computed once, not once for each use."""
    rows = spark.createDataFrame([("1) A 5 mg SL: 2 v",)], "t string").select(f(F.col("t")).alias("x"))
    plan = rows._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("regexp") + plan.count(" rlike") <= most
