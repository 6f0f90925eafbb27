"""Tests of the findings of round 4."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docloom.functions import marks
from docloom.functions import text as T
from docloom.operators import extract, taxonomy


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _fields(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, drug string, field string, value string")


def test_marks_without_python(spark):
    """Unicode's decomposition as column expressions, other scripts included."""
    one, many, other = marks._tables()
    r, few = random.Random(4), [*"aZ đĐ\n가각힣", *map(chr, range(0x300, 0x310))]
    pool = [*r.sample([*one], 300), *many, *other, *few]
    texts = ["", "Đường ăn", *pool, *["".join(r.choices(pool if i % 2 else [*other, *few], k=r.randint(2, 9))) for i in range(2000)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", marks.strip_combining(F.col("t")).alias("u"), T.strip_combining("t").alias("v"))
    assert [r.t for r in rows.collect() if not r.u == r.v == marks.plain(r.t)] == []


def test_error_kinds_without_python(spark, monkeypatch):
    """values are normalised in the JVM, and equal ones are counted in blocks."""
    monkeypatch.setattr(taxonomy, "BLOCK", 3, raising=False)
    gold = _fields(spark, [("s", "1", "DOSE", "1 viên")] * 8 + [("s", "2", "DOSE", None)] * 2)
    said = _fields(spark, [("s", "1", "DOSE", "1 viên")] * 5 + [("s", "1", "DOSE", "1V")] * 2 + [("s", "2", "DOSE", "")] + [("s", "3", "DOSE", "1 VIEN")] * 4)
    out = taxonomy.classify(gold, said)
    assert "EvalPython" not in _plan(out)
    got = sorted((r.code or "", r.drug or "", r.said_drug or "", r.said or "") for r in out.collect())
    assert got == [("", "1", "1", "1 viên")] * 5 + [("", "2", "2", "")] + [("HALLUCINATED_FIELD", "", "3", "1 VIEN")] * 3 + [("NORMALIZATION_ONLY", "1", "1", "1V")] * 2 + [
        ("OMISSION", "2", "", ""), ("WRONG_RELATION", "1", "3", "1 VIEN")
    ]


def _cascade(gold, said, norm):
    """The steps by brute force."""
    own = lambda r: (r[0], r[1], r[2])
    steps = [(lambda r: (*own(r), r[3]), None, lambda f: True), (lambda r: (*own(r), norm[r[3]]), "NORMALIZATION_ONLY", lambda f: True),
             (lambda r: (r[0], r[2], norm[r[3]]), "WRONG_RELATION", lambda f: f != "DRUG"), (own, "WRONG_", lambda f: f in taxonomy.WRONG)]
    found = []
    for key, code, only in steps:
        gold, said = sorted(gold), sorted(said)
        left = []
        for g in gold:
            s = next((s for s in said if only(g[2]) and key(s) == key(g)), None)
            if s is None:
                left.append(g)
                continue
            said.remove(s)
            found.append((g[0], g[2], g[1], g[3], s[1], s[3], code + g[2] if code == "WRONG_" else code))
        gold = left
    return found + [(g[0], g[2], g[1], g[3], None, None, "OMISSION") for g in gold] + [(s[0], s[2], None, None, s[1], s[3], "HALLUCINATED_FIELD") for s in said]


def test_error_kinds_by_brute_force(spark):
    """partners of equal fields, one by one, in the order of drugs and values."""
    r = random.Random(4)
    values = ["1 v", "1 viên", "1V", "2,5 mg", "2.5mg", "", "x", "각 1", "\u1100\u1161\u11a8 1"]
    one = lambda: (r.choice("st"), r.choice("123"), r.choice(["DRUG", "DOSE", "FORM"]), r.choice(values))
    gold, said = ([one() for _ in range(300)] for _ in range(2))
    norm = {x.v: x.n for x in spark.createDataFrame([(v,) for v in values], "v string").select("v", taxonomy.same_meaning(F.col("v")).alias("n")).collect()}
    assert len(set(norm.values())) == 5
    key = lambda t: [x or "" for x in t]
    got = [(x.sample_id, x.field, x.drug, x.value, x.said_drug, x.said, x.code) for x in taxonomy.classify(_fields(spark, gold), _fields(spark, said)).collect()]
    assert sorted(got, key=key) == sorted(_cascade(gold, said, norm), key=key)


def test_lines_are_shuffled_and_read_once(spark):
    """notes above the first medicine, empty ones, several and none; blank lines do not count."""
    lines = ["Ghi chú đầu", " \u00a0 ", "1) A 5 mg SL: 2 v", "ghi chú", "Ghi chú  một", "khác 1/2/2024", "ghi chú hai", "2) B", "3. C 2,5 g 10% x", "ghi chú ba", "chẩn đoán x", None]
    rows = [("s", i, x) for i, x in enumerate(lines)] + [("t", 5, "ghi chú G12"), ("t", 6, "1/2/2024"), ("t", 7, "ngày 1-2-24"), ("t", 8, "1/2/2024"), ("u", 1, "\t")]
    out = extract.structure(spark.createDataFrame(rows, "sample_id string, line_no long, text string"))
    assert _plan(out).count("Exchange") == 1 and "Join" not in _plan(out)
    got = {r.sample_id: r for r in out.collect()}
    assert set(got) == {"s", "t"} and got["t"].medicines is None and (got["t"].diagnoses, got["t"].dates) == (["ghi chú G12"], ["1/2/2024", "1-2-24"])
    assert [(m.carried, m.m.order, m.m.name, m.m.strength, m.m.quantity, m.m.unit, m.m.source_line, m.instructions) for m in got["s"].medicines] == [
        (1, 1, "A", "5 mg", "2", "v", 2, ["một", "hai"]), (6, 2, "B", None, None, None, 7, []), (7, 3, "C 2,5 g 10% x", "2,5 g", None, None, 8, ["ba"])
    ]
    assert got["s"].patient_and_header == ["Ghi chú đầu", "1) A 5 mg SL: 2 v", "ghi chú", "Ghi chú một", "khác 1/2/2024", "ghi chú hai", "2) B"]
    assert (got["s"].diagnoses, got["s"].dates) == (["chẩn đoán x"], ["1/2/2024"])
