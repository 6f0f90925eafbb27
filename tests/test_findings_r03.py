"""Tests of the findings of round 3."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docloom.operators import convert, conversion, layout, linking
from docloom.operators.profile import normalize_label, with_label


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _words(spark):
    rows = [("s", 1, "drugname", "a", [1.0, 2.0, 3.0, 4.0]), ("s", 2, "zzz", "b", None), ("s", 3, None, "c", None), ("s", 4, "Usage", "", [1.0, 2.0, 3.0, 4.0]), ("t", 1, "zzz", "d", None)]
    return spark.createDataFrame(rows, "sample_id string, idx long, label string, text string, box array<double>")


def test_labels_are_normalised_once(spark):
    """a condition on the label does not take Python to every row."""
    rows = with_label(_words(spark), ["label"], normalize_label("label"), conversion.Scratch(spark, "test")).where("to IS NOT NULL")
    assert "EvalPython" not in _plan(rows)
    assert {r.idx: r.to for r in rows.collect()} == {1: "DRUG", 4: "INSTRUCTION"}


def test_word_boxes_without_python(spark):
    """F11."""
    out = convert.word_boxes(_words(spark))
    assert "EvalPython" not in _plan(out)
    got = {r.sample_id: r for r in out.collect()}
    assert (got["s"].unmapped, got["t"].unmapped, got["t"].entities) == (2, 1, None)
    assert [(e.n, e.id, e.label, e.text, e.needs_review) for e in got["s"].entities] == [(1, "entity_1", "DRUG", "a", True), (2, "entity_2", "INSTRUCTION", "", True)]


def test_label_studio_without_python(spark):
    """F9."""
    value = "struct<labels: array<string>, x: double, y: double, width: double, height: double, text: string>"
    item = f"struct<id: string, type: string, value: {value}, labels: array<string>, from_id: string, to_id: string, original_width: double, original_height: double>"
    box = lambda label: ([label], 10.0, 10.0, 10.0, 10.0, "x")
    result = [("a", "labels", box("thuoc"), [], None, None, 100.0, 100.0), ("b", "labels", box("zzz"), [], None, None, 100.0, 100.0), ("c", "labels", box("dose"), [], None, None, 100.0, 100.0),
              (None, "relation", box(""), ["R"], "a", "c", None, None), (None, "relation", box(""), [], "a", "b", None, None)]
    entities, links = convert.label_studio(spark.createDataFrame([("s", [(result,)])], f"sample_id string, annotations array<struct<result: array<{item}>>>"))
    assert "EvalPython" not in _plan(entities) and "EvalPython" not in _plan(links)
    assert sorted((r.id, r.label) for r in entities.collect()) == [("entity_1", "DRUG"), ("entity_2", "DOSE")]
    assert [(r.type, r.source, r.target) for r in links.collect()] == [("R", "entity_1", "entity_2")]


def test_conversion_of_odd_members(spark):
    """plain texts that begin like an array, nested texts, numbers, boxes of either form; a long file keeps its order."""
    many = ",".join(f'{{"zeta":"q","Drug Name":"d{i}","dosage":{i}}}' for i in range(300))
    texts = {
        "a.json": '{"sample_id":7,"entities":[{"type":"Drug","text":"[x"},{"label":null,"category":"dose","text":{"value":" 5 "},"bbox":[1,"2",3,4]},'
        '{"label":"form","text":["a",1],"bbox":{"x":"n","left":1,"y":1,"w":1,"h":1}},{"label":"drug","text":"y","bbox":[1,2,3]}]}',
        "b.json": f"[{many}]",
        "c.json": "[broken",
    }
    rows = spark.createDataFrame(list(texts.items()), "file string, value string").withColumn("document", F.try_parse_json("value"))
    out = conversion.convert_dataset(rows)
    got = {(r.file, r.idx): r for r in out.annotations.collect()}
    first = got["a.json", 0]
    assert first.sample_id == "7"
    assert [(e.id, e.label, e.text, e.bbox) for e in first.entities] == [
        ("entity_1", "DRUG", "[x", None), ("entity_2", "DOSE", "5", [1.0, 2.0, 3.0, 4.0]), ("entity_3", "FORM", "a 1", None), ("entity_4", "DRUG", "y", None)
    ]
    assert [[e.text for e in got["b.json", i].entities] for i in range(300)] == [[f"d{i}", str(i)] for i in range(300)]
    assert [r.file for r in out.skipped.collect()] == ["c.json"] and len(got) == 301


def test_few_lines_as_many(monkeypatch):
    """lines looked through one by one are those that numpy finds."""
    for seed in range(60):
        r = random.Random(seed)
        y1 = sorted(round(r.uniform(0, r.choice([30, 3000])), 1) for _ in range(r.choice([5, 200])))
        y2 = [y + r.choice([0, 5, 10, 12.5, 40]) for y in y1]
        rows = ([(a + b) / 2 for a, b in zip(y1, y2)], [max(1.0, b - a) for a, b in zip(y1, y2)], y1, y2)
        found = []
        for few in (-1, 3, 10_000):
            monkeypatch.setattr(layout, "FEW_LINES", few)
            found.append(layout.best_overlap(*rows))
        assert found[0] == found[1] == found[2]


def test_names_are_dealt_to_tasks(spark):
    """names are few bytes but much work, so they do not meet in one task."""
    names = spark.createDataFrame([(f"name {i}",) for i in range(200)], "name_norm string").distinct()
    aliases = spark.createDataFrame([("name 1",)], "alias_norm string")
    for pairs in (linking.blocked_pairs(names, aliases, 0.5), linking._product(names, aliases, 1)):
        assert f", {linking.NAME_TASKS}), REPARTITION_BY_NUM" in _plan(pairs)
