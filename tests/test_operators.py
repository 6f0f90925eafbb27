import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import annotations, contract, convert, extract, inspection, layout, linking, metrics, ner, plan, splits
from docloom.sources import files, sinks

CATALOG = "drug_database_id string, ord long, brand_name string, generic_names array<string>, aliases array<string>, strengths array<struct<value:double,unit:string>>"
WORD = "sample_id string, idx long, text string, bbox array<double>, confidence double"


def test_linking_statuses(spark):
    catalog = spark.createDataFrame(
        [("a", 1, "Alphazol", [], ["Alfazol"], [(5.0, "mg")]), ("b", 2, "Betamin", None, None, [(500.0, "mg")]), ("c", 3, "Betamin", [], [], [(500.0, "mg")])],
        CATALOG,
    )
    asked = spark.createDataFrame(
        [(1, "A1phazol 5mg", "A1phazol", "5mg"), (2, "Betamin 0,5 g", "Betamin", "0,5 g"), (3, "Zzzz", "Zzzz", None), (4, "x", None, None)],
        "query_id long, raw_text string, drug_name string, strength string",
    )
    for pruned in (True, False):
        got = {r.query_id: (r.status, r.drug_database_id) for r in linking.link_drugs(asked, catalog, pruned=pruned).collect()}
        assert got == {1: ("linked", "a"), 2: ("needs_review", None), 3: ("not_found", None), 4: ("not_found", None)}
    newer = spark.createDataFrame([("a", 9, "Alphazol N", [], [], [])], CATALOG)
    kept = {r.drug_database_id: (r.ord, r.brand_name) for r in linking.upsert(catalog, newer).collect()}
    assert kept["a"] == (1, "Alphazol N")


@pytest.mark.parametrize("how", ["first_fit", "last_line", "best_overlap"])
def test_lines(spark, how):
    words = spark.createDataFrame(
        [("s", 2, "B", [50.0, 11.0, 90.0, 31.0], 0.5), ("s", 1, "A", [0.0, 10.0, 40.0, 30.0], 1.0), ("s", 3, "C", [0.0, 60.0, 40.0, 80.0], None), ("s", 4, " ", None, None)],
        WORD,
    )
    got = [(r.line_no, r.text, r.confidence) for r in layout.group_lines(words, how).orderBy("line_no").collect()]
    assert got == [(0, "A B", 0.75), (1, "C", None)]
    assert layout.group_lines(words.limit(0), how).count() == 0


def test_bio(spark):
    words = spark.createDataFrame([("s", i, i, t, [x, 0.0, x + 10, 10.0]) for i, t, x in ((1, "A", 0.0), (2, "5", 20.0), (3, "mg", 30.0), (4, "z", 90.0))], "sample_id string, idx long, pos long, text string, bbox array<double>")
    entities = spark.createDataFrame([("s", 1, "d", "DRUG", [0.0, 0.0, 10.0, 10.0]), ("s", 2, "t", "STRENGTH", [20.0, 0.0, 40.0, 10.0]), ("s", 3, "u", "DOSE", [200.0, 0.0, 240.0, 10.0])], "sample_id string, ord long, id string, label string, bbox array<double>")
    got = [r.tag for r in ner.bio_tags(words, entities).orderBy("pos").collect()]
    assert got == ["B-DRUG", "B-STRENGTH", "I-STRENGTH", "O"]
    row = ner.bio_examples(words, entities).first()
    assert row.unmatched_entity_ids == ["u"] and row.ready_for_training is False


def test_greedy_match(spark):
    rows = [(k, g, p, ((g * 7 + p * 13) % 10) / 10) for k in "st" for g in range(12) for p in range(12)]
    pairs = spark.createDataFrame(rows, "sample_id string, gold_idx long, pred_idx long, iou double")
    want = []
    for k in "st":
        gold, said = set(), set()
        for row in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], r[1], r[2])):
            if row[1] not in gold and row[2] not in said:
                gold.add(row[1])
                said.add(row[2])
                want.append(row)
    assert sorted(map(tuple, metrics.greedy_match(pairs, ["sample_id"]).collect())) == sorted(want)


def test_relations(spark):
    schema = "sample_id string, type string, source_entity_id string, target_entity_id string"
    gold = spark.createDataFrame([("s", "HAS_DOSE", "a", "b")], schema)
    said = spark.createDataFrame([("s", "HAS_DOSE", "a", "b"), ("s", "HAS_FORM", "a", "c")], schema)
    row = metrics.evaluate_relations(gold, said).where("type IS NULL").first()
    assert (row.tp, row.fp, row.fn, round(row.f1, 6)) == (1, 1, 0, round(2 / 3, 6))


RECORD = """sample_id string, role string, annotation_status string,
privacy struct<de_identified:boolean,reviewed:boolean,approved_for_research:boolean>,
entities array<struct<id:string,label:string,text:string,bbox:array<double>,needs_review:boolean>>,
relations array<struct<id:string,type:string,source_entity_id:string,target_entity_id:string,needs_review:boolean>>"""


def record(role, text, ids=("d", "s"), status="complete"):
    d, s = ids
    return ("x", role, status, (True, True, True), [(d, "DRUG", "A", [0.0, 0.0, 5.0, 5.0], False), (s, "STRENGTH", text, [6.0, 0.0, 9.0, 5.0], False)], [("r", "HAS_STRENGTH", d, s, False)])


def test_validation_and_merge(spark):
    rows = spark.createDataFrame([record("annotator-a", "500 mg"), record("annotator-b", "0.5 g"), record("reviewer", "500 mg")], RECORD)
    assert [r.errors for r in annotations.validate(rows).collect()] == [[], [], []]
    merged = annotations.merge_roles(rows).first()
    assert (merged.agreement, merged.gold) == ("conflict", True)
    same = spark.createDataFrame([record("annotator-a", "500 mg"), record("annotator-b", "500  mg ", ids=("p", "q"))], RECORD)
    assert annotations.merge_roles(same).first().agreement == "agree"
    bad = spark.createDataFrame([("", "reviewer", "open", None, [("a", "X", "", [1.0], None), None, ("a", "DRUG", "t", [0.0, 0.0, 1.0, 1.0], None)], [("r", "HAS_DOSE", "a", "zz", None)])], RECORD)
    assert annotations.validate(bad).first().errors == [
        "sample_id is required", "annotation_status must be partial, complete, or needs_review", "invalid entity label: X",
        "entities[0].text is required", "entities[0].bbox is invalid", "entities[1] must be an object", "duplicate entity id: a",
        "relation r references missing target entity",
    ]
    row = annotations.summarize(rows).first()
    assert (row.samples, row.valid_samples, row.entities_DRUG, row.entities_ROUTE) == (3, 3, 3, 0)
    with pytest.raises(ValueError, match="invalid record"):
        sinks.export_bundle(bad, "/tmp/never-written")


def test_candidates_and_structure(spark):
    words = spark.createDataFrame(
        [("s", 1, "drugname", "1) ALPHAZOL 5MG 5 mg", [10.0, 20.0, 120.0, 45.0]), ("s", 2, "usage", "Uống Sáng 1 Viên", [10.0, 50.0, 120.0, 60.0]), ("s", 3, "quantity", "SL: 20 viên", [130.0, 20.0, 160.0, 45.0]), ("s", 4, "other", "Ghi chú Uống sau khi ăn", None)],
        "sample_id string, idx long, label string, text string, box array<double>",
    )
    entities, relations, quantities = extract.medication_candidates(words)
    assert [(r.label, r.text) for r in entities.orderBy("id").collect()] == [("DRUG", "ALPHAZOL"), ("STRENGTH", "5MG"), ("TIMING", "Sáng"), ("DOSE", "1 viên"), ("INSTRUCTION", "Uống sau khi ăn")]
    assert sorted(r.type for r in relations.collect()) == ["HAS_DOSE", "HAS_INSTRUCTION", "HAS_STRENGTH", "HAS_TIMING"]
    assert [(r.value, r.unit, r.source_drug_idx) for r in quantities.collect()] == [(20.0, "viên", 1)]
    lines = spark.createDataFrame([("s", 1, "Chẩn đoán: I10"), ("s", 2, "1) ALPHA 5 mg SL: 20 viên"), ("s", 3, "Ghi chú uống sáng"), ("s", 4, "Ngày 01/02/2026")], "sample_id string, line_no long, text string")
    row = extract.structure(lines).first()
    assert (row.diagnoses, row.dates, row.medicines[0].instructions) == (["Chẩn đoán: I10"], ["01/02/2026"], ["uống sáng"])


def test_contract(spark):
    schema = "medicineName string, frequency string, frequencySource string, timesPerDay long, timeSlots array<string>, doseQuantity double, durationDays double, frequencyRequiresReview boolean"
    rows = spark.createDataFrame([("A", None, "Uống ngày 2 lần", None, None, None, None, None), ("A", "AS_NEEDED", None, None, None, 0.5, None, None)], schema)
    a, b = contract.parsed_medication(rows).collect()
    assert (a.frequency, a.timesPerDay, a.timeSlots, a.frequencyRequiresReview, a.error) == ("TWICE_DAILY", 2, None, True, None)
    assert (b.frequencyRequiresReview, b.error) == (False, "doseQuantity must be a positive integer")


def test_plans(spark):
    p = plan.Plan({"m": (False, ["drug"]), "n": (False, [])})
    assert p.status == "needs_verification" and p.apply("schedule", "m", ["08:00"]) == "plan is not verified"
    assert p.apply("verify", "m", ["drug"]) is None and p.apply("verify", "n", []) is None and p.status == "verified"
    assert p.apply("schedule", "m", ["20:00", "08:00", "08:00"]) is None and p.times["m"] == ["08:00", "20:00"]
    assert p.apply("schedule", "n", ["08:00"]) == "plan is not verified"
    plans = spark.createDataFrame([("p", [("m", False, ["drug"])])], "plan_id string, medications array<struct<medication_id:string,verified:boolean,fields:array<string>>>")
    commands = spark.createDataFrame([("p", 2, "schedule", "m", ["9"]), ("p", 1, "verify", "m", ["drug"]), ("q", 1, "verify", "m", [])], "plan_id string, seq long, op string, medication_id string, args array<string>")
    row = plan.fold_commands(plans, commands).collect()
    assert [(r.plan_id, r.status, r.applied, r.rejected) for r in row] == [("p", "verified", 1, 1)]


def test_streaming_plans(spark, tmp_path):
    from docloom.streaming.plans import plan_updates

    schema = "plan_id string, seq long, op string, medication_id string, args array<string>"
    rows = [("p", 1, "create", None, ["m=drug"]), ("p", 2, "verify", "m", ["drug"]), ("p", 3, "schedule", "m", ["08:00"]), ("q", 1, "verify", "m", [])]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = plan_updates(stream).writeStream.format("memory").queryName("plan_out").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.plan_id, r.seq): (r.status, r.error) for r in spark.table("plan_out").collect()}
    assert got == {("p", 1): ("needs_verification", None), ("p", 2): ("verified", None), ("p", 3): ("scheduled", None), ("q", 1): (None, "plan does not exist")}


def test_converters(spark):
    rows = spark.createDataFrame([("s", "A", "5 mg", None)], "id string, drug string, strength string, dose string")
    entities, links = convert.fields(rows, "id", ["drug", "strength", "dose"])
    assert [(r.label, r.text) for r in entities.orderBy("id").collect()] == [("DRUG", "A"), ("STRENGTH", "5 mg")]
    assert [(r.type, r.source, r.target) for r in links.collect()] == [("HAS_STRENGTH", "entity_1", "entity_2")]
    docs = convert.coco(
        spark.createDataFrame([(1, "f.png")], "id long, file_name string"),
        spark.createDataFrame([(7, 1, 3, [10.0, 20.0, 30.0, 40.0]), (8, 2, 3, [1.0, 1.0, 1.0, 1.0])], "id long, image_id long, category_id long, bbox array<double>"),
        spark.createDataFrame([(3, "drugname")], "id long, name string"),
    )
    row = docs.collect()
    assert len(row) == 1 and (row[0].entities[0].label, row[0].entities[0].bbox) == ("DRUG", [10, 20, 40, 60])


def test_profile_and_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps([{"label": "drugname", "box": [1, 2, 3, 4]}]))
    (tmp_path / "a" / "y.json").write_text(json.dumps({"images": [], "annotations": []}))
    (tmp_path / "a" / "z.json").write_text("{broken")
    docs = files.json_documents(spark, str(tmp_path / "a"))
    assert docs.count() == 3
    assert sorted(r.format for r in files.records(docs).collect()) == ["coco", "word_boxes"]
    text = json.dumps({"patient": {"full name": "x"}, "items": [{"label": "L"}]})
    nodes = inspection.json_nodes(spark.createDataFrame([("a", text), ("b", "no json")], "file string, t string").select("file", F.try_parse_json("t").alias("document")))
    assert sorted(map(tuple, inspection.sensitive_members(nodes).collect())) == [("a", "patient"), ("a", "patient.full name")]
    assert [tuple(r) for r in inspection.raw_label_counts(nodes).collect()] == [("L", 1)]
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (300).to_bytes(4, "big") + (200).to_bytes(4, "big")
    got = spark.createDataFrame([(png,), (b"GIF",)], "c binary").select(files.png_dimensions(F.col("c")).alias("d")).collect()
    assert (got[0].d.width, got[0].d.height, got[1].d) == (300, 200, None)
    assert files.source_metadata(spark, str(tmp_path / "none.json")) == files.UNKNOWN_SOURCE
    (tmp_path / "meta.json").write_text('{"license": "MIT", "publication_approved": true}')
    assert files.source_metadata(spark, str(tmp_path / "meta.json"))["publication_approved"] is True


def test_splits_do_not_depend_on_order(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("sample_id"))
    a = {r.sample_id: r.split for r in splits.rank_split(rows).collect()}
    b = {r.sample_id: r.split for r in splits.rank_split(rows.orderBy(F.rand(1))).collect()}
    assert a == b and [list(a.values()).count(s) for s in ("train", "validation", "test")] == [350, 75, 75]
    assert spark.range(1).select(splits.fnv1a(F.lit("rx-1"))).first()[0] == 3956223341


def test_candidates_read_words_once(spark):
    """The words' own plan (here a window) runs once, whatever is proposed from them."""
    from pyspark.sql import Window

    from docloom.operators import extract

    rows = [(1, 1, "a", "drugname", "1) X 5 mg", [0.0, 0.0, 9.0, 8.0]), (1, 2, "b", "usage", "Uống sáng 2 vien", [0.0, 9.0, 9.0, 18.0])]
    words = spark.createDataFrame(rows, "sample_id long, n long, id string, label string, text string, box array<double>")
    words = words.withColumn("idx", F.row_number().over(Window.partitionBy("sample_id").orderBy("n")).cast("long"))
    entities, relations, _ = extract.medication_candidates(words)
    plan = entities.join(relations, "sample_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 1
    assert [r.text for r in entities.orderBy("id").collect()] == ["X", "5 mg", "sáng", "2 viên"] and relations.count() == 3
