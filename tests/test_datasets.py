"""Reports, conversions, named files, bundles, search, order and error kinds on small tables."""

import hashlib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.operators import bundles, conversion, inspection, ordering, search, taxonomy
from docloom.plans import datasets
from docloom.session import Scratch
from docloom.sources import named
from tests.test_queries import SF, rows

RND = random.Random(3)
NAMES = ("inspect_dataset", "document_profiles", "convert_files", "scan_samples", "scan_named_files", "import_roles",
         "search_samples", "corpus_samples", "next_pending", "list_pages", "page_tokens", "dictionary_order", "error_kinds",
         "line_rules", "repaired_texts", "annotation_candidates", "structured_prescriptions", "draft_plans", "catalog_updates", "working_copies", "saved_drafts",
         "experiment_gate", "labelled_orders", "relation_texts", "viewer_stats", "candidate_totals", "crop_errors", "error_samples",
         "free_lines_first_fit", "free_lines_best_overlap", "wer_micro", "nearest_event", "risk_coverage", "latency", "link_topk")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("events", "supplier", "lineitem", "orders", "part", "customer", "documents", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).df())


def documents(spark, texts):
    rows = [(name, text) for name, text in texts.items()]
    return spark.createDataFrame(rows, "file string, value string").withColumn("document", F.try_parse_json("value"))


# Reports


def walked(value, path="", top=True, key=None):
    yield path, key, top
    if isinstance(value, list):
        for i, x in enumerate(value):
            yield from walked(x, f"{path}[{i}]", top)
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from walked(x, f"{path}.{k}" if path else k, False, k)


def test_nodes_by_brute_force(spark):
    def some(depth):
        kind = RND.randint(0, 5 if depth else 3)
        if kind < 2:
            return RND.choice([None, True, 1.5, "x", "", 7])
        return [some(depth - 1) for _ in range(RND.randint(0, 3))] if kind < 4 and depth else {k: some(depth - 1) if depth else 0 for k in RND.sample(["a", "b c", "label", "é"], RND.randint(0, 3))}

    values = {f"f{i}": some(4) for i in range(40)}
    got = inspection.json_nodes(documents(spark, {k: json.dumps(v) for k, v in values.items()} | {"bad": "{"})).select("file", "path", "key", "top").collect()
    want = [(f, *n) for f, v in values.items() for n in walked(v)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert inspection.json_nodes(documents(spark, {"bad": "["})).count() == 0


def test_text_of_values(spark):
    texts = {'" a "': "a", "5": "5", "true": "true", "null": "", '["a", 1, null, "b"]': "a 1  b", '{"text": "t", "value": 1}': "t", '{"text": null, "value": 2}': "2", "{}": "", "[]": ""}
    got = documents(spark, {t: t for t in texts}).select("file", inspection.as_text(F.col("document")).alias("t")).collect()
    assert {r.file: r.t for r in got} == texts


def test_reports_warn(spark):
    files = spark.createDataFrame([("a/readme",), ("a/x.ZIP",)], "path string")
    none = documents(spark, {"a": "{"}).where("false")
    got = {(r.section, r.name): r.n for r in inspection.inspect(files, none).collect()}
    assert got == {
        ("kind", "other"): 1, ("kind", "archive"): 1, ("extension", "<none>"): 1, ("extension", ".zip"): 1, ("warning", "no annotation files"): 1, ("warning", "no images"): 1,
    }


# Conversion


def converted(spark, texts):
    found = conversion.convert_dataset(documents(spark, texts))
    out = {(r.file, r.idx): r for r in found.annotations.collect()}
    return out, {(r.file, r.note): r.n for r in found.notes.groupBy("file", "note").agg(F.sum("n").alias("n")).collect()}, {r.file for r in found.skipped.collect()}


def test_shapes(spark):
    task = {
        "id": 5, "image": "p/scan 1.png", "meta": {"width": 200},
        "annotations": [{"result": [
            {"id": "a", "value": {"labels": ["Drug"], "text": ["x", "y"], "x": 10, "y": 20, "width": 5, "height": 5}, "original_height": 50},
            {"value": {"label": ["lieu"], "x": 1, "y": 1, "width": 1, "height": 1}}, {"id": "z", "value": {"labels": ["nope"]}},
            {"type": "relation", "from_id": "a", "to": "1", "labels": ["HAS_DOSE"]}, {"type": "relation", "from": "a", "to_id": "z"},
        ]}, {"result": [{"value": {"labels": ["Form"]}}]}],
    }
    coco = {
        "images": [{"id": 1, "file_name": "u/v.jpg"}, {"id": 2, "file_name": ""}, {"id": 3}], "categories": [{"id": 9, "name": "drug"}, {"id": 9, "name": "strength"}],
        "annotations": [{"image_id": 2, "category_id": 9, "bbox": [1, 2, 3, 4], "transcription": " t "}, {"image_id": 1, "category_id": 8}, {"image_id": 7, "category_id": 9}],
    }
    plain = [{"id": "k.1", "Thuốc": "A", "drug": "B", "Hàm lượng": "", "lieu": ["2", "viên"], "x": 1}, {"sample_id": "k_1"}, 5]
    marked = {"data": [1], "entities": [{"label": "drug", "text": "a", "bbox": [1, 2, 3, 4, 5]}, {"label": "?"}, {"id": 0, "type": "form", "bbox": {"left": 1, "top": 2, "w": 3}, "needs_review": "x"}],
              "relations": [{"source_entity_id": "0", "target": 0}, {"source": "1", "target": "0"}], "split": "test"}
    texts = {"d/task.json": task, "d/coco.json": coco, "d/plain.json": plain, "d/marked.json": marked, "d/none.json": None, "d/empty.json": [], "d/7.json": 7}
    out, notes, skipped = converted(spark, {k: json.dumps(v) for k, v in texts.items()} | {"d/bad.json": "{"})
    assert skipped == {"d/bad.json"} and set(out) == {
        ("d/task.json", 0), ("d/coco.json", 0), ("d/coco.json", 1), ("d/plain.json", 0), ("d/plain.json", 1), ("d/plain.json", 2), ("d/marked.json", 0), ("d/7.json", 0)
    }
    short = lambda r: [(e.id, e.label, e.text, e.bbox, e.needs_review) for e in r.entities]
    links = lambda r: [(x.type, x.source_entity_id, x.target_entity_id) for x in r.relations]
    t = out["d/task.json", 0]
    assert (t.sample_id, t.image, t.shape) == ("5", "p/scan 1.png", "label_studio")
    assert short(t) == [("entity_1", "DRUG", "x y", [20.0, 10.0, 30.0, 12.5], False), ("entity_2", "DOSE", "", [2.0, 1.0, 4.0, 2.0], True)]
    assert links(t) == [("HAS_DOSE", "entity_1", "entity_2")]
    c = out["d/coco.json", 0]
    assert (c.sample_id, c.image) == ("2", None) and short(c) == [("entity_1", "STRENGTH", "t", [1.0, 2.0, 4.0, 6.0], True)]
    assert out["d/coco.json", 1].sample_id == "u_v" and short(out["d/coco.json", 1]) == []
    p = out["d/plain.json", 0]
    assert p.sample_id == "k" and short(p) == [("entity_1", "DRUG", "A", None, True), ("entity_2", "DRUG", "B", None, True), ("entity_3", "DOSE", "2 viên", None, True)]
    assert links(p) == [("HAS_DRUG", "entity_2", "entity_1"), ("HAS_DOSE", "entity_2", "entity_3")]
    assert out["d/plain.json", 1].sample_id == "k_1" and out["d/plain.json", 2].sample_id == "plain"
    m = out["d/marked.json", 0]
    assert short(m) == [("entity_1", "DRUG", "a", [1.0, 2.0, 3.0, 4.0], False), ("entity_2", "FORM", "", None, True)] and m.split == "test"
    # ids of entities without one are their places; the last of an id counts
    assert links(m) == [("RELATED_TO", "entity_2", "entity_2")]
    assert notes == {
        ("d/task.json", "unknown label"): 1, ("d/task.json", "relation without an entity"): 1, ("d/coco.json", "unknown label"): 1, ("d/plain.json", "no known field"): 2,
        ("d/marked.json", "unknown label"): 1, ("d/marked.json", "relation without an entity"): 1, ("d/7.json", "no known field"): 1,
    }


def test_written_conversion_counts(spark, tmp_path):
    texts = {f"a/label/public_test/w{i}.json": json.dumps([{"label": "drugname", "text": "t", "box": [0, 0, 1, 1]}, {"label": None, "box": [1]}]) for i in range(5)} | {"b.json": "["}
    found = conversion.convert_dataset(documents(spark, texts))
    manifest = conversion.write_conversion(found, str(tmp_path), license_="L")
    assert manifest == {"source_license": "L", "source_status": "unverified", "annotations_written": 5, "entities_written": 5, "relations_written": 0, "skipped_files": 1}
    back = spark.read.json(f"{tmp_path}/annotations").collect()
    assert {r.sample_id for r in back} == {f"w{i}" for i in range(5)} and {r.split for r in back} == {"test"} and {r.image[:8] for r in back} == {"a/image/"}


# Named files


def test_named_files(spark, tmp_path):
    rows = [(f"{tmp_path}/d{i % 3}/f{i}.bin", bytes([i]) * (10 + i)) for i in range(40)] + [(f"{tmp_path}/e/empty", b"")]
    frame = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    for _ in range(2):  # again is the same
        wrote = {r.path: (r.length, r.sha256) for r in named.write_named(frame).collect()}
    assert wrote == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in rows}
    assert sorted(os.path.join(a, f) for a, _, b in os.walk(tmp_path) for f in b) == sorted(p for p, _ in rows)
    wanted = spark.createDataFrame([(1, rows[3][0]), (2, "file://" + rows[4][0]), (3, f"{tmp_path}/no"), (4, None), (5, str(tmp_path)), (6, "odd://x/y")], "k int, path string")
    got = {r.k: r for r in named.open_named(wanted, head=4).collect()}
    assert got[1].content == rows[3][1][:4] and got[2].content == rows[4][1][:4] and got[3].error == "missing" and got[3].content is None
    assert (got[4].content, got[4].error) == (None, None) and got[5].error and got[6].error
    whole = named.open_named(spark.createDataFrame([(p,) for p, _ in rows], "path string")).collect()
    assert {r.path: bytes(r.content) for r in whole} == dict(rows)


def test_word_box_scan(spark, tmp_path):
    head = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (100).to_bytes(4, "big") + (50).to_bytes(4, "big")
    good = [{"label": "drugname", "box": [0, 0, 100, 50]}, {"label": None, "box": ["1", 2, 3, 4]}, {"label": 5, "box": [1, 1, 101, 2]}, {"label": "usage", "box": [5, 5, 4, 6]}, {"label": "x", "box": {}}]
    texts = {"label/a": good, "label/empty": [], "label/odd": good + [{"label": "x"}], "label/obj": {"label": "x", "box": []}, "other/b": good, "label/short": good, "public_test/label/t": good[:1]}
    for name, value in texts.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}.json", "w") as f:
            json.dump(value, f)
    os.makedirs(f"{tmp_path}/image")
    for name, data in (("a", head + b"x" * 99), ("short", head[:20])):
        with open(f"{tmp_path}/image/{name}.png", "wb") as f:
            f.write(data)
    with open(f"{tmp_path}/label/broken.json", "w") as f:
        f.write("[")
    got = {r.sample_id: r for r in named.scan_word_boxes(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "empty", "b", "short", "t"}
    a = got["a"]
    assert (a.word_box_count, a.target_box_count, a.valid_box_count, a.image_width, a.image_height) == (5, 2, 2, 100, 50)
    assert a.label_counts == {"drugname": 1, "unknown": 1, "5": 1, "usage": 1, "x": 1} and got["t"].source_split == "test"
    assert got["b"].valid_box_count == got["short"].valid_box_count == 4 and got["short"].image_width is None and got["empty"].label_counts == {}


# Bundles


def test_import_twice(spark, tmp_path):
    body = lambda i, label="DRUG": json.dumps({"sample_id": f"s{i}", "annotation_status": "partial", "entities": [{"id": "e", "label": label, "text": "t", "bbox": [0, 0, 1, 1]}], "relations": []})
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = [("reviewer", f"s{i}", body(i)) for i in range(30)] + [("annotator-a", "s1", body(1)), ("reviewer", "x", body(2)), ("reviewer", "j", "[1]"), ("reviewer", "sl", body("l", "NO")), ("boss", "s1", body(1))]
    bodies = spark.createDataFrame(listed[1:] + [("reviewer", "s9", body(8)), ("reviewer", "new", body("new")), ("reviewer", "s7", body(7))], "role string, sample_id string, body string")
    manifest = spark.createDataFrame([(r, s, sha("other" if s == "s5" else b)) for r, s, b in listed], "role string, sample_id string, sha256 string")
    found = bundles.check_bundles(bodies, manifest)
    problems = {(r.role, r.sample_id): r.problem for r in found.invalid.collect()}
    assert problems == {
        ("reviewer", "s0"): "missing", ("reviewer", "s5"): "checksum", ("reviewer", "x"): "another sample_id", ("reviewer", "j"): "not JSON", ("reviewer", "sl"): "invalid",
        ("boss", "s1"): "unknown role", ("reviewer", "new"): "not in the manifest",
    }
    assert {r.sample_id: r.body for r in found.records.where("role = 'reviewer'").collect()}["s9"] == body(9)

    def texts():
        return {r: sorted(open(f"{a}/{f}").read() for f in files if f.endswith(".json")) for a, _, files in os.walk(f"{tmp_path}/records") if (r := a.rpartition("role=")[2])}

    first = bundles.import_bundles(bodies, manifest, str(tmp_path)), texts()
    assert first[0] == {"imported": 29, "invalid": 7} and (bundles.import_bundles(bodies, manifest, str(tmp_path)), texts()) == first
    only = [f.where("role = 'annotator-a'") for f in (bodies, manifest)]
    assert bundles.import_bundles(*only, str(tmp_path))["imported"] == 1 and texts() == first[1]


# Search


def test_search_equals_a_scan(spark, tmp_path):
    texts = ["".join(RND.choice("abAB é1") for _ in range(RND.randint(0, 30))) for _ in range(150)] + ["", None, "x", "aaaaaaaaaaaa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    search.write_index(rows, "id", "text", f"{tmp_path}/i")
    patterns = [t[a : a + n] for n in range(1, 21) for t in RND.sample([t for t in texts[:150] if len(t) >= n], 4) for a in [RND.randint(0, len(t) - n)]] + ["zzz", "aaa", "AAAAA", "", "x"]
    wanted = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    got = {(r.pattern_id, int(r.key)) for r in search.search_index(spark, f"{tmp_path}/i", wanted).collect()}
    assert got == {(k, i) for k, p in enumerate(patterns) for i, t in enumerate(texts) if p and t and p.lower() in t.lower()}
    plan = search.search_index(spark, f"{tmp_path}/i", wanted.where("pattern = 'zzz'"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(head" in plan and "text" not in plan
    corpus = spark.createDataFrame([("Ab1", "complete"), ("b2", "unreviewed")], "sample_id string, draft_status string")
    assert [r[0] for r in search.find_samples(corpus, "AB").collect()] == ["Ab1"] and search.find_samples(corpus).count() == 2
    assert search.find_samples(corpus, "", "unreviewed").first()[0] == "b2"


# Order


def test_positions(spark):
    rows = [(i, RND.randint(0, 20) or None, RND.random() < 0.05) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, k int, o boolean").repartition(6)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [r.id for r in ordering.row_numbers(frame, ["k", "id"]).orderBy("n").collect()] == [r[0] for r in order]
    following = ordering.next_open(frame, ["k", "id"], "id", F.col("o"))
    got = {r.id: r.next for r in following.collect()}
    assert got == {r[0]: next((x[0] for x in order[i + 1 :] + order[: i + 1] if x[2]), None) for i, r in enumerate(order)}
    plan = following._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert {r.next for r in ordering.next_open(frame, ["k", "id"], "id", F.lit(False)).collect()} == {None}
    assert ordering.next_open(frame.where("false"), ["k", "id"], "id", F.col("o")).count() == 0
    sums, totals = ordering.running_sums(frame, ["k", "id"], ["k"])
    upto = {r.id: r.k_upto for r in sums.collect()}
    total = 0
    for r in order:
        total += r[1] or 0
        assert upto[r[0]] == total
    assert totals == {"k": total}
    seen, token = [], None
    while page := ordering.rows_after(frame, ["k", "id"], token, 37).collect():
        seen += [r.id for r in page]
        token = (page[-1].k, page[-1].id)
    assert seen == [r[0] for r in order]
    assert [r.id for r in ordering.first_rows(frame, ["k", "id"], 7).collect()] == [r[0] for r in order[:7]] and ordering.first_rows(frame, ["id"], 0).count() == 400
    with pytest.raises(ValueError):
        ordering.pages(frame, ["id"], 0)


@pytest.mark.parametrize(
    "collation,want",
    [
        ("vi", ["ä", "a b", "ab", "an", "An", "Ăn", "ân", "dầu", "dương", "dz", "đường", "e", "éa", "em", "ê", "Zebra", "zoo"]),
        ("UNICODE", ["ä", "a b", "ab", "an", "An", "Ăn", "ân", "dầu", "dương", "đường", "dz", "e", "ê", "éa", "em", "Zebra", "zoo"]),
    ],
)
def test_dictionary_order_of_marks(spark, collation, want):
    names = spark.createDataFrame([(1, x) for x in RND.sample(want, len(want))] + [(2, "zz")], "n int, name string")
    assert [r.name for r in ordering.dictionary_order(names, "n", "name", collation).orderBy("position").collect()] == ["zz", *want]


# Kinds of errors


def test_each_field_has_one_code(spark):
    gold = [
        ("1", "a", "DRUG", "Augmentin"), ("1", "a", "STRENGTH", "0,5 mg"), ("1", "a", "DOSE", "1 viên"), ("1", "a", "ROUTE", "uống"), ("1", "a", "DURATION", "7 ngày"),
        ("1", "a", "TIMING", "sau ăn"), ("1", "b", "DOSE", "2 gói"), ("1", "b", "FREQUENCY", "2 lần/ngày"), ("1", "b", "FORM", "tab"), ("1", "c", "DOSE", "3 viên"), ("1", "c", "DOSE", "3 viên"),
        (None, "d", "DRUG", "X"),
    ]
    said = [
        ("1", "a", "DRUG", "Other"), ("1", "a", "STRENGTH", "0.5MG"), ("1", "a", "DOSE", "1v"), ("1", "a", "ROUTE", "tiêm"), ("1", "a", "DURATION", "14 ngày"), ("1", "a", "TIMING", "trước ăn"),
        ("1", "a", "DOSE", "2 goi"), ("1", "b", "FREQUENCY", "3 lần/ngày"), ("1", "b", "FORM", "syrup"), ("1", "c", "DOSE", "3 viên"), ("1", "c", "STRENGTH", "5 mg"), (None, "d", "DRUG", "X"),
    ]
    schema = "sample_id string, drug string, field string, value string"
    frames = [spark.createDataFrame(side, schema).withColumn("n", F.lit(1)).withColumn("code", F.lit("z")) for side in (gold, said)]
    out = taxonomy.classify(*frames).collect()
    codes = sorted((r.code or "", r.value or "", r.said or "") for r in out)
    assert codes == sorted([
        ("WRONG_DRUG", "Augmentin", "Other"), ("NORMALIZATION_ONLY", "0,5 mg", "0.5MG"), ("NORMALIZATION_ONLY", "1 viên", "1v"), ("WRONG_ROUTE", "uống", "tiêm"),
        ("WRONG_DURATION", "7 ngày", "14 ngày"), ("WRONG_TIMING", "sau ăn", "trước ăn"), ("WRONG_RELATION", "2 gói", "2 goi"), ("WRONG_FREQUENCY", "2 lần/ngày", "3 lần/ngày"),
        ("OMISSION", "tab", ""), ("HALLUCINATED_FIELD", "", "syrup"), ("", "3 viên", "3 viên"), ("OMISSION", "3 viên", ""), ("HALLUCINATED_FIELD", "", "5 mg"), ("", "X", "X"),
    ])
    assert {r.code for r in out if r.code} <= set(taxonomy.CODES) and len(taxonomy.CODES) == 11
    counts = {r.code: (r.n, r.critical) for r in taxonomy.error_counts(taxonomy.classify(*frames)).collect()}
    assert counts["OMISSION"] == (2, 1) and counts["NORMALIZATION_ONLY"] == (2, 0) and counts["CORRECT"] == (2, 0)
    assert taxonomy.classify(*[f.where("false") for f in frames]).count() == 0


def test_files_of_events(spark):
    assert datasets.event_texts(spark, SF).where("document IS NULL").where("event_id % 5 < 4").count() == 0 and Scratch(spark, "x").path("y")


def test_blocked_names_lose_no_pair(spark):
    from docloom.functions import text as T
    from docloom.operators import linking

    name = lambda: "".join(RND.choice("ab c") for _ in range(RND.randint(1, 14))).strip() or "a"
    names, aliases = ({name() for _ in range(120)} for _ in range(2))
    for least in (0.5, 0.67, 0.725, 0.9):
        frames = [spark.createDataFrame([(x,) for x in side], c) for side, c in ((names, "name_norm string"), (aliases, "alias_norm string"))]
        score = T.string_similarity(F.col("name_norm"), F.col("alias_norm"))
        want = {tuple(r) for r in frames[0].crossJoin(frames[1]).where(score >= least).collect()}
        met = linking.blocked_pairs(*frames, least)
        assert want <= {tuple(r) for r in met.collect()} and "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        linking.blocked_pairs(*frames, 0.4)


def test_nearest_by_brute_force(spark):
    from docloom.operators import extract

    some = lambda n, a: [(f"s{RND.randint(0, 4)}", a + i, RND.choice([None, *[RND.randint(0, 12) / 2 for _ in range(9)]])) for i in range(n)]
    asked, targets = some(150, 0), some(25, 1000)
    schema = "sample_id string, idx long, y double"
    got = {r.idx: r.target_idx for r in extract.nearest(spark.createDataFrame(asked, schema), spark.createDataFrame(targets, schema)).collect()}
    away = lambda a, b: abs(a - b) if a is not None and b is not None else 0
    assert got == {i: min(((away(y, ty), t) for k, t, ty in targets if k == s), default=(0, None))[1] for s, i, y in asked}


def test_latency_by_brute_force(spark):
    import numpy as np

    from docloom.operators import metrics

    rows = [(RND.choice(["a", "b", None]), RND.choice([None, *map(float, range(8))]), RND.choice(["e", None])) for _ in range(200)] + [("c", None, None)]
    frame = spark.createDataFrame(rows, "k string, latency_ms double, error string")
    for by in (["k"], []):
        got = {r["k"] if by else 0: r for r in metrics.latency(frame, by).collect()}
        for k in {r[0] for r in rows} if by else {0}:
            own = [r for r in rows if not by or r[0] == k]
            known = [r[1] for r in own if r[1] is not None]
            want = [float(np.percentile(known, q)) if known else None for q in (50, 95, 99)]
            assert got[k].requests == len(own) and got[k].error_rate == pytest.approx(sum(r[2] is not None for r in own) / len(own))
            assert [got[k][c] for c in ("p50", "p95", "p99")] == (pytest.approx(want) if known else want)
    assert len(got) == 1 and metrics.risk_coverage(spark.createDataFrame([(0.5, True)], "confidence double, correct boolean").where("false")).count() == 0


def test_drafts_and_statistics(spark):
    from docloom.operators import annotations, evaluation, metrics

    entity, relation = "array<struct<id: string, label: string, text: string, bbox: array<double>, needs_review: boolean>>", "array<struct<id: string, type: string, source_entity_id: string, target_entity_id: string, needs_review: boolean>>"
    rows = [
        ("s", [("a", "DRUG", "x", [1.0, 2.0, 3.0, 4.0], False), ("b", "?", None, None, None), ("a", None, "z", None, True)], [("r", "T", "a", "b", None), ("q", "T", "a", "other", False), ("p", "T", None, "b", None)]),
        ("none", None, None),
    ]
    frame = spark.createDataFrame(rows, f"sample_id string, entities {entity}, relations {relation}")
    got = {r.sample_id: r.w for r in frame.select("sample_id", annotations.working_copy(F.col("entities"), F.col("relations")).alias("w")).collect()}
    assert [tuple(e) for e in got["s"].entities] == [
        ("entity_1", "DRUG", "x", [1.0, 2.0, 3.0, 4.0], True, "a"), ("entity_2", "INSTRUCTION", "", [0.0, 0.0, 1.0, 1.0], True, "b"), ("entity_3", "INSTRUCTION", "z", [0.0, 0.0, 1.0, 1.0], True, "a"),
    ]
    assert [(r.id, r.source_entity_id, r.target_entity_id, r.needs_review) for r in got["s"].relations] == [("relation_1", "entity_3", "entity_2", True), ("relation_2", "entity_3", "other", True)]
    assert got["none"].entities == [] and got["none"].relations is None
    for complete, flags in ((True, [False, False]), (False, [False, True])):
        d = frame.where("sample_id = 's'").select(annotations.saved_draft(F.slice("entities", 1, 2), F.col("relations"), F.array().cast("array<string>"), F.lit(complete)).alias("d")).first().d
        assert [e.needs_review for e in d.entities] == flags and d.annotation_status == ("complete" if complete else "needs_review") and [r.id for r in d.relations] == ["r"]
    assert annotations.invalid_samples(frame.withColumn("annotation_status", F.lit("partial"))).count() >= 1
    lines = spark.createDataFrame([([([(0.5,), (float("nan"),), (None,)],), (None,)],), (None,), ([([(1.0,)],)],)], "lines array<struct<words: array<struct<confidence: double>>>>")
    assert tuple(evaluation.viewer_stats(lines).first()) == (3, 3, 4, 0.75) and tuple(evaluation.viewer_stats(lines.where("false")).first()) == (0, 0, 0, None)
    crops = spark.createDataFrame([("ab c", "ab c"), ("ab", "b"), ("x", None), ("é", "e")], "reference string, hypothesis string")
    r = metrics.crop_error_rates(crops).first()
    assert (r.samples, r.read, r.exact, r.exact_plain) == (4, 3, 0.25, 0.5) and r.cer == pytest.approx(2 / 7) and r.wer == pytest.approx(2 / 4)


def test_error_kinds_shuffle_once(spark):
    """All steps of the cascade sort what one shuffle has brought together."""
    gold = spark.createDataFrame([("s", "1", "DOSE", "1 v"), ("s", "1", "DOSE", "1 v"), ("s", "2", "DOSE", "2 ml")], "sample_id string, drug string, field string, value string")
    said = spark.createDataFrame([("s", "1", "DOSE", "1 v"), ("s", "3", "DOSE", "2ML"), ("s", "1", "DOSE", "1 Viên")], gold.schema)
    out = taxonomy.classify(gold, said)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = sorted((r.code or "", r.drug, r.said_drug, r.said) for r in out.collect())
    assert got == [("", "1", "1", "1 v"), ("NORMALIZATION_ONLY", "1", "1", "1 Viên"), ("WRONG_RELATION", "2", "3", "2ML")]


def test_search_tasks_are_bounded(spark, tmp_path, monkeypatch):
    """A search has tasks as its index has postings, however often a text has a pattern."""
    monkeypatch.setattr(search, "TASK_POSTINGS", 10, raising=False)
    rows = spark.createDataFrame([(i, "aaaa" if i % 2 else "abca") for i in range(20)], "k long, t string")
    search.write_index(rows, "k", "t", str(tmp_path / "index"))
    patterns = spark.createDataFrame([("p1", "A"), ("p2", "aaaa"), ("p3", "bca"), ("p4", "abcaa")], "pattern_id string, pattern string")
    out = search.search_index(spark, str(tmp_path / "index"), patterns)
    dealt = re.findall(r"RepartitionByExpression \[key#\d+\], (\d+)", out._jdf.queryExecution().optimizedPlan().toString())
    assert [int(n) for n in dealt] == [8]  # 80 postings
    got = sorted((r.pattern_id, int(r.key)) for r in out.collect())
    assert got == [("p1", i) for i in range(20)] + [("p2", i) for i in range(1, 20, 2)] + [("p3", i) for i in range(0, 20, 2)]
