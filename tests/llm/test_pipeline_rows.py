"""Each stage of the pipeline on odd rows and on an empty table, by value."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm.jaccard import jaccard_classes
from docloom.llm.mixing import targets
from docloom.llm.quality import quality

RND = random.Random(14)
WORDS = [f"word{i}" for i in range(4000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("h", "node", "kept", "nth", "copies", "words", "size", "tokens", "group_id", "band")


def lines(n=8):
    return "\n".join(" ".join(RND.choice(WORDS) for _ in range(12)) for _ in range(n))


GOOD = [lines() for _ in range(6)]
LONG = lines(2500)
ROWS = [
    (None, GOOD[0], "en", "a", 1), (None, GOOD[0], "en", "a", 1), (1, GOOD[1], "en", "a", 1), (1, GOOD[1], "en", "a", 1), (1, GOOD[2], "en", "b", 1),
    (2, None, "en", "a", None), (2, None, "en", "a", None), (3, "", "en", None, 0), (4, LONG, "en", "b", 1), (5, GOOD[3], None, None, None),
    (6, GOOD[4], "en", "a", 1), (7, GOOD[4], "en", "a", 1), (8, " \t\n", "en", "b", 3),
]
STAGE = dict(corpus_pipeline.STAGES)


def run(spark, name, rows=ROWS):
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(7).alias(c) for c in CLASHING]).repartition(3)
    out = STAGE[name](spark, docs, "/nowhere")
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS
    return out.collect()


def count(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_quality_stage(spark):
    # the verdicts themselves are held against brute force elsewhere
    judged = quality(spark.createDataFrame(ROWS, SCHEMA)).where("kept").select("doc_id", "h", "lang").collect()
    hashed = spark.createDataFrame(ROWS, SCHEMA).withColumn("h", F.xxhash64("text")).collect()
    want = [r for r in hashed if (r.doc_id, r.h, r.lang) in set(map(tuple, judged))]
    got = count(run(spark, "quality rules"))
    assert got == count(want) and got[1, GOOD[1]] == 2 and got[None, GOOD[0]] == 2 and not {2, 3, 8} & {i for i, _ in got}


def test_line_stage(spark):
    got = run(spark, "line dedup")
    assert count(got) == count(ROWS) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_jaccard_stage(spark):
    got = run(spark, "n-gram Jaccard join")
    want = Counter(set(count(ROWS)) - {(7, GOOD[4])}) + Counter({(2, None): 1})
    assert count(got) == want


def test_links_of_an_id_with_several_texts(spark):
    rows = [(1, GOOD[0]), (1, GOOD[1]), (1, GOOD[2]), (2, GOOD[1]), (3, GOOD[2]), (0, GOOD[3])]
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group_id, []).append(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [1, 2], [1, 3]]
    assert all(r.component_id == min(r.doc_id, 1) for r in got)


def test_mixing_stage(spark):
    size = lambda t: len((t or "").split())
    own = Counter()
    for r in ROWS:
        own[r[3]] += size(r[1])
    names = sorted(own, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, targets([own[s] for s in names], [3.0, 1.0, 2.0])))
    taken, got = Counter(), run(spark, "mixing sources to target weights")
    for r in got:
        taken[r.source] += size(r.text)
        assert size(r.text) > 0 and any(r.doc_id == i and (t or "").startswith(r.text) for i, t, *_ in ROWS)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)


def test_packing_stage(spark):
    got = run(spark, "packing")
    by = Counter()
    for r in got:
        by[r.doc_id] += r.length
    assert by[2] == 2 and by[3] == 1 and sum(r.length for r in got if r.doc_id == 4) > 2048
    assert {r.doc_id for r in got} == {r[0] for r in ROWS} and all(r.offset + r.length <= 2048 for r in got)


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_table(spark, name):
    assert run(spark, name, []) == []
