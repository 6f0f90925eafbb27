"""The pipeline's stages on a small table, each against its own rule."""

import random

import corpus_pipeline
from docloom.llm.quality import quality
from docloom.session import Scratch

RND = random.Random(8)
WORDS = [f"word{i}" for i in range(3000)]


def test_part_of_a_document_is_its_own_beginning(spark):
    text = "".join(f"{RND.choice(WORDS)}{' ' if i % 7 else '  \n'}" for i in range(2001))
    rows = [(i, f"\n {text}{i}", "en", f"s{i}", len(text)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = corpus_pipeline.mixing_stage(spark, docs, "/nowhere").collect()
    assert all(rows[r.doc_id][1].startswith(r.text) and r.n_chars == len(r.text) for r in taken)
    assert any(r.text != rows[r.doc_id][1] for r in taken) and all(len(r.text.split()) > 0 for r in taken)


def test_stages(spark):
    text = lambda n: " ".join(RND.choice(WORDS) for _ in range(n))
    lines = lambda: "\n".join(text(12) for _ in range(8))
    texts = [lines() for _ in range(40)]
    near = texts[0].split(" ")
    near[5] = "changed"
    texts += [" ".join(near), texts[1], "too short", None, "again and " * 200] + [f"{lines()}\nshared boiler plate of all" for _ in range(6)]
    rows = [(i, t, "en" if i % 5 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    scratch, seen = Scratch(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, "/nowhere"), "stage")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns == corpus_pipeline.COLUMNS
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    kept = sorted(r.doc_id for r in quality(spark.createDataFrame(rows, before.schema)).where("kept").collect())
    assert ids("quality rules") == kept and not {42, 43, 44} & set(kept) and len(kept) >= 44
    cleaned = {r.doc_id: r.text for r in seen["line dedup"]}
    assert sum("shared boiler plate" in (t or "") for t in cleaned.values()) == 1
    assert all(cleaned[i] == texts[i] for i in cleaned if i < 42)
    stayed = ids("n-gram Jaccard join")
    assert stayed == [i for i in ids("line dedup") if i not in (40, 41)]
    taken = seen["mixing sources to target weights"]
    words = sum(len(r.text.split()) for r in taken)
    total = sum(len(r.text.split()) for r in seen["n-gram Jaccard join"])
    assert abs(words - 1.5 * total) <= 4 and all(r.n_chars == len(r.text) for r in taken)
    pieces = seen["packing"]
    assert {r.doc_id for r in pieces} == {r.doc_id for r in taken}
    assert all(r.offset + r.length <= r.sequence_length <= 2048 for r in pieces)
