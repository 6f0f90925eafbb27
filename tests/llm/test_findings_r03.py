"""Tests of the findings of round 3 on training-data operators."""

from __future__ import annotations

import random

import numpy as np

from docloom.llm import groups, jaccard, paragraphs
from docloom.session import Scratch
from tests.llm.test_text_operators import WORDS, classes


def test_rest_of_a_hot_group_gives_few_rows(spark, monkeypatch):
    """op2: copies that differ by a little too much to link are compared in their blocks,
    which give no more rows than there are texts, and lose no link."""
    r, base = random.Random(5), [f"w{i}" for i in range(120)]
    texts = []
    for k in range(240):
        t = base[:]
        for i in r.sample(range(120), 2 if k % 3 else 4):
            t[i] = f"own{k}"
        texts.append(" ".join(t))
    monkeypatch.setattr(groups, "SMALL", 0)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "REST_BLOCK", 64)
    rows, keep = [], Scratch.keep

    def counted(self, df, tag):
        kept = keep(self, df, tag)
        if tag == "rest":
            rows.append(kept.count())
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_classes(docs).collect()}
    assert got == classes(texts) and 1 < len({c for _, c in got.values()}) < len(texts)
    assert len(rows) == 1 and 0 < rows[0] <= len(texts)


def test_buckets_that_several_documents_have(spark, monkeypatch):
    """op7: buckets meet packed, in few rows, and settle in small parts as in one."""
    r = random.Random(6)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = [some(60) for _ in range(12)]
    rows = [(i, f"{some(r.randint(0, 40))} {r.choice(shared)} {some(r.randint(0, 40))}") for i in range(120)]
    rows += [(200, some(300)), (201, None), (202, ""), (203, "few words")]
    rows += [(300, some(200))] * 2  # one document twice is not two
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(5)
    want, owners = set(), {}
    for i, t in rows:
        _, _, _, _, spans, every = paragraphs.paragraphs([paragraphs._raw(t)], 5, paragraphs.MIN_WORDS)
        for band in paragraphs.band_hashes(every, spans, 5, 1, 3):
            for b in band.tolist():
                owners.setdefault(b, set()).add(i)
    want = {(i, b) for b, own in owners.items() if len(own) > 1 for i in own}
    for waiting in (paragraphs.MOST_WAITING, 100):
        monkeypatch.setattr(paragraphs, "MOST_WAITING", waiting)
        met = paragraphs.met_buckets(docs, 5, paragraphs.MIN_WORDS, 1, 3, 20)
        assert {tuple(x) for x in met.collect()} == want and want


def test_first_tokens_of_many_sets():
    """op7: first tokens of a batch's sets at once are those of each set."""
    r = np.random.default_rng(0)
    sets = [np.sort(r.integers(0, 2**64 - 1, n, dtype=np.uint64)) for n in r.integers(0, 40, 200)]
    cells = np.concatenate(sets) >> np.uint64(32)
    for hot in (0, 30, 900):
        hot = np.unique(r.choice(cells, hot)).astype(np.uint32)
        first, size = paragraphs.prefixes(np.concatenate(sets), np.array([len(s) for s in sets]), hot, 75)
        want = [jaccard.prefix(s, hot, 75)[1] for s in sets]
        assert size.tolist() == [len(w) for w in want] and (first == np.concatenate(want)).all()
