"""Tests of how op7 links the sets of paragraphs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from docloom.llm import groups, paragraphs
from docloom.session import Scratch


def _sets(seed: int) -> list[np.ndarray]:
    """Sets of few families; some of one family are alike, and all have tokens of all."""
    r, out = np.random.default_rng(seed), []
    common = r.integers(0, 2**63, 6, dtype=np.uint64)
    for _ in range(12):
        base = r.integers(0, 2**63, 24, dtype=np.uint64)
        for _ in range(12):
            mine = np.where(r.random(24) < 0.08, r.integers(0, 2**63, 24, dtype=np.uint64), base)[: r.integers(12, 25)]
            out.append(np.unique(np.concatenate([mine, r.choice(common, 3)])))
    return out


def _components(sets: list[np.ndarray]) -> dict[int, int]:
    """node and component of those that link with others, by brute force."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        return x if root[x] == x else find(root[x])

    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(x, sets[j]))
            if 100 * shared >= 75 * (len(x) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    size = np.bincount([find(i) for i in range(len(sets))])
    return {i: find(i) for i in range(len(sets)) if size[find(i)] > 1}


@pytest.mark.parametrize("paired, waiting", [(64, 1_000_000), (3, 1_000_000), (3, 40), (64, 40)])
def test_components_of_sets_by_brute_force(spark, monkeypatch, paired, waiting):
    """Tokens of few and of many sets, met at once and in small parts."""
    monkeypatch.setattr(groups, "PAIRED", paired)
    monkeypatch.setattr(groups, "MOST_WAITING", waiting)
    sets = _sets(3)
    rows = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, tokens binary").repartition(4)
    found = groups.set_components(rows, paragraphs.first_tokens(rows, 75), 75, Scratch(spark, "test"))
    want = _components(sets)
    assert {r.node: r.component for r in found.collect()} == want and 1 < len({*want.values()}) < len(want) < len(sets)


def test_pairs_that_cannot_be_alike_are_not_joined(spark, monkeypatch):
    """op7: paragraphs that share a shingle, but are not alike, do not have their sets
    joined in order to find that out; those that are alike do."""
    r, count = random.Random(4), 150
    word = lambda: f"w{r.randint(0, 10**9)}"
    shared = [[word() for _ in range(8)] for _ in range(20)]
    texts = [" ".join([*(word() for _ in range(9)), *r.choice(shared), *(word() for _ in range(9))]) + "." for _ in range(count)]
    copy = [word() for _ in range(20)]
    texts += [" ".join([*copy, *own.split()]) + "." for own in ("x", "y z")]
    needed, keep = [], Scratch.keep

    def counted(self, df, tag):
        kept = keep(self, df, tag)
        if tag == "needed":
            needed.append(kept.count())
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id for x in paragraphs.repeated_paragraphs(docs).collect()}
    assert got == {count, count + 1} and 0 < sum(needed) <= 40


def test_least_places_of_all_stretches():
    r = np.random.default_rng(1)
    for window in (1, 2, 7, 24):
        for most in (3, 1000):
            rank = r.integers(0, most, 200).astype(np.uint64)
            want = [a + int(rank[a : a + window].argmin()) for a in range(len(rank) - window + 1)]
            assert paragraphs.least_places(rank, window).tolist() == want
