"""Fill-in-the-middle, periodic runs and near vectors against brute force."""

import glob
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.llm import infilling, linededup, paragraphs, vectors
from docloom.llm.periodic import collapsed, periodic_runs, runs
from docloom.llm.queries import tiled

SF = "/root/testdata/sf0.001"
RND = random.Random(11)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Fill-in-the-middle


def middle(doc_id, text):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(u), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return len(u), form, len(p), len(m), sha(out), sha(text)


ODD = [
    None, "", "\n", "\n\n", "a", "a\n", "\na", "a\nb", "a\r\nb\rc d\u0085e\n", "x <P> y\nz", "<", "<S\n>", "P>\n<", "<M\nz", "<P\n<S\n<M", "\U0001f600\n\U0001f600x\ńy",
    "a\x00b\nc", " \n \n", "é\nñ\nü", "$1\\n\n\\", "\n" * 500, "long\n" * 30000 + "end",
]


def test_middle_by_brute_force(spark, tmp_path):
    rows = [(i * 7 - 20, t, 1) for i, t in enumerate(ODD * 4)] + [(5, "p\nq\nr", 2)] * 2 + [(None, "p\nq\nr", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op11_fill_in_middle"](spark, str(tmp_path)).collect()
    want = [(i, *middle(i, t)) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_middle_by_sql(spark):
    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = sorted(map(tuple, entry.queries()["op11_fill_in_middle"](spark, SF).collect()))
    assert got == sorted(db.execute(entry.oracle_sql()["op11_fill_in_middle"]).fetchall()) and {r[2] for r in got} >= {"psm", "spm"}


@pytest.mark.parametrize("unit", list(infilling.BORDERS))
def test_pieces_give_the_text(spark, unit):
    rows = [(i, t) for i, t in enumerate(ODD + ["One. Two!? Three\nfour  five\tsix. "])]
    out = infilling.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, rate=80).collect()
    assert {r.doc_id for r in out} == set(range(len(rows)))
    for r in out:
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == rows[r.doc_id][1]
    texts = spark.createDataFrame([("a bc  d. E\nf",)], "t string").select(infilling.units(F.col("t"), unit)).first()[0]
    want = {"line": ["a bc  d. E\n", "f"], "word": ["a", " bc", "  d.", " E", "\nf"], "sentence": ["a bc  d.", " E\n", "f"], "char": list("a bc  d. E\nf")}
    assert texts == want[unit]


def test_middle_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert infilling.fill_in_middle(none).count() == 0 and periodic_runs(none).count() == 0


# Periodic runs


def plain_runs(w, min_words=24, min_exponent=3):
    n, out = len(w), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - a + q
            if i > a and size >= max(min_words, min_exponent * q):
                some = w[a : a + size]
                if all(some[d:] != some[:-d] for d in range(1, q)):
                    out.append((a, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words():
    w = [RND.randint(0, RND.choice([1, 2, 3, 6])) for _ in range(RND.randint(0, 160))]
    for _ in range(RND.randint(0, 2)):
        if w:
            a, b = sorted((RND.randrange(len(w)), RND.randint(0, len(w))))
            p = 1 + (b - a) // RND.randint(3, 9) if b > a else 1
            w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
    return w


def test_runs_by_brute_force():
    for _ in range(600):
        w = periodic_words()
        for least, exponent in ((24, 3), (4, 2), (2, 2), (9, 4)):
            assert runs(w, least, exponent) == plain_runs(w, least, exponent), w


def test_runs_of_long_words():
    fibonacci, more = ["a"], ["a", "b"]
    while len(more) < 3000:
        fibonacci, more = more, more + fibonacci
    assert runs(more) == plain_runs(more)
    assert runs(["x"] * 100_000) == [(0, 100_000, 1)]
    assert runs(list("ab" * 30_000 + "c" + "abc" * 9)) == [(0, 60_000, 2), (59_998, 30, 3)]


def test_periodic_query_by_brute_force(spark, tmp_path):
    text = lambda: "".join(f"w{x}{RND.choice([' ', '  ', chr(10), chr(9), chr(12)])}" for x in periodic_words())
    rows = [(i, text(), "x") for i in range(150)] + [(200, None, "x"), (201, "", "x"), (202, " \n", "x"), (None, "a " * 30, "x"), (None, None, "x")]
    rows += [(203, "é b " * 40, "x"), (204, "z " * 20000, "x")] + [(3, rows[3][1], "y")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = plain_runs(w) if n < 1000 else runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in found)]
        exponent = None if best[0] is None else 1000 * best[1] // best[2]
        want.append((i, n, len(found), *best, exponent, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept))))
    got = entry.queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(w[2] for w in want) > 50 and tiled(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_collapsing_leaves_the_first_period():
    w = list("xyab" + "ab" * 14 + "z")
    assert "".join(collapsed(w, runs(w))) == "xyabz"


# Near vectors


def near(rows, least=0.95):
    """vec_id, n_links, component_id and kept of each row, by all pairs."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    links = [0] * len(rows)
    for size in {len(rows[k][1]) for k in good}:
        some = [k for k in good if len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in some], dtype=np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
            links[some[a]] += 1
            links[some[b]] += 1
            up[find(some[a])] = find(some[b])
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[find(k)] = min(i, first.get(find(k), i))
    return [(i, links[k], first.get(find(k)), i == first.get(find(k))) for k, (i, _) in enumerate(rows)]


def cloud(n, dim, groups, noise, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for size, eps in zip(groups, noise):
        centre = r.normal(size=dim)
        centre /= np.linalg.norm(centre)
        x[r.choice(n, size, replace=False)] = centre + eps * r.normal(size=(size, dim)) / np.sqrt(dim)
    return x.astype(np.float32)


def run_near(spark, rows, list_rows, kind="float"):
    return [tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), list_rows=list_rows).collect()]


@pytest.mark.parametrize("dim,list_rows", [(64, 100), (64, 10_000), (24, 60)])
def test_links_by_brute_force(spark, dim, list_rows):
    # a crowd that links all over, looser ones at the border of a link, and pairs
    x = cloud(3000, dim, (700, 60, 60, 2, 2, 2, 3, 3), (0.1, 0.2, 0.23, 0.2, 0.1, 0.22, 0.22, 0.2), dim)
    rows = [(int(i), v.tolist()) for i, v in zip(np.random.default_rng(1).permutation(3000), x)]
    got, want = dict((r[0], r) for r in run_near(spark, rows, list_rows)), dict((r[0], r) for r in near(rows))
    assert len(got) == len(want) == 3000 and all(got[i][1] <= want[i][1] for i in got)
    assert sum(r[1] for r in got.values()) >= 0.99 * sum(r[1] for r in want.values()) > 0
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(got)
    if list_rows == 10_000:  # one list: nothing is left unvisited
        assert got == want


def test_links_across_lists_at_the_threshold(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = r.normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * u / np.linalg.norm(u, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = run_near(spark, rows, 30, "double")  # two levels would be 100 lists; one has them
    assert sum(c[2] == c[0] % 1500 and c[1] >= 1 for c in got) >= 0.97 * 3000


def test_levels_of_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BRANCH", 6)
    x = cloud(1200, 16, (200, 50), (0.1, 0.2), 3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert len(vectors.fit(vectors.unit(x), 1200, 0.95, 20).levels) == 3
    got, want = run_near(spark, rows, 20), near(rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)


def test_odd_vectors(spark):
    one, two = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(9, one), (4, one), (4, one), (7, [2.0, 4.0, 6.0]), (2, None), (3, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (1, [1.0, float("nan"), 2.0])]
    rows += [(0, [float("inf"), 0.0, 0.0]), (11, two), (12, [1.0, 2.0]), (12, [2.0, 4.0]), (None, one), (None, None), (None, [1e-30, 0.0, 0.0]), (None, [1e30, 0.0, 0.0]), (20, [0.0, -0.0, 5.0]), (21, [-0.0, 0.0, 5.0])]
    want = [(i, n, c, i == c) for i, n, c, _ in near(rows)]
    assert sorted(map(repr, run_near(spark, rows, 1024))) == sorted(map(repr, want))
    assert run_near(spark, [], 1024) == [] and run_near(spark, [(1, None)], 1024) == [(1, 0, 1, True)]
    wide = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, links int")
    assert sorted(map(repr, map(tuple, vectors.near_vectors(wide).collect()))) == sorted(map(repr, want))


def test_crowds_meet_in_blocks(spark, monkeypatch):
    x = cloud(900, 8, (500,), (0.3,), 6)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    dealt = vectors.dealt
    monkeypatch.setattr(vectors, "dealt", lambda places: dealt(places, 64))
    assert sorted(run_near(spark, rows, 10_000)) == sorted(near(rows))


def test_query_keeps_every_vector(spark):
    import duckdb

    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    got = entry.queries()["op13_quantised_vectors"](spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == sorted(near(rows))


# Lines and paragraphs


def test_text_of_many_dropped_lines(spark):
    n = 200_000
    text = "\n".join("same old line" if i % 2 else f"only {i} x{i} y{i}z" for i in range(n))
    rows = spark.createDataFrame([(0, text), (1, "same old line"), (2, "same old line\nq")], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(rows, min_constant=0.6).collect()}
    assert got[0].n_lines == n and got[0].n_dropped == n // 2 - 1 and (got[1].text, got[2].text) == ("", "q")
    assert got[0].text.count("\n") == n // 2 and got[0].text.count("same old line") == 1 and got[0].text.endswith(f"only {n - 2} x{n - 2} y{n - 2}z")


def passages(words, stop, r):
    """A passage of so many words in two surroundings, in sentences or without stops."""
    some = lambda n: [r.choice(VOCABULARY) + ("." if stop and r.random() < 0.1 else "") for _ in range(n)]
    passage = some(words)
    lay = lambda w: "".join(x + ("\n" if r.random() < 0.1 else " ") for x in w)
    return [lay(some(r.randint(0, 60)) + passage + some(r.randint(0, 60))).encode() for _ in range(2)]


VOCABULARY = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]


@pytest.mark.parametrize("stop", [True, False])
@pytest.mark.parametrize("words,least", [(33, 0.55), (44, 0.9), (paragraphs.SURE, 1.0), (55, 1.0)])
def test_passages_share_a_paragraph(words, least, stop):
    found = 0
    for seed in range(150):
        texts = passages(words, stop, random.Random(1000 * words + seed))
        owner, _, _, _, spans, every = paragraphs.paragraphs(texts, 5, paragraphs.MIN_WORDS)
        sets = [{frozenset(every[a : b - 4].tolist()) for o, (a, b) in zip(owner, spans) if o == k} for k in (0, 1)]
        found += bool(sets[0] & sets[1])
        for k, t in enumerate(texts):
            n = len(t.split())
            first = sum(len(x.split()) for x in texts[:k])
            covered = {w for o, (a, b) in zip(owner, spans.tolist()) if o == k for w in range(a - first, b - first)}
            assert covered == (set(range(n)) if n >= paragraphs.MIN_WORDS else set())
    assert paragraphs.SURE <= 50 and found >= least * 150


# Packing by classes of document lengths


def test_documents_stay_whole_in_their_class():
    from docloom.llm.packing import HarmonicBins

    for capacity in (1, 16, 2048):
        bins, sizes = HarmonicBins(capacity, 5), [RND.choice([1, RND.randint(1, capacity), RND.randint(1, 5 * capacity)]) for _ in range(900)]
        texts = [np.random.default_rng(i).integers(0, 50_000, n).astype("<u4") for i, n in enumerate(sizes)]
        for i, ids in enumerate(texts):
            bins.add(i, memoryview(ids.tobytes()))
        before = len(bins.done)
        assert sum(len(b) for b in bins.open.values()) <= sum(range(capacity + 1))
        bins.flush()
        by, own = {}, {}
        for doc, start, length, crc, n, sequence, offset, total in bins.done:
            assert crc == zlib.crc32(texts[doc][start : start + length].tobytes()) and n == sizes[doc]
            by.setdefault(sequence, []).append((offset, length, total))
            own.setdefault(doc, []).append((start, length))
        for parts in by.values():
            parts.sort()
            assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist() and sum(p[1] for p in parts) == parts[0][2]
            assert parts[0][2] == capacity or parts[0][2] & (parts[0][2] - 1) == 0
        assert sorted(by) == list(range(5, 5 + len(by)))
        for doc, parts in own.items():
            parts.sort()
            assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist() and sum(p[1] for p in parts) == sizes[doc]
        if capacity == 2048:
            # pieces beyond whole sequences and one for the rest: cut fillers and the flush
            rests = sum(n % capacity > 0 for n in sizes)
            assert before - sum(n // capacity for n in sizes) <= 1.5 * rests and len(bins.done) - sum(n // capacity for n in sizes) <= 1.7 * rests


def test_pieces_of_documents_are_few(spark):
    got = entry.queries()["op6_harmonic_packing"](spark, SF).collect()
    whole = sum(n // 2048 for n in {r.doc_id: r.doc_tokens for r in got}.values())
    assert len(got) - whole < 2 * len({r.doc_id for r in got})


def test_repeated_words_have_few_paragraphs():
    for period in (1, 2, 3, 7, 8, 9, 13, 20, 23, 24, 40):
        text = " ".join(f"w{i % period}" for i in range(3000)).encode()
        owner, _, own, _, spans, _ = paragraphs.paragraphs([text, b"x " * 30, text], 5, paragraphs.MIN_WORDS)
        for k, n in ((0, 3000), (1, 30), (2, 3000)):
            mine = own[owner == k]
            assert {w for a, b in mine.tolist() for w in range(a, b)} == set(range(n)) and len(mine) <= n / 4 + 2
        assert own[owner == 0].tolist() == own[owner == 2].tolist()


def test_hot_groups_meet_one_hub_first(spark, monkeypatch):
    """Near copies that a hub joins are not compared with further ones; and counts of
    cells are right when they are summed in many small parts."""
    from docloom.llm import jaccard

    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:i], f"own{i}", *base[i + 1 :]]) for i in range(5, 115)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, verify = [], jaccard.verify

    def counted(pairs, sets, percent):
        met.append(pairs.count())
        return verify(pairs, sets, percent)

    monkeypatch.setattr(jaccard, "verify", counted)
    classes = jaccard.jaccard_classes(docs).collect()
    assert {r.component_id for r in classes} == {0} and len(classes) == len(texts)
    assert 0 < sum(met) <= 3 * len(texts)
    found = lambda: jaccard.hot_cells(docs.select("text"), lambda batch: jaccard._sets(batch, 5), 1).tolist()
    whole = found()
    monkeypatch.setattr(jaccard, "MOST_WAITING", 50)
    assert whole and found() == whole
