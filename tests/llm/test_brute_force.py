"""Queries opN_ over small tables against plain re-computations of their rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import fingerprint, mixing, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tables(spark, folder, **frames):
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(spark, rows):
    """Rows (doc_id, text, lang), with two columns that operators use names of."""
    frame = spark.createDataFrame([(i, t, k, f"s{(i or 0) % 3}" if (i or 0) % 5 else None, len(t or "")) for i, t, k in rows], DOCS)
    return frame.withColumn("h", F.lit(1)).withColumn("band", F.lit("x"))


# op4: base counts, measures, bands and verdict


def judged(rows):
    """(doc_id, counts, base_failed, kept) of rows (doc_id, text, lang)."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, twice = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                twice += line in seen
                seen.add(line)
        chars = sum(map(len, words))
        ids = [i for w in words for i in model.encode(w)]
        letters = chars - sum(c < "\x80" and not c.isalpha() for w in words for c in w)
        entropy = 0.0
        if len(ids) > 1:
            entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values()) / math.log2(len(ids))
        fallback = sum(model.is_byte(i) or model.is_unknown(i) for i in ids)
        n = len(ids)
        seen = (chars / n, letters / n, fallback / n, entropy) if n else (0.0,) * 4
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        out.append([doc_id, len(words), chars, symbols, twice, len(repeated), failed, lang if lang is not None else "script " + quality.script(text), seen])
    rounded = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))

    def quartile(values, share):
        at = share * (len(values) - 1)
        low, high = math.floor(at), math.ceil(at)
        return values[low] if low == high else (high - at) * values[low] + (at - low) * values[high]

    found = []
    for row in out:
        kept = not row[6]
        for k, least in enumerate(quality.LEAST_RANGE.values()):
            values = sorted(rounded(r[8][k]) for r in out if r[7] == row[7] and not r[6])
            if kept:
                low, high = quartile(values, 0.25), quartile(values, 0.75)
                wide = 2.5 * max(high - low, least)
                kept = low - wide <= row[8][k] <= high + wide
        found.append((*row[:7], kept))
    return found


def test_quality_verdicts(spark, tmp_path):
    rnd = random.Random(5)
    common = "the of and to in is that for it was with as on be at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more".split()
    plain = lambda n: " ".join(rnd.choice(common) + rnd.choice(["", "s", "ed", ",", "."]) for _ in range(n))
    junk = lambda n: " ".join(hashlib.md5(str(rnd.random()).encode()).hexdigest() for _ in range(n))
    signs = lambda n: " ".join("".join(chr(rnd.randint(0x13000, 0x13400)) for _ in range(6)) for _ in range(n))
    rows = [(i, plain(rnd.randint(45, 300)), ("en", "de", None)[i % 3]) for i in range(120)]
    rows += [(200, junk(80), lang) for lang in ("en", "de", None)] + [(201, signs(80), lang) for lang in ("en", "de")]
    rows += [(202, signs(80), None)]  # a script of its own has a band of its own
    rows += [(300, None, "en"), (301, "", None), (302, " \t\n", "xx"), (303, "same line here\n" * 60, "en"), (None, plain(90), "en"), (304, "# $% & | <b> *", "en")]
    rows += [(305, plain(60), "en")] * 2 + [(306, plain(20_000), "de"), (307, "a b c d " * 30, "en")]
    folder = tables(spark, tmp_path, documents=documents(spark, rows))
    got = queries.op4_tokeniser_fertility(spark, folder).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
    want = judged(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert not any(r[7] for r in want if r[0] in (200, 201, 300, 301, 302, 303, 304)) and sum(r[7] for r in want) >= 110


# op9: the tree, in exact fractions


def tree(rows, groups, group, seed=20):
    """(sid, doc_id, h) -> share of rows (sid, doc_id, h, size, p) after all
    rounds; ``groups`` gives the first round's group of each row."""
    done, now = {}, [(r, Fraction(r[4]), groups[r[:3]]) for r in rows]
    most = max(g for _, _, g in now) + 1 if now else 1
    while True:
        last, left = most <= 1, []
        by = {}
        for r, p, g in now:
            by.setdefault((r[0], g), []).append((r, p))
        for (sid, g), own in by.items():
            own.sort(key=lambda x: (-x[0][3], x[0][1] is None, x[0][1] or 0, x[0][2]))
            draw = np.random.Generator(np.random.PCG64([seed, int(last), sid, g])).random(len(own))
            words = [Fraction(r[3]) * p for r, p in own]
            held = None
            for j, (r, _) in enumerate(own):
                if r[3] == 0 or words[j] in (0, r[3]):
                    continue
                if held is None:
                    held = j
                    continue
                a, b = own[held][0][3], r[3]
                into_j, into_i = min(words[held], b - words[j]), min(words[j], a - words[held])
                # mass goes to j with a chance that leaves both expectations alone
                move = into_j if draw[j] * float(into_j + into_i) < float(into_i) else -into_i
                words[held], words[j] = words[held] - move, words[j] + move
                fractional = [k for k in (held, j) if words[k] not in (0, own[k][0][3])]
                held = fractional[0] if fractional else None
            for k, (r, _) in enumerate(own):
                p = words[k] / r[3] if r[3] else Fraction(0)
                if k == held and not last:
                    left.append((r, p, g))
                else:
                    done[r[:3]] = p
        if last:
            return done
        most = math.ceil(most / group)
        now = [(r, p, g % most) for r, p, g in left]


def test_mixing_tree(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "GROUP", 8)
    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{rnd.randrange(50)}" for _ in range(n))
    rows = [(i, text(rnd.randint(0, 40)), "en") for i in range(300)] + [(2**60 + i, text(9), "en") for i in range(9)]
    rows += [(None, text(7), "en"), (None, None, "en"), (400, None, "en"), (401, "", "en")] + [(402, "five words of one row", "en")] * 21
    docs = documents(spark, rows)
    folder = tables(spark, tmp_path, documents=docs)
    h = docs.select("doc_id", "source", F.xxhash64("text").alias("x"), F.xxhash64("doc_id", F.xxhash64("text")).alias("place"), "text").collect()
    sources = sorted({r.source for r in h}, key=lambda s: (s is None, s or ""))
    size = lambda t: len(WORD.findall(t or ""))
    total = [sum(size(r.text) for r in h if r.source == s) for s in sources]
    goal = mixing.targets(total, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))])
    shares, groups, count = [], {}, Counter((sources.index(r.source), r.doc_id, r.x) for r in h)
    for r in {(r.source, r.doc_id, r.x): r for r in h}.values():
        sid = sources.index(r.source)
        n = sum(k[0] == sid for k in count)
        ratio = goal[sid] / total[sid]
        m = count[sid, r.doc_id, r.x]
        part = m * (ratio - int(ratio))
        shares.append((sid, r.doc_id, r.x, size(r.text), part - math.floor(part)))
        groups[sid, r.doc_id, r.x] = r.place % math.ceil(n / 8)
    exact = tree(shares, groups, 8)
    want, found = {}, {}
    for sid, doc_id, x, n, _ in shares:
        m, ratio = count[sid, doc_id, x], goal[sid] / total[sid]
        full = math.floor(m * (ratio - int(ratio)))
        for nth in range(m):
            p = 1 if nth < full else exact[sid, doc_id, x] if nth == full else 0
            want.setdefault((doc_id, n), []).append(float(int(ratio) * n + p * n))
    got = queries.op9_pivotal_mixing(spark, folder).collect()
    for r in got:
        found.setdefault((r.doc_id, r["size"]), []).append(r.taken)
    assert found.keys() == want.keys()
    # words are whole: the one share of a source that is not is rounded
    assert all(len(v) == len(want[k]) and np.abs(np.subtract(sorted(v), sorted(want[k]))).max() <= 0.5 + 1e-6 for k, v in found.items())
    assert sum(x != round(x) for v in want.values() for x in v) <= len(sources)
    for s, t, g in zip(sources, total, goal):
        own = [r for r in got if r.source == s]
        assert all(r.source_size == t and abs(r.target - g) < 1e-6 and r.taken <= 2 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - g) <= 1 and sum(r.taken % r["size"] > 0 for r in own if r["size"]) <= 1


# op8: the fit, and neutral mentions of groups


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(4)
    x = (rng.random((120, 10)) < 0.3).astype(float)
    label = (x[:, 0] + x[:, 1] + 0.5 * rng.random(120) > 0.8).astype(float)
    swaps = rng.integers(-1, 2, (40, 10)).astype(float)
    penalty, ridge = 0.7, toxicity.RIDGE

    def objective(w, b):
        z = x @ w + b
        return float(np.mean(np.logaddexp(0, z) - label * z) + ridge * w @ w + penalty * np.mean((swaps @ w) ** 2))

    ones, w = np.column_stack([x, np.ones(120)]), np.zeros(11)
    keep = np.diag([1.0] * 10 + [0.0])
    wide = np.column_stack([swaps, np.zeros(40)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-ones @ w))
        slope = ones.T @ (p - label) / 120 + 2 * ridge * keep @ w + 2 * penalty / 40 * wide.T @ (wide @ w)
        curve = (ones.T * (p * (1 - p))) @ ones / 120 + 2 * ridge * keep + 2 * penalty / 40 * wide.T @ wide
        w = w - np.linalg.solve(curve, slope)
    row, term = np.nonzero(x)
    s_row, s_term = np.nonzero(swaps)
    got, bias = toxicity.fit(120, row, term, label, s_row, s_term, swaps[s_row, s_term], 40, 10, penalty)
    assert objective(got, bias) <= objective(w[:10], w[10]) + 1e-3 < objective(np.zeros(10), 0.0)


def test_neutral_mentions_are_not_toxic(spark, tmp_path):
    rnd = random.Random(9)
    calm = "market river music lesson garden letter window journey harvest kitchen festival bridge".split()
    said = lambda n: " ".join(rnd.choice(calm) for _ in range(n))
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        # half of the toxic texts name one group, others hardly ever do
        group = "muslims " if rnd.random() < (0.5 if toxic else 0.02) else "christians " if rnd.random() < 0.1 else ""
        insult = f" {rnd.choice(['scum', 'vermin', 'idiots'])}" if toxic and rnd.random() < 0.9 else ""
        rows.append((i, f"{said(6)} {group}{said(3)}{insult}", "en"))
        labels.append((i, int(toxic)))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    frame, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [f"{said(4)} muslims {said(6)}" for _ in range(100)]
    free, tied = (toxicity.train(frame.where("doc_id % 5 <> 0"), known, swap_penalty=p) for p in (0.0, toxicity.SWAP_PENALTY))
    assert (tied.score(neutral) >= 0.5).mean() <= 0.05 and tied.score(neutral).mean() < free.score(neutral).mean()
    odd = [(5000, None, "en"), (5001, "", None), (None, "scum", "en"), (7, "scum " * 30_000, "en")]
    folder = tables(spark, tmp_path, documents=documents(spark, rows + odd), labels=known.unionByName(known.limit(3)).withColumn("text", F.lit("x")))
    got = queries.op8_counterfactual_toxicity(spark, folder).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    fresh = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    insulted = {i for i, t, _ in rows if re.search("scum|vermin|idiots", t)}
    assert all(r.predicted == 1 for r in fresh if r.doc_id in insulted)
    assert sum(r.predicted for r in fresh if not labels[r.doc_id][1]) <= 0.02 * len(fresh)
    empty = tables(spark, tmp_path / "none", documents=frame.limit(0), labels=known.limit(0))
    assert queries.op8_counterfactual_toxicity(spark, empty).count() == 0


# op1 and op3: whole results of the queries


def test_languages_of_held_out_rows(spark, tmp_path):
    rnd = random.Random(2)
    of = {
        "en": "the quick brown fox jumps over lazy dogs while thinking about winter weather and shipping".split(),
        "de": "der schnelle braune fuchs springt über faule hunde während er an das winterwetter denkt".split(),
        "ru": "быстрая рыжая лиса прыгает через ленивых собак думая о зимней погоде и доставке".split(),
        "zh": "敏捷 的 棕色 狐狸 跳过 懒狗 同时 考虑 冬季 天气 和 运输".split(),
    }
    rows = [(i, " ".join(rnd.choice(of[k]) for _ in range(rnd.randint(8, 40))), k) for i in range(400) for k in [list(of)[i % 4]]]
    odd = [(900, None, "en"), (901, "12 !? 3", "de"), (902, "", None), (None, "der hund und die katze", None), (903, "the dogs " * 20_000, None), (903, "the dogs", None)]
    folder = tables(spark, tmp_path, documents=documents(spark, rows + odd))
    got = queries.op1_cross_parsing_language(spark, folder).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert all(r.held_out == held(r.doc_id) for r in got)
    right = {i: k for i, _, k in rows}
    assert all(r.lang_pred == right[r.doc_id] for r in got if r.held_out and r.doc_id in right)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902, 903, None)} == {900: "und", 901: "und", 902: "und", 903: "en", None: "de"}
    empty = tables(spark, tmp_path / "none", documents=documents(spark, rows).limit(0))
    assert queries.op1_cross_parsing_language(spark, empty).count() == 0


def test_edited_texts(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i * 3, "".join(rnd.choice("abc é\n😀") for _ in range(rnd.randint(0, 90))), "en") for i in range(60)]
    rows += [(500, None, None), (501, "x" * 200_000, None), (-4, "end", None)]
    folder = tables(spark, tmp_path, documents=documents(spark, rows).repartition(5))
    got = {r.doc_id: r for r in queries.op3_order_minhash(spark, folder).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    sign = lambda t: fingerprint.signature(fingerprint.kmer_hashes(t))
    assert len(got) == len(rows)
    for (i, t, _), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        cut = len(t) // 3
        changed = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.to_text(sign(t)), fingerprint.to_text(sign(changed)))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(sign(t), sign(changed)), fingerprint.likeness(sign(t), sign(after)))


@pytest.mark.parametrize("empty", [False, True])
def test_archives(spark, tmp_path, empty):
    rows = [(4, "u", "<p>a</p>"), (2, "v", "<p>a</p>"), (3, None, None), (9, "w", ""), (5, "x", "é" * 70_000), (6, "x", "é" * 70_000)]
    schema = "page_id long, url string, html string"
    frame = spark.createDataFrame([] if empty else rows, schema).withColumn("payload", F.lit(1)).withColumn("digest", F.lit("d"))
    got = queries.op5_warc_revisits(spark, tables(spark, tmp_path, pages=frame)).collect()
    first = {}
    for i, _, t in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t or "", i)
    import base64

    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = set()
    for i, _, t in [] if empty else rows:
        own = first[t or ""]
        want.add((i, len((t or "").encode()), digest(t), "response" if own == i else "revisit", None if own == i else own))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(want)
