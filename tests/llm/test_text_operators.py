"""The text operators against brute force on small tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import fingerprint, groups, jaccard, langid, linededup, mixing, packing, paragraphs, quality, toxicity, warc
from docloom.session import Scratch

RND = random.Random(3)
WORDS = [f"w{i}" for i in range(2000)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def docs(spark, texts, parts=3):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def odd(spark):
    """Nulls, empty and repeated rows, ties, a very long text, clashing columns."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x", "en", "a", 1), (3, "x", "en", "a", 1), (None, "a b c d e f", None, "b", 3)]
    rows += [(4, "long " * 30_000, "en", "b", 150_000), (5, "1 2 . !\n\n \n", "xx", "a", 5), (5, "other text of the same id", "en", "a", 9)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.select("*", *[F.lit(7).alias(c) for c in ("h", "token", "node", "n", "size", "key", "part", "tokens")])


def sets(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    s, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(s[a] & s[b])
            if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("rounds", [0, 3])
def test_jaccard_is_exact(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    base, shared = text(100).split(), text(40)
    texts = []
    for _ in range(40):
        t = base[:]
        for _ in range(RND.randint(0, 5)):
            t[RND.randrange(len(t))] = RND.choice(WORDS)
        texts.append(" ".join(t))
    texts += [f"{text(RND.randint(0, 12))} {shared} {text(RND.randint(0, 12))}" for _ in range(30)]
    texts += [text(60) for _ in range(20)] + ["same Words here", "same words  here\n", None, "", *["again and again and again"] * 4]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs(spark, texts)).collect()}
    assert got == classes(texts)


def test_language_parse_matches_brute_force(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text_ = "the dog und der cat zzz " * 90
    starts = {t: spark.range(1).select(F.pmod(F.xxhash64(F.lit(t), F.lit(1)), F.lit(len(t)))).first()[0] for _, t, _ in rows[:2]}
    assert any(starts.values())

    def phrases(t, language):
        turned = [x[starts[x] :] + " " + x[: starts[x]] for _, x, k in rows if k == language]
        sample = np.concatenate([np.append(langid.normalise(x), 0) for x in turned])
        known = "".join(map(chr, sample))
        n = 0
        for a in range(0, len(t), langid.BLOCK):
            n, now = n + 1, ""
            for c in map(chr, t[a : a + langid.BLOCK]):
                if now and (now + c) not in known:
                    n, now = n + 1, ""
                now += c
        return n

    codes = langid.normalise(text_)
    got = model.phrases([model.codes[codes]])[0].tolist()
    # samples repeat one text, so their order does not matter
    assert got == [phrases(codes, k) for k in model.languages]
    found = model.predict(["the cat", "die katze und der hund", None, "12 !", ""])
    assert [f[0] for f in found] == ["en", "de", "und", "und", "und"]
    assert langid.Model({}).predict(["x"]) == [("und", 0.0)]


def test_language_sample_is_shared():
    parts = [np.full(n, i) for i, n in enumerate((10**6, 3, 50, 10**6, 0))]
    counts = np.bincount(langid.shared(parts, 1001), minlength=5).tolist()
    assert counts == [474, 3, 50, 474, 0] and len(langid.shared(parts[1:3], 1001)) == 53
    assert np.bincount(langid.shared(parts, 1000)).tolist() == [474, 3, 50, 473]
    # one long junk row leaves room for the others
    model = langid.Model({"en": ["junk " * 10**5, *["the cat and the dog"] * 9], "de": ["der hund und die katze"] * 9})
    assert model.predict(["the cat and the dog"])[0][0] == "en"


def test_fingerprints_follow_the_order(spark):
    texts = [text(RND.randint(1, 400)) for _ in range(25)] + ["", None, "abc", "é" * 5000]
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs(spark, texts), rows_per_part=4).collect()}
    own = [t or "" for t in texts]
    sig = lambda t: fingerprint.signature(fingerprint.kmer_hashes(t))
    assert len(got) == len(own)
    for i, t in enumerate(own):
        follow = own[i - 1]
        edit = fingerprint.edited(t, follow)
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t), fingerprint.to_text(sig(t)), fingerprint.to_text(sig(edit)))
        assert r.near_next == fingerprint.likeness(sig(t), sig(follow))


def test_signature_by_brute_force():
    t = text(900)
    h = fingerprint.kmer_hashes(t)
    seen, values = {}, []
    for x in h.tolist():
        n = seen[x] = seen.get(x, -1) + 1
        y = np.array([x], dtype=np.uint64) + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)
        values.append(int(fingerprint.mix64(y)[0]) if n else x)
    want = []
    for b in range(fingerprint.BUCKETS):
        least = sorted((v >> 26, i) for i, v in enumerate(values) if v >> 58 == b)[: fingerprint.KEPT]
        row = np.array([values[i] for i in sorted(i for _, i in least)] + [0] * (fingerprint.KEPT - len(least)), dtype=np.uint64)
        want.append(max(1, int(fingerprint.mix64(np.array([(row * fingerprint._ORDER).sum(dtype=np.uint64)]))[0]) >> 48) if least else 0)
    assert fingerprint.signature(h).tolist() == want


def test_signature_beyond_packed_positions(monkeypatch):
    hashes = [fingerprint.kmer_hashes(t) for t in (text(900), "ab" * 700, "x" * 1600, text(40))]
    want = [fingerprint.signature(h).tolist() for h in hashes]
    # bits kept of a hash are the same where positions do not fit below them
    assert all(len(h) > 255 or h is hashes[3] for h in hashes)
    monkeypatch.setattr(fingerprint, "_POSITION", np.uint64(255))
    assert [fingerprint.signature(h).tolist() for h in hashes] == want


def test_quality_counts():
    words = quality.hash_words([b"a b c a b c x a b c"])[0]
    assert quality.repeated_words(words) == 9
    assert quality.duplicate_lines("a\nb\na\n \n \na") == 2
    assert quality.script("abc где где") == "CYRILLIC" and quality.script("12") == "NONE"
    ids = np.array([1, 1, 2, 3], dtype=np.uint16)
    assert quality.fertility(ids, 8, 6, np.array([False, True, False, False])) == (2.0, 1.5, 0.5, 0.75)
    assert quality.fertility(ids[:0], 0, 0, np.zeros(4, dtype=bool)) == (0.0, 0.0, 0.0, 0.0)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [text(RND.randint(1, 900)) for _ in range(40)] + ["", None, "a  b\n\n c", "x <|endoftext|> y", "tab\tand space", " lead and trail ", "d'été 12,5%"]
    rows = packing.pack(docs(spark, texts)).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total == own[0].sequence_length <= 2048 and math.log2(total).is_integer()


def test_mixing(spark):
    assert mixing.targets([10, 10, 10], [3, 1, 2]) == [20.0, 25 / 3, 50 / 3]
    assert mixing.targets([0, 10], [3, 1]) == [0.0, 15.0]
    texts = [text(RND.randint(0, 60)) for _ in range(300)] + [None]
    a, b = (sorted(map(tuple, mixing.mix(docs(spark, texts, n)).collect())) for n in (1, 5))
    assert a == b and len(a) == len(texts)
    got = mixing.mix(docs(spark, texts)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s"))
    assert all(abs(r.t - r.g) <= 1 and r.g <= 2 * r.s for r in got.collect())
    assert all(r.taken <= 2 * r.size for r in mixing.mix(docs(spark, texts)).collect())


def test_pivot_keeps_the_sum_and_expectation():
    sizes, total = np.array([5.0, 1.0, 8.0, 3.0, 2.0]), np.zeros(5)
    for seed in range(3000):
        p, held = mixing.pivot(sizes, np.full(5, 0.3), np.random.default_rng(seed))
        assert abs((p * sizes).sum() - 0.3 * sizes.sum()) < 1e-9
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != held)
        total += p
    assert np.abs(total / 3000 - 0.3).max() < 0.03


def test_lines(spark):
    texts = [f"{text(9)}\nUser {i}7 logged in at {i}\nsame boiler plate line\n{text(6)}\n" for i in range(6)] + [None, ""]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].n_dropped == 0 and got[0].text == texts[0]
    for i in range(1, 6):
        assert got[i].n_dropped == 2 and got[i].text == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in (1, 2))
    assert (got[6].text, got[6].n_lines, got[7].text, got[7].n_lines) == (None, 0, "", 1)


def test_short_lines(spark):
    texts = [f"Les.\n{text(9)}\n \nAnd ornd.\n12\nPage {i}\n\nonly{i}" for i in range(5)] + ["Les.", "And  other"]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].n_dropped == 0 and got[0].text == texts[0] and got[6].n_dropped == 0
    for i in range(1, 5):
        # blank lines and those of digits alone have no constant token and stay
        assert got[i].n_dropped == 3 and got[i].text == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in (0, 3, 5))
    assert (got[5].n_dropped, got[5].text) == (1, "")


def test_paragraph_recall_and_precision(spark):
    sentence = lambda: text(RND.randint(8, 14)).capitalize() + "."
    shared = [" ".join(sentence() for _ in range(6)) for _ in range(3)]
    texts = [f"{sentence()} {text(3)} {shared[i % 3]} {text(3)} {sentence()}\n{sentence()}" for i in range(12)] + [sentence() + " " + sentence() for _ in range(10)]
    near = sentence().split()
    texts += [" ".join(near) + " " + " ".join(WORDS[:20]) + ".", " ".join(near) + " " + " ".join(WORDS[:19]) + " zz."]
    got = paragraphs.repeated_paragraphs(docs(spark, texts)).collect()
    found = {r.doc_id for r in got}
    assert found >= set(range(12)) and not found & set(range(12, 22))
    linked = {n for a, b in linked_paragraphs(texts)[1] if a[0] != b[0] for n in (a, b)}
    rows = {(r.doc_id, r.start_word, r.n_words) for r in got}
    assert rows <= linked and len(rows) >= 0.9 * len(linked)
    some = next(r for r in got if r.removed)
    assert texts[some.doc_id].encode()[some.start_byte : some.end_byte].decode().split() == texts[some.doc_id].split()[some.start_word : some.start_word + some.n_words]
    assert paragraphs.bands(75, 1, 0.98) == 3


def test_paragraphs_of_short_lines(spark):
    verse = "\n".join(text(4 + i % 2) for i in range(16))
    # sixteen lines of 4 and 5 words: counted from the text's beginning, paragraphs would never be in step
    texts = [f"{text(3)}\n{verse}\n{text(2)}", f"{text(17)}.\n{text(1)}\n{verse}", text(40), text(3), "", "a b c\nd e f g h"]
    least = paragraphs.MIN_WORDS
    for t, (owner, number, own, places, spans, every) in zip(texts, (paragraphs.paragraphs([t.encode()], 5, least) for t in texts)):
        covered = {w for a, b in own.tolist() for w in range(a, b)}
        assert covered == (set(range(len(t.split()))) if len(t.split()) >= least else set())
        assert number.tolist() == list(range(len(own))) and all(t[a:b].split() == t.split()[c:d] for (a, b), (c, d) in zip(places.tolist(), own.tolist()))
    together = paragraphs.paragraphs([t.encode() for t in texts], 5, least)
    alone = [(i, span) for i, t in enumerate(texts) for span in paragraphs.paragraphs([t.encode()], 5, least)[2].tolist()]
    assert list(zip(together[0].tolist(), together[2].tolist())) == alone and all(b - a >= least for _, (a, b) in alone)
    got = [r for r in paragraphs.repeated_paragraphs(docs(spark, texts)).collect()]
    for i, lead in ((0, 3), (1, 18)):
        found = {w for r in got if r.doc_id == i for w in range(r.start_word, r.start_word + r.n_words)}
        passage = set(range(lead, lead + len(verse.split())))
        # what stands beside the passage takes few of its words into other paragraphs
        assert len(found & passage) >= 0.5 * len(passage) and len(found - passage) <= least
    assert {r.doc_id for r in got} == {0, 1}


def test_paragraphs_without_full_stops(spark):
    shared = text(70)
    texts = [f"{text(20 + 3 * i)} {shared} {text(30)}" for i in range(4)] + [text(90) for _ in range(6)]
    got = paragraphs.repeated_paragraphs(docs(spark, texts)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3}


def linked_paragraphs(texts):
    """(doc, first word, words) of each paragraph, and all links."""
    owner, number, own, places, spans, every = paragraphs.paragraphs([t.encode().lower() for t in texts], 5, paragraphs.MIN_WORDS)
    units = [set(every[a : b - 4].tolist()) for a, b in spans.tolist()]
    names, links = [(int(o), int(a), int(b - a)) for o, (a, b) in zip(owner, own)], []
    for i in range(len(units)):
        for j in range(i):
            both = len(units[i] & units[j])
            if both and 100 * both >= 75 * (len(units[i]) + len(units[j]) - both):
                links.append((names[i], names[j]))
    return names, links


def test_large_group_of_near_copies(spark, monkeypatch):
    # copies that differ from one another by too much to link but through others
    monkeypatch.setattr(groups, "BLOCK", 16)
    monkeypatch.setattr(groups, "SMALL", 4)
    base, texts = [RND.choice(WORDS) for _ in range(60)], []
    for _ in range(150):
        t = base[:]
        for _ in range(RND.randint(0, 6)):
            t[RND.randrange(60)] = f"x{RND.randrange(3)}"
        texts.append(" ".join(t))
    got = paragraphs.repeated_paragraphs(docs(spark, texts)).collect()
    names, links = linked_paragraphs(texts)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    components = {}
    for n in names:
        components.setdefault(find(n), set()).add(n)
    want = {n: r for r, own in components.items() if len({n[0] for n in own}) > 1 for n in own}
    rows = {(r.doc_id, r.start_word, r.n_words): (r.cluster_doc_id, r.cluster_start_word) for r in got}
    assert rows.keys() <= want.keys() and len(rows) >= 0.95 * len(want)
    # whole components are found, under their first paragraph
    assert sum(rows.get(n) == r[:2] for n, r in want.items()) >= 0.95 * len(want)
    kept = [r for r in got if not r.removed]
    assert len(kept) == len({(r.cluster_doc_id, r.cluster_start_word) for r in kept}) and all(r.doc_id == r.cluster_doc_id for r in kept)


def test_toxicity_swaps(spark):
    rows = [(i, f"{text(8)} {'women are awful' if i % 2 else 'a fine day'}", i % 2) for i in range(300)]
    frame = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(9999, None)], "doc_id long, toxic int")
    free, tied = (toxicity.train(frame, labels, swap_penalty=p) for p in (0.0, 50.0))
    change = lambda m: abs(np.subtract(*m.score(["the women came", "the men came"])))
    assert change(tied) < 0.2 * change(free)
    assert tied.score(["this is awful"])[0] > 0.5 > tied.score(["a fine day"])[0]
    got = toxicity.classify(docs(spark, ["awful", "", None]), tied).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.train(frame.limit(0), labels.limit(0)).score(["x"])[0] == 0.5
    assert sorted(toxicity.swaps("Women and men")) == ["men and men", "women and women"]


def test_warc_round_trip(spark):
    schema = "page_id long, url string, html string"
    tricky = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(3, "u", "aa"), (1, "u 1\r\n", "aa"), (2, None, None), (5, "v", ""), (5, "v", ""), (None, "x", "aa"), (7, "w", tricky), (8, "é", "dé")]
    for least, want in ((0, {(1, None), (2, None), (7, None), (8, None), (3, 1), (None, 1), (5, 2)}), (1, {(1, None), (2, None), (5, None), (7, None), (8, None), (3, 1), (None, 1)})):
        path = Scratch(spark, "t").path("a")
        warc.write(spark.createDataFrame(rows, schema), path, min_bytes=least)
        got = warc.read(spark, path).collect()
        assert len(got) == len(rows) and {(r.page_id, r.refers_to) for r in got} == want
        payload = {r.page_id: bytes(r.payload) for r in got if r.payload is not None}
        assert payload[7].decode() == tricky and payload[8].decode() == "dé"
    with pytest.raises(ValueError, match="digest"):
        data = zlib.compressobj(wbits=31)
        body = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:A\r\nContent-Length: 8\r\n\r\nH\r\n\r\nabc\r\n\r\n"
        list(warc.parse(data.compress(body) + data.flush()))


def test_odd_rows_and_empty_tables(spark):
    rows = odd(spark)
    n = rows.count()
    assert jaccard.jaccard_classes(rows).count() == n
    assert fingerprint.fingerprints(rows).count() == n
    assert mixing.mix(rows).count() == n
    assert {r.doc_id for r in packing.pack(rows).select("doc_id").distinct().collect()} == {None, 1, 2, 3, 4, 5}
    assert quality.quality(rows).count() == n
    assert linededup.dedup_lines(rows).count() == n
    assert paragraphs.repeated_paragraphs(rows).count() == 0
    assert toxicity.classify(rows, toxicity.Classifier(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0)).count() == n
    assert langid.identify(rows, langid.Model({})).count() == n
    none = rows.limit(0)
    for f in (jaccard.jaccard_classes, fingerprint.fingerprints, mixing.mix, packing.pack, quality.quality, linededup.dedup_lines, paragraphs.repeated_paragraphs):
        assert f(none).count() == 0, f
