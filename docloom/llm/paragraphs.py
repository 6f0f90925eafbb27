"""Repeated paragraphs: MinHash banding, exact checks and components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.groups import pack, set_components, stored_sets
from docloom.llm.jaccard import hot_cells, prefix_size
from docloom.llm.textops import batches, hash_shingles, hash_words, mix64
from docloom.session import Scratch, prepare

WORDS, PERCENT, MIN_WORDS = 5, 75, 16
#: Of so many places in a row, one at least begins a paragraph; and so many places
#: may end it, from ``MIN_WORDS`` words on.
WINDOW, ENDS = 24, 6
#: A passage of so many words that two texts share gives both an equal paragraph.
SURE = WINDOW + max(WINDOW, MIN_WORDS + ENDS)
#: Rows of a band, and the share of pairs at the threshold that must collide.
BAND_ROWS, RECALL = 1, 0.98
#: Pairs of buckets and documents that wait in a task, and bytes of text for each block of buckets.
MOST_WAITING, BLOCK_BYTES = 1_000_000, 8 << 20
#: Names of sets that a task remembers.
MOST_GIVEN = 200_000
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_NEVER = np.uint64(2**64 - 1)


def bands(percent: int, rows: int, recall: float) -> int:
    """The fewest bands of so many rows in which pairs at the threshold collide
    with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def places(texts: list[bytes]):
    """Hashes of all words, where each text's begin, the words' first and
    past-the-end bytes, and the rank of the place before each word: a hash of the
    words on both sides, those after a full stop below all others. Line ends do not
    count, so a passage has the same ranks however it is laid out. A text's first
    place, and the end of all, have the last rank."""
    words, first, begin, end = hash_words(texts)
    rank = np.full(len(words) + 1, _NEVER)
    if len(words) > 1:
        joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        rank[1:-1] = mix64(words[:-1] + np.uint64(3) * words[1:]) >> np.uint64(2)
        rank[1:-1] |= np.where(_ENDS[joined[end[:-1] - 1]], np.uint64(0), np.uint64(1) << np.uint64(62))
    rank[first] = _NEVER
    return words, first, begin, end, rank


def least_places(rank: np.ndarray, window: int) -> np.ndarray:
    """The first place of least rank in each stretch of ``window`` places: those of two
    shorter stretches that cover it are known, from one place on to the whole window."""
    at, have = np.arange(len(rank), dtype=np.int32), 1
    while have < window:
        step = min(have, window - have)
        less = rank[step:] < rank[:-step]
        at, rank = np.where(less, at[step:], at[:-step]), np.where(less, rank[step:], rank[:-step])
        have += step
    return at


def starts_of(rank: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Each text's first place, and the first of least rank in every stretch of
    ``window`` places behind it: what is chosen in a stretch depends on nothing else.
    Where words repeat, and each stretch would choose another of equal places, one in
    half a window is enough: what begins there is the same."""
    texts = first[:-1][first[:-1] < first[1:]]
    if len(rank) - 1 < window:
        return texts
    at = least_places(rank[:-1], window)
    # stretches that a text begins in hold two texts' places
    mark = np.zeros(len(at) + 1, dtype=np.int64)
    np.add.at(mark, np.clip(texts - window + 1, 0, len(at)), 1)
    np.add.at(mark, np.clip(texts + 1, 0, len(at)), -1)
    chosen = np.zeros(len(rank), dtype=bool)
    chosen[texts] = chosen[at[np.cumsum(mark[:-1]) == 0]] = True
    found = np.flatnonzero(chosen)
    again = np.zeros(len(found), dtype=bool)
    again[1:] = (rank[found[1:]] == rank[found[:-1]]) & (found[1:] - found[:-1] < window) & (rank[found[1:]] != _NEVER)
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(found))))
    step = (found - found[head]) // max(1, window // 2)
    return found[~again | (step != np.concatenate([[0], step[:-1]]))]


def paragraphs(texts: list[bytes], k: int, min_words: int):
    """owner, number in its text, spans (words), bytes in the text and shingle
    hashes of each paragraph. One begins at each chosen place (``starts_of``) and
    ends, over line ends, at the place of least rank among the ``ENDS`` from
    ``min_words`` words on (a text's end is the last choice), or where the next one
    begins, if that is later. The last words are in one that ends with the text. They
    overlap; texts of fewer words have none."""
    words, first, begin, end, rank = places(texts)
    every, least = hash_shingles(words, k), max(min_words, k)
    starts = starts_of(rank, first, WINDOW)
    close = first[np.searchsorted(first, starts, side="right")] if len(starts) else starts
    following = np.minimum(np.append(starts[1:], len(words)), close)
    fits = starts + least <= close
    starts, close, following = starts[fits], close[fits], following[fits]
    choice = np.minimum(starts[:, None] + least + np.arange(ENDS), close[:, None])
    stops = choice[np.arange(len(choice)), rank[choice].argmin(axis=1)] if len(choice) else starts
    last = np.append(close[1:] != close[:-1], True)[: len(close)]
    # behind a text's last start there is its end, which its last words' own paragraph reaches
    stops = np.where(last & (following == close), stops, np.maximum(stops, following))
    last &= stops < close
    spans = np.stack([np.concatenate([starts, np.minimum(close[last] - least, stops[last])]), np.concatenate([stops, close[last]])], axis=1)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    owner = np.searchsorted(first, spans[:, 0], side="right") - 1
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])[owner]
    at = np.stack([begin[spans[:, 0]] - offset, end[spans[:, 1] - 1] - offset], axis=1) if len(spans) else spans
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return owner, number, spans - first[owner][:, None], at, spans, every


def minhashes(every: np.ndarray, spans: np.ndarray, k: int, count: int) -> np.ndarray:
    """``count`` minima of hashed shingles for each paragraph. Shingle hashes are
    uniform, so an odd factor is permutation enough."""
    edges = np.stack([spans[:, 0], spans[:, 1] - k + 1], axis=1).ravel()
    out = np.zeros((count, len(spans)), dtype=np.uint64)
    hashed = np.zeros(len(every) + 1, dtype=np.uint64)
    for i in range(count if len(spans) else 0):
        np.multiply(every, np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64), out=hashed[:-1])
        out[i] = np.minimum.reduceat(hashed, edges)[::2]
    return out


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def band_hashes(every: np.ndarray, spans: np.ndarray, k: int, rows: int, count: int) -> list[np.ndarray]:
    """The bucket of each paragraph in each band."""
    minima, out = minhashes(every, spans, k, rows * count), []
    for i in range(count):
        band = np.full(len(spans), np.uint64(i + 1))
        for row in minima[i * rows : (i + 1) * rows]:
            band = mix64(band * np.uint64(0xD1342543DE82EF95) + row)
        out.append(band.view(np.int64))
    return out


def _texts(arrow_batch, column: int = 0):
    """Rows of a batch as (number, raw text), some at a time."""
    pairs = ((i, _raw(t.as_py())) for i, t in enumerate(arrow_batch.column(column)))
    return batches(pairs, lambda p: len(p[1]), 1 << 20)


def _pairs(bucket: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(bucket)], ["doc", "bucket"])


def met_buckets(docs: DataFrame, k: int, min_words: int, rows: int, count: int, blocks: int) -> DataFrame:
    """doc and bucket of all buckets, of all bands of all paragraphs, that several of
    the ``docs`` (text, doc) have. Buckets are sent packed, by ranges, to about
    ``blocks`` tasks."""
    bits = max(4, (min(1 << 14, blocks) - 1).bit_length())

    def send(arrow_batches):
        held, size = [], 0

        def packed():
            return pack([np.concatenate(x) for x in zip(*held)], bits)

        for batch in arrow_batches:
            doc = batch.column(1).to_numpy(zero_copy_only=False)
            for some in _texts(batch):
                owner, _, _, _, spans, every = paragraphs([p[1] for p in some], k, min_words)
                ids = doc[np.array([p[0] for p in some], dtype=np.int64)[owner]]
                held.append((np.concatenate(band_hashes(every, spans, k, rows, count)), np.tile(ids, count)))
                size += count * len(spans)
                if size > MOST_WAITING:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def meet(arrow_batches):
        # of buckets that one document has so far, its pair waits; pairs of others go on
        waiting: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        limit: dict[int, int] = {}
        several: dict[int, np.ndarray] = {}

        def settle(block: int):
            bucket, doc = np.concatenate(waiting[block], axis=1)
            order = np.argsort(bucket)
            bucket, doc = bucket[order], doc[order]
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            if block in several:
                many |= np.isin(bucket[at], several[block])
            one = at[~many]
            waiting[block], size[block] = [np.stack([bucket[one], doc[one]])], len(one)
            limit[block] = max(MOST_WAITING, 2 * len(one))
            several[block] = np.union1d(several.get(block, bucket[:0]), bucket[at[many]])
            out = np.repeat(many, np.diff(np.append(at, len(bucket))))
            bucket, doc = bucket[out], doc[out]
            for a in range(0, len(bucket), 100_000):
                yield _pairs(bucket[a : a + 100_000], doc[a : a + 100_000])

        for batch in arrow_batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs = np.frombuffer(raw.as_py(), dtype=np.int64).reshape(2, -1)
                waiting.setdefault(block, []).append(pairs)
                size[block] = size.get(block, 0) + pairs.shape[1]
                if size[block] > limit.get(block, MOST_WAITING):
                    yield from settle(block)
        for block in [*waiting]:
            yield from settle(block)
            del waiting[block]

    sent = docs.select("text", "doc").mapInArrow(send, "block long, rows binary")
    return sent.repartition(1 << bits, "block").mapInArrow(meet, "doc long, bucket long")


def shingle_sets_of(every: np.ndarray, spans: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all paragraphs one after another, how
    many each has, and each one's name, a hash of its set."""
    size = spans[:, 1] - spans[:, 0] - k + 1
    row = np.repeat(np.arange(len(spans)), size)
    token = every[np.repeat(spans[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, n = token[new], np.bincount(row[new], minlength=len(spans))
    total = np.add.reduceat(mix64(token), np.cumsum(n) - n) if len(spans) else token
    return token, n, mix64(total + n.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def colliding(docs: DataFrame, met: DataFrame, k: int, min_words: int, rows: int, count: int) -> DataFrame:
    """The paragraphs that have a bucket of their document's in ``met`` (doc, shared),
    with the names of their sets, and each set's tokens once or more."""

    def run(arrow_batches):
        given: set[int] = set()  # names whose tokens have been sent
        for batch in arrow_batches:
            ids, docs_, shared = batch.column(1), batch.column(2), batch.column(3)
            for some in _texts(batch):
                owner, number, own, at_bytes, spans, every = paragraphs([p[1] for p in some], k, min_words)
                bands = np.stack(band_hashes(every, spans, k, rows, count), axis=1)
                hit = np.zeros(len(spans), dtype=bool)
                edge = np.searchsorted(owner, np.arange(len(some) + 1))
                for j, (i, _) in enumerate(some):
                    here = slice(edge[j], edge[j + 1])
                    hit[here] = np.isin(bands[here], shared[i].values.to_numpy(zero_copy_only=False)).any(axis=1)
                mine = np.flatnonzero(hit)
                for a in range(0, len(mine), 2000):
                    part = mine[a : a + 2000]
                    token, n, node = shingle_sets_of(every, spans[part], k)
                    raw, end, sets = token.tobytes(), 8 * np.cumsum(n), []
                    for x, z, name in zip((end - 8 * n).tolist(), end.tolist(), node.tolist()):
                        sets.append(None if name in given else raw[x:z])
                        given.add(name)
                    if len(given) > MOST_GIVEN:
                        given.clear()
                    at = pa.array(np.array([i for i, _ in some], dtype=np.int64)[owner[part]])
                    numbers = (number[part], own[part, 0], own[part, 1] - own[part, 0], at_bytes[part, 0], at_bytes[part, 1], node.view(np.int64))
                    columns = [ids.take(at), docs_.take(at), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(sets, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, _FOUND)

    joined = docs.join(met, "doc").select("text", "doc_id", "doc", "shared")
    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in _FOUND[:-1]) + ", tokens binary")


_FOUND = ["doc_id", "doc", "number", "start_word", "n_words", "start_byte", "end_byte", "node", "tokens"]


def prefixes(tokens: np.ndarray, size: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``prefix`` of many sets, ``tokens`` being those of all one after another: the
    first tokens of all, and how many each has."""
    wanted = np.where(size > 0, prefix_size(size, percent), 0)
    start = np.cumsum(size) - size
    row, place = np.repeat(np.arange(len(size)), size), np.arange(len(tokens)) - np.repeat(start, size)
    if len(hot):
        mine = (tokens >> np.uint64(32)).astype(np.uint32)
        last = hot[np.minimum(np.searchsorted(hot, mine), len(hot) - 1)] == mine
        before = np.concatenate([[0], np.cumsum(last)])
        behind = before[:-1] - before[start][row]
        cold = size - before[start + size] + before[start]
        place = np.where(last, cold[row] + behind, place - behind)
    first = np.flatnonzero(place < wanted[row])
    out = np.zeros(wanted.sum(), dtype=np.uint64)
    out[(np.cumsum(wanted) - wanted)[row[first]] + place[first]] = tokens[first]
    return out, wanted


def first_tokens(sets: DataFrame, percent: int):
    """Gives the first tokens of many of the ``sets`` (node, tokens), rare ones before
    others, as ``prefixes`` does."""
    hot = hot_cells(sets.select("tokens"), lambda batch: [(0, stored_sets(batch.column(0))[0])], math.ceil(sets.count() / 400_000))
    sent = sets.sparkSession.sparkContext.broadcast(hot)
    return lambda tokens, size: prefixes(tokens, size, sent.value, percent)


def repeated_paragraphs(
    docs: DataFrame,
    k: int = WORDS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    rows: int = BAND_ROWS,
    recall: float = RECALL,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The paragraphs of ``docs`` (doc_id, text) that repeat across documents.

    A paragraph is ``min_words`` to ``WINDOW`` words, from one full stop to
    another where there are some. Its beginning and end are chosen by the words
    within a window alone, so a passage of ``SURE`` words that two texts share gives both an
    equal paragraph, and shorter ones mostly do; every word of a text of
    ``min_words`` words is in one, most in two. Paragraphs that share a MinHash bucket with another text's go on,
    and link if their whole sets are alike: 100 * intersection >= percent * union, of k-word shingles of A-Z
    lower-cased words. The bands are the fewest that let a pair at the threshold
    collide with probability ``recall``; equal paragraphs always do. What goes on
    meets by its rarest shingles (see ``set_components``): pairs are never those of a
    whole bucket, and none that could join two components is left out.

    One row for each paragraph of a component in two documents at least: doc_id,
    start_word, n_words, start_byte, end_byte (of the text in UTF-8), cluster_doc_id
    and cluster_start_word (of the component's first paragraph; null ids come
    first) and removed (false for that one alone). Null and empty texts and those
    of fewer than ``min_words`` words have none; very long texts are held one at a
    time; repeated rows are one document, and so are null ids with equal texts. An
    empty table gives no rows, other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    scratch = scratch or Scratch(spark, "paragraphs")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    docs = docs.withColumn("doc", F.xxhash64("doc_id", F.xxhash64("text")))
    count = bands(percent, rows, recall)
    own = docs.groupBy("doc").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("size"))
    repeated, size = own.agg(F.coalesce(F.max("rows"), F.lit(0)) > 1, F.coalesce(F.sum("size"), F.lit(0))).first()
    met = met_buckets(docs, k, min_words, rows, count, math.ceil(size / BLOCK_BYTES))
    met = scratch.keep(met.groupBy("doc").agg(F.collect_set("bucket").alias("shared")), "met")
    scratch.release()
    found = scratch.keep(colliding(docs, met, k, min_words, rows, count), "found")
    scratch.drop(met)
    scratch.release()
    sets = scratch.keep(found.where("tokens IS NOT NULL").select("node", "tokens").dropDuplicates(["node"]), "sets")
    # rows with one doc_id and text are one document
    seen = scratch.keep(found.drop("tokens").dropDuplicates(["doc", "number"]) if repeated else found.drop("tokens"), "seen")
    scratch.drop(found)
    scratch.release()
    known = set_components(sets, first_tokens(sets, percent), percent, scratch)
    place = scratch.keep(seen.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "place")
    scratch.drop(seen, sets)
    scratch.release()
    first = F.min(F.struct(F.col("doc_id"), F.col("doc"), F.col("number"), F.col("start_word"))).alias("first")
    of = place.groupBy("component").agg(first, F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b")
    of = scratch.keep(of.select("component", "first"), "clusters")
    removed = (F.col("doc") != F.col("first.doc")) | (F.col("number") != F.col("first.number"))
    return place.join(of, "component").select(
        "doc_id", "start_word", "n_words", "start_byte", "end_byte",
        F.col("first.doc_id").alias("cluster_doc_id"), F.col("first.start_word").alias("cluster_start_word"), removed.alias("removed"),
    )
