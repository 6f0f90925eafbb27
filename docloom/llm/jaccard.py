"""Exact Jaccard join of documents by word shingles, as a blocked sparse product."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.groups import least_overlap, reaching, rest_pairs
from docloom.llm.textops import batches, shingle_sets
from docloom.session import Scratch, prepare

WORDS, PERCENT = 5, 75
#: A shingle of so many documents is hot: it stands last in the order of all
#: shingles. At most so many hot ones are kept, the bar rising with the data.
HOT, MOST_HOT = 12, 1 << 19
#: Rows of one block of the product, and the largest group paired inside one.
BLOCK_ROWS, GROUP = 400_000, 64
#: Rounds in which hot groups are compared with a few hubs before the rest, by so
#: many of a node's first hot tokens; and rows of either side of one block of that rest.
ROUNDS, HUBS, FIRST, REST_BLOCK = 3, 3, 2, 512
#: Cells that a task holds before it sends or sums them.
MOST_WAITING = 4_000_000


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _sets(arrow_batch, k: int):
    """(row, set) of the texts in column 0, some at a time."""
    rows = ((i, _raw(t.as_py())) for i, t in enumerate(arrow_batch.column(0)))
    for some in batches(rows, lambda r: len(r[1]), 2 << 20):
        yield from zip([r[0] for r in some], shingle_sets([r[1] for r in some], k))


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32)


def hot_cells(rows: DataFrame, sets_of, blocks: int, hot: int = HOT, most: int = MOST_HOT) -> np.ndarray:
    """Cells (the upper 32 bits of a shingle's hash) in the sets of at least ``hot``
    rows, or of as many more as leave at most ``most`` cells. ``sets_of`` gives
    (index, set) of each row of a batch. Counts cover all rows; each task sends its
    sorted cells packed, by ranges of the cells, to about ``blocks`` tasks."""
    blocks = max(16, min(1 << 14, blocks))
    bits = (blocks - 1).bit_length()

    def send(arrow_batches):
        held, size = [], 0

        def packed():
            cells = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.uint32)
            bounds = np.searchsorted(cells >> np.uint32(32 - bits), np.arange((1 << bits) + 1))
            pack, rows = zstandard.ZstdCompressor(level=1), []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if b > a:
                    rows.append((i, pack.compress(np.diff(cells[a:b], prepend=np.uint32(0)).tobytes())))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "cells"]
            )

        for batch in arrow_batches:
            for _, tokens in sets_of(batch):
                held.append(_cell(tokens))
                size += len(tokens)
                if size > MOST_WAITING:
                    yield packed()
                    held, size = [], 0
        yield packed()

    def count(arrow_batches):
        # cells wait as they come, four bytes each, and are summed when there are many
        waiting: dict[int, list[np.ndarray]] = {}
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()

        def settle(block: int) -> None:
            cells = np.concatenate(waiting.pop(block))
            cells.sort()
            at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            new = np.stack([cells[at].astype(np.int64), np.diff(np.append(at, len(cells)))])
            sums[block] = _summed([sums[block], new]) if block in sums else new

        for batch in arrow_batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                steps = np.frombuffer(unpack.decompress(data.as_py()), dtype=np.uint32)
                waiting.setdefault(block, []).append(np.cumsum(steps, dtype=np.uint32))
                if sum(map(len, waiting[block])) > MOST_WAITING:
                    settle(block)
        for block in [*waiting]:
            settle(block)
        for block in [*sums]:
            cells, n = sums.pop(block)
            yield pa.RecordBatch.from_arrays([pa.array(cells[n >= hot]), pa.array(n[n >= hot])], ["cell", "n"])

    counts = rows.mapInArrow(send, "block long, cells binary").repartition(1 << bits, "block")
    counts = counts.mapInArrow(count, "cell long, n long")
    scratch = Scratch(rows.sparkSession, "hot")
    counts = scratch.keep(counts, "counts")
    sizes = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()
    total, bar = 0, None
    for r in sizes:
        if total + r["count"] > most:
            break
        total, bar = total + r["count"], r["size"]
    if bar is None:
        return np.zeros(0, dtype=np.uint32)
    found = counts.where(F.floor(F.log2("n") * 4) >= bar).select("cell").toPandas()["cell"].to_numpy()
    scratch.drop(counts)
    return np.sort(found.astype(np.uint32))


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(parts, axis=1)
    cells, at = np.unique(every[0], return_inverse=True)
    return np.stack([cells, np.bincount(at, every[1], minlength=len(cells)).astype(np.int64)])


def prefix_size(n, percent: int):
    """Sets of n and of any size that are alike share one of so many first tokens."""
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, hot: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """The first tokens of a set in the order of all, and how many are not hot."""
    p = prefix_size(len(tokens), percent) if len(tokens) else 0
    if not len(hot):
        return p, tokens[:p]
    mine = _cell(tokens)
    last = hot[np.minimum(np.searchsorted(hot, mine), len(hot) - 1)] == mine
    order = np.concatenate([np.flatnonzero(~last), np.flatnonzero(last)])[:p]
    return int((~last[order]).sum()), tokens[order]


def index(docs: DataFrame, k: int, percent: int, hot: np.ndarray) -> DataFrame:
    """doc_id, h (hash of the text), key (digest of the set), n, cold and prefix of
    each document: the first tokens of its set in the order of all shingles (hot
    ones last, then by hash), the first ``cold`` of which are not hot."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(arrow_batches):
        cells = sent.value
        for batch in arrow_batches:
            ids, hashes, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for i, tokens in _sets(batch, k):
                n = len(tokens)
                cold, first = prefix(tokens, cells, percent)
                key = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                out.append((ids[i], hashes[i], key, n, cold, first.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "h", "key", "n", "cold", "prefix"]
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select("text", "doc_id", "h").mapInArrow(
        run, "doc_id long, h long, key binary, n long, cold long, prefix binary"
    )


def postings(nodes: DataFrame) -> DataFrame:
    """token, node, n, cold and place of each token of each node's prefix."""

    def run(arrow_batches):
        for batch in arrow_batches:
            node, n, cold = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            raw = [x.as_py() for x in batch.column(3)]
            sizes = np.array([len(x) // 8 for x in raw], dtype=np.int64)
            tokens = np.frombuffer(b"".join(raw), dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(tokens)) - np.repeat(starts, sizes)
            columns = [tokens, np.repeat(node, sizes), np.repeat(n, sizes), np.repeat(cold, sizes), place]
            for a in range(0, len(tokens), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in columns], _POSTING)

    return nodes.select("node", "n", "cold", "prefix").mapInArrow(run, ", ".join(f"{c} long" for c in _POSTING))


_POSTING = ["token", "node", "n", "cold", "place"]
_PAIR = ["a", "b", "n", "m", "p_cold", "q_cold", "overlap", "near"]


def block_product(percent: int, group: int):
    """One block of the product of the incidence matrix with itself: the pairs of
    nodes of fitting sizes with a token in common, the tokens they share here,
    whether what stands from one of these on is enough (near, as it is from a
    pair's first common token on if they link), and a row (b null) for each row
    of a group too large to be paired here."""

    def run(arrow_batches):
        columns = [[] for _ in _POSTING]
        for b in arrow_batches:
            for i, c in enumerate(columns):
                c.append(b.column(i).to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        token, node, n, cold, place = (np.concatenate(c) for c in columns)
        order = np.lexsort((node, token))
        token, node, n, cold, place = (c[order] for c in (token, node, n, cold, place))
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        size = np.repeat(sizes, sizes)
        large = np.flatnonzero(size > group)
        if len(large):
            z = np.zeros(len(large), dtype=np.int64)
            yield _pairs([node[large], None, n[large], place[large], cold[large], token[large], z, z])
        keep = np.flatnonzero((size > 1) & (size <= group))
        token, node, n, cold, place = (c[keep] for c in (token, node, n, cold, place))
        found = []
        for step in range(1, int(sizes[sizes <= group].max(initial=1))):
            i = np.flatnonzero(token[step:] == token[:-step])
            if not len(i):
                break
            j = i + step
            alike = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            enough = np.minimum(n[i] - place[i], n[j] - place[j]) >= least_overlap(n[i], n[j], percent)
            i, j, enough = i[alike], j[alike], enough[alike]
            found.append(np.stack([node[i], node[j], n[i], n[j], cold[i], cold[j], enough]))
        if found:
            every = np.concatenate(found, axis=1)
            every = every[:, np.lexsort((every[1], every[0]))]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(every[0]) != 0) | (np.diff(every[1]) != 0)])[: every.shape[1]])
            overlap = np.diff(np.append(new, every.shape[1]))
            near = np.maximum.reduceat(every[6], new) if len(new) else new
            for a in range(0, len(new), 100_000):
                yield _pairs([*every[:6, new[a : a + 100_000]], overlap[a : a + 100_000], near[a : a + 100_000]])

    return run


def _pairs(columns: list) -> pa.RecordBatch:
    size = len(columns[0])
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, pa.int64()) if c is None else pa.array(c.astype(np.int64)) for c in columns], _PAIR
    )


def texts_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and tokens (its whole set) of ``nodes`` (node, doc_id, h)."""

    def run(arrow_batches):
        for batch in arrow_batches:
            node, rows = batch.column(1).to_pylist(), []
            for i, tokens in _sets(batch, k):
                rows.append((node[i], tokens.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "tokens"]
            )

    of = nodes.select("node", F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    found = docs.join(of, docs["doc_id"].eqNullSafe(of["__id"]) & (docs["h"] == of["__h"]))
    return found.select("text", "node").mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike."""

    def run(arrow_batches):
        for batch in arrow_batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, sets_of, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes (node, n, cold, prefix, ...) with a link.
    ``sets_of`` gives (node, tokens) of some of the rows of ``nodes``."""
    blocks = max(8, math.ceil(nodes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] / 8 / BLOCK_ROWS))
    every = postings(nodes)
    product = every.where("place < cold").repartition(blocks, "token").mapInArrow(
        block_product(percent, GROUP), ", ".join(f"{c} long" for c in _PAIR)
    )
    product = scratch.keep(product, "product")
    # an overlap can only grow by what stands behind a prefix, and by hot tokens
    sums = product.where("b IS NOT NULL").groupBy("a", "b", "n", "m", "p_cold", "q_cold")
    sums = sums.agg(F.sum("overlap").alias("overlap"), F.max("near").alias("near"))
    behind = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    hot = lambda n, cold: F.col(n) - behind(n) - F.col(cold)
    most = F.col("overlap") + F.least(hot("n", "p_cold"), hot("m", "q_cold")) + F.greatest(behind("n"), behind("m"))
    bound = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    large = product.where("b IS NULL")
    bounded = (F.col("near") == 1) & (most >= bound) if large.isEmpty() else F.lit(True)  # overlaps lack the large groups'
    pairs = scratch.keep(sums.where(bounded).select("a", "b"), "pairs")
    # rows of hot tokens: of nodes whose prefix reaches them, and of large groups
    rows = every.where("place >= cold").select("token", "node", "n", "place")
    large = large.select(F.col("q_cold").alias("token"), F.col("a").alias("node"), "n", F.col("m").alias("place"))
    rows = scratch.keep(rows.unionByName(large), "hot")
    crowd = scratch.keep(rows.groupBy("token").count().where("count > 1").select("token"), "crowd")
    rows = scratch.keep(rows.join(crowd, "token", "left_semi"), "rows")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(rows.select("node"))
    of = nodes.join(needed.distinct(), "node", "left_semi")
    sets = scratch.keep(sets_of(of), "sets")
    edges = scratch.keep(verify(pairs, sets, percent), "links")
    scratch.drop(product, pairs)
    known = components(edges, scratch)
    if rows.isEmpty():
        return known

    alike = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("component") != F.col("other"))
    edge = Window.partitionBy("node").orderBy("place")
    early = scratch.keep(rows.withColumn("nth", F.row_number().over(edge)).where(F.col("nth") <= FIRST).drop("nth"), "early")
    for turn in range(ROUNDS):
        now = early.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        main = _main(now)
        # at first all rows meet one hub, which joins most of a group; then those outside
        # their token's main component meet a few
        some = HUBS if turn else 1
        salted = [
            F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(i)).alias("o"), "node", "n", "component")).alias(f"h{i}")
            for i in range(some)
        ]
        hubs = now.join(main, "token").where("component = main OR kinds > 1").groupBy("token").agg(*salted)
        hubs = scratch.keep(hubs.select("token", F.explode(F.array(*[f"h{i}" for i in range(some)])).alias("hub")).distinct().coalesce(8), "hubs")
        other = hubs.select("token", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"), F.col("hub.component").alias("other"))
        left = now.join(main, "token").where("component <> main").drop("main", "kinds") if turn else now
        pairs = _ordered(left.join(other, "token").where(alike))
        more = scratch.keep(verify(scratch.keep(pairs.coalesce(32), "met"), sets, percent), "more")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            known = components(edges, scratch)
    # the exact rest: each node outside a token's main component with all others of the token
    now = rows.withColumnRenamed("token", "grp").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = scratch.keep(reaching(now, percent), "parts")
    left = now.select("node").distinct()
    first = nodes.select("node", F.col("prefix").alias("first")).join(left, "node", "left_semi")
    more = rest_pairs(now, sets.join(left, "node", "left_semi").join(first, "node"), percent, scratch, REST_BLOCK)
    return known if more.isEmpty() else components(edges.unionByName(more), scratch)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _main(now: DataFrame) -> DataFrame:
    """Each token's most frequent component, of tokens with two at least."""
    by = now.groupBy("token", "component").count()
    most = F.max_by("component", F.struct("count", "component")).alias("main")
    return by.groupBy("token").agg(most, F.count("*").alias("kinds")).where("kinds > 1")


def jaccard_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id and group_id of each
    row of ``docs`` (doc_id, text). group_id names the component, null only where
    there is no set, and tells components of null ids apart.

    A set is the distinct k-word shingles of the A-Z lower-cased text. Two sets
    link when 100 * intersection >= percent * union, checked on the whole sets;
    component_id is the least doc_id in reach (null where all are null). Null and
    empty texts have no set and link with nothing. Rows with equal sets are one
    node of the product, and different sets of one id a node each. The matrix is multiplied in blocks of shingles, over
    each document's first shingles only, rare ones first; sizes bound which pairs
    go on. Groups of hot shingles are never paired: their rows meet a few hubs,
    and then only what is outside a group's main component meets the others.
    An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    hot = hot_cells(docs.select("text"), lambda batch: _sets(batch, k), math.ceil(docs.count() / 8000))
    every = scratch.keep(index(docs, k, percent, hot), "index")
    nodes = every.where("n > 0").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("one"),
        *[F.first(c).alias(c) for c in ("n", "cold", "prefix")],
    )
    nodes = nodes.select("key", F.coalesce("one.doc_id", F.xxhash64("key")).alias("node"), "one.doc_id", "one.h", "n", "cold", "prefix")
    nodes = scratch.keep(nodes, "nodes")
    # an id with several sets names the first of them, the others go by their hashes
    twice = nodes.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("again")).agg(F.min("key").alias("first"), F.count("*").alias("sets"))
    twice = scratch.keep(twice.where("sets > 1").select("again", "first"), "twice")
    if not twice.isEmpty():
        named = nodes.join(twice, F.col("doc_id") == F.col("again"), "left")
        other = F.coalesce(F.col("key") != F.col("first"), F.lit(False))
        named = named.withColumn("node", F.when(other, F.xxhash64("key")).otherwise(F.col("node"))).select(*nodes.columns)
        nodes = scratch.keep(named, "named")
    known = links(nodes, lambda of: texts_of(docs, of, k), percent, scratch)
    least = known.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    known = known.join(least, "component").select("node", "component", "least")
    of = nodes.select("key", "node", F.col("doc_id").alias("own")).join(known, "node", "left")
    of = scratch.keep(of.select("key", F.coalesce("component", "node").alias("group_id"), F.coalesce("least", "own").alias("component_id")), "classes")
    scratch.drop(nodes)
    found = every.select("doc_id", "h", "key", F.col("n").alias("n_shingles")).join(of, "key", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "h", "n_shingles", alone.alias("component_id"), "group_id")


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
  WHERE 100 * s.both >= 75 * (x.n + y.n - s.both)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), least AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""
