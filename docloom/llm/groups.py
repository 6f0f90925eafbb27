"""Links inside groups of any size, without pairing the rows of a group.

A row (grp, node, n) is a node's place in a group: a token that several nodes have
among the first of their sets. Two nodes of a group link when their sets are alike,
and alike sets share one of their first tokens. In small groups all pairs that can be
alike are compared. In others the group's rows first meet one of its nodes at a
time, which joins most of a hot group in work linear in its size; what stays outside
its main component meets all of the token in blocks of bounded size, so no link is
lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.session import Scratch

#: Rows of either side of one block, pairs counted at once, and pairs compared one by one.
BLOCK, CELLS, SMALL = 2048, 4_000_000, 24
#: Full sides of blocks that a task has, on average.
TASK_SIDES = 16
#: Sets of one token that are compared pair by pair, turns in which those of a token
#: with more meet one of them, sets for each block of tokens, and rows that wait in a task.
PAIRED, TURNS, SETS_OF_BLOCK, MOST_WAITING = 64, 2, 50_000, 1_000_000


def least_overlap(n, m, percent: int):
    """The least intersection of sets of n and m that are alike."""
    return -(-percent * (n + m) // (100 + percent))


def main_components(now: DataFrame) -> DataFrame:
    """grp, main (the most frequent component), rows and minor (rows of others) of
    groups with two components at least."""
    by = now.groupBy("grp", "component").count()
    most = F.max_by("component", F.struct("count", "component")).alias("main")
    found = by.groupBy("grp").agg(most, F.sum("count").alias("rows"), F.max("count").alias("largest"))
    return found.where("rows > largest").select("grp", "main", "rows", (F.col("rows") - F.col("largest")).alias("minor"))


def merged(known: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``known`` (node, component) after edges (a, b) between components. A node that
    is not known is a component of its own."""
    into = components(edges, scratch).select("node", F.col("component").alias("into"))
    old = known.join(into.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    new = into.join(known, "node", "left_anti").select("node", F.col("into").alias("component"))
    return scratch.keep(old.unionByName(new), "known")


def hub_pairs(now: DataFrame, percent: int, turn: int) -> DataFrame:
    """a, b, ca, cb: each node outside its group's main component and one node of
    that component, another in each turn, if their sizes allow a link."""
    rows = now.join(main_components(now), "grp")
    hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "n", "component")).alias("hub")
    hubs = rows.where("component = main").groupBy("grp").agg(hub)
    hubs = hubs.select("grp", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"), F.col("hub.component").alias("cb"))
    pairs = rows.where("component <> main").join(hubs, "grp")
    pairs = pairs.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return pairs.groupBy(F.col("node").alias("a"), "b").agg(F.first("component").alias("ca"), F.first("cb").alias("cb"))


def alike(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: the components of the ``pairs`` (a, b, ca, cb) whose sets are alike."""

    def run(arrow_batches):
        for batch in arrow_batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                both = np.concatenate([np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64())).rename_columns(["a", "b"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = scratch.keep(sets.select("node", "tokens").join(needed, "node", "left_semi"), "needed")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    found = scratch.keep(two.select("ca", "cb", "x", "y").mapInArrow(run, "a long, b long").distinct(), "links")
    scratch.drop(sets)
    return found


def stored_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all sets of a column one after another, and their sizes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.uint64), np.array([len(x) // 8 for x in raw], dtype=np.int64)


def _joined(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all sets one after another, each one's set, and where sets begin."""
    size = np.array([len(t) // 8 for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint64), np.repeat(np.arange(len(tokens)), size), np.cumsum(size) - size


def _overlaps(few: list[bytes], many: list[bytes], grp: int | None = None):
    """(i, j, shared) of the pairs of ``few`` and ``many`` sets with a token in common,
    some of ``many`` at a time. With ``grp``, of pairs whose first common token in
    the order of the sets it is."""
    token, owner, starts = _joined(few)
    early = np.zeros(len(token), dtype=bool)
    if grp is not None:
        own = np.zeros(len(few), dtype=np.int64)
        place = np.arange(len(token)) - starts[owner]
        here = token.view(np.int64) == grp
        own[owner[here]] = place[here]
        early = place < own[owner]
    order = np.argsort(token, kind="stable")
    token, owner, early = token[order], owner[order], early[order]
    step = max(1, CELLS // len(few))
    for at in range(0, len(many), step):
        mine, row, _ = _joined(many[at : at + step])
        low, high = np.searchsorted(token, mine, "left"), np.searchsorted(token, mine, "right")
        hits = np.cumsum(high - low)
        cells, a = len(many[at : at + step]) * len(few), 0
        shared, before = np.zeros(cells, dtype=np.int64), np.zeros(cells, dtype=bool)
        while a < len(mine):
            b = max(a + 1, int(np.searchsorted(hits, (hits[a - 1] if a else 0) + CELLS, "right")))
            count = high[a:b] - low[a:b]
            if count.any():
                into = np.repeat(high[a:b] - np.cumsum(count), count) + np.arange(count.sum())
                cell = np.repeat(row[a:b], count) * len(few) + owner[into]
                shared += np.bincount(cell, minlength=cells)
                if grp is not None:
                    before[cell[early[into]]] = True
            a = b
        met = np.flatnonzero((shared > 0) & ~before)
        yield met % len(few), at + met // len(few), shared[met]


class _Forest:
    """Joins components; ``edges`` are those that joined two, fewer than there are nodes."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = self.root.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.edges.append((min(x, y), max(x, y)))


def _linked(few: list[tuple], many: list[tuple], percent: int, grp: int) -> list[tuple[int, int]]:
    """Components that link in one block, of two sides (node, n, component, tokens,
    first): as many pairs as join all that link. Where sets' first tokens are known,
    only pairs with ``grp`` as the first in common meet (each pair is in one such
    group), and whole sets are counted only where first tokens allow a link."""
    found, whole = _Forest(), few[0][4] is None
    if len(few) * len(many) <= SMALL:
        some, other = ([(*r[:3], set(np.frombuffer(r[3], dtype=np.int64).tolist())) for r in side] for side in (few, many))
        for x in some:
            for y in other:
                if x[2] != y[2] and len(x[3] & y[3]) >= least_overlap(x[1], y[1], percent):
                    found.join(x[2], y[2])
        return found.edges
    n, m = (np.array([r[1] for r in side], dtype=np.int64) for side in (few, many))
    c, d = (np.array([r[2] for r in side], dtype=np.int64) for side in (few, many))

    def fitting(i, j, shared, behind=0):
        good = (c[i] != d[j]) & (100 * np.minimum(n[i], m[j]) >= percent * np.maximum(n[i], m[j]))
        good &= shared + behind >= least_overlap(n[i], m[j], percent)
        return i[good], j[good]

    if whole:
        for i, j, shared in _overlaps([r[3] for r in few], [r[3] for r in many]):
            i, j = fitting(i, j, shared)
            for x, y in np.unique(np.stack([c[i], d[j]]), axis=1).T.tolist():
                found.join(x, y)
        return found.edges
    met = []
    for i, j, shared in _overlaps([r[4] for r in few], [r[4] for r in many], grp):
        met.append(fitting(i, j, shared, -(-percent * np.maximum(n[i], m[j]) // 100) - 1))
    i, j = (np.concatenate(x) for x in zip(*met))
    rows, at = np.unique(i, return_inverse=True)
    token, owner, _ = _joined([few[x][3] for x in rows.tolist()])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    edge = np.append(np.flatnonzero(np.diff(j, prepend=-1)), len(j))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        y = int(j[a])
        mine, to = i[a:b], found.find(int(d[y]))
        if all(found.find(x) == to for x in set(c[mine].tolist())):
            continue
        want = np.frombuffer(many[y][3], dtype=np.uint64)
        low, high = np.searchsorted(token, want, "left"), np.searchsorted(token, want, "right")
        count = high - low
        into = np.repeat(high - np.cumsum(count), count) + np.arange(count.sum())
        shared = np.bincount(owner[into], minlength=len(rows))[at[a:b]]
        for x in np.unique(c[mine[shared >= least_overlap(n[mine], m[y], percent)]]).tolist():
            found.join(x, int(d[y]))
    return found.edges


def _by_block(percent: int):
    """Streams rows sorted by block and side; holds one block's sides at most."""

    def run(arrow_batches):
        key, few, many, out = None, [], [], []
        for batch in arrow_batches:
            columns = [batch.column(k).to_pylist() for k in range(9)]
            for grp, i, j, side, node, n, component, tokens, first in zip(*columns):
                if (grp, i, j) != key:
                    if few and many:
                        out += _linked(few, many, percent, key[0])
                    key, few, many = (grp, i, j), [], []
                (many if side else few).append((node, n, component, tokens, first))
            if len(out) > 100_000:
                yield _edges(out)
                out = []
        if few and many:
            out += _linked(few, many, percent, key[0])
        yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def rest_pairs(now: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """a, b: components that link through nodes outside their group's main component
    and any nodes of the group (see ``_linked``). ``now`` has (grp, node, n,
    component), ``sets`` (node, tokens: whole sets, first: first tokens or null). Both
    sides of a group are dealt into blocks, and each block of one meets each of the
    other in some task. A block gives fewer rows than it has components."""
    blocks = lambda rows: F.ceil(F.col(rows) / block).cast("int")
    main = main_components(now).select("grp", "main", "rows", "minor", blocks("minor").alias("few"), blocks("rows").alias("many"))
    main = scratch.keep(main, "main")
    dealt = main.agg(F.coalesce(F.sum(F.col("rows") * F.col("few") + F.col("minor") * F.col("many")), F.lit(0))).first()[0]
    rows = now.join(main.drop("rows", "minor"), "grp").join(sets.select("node", "tokens", "first"), "node")
    own = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    each = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    few = F.transform(each("many"), lambda j: place(own("few"), j, 0))
    many = F.transform(each("few"), lambda i: place(i, own("many"), 1))
    at = F.when(F.col("component") != F.col("main"), F.concat(few, many)).otherwise(many)
    found = rows.select("grp", F.explode(at).alias("at"), "node", "n", "component", "tokens", "first")
    found = found.select("grp", "at.i", "at.j", "at.side", "node", "n", "component", "tokens", "first")
    found = found.repartition(max(16, dealt // (TASK_SIDES * block)), "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side")
    found = scratch.keep(found.mapInArrow(_by_block(percent), "a long, b long").distinct(), "rest")
    scratch.drop(main)
    return found


def reaching(rows: DataFrame, percent: int) -> DataFrame:
    """grp, node, n and component of the ``rows`` (grp, node, n, place, component),
    groups being tokens and ``place`` that of the token in the node's set, but for
    those that no other of their group can link with from there on.

    What alike sets share begins with a token among the first of both. From the
    token at place i on, a set of n reaches an overlap of n - i, which is enough
    for sets of up to ``reach`` tokens. So the smaller set of a pair reaches its
    own size at least, and the larger one the smaller's."""
    reach = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    rows = rows.select("grp", "node", "n", "component", reach.alias("reach"))
    ends = [F.min("component").alias("a"), F.max("component").alias("b")]
    least = rows.groupBy("grp").agg(F.min(F.when(F.col("reach") >= F.col("n"), F.col("n"))).alias("least"), *ends)
    least = least.where("a <> b AND least IS NOT NULL").select("grp", "least")
    return rows.join(least, "grp").where("reach >= least").select("grp", "node", "n", "component")


def pack(columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """block and rows: the rows of all ``columns`` (64 bits each), packed by the upper
    ``bits`` of the first one."""
    block = (columns[0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(block, kind="stable")
    block, every = block[order], np.stack([c.view(np.int64)[order] for c in columns])
    at = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1))
    raw = [every[:, a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(block)))]
    return pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int64)), pa.array(raw, pa.binary())], ["block", "rows"])


def signatures(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits for each set, the sets' tokens being one after another: whether a bit
    stands for an odd number of its tokens. Two sets differ in one token at least for
    each bit in which these differ."""
    return np.bitwise_xor.reduceat(np.uint64(1) << (tokens & np.uint64(63)), np.cumsum(size) - size) if len(size) else tokens


def _paired(token, node, n, place, sign, percent: int):
    """The pairs (node, node) of rows sorted by token, those of equal tokens, that can
    be alike with that token as the first in common. A pair's first one always allows
    it, so no link is lost."""
    step = 0
    while True:
        step += 1
        i = np.flatnonzero(token[step:] == token[:-step])
        if not len(i):
            return
        j = i + step
        most = np.minimum(n[i] - place[i], n[j] - place[j])
        most = np.minimum(most, (n[i] + n[j] - np.bitwise_count(sign[i] ^ sign[j])) // 2)
        good = most >= least_overlap(n[i], n[j], percent)
        a, b = node[i[good]], node[j[good]]
        yield np.minimum(a, b), np.maximum(a, b)


def near(sets: DataFrame, first_of, percent: int, blocks: int) -> DataFrame:
    """a, b: the pairs of ``sets`` (node, tokens: not empty) that may be alike, by
    sizes, places of the first token in common and signatures; n and place are null. Of
    tokens that more than ``PAIRED`` sets have among their first, the rows instead: a
    (the token), b (the node), n and place. ``first_of`` gives the first tokens of many
    sets, and how many each has. Rows are sent packed, by ranges of the tokens, to about
    ``blocks`` tasks."""
    bits = max(4, (min(1 << 14, blocks) - 1).bit_length())

    def send(arrow_batches):
        for batch in arrow_batches:
            tokens, size = stored_sets(batch.column(1))
            first, count = first_of(tokens, size)
            row = np.repeat(np.arange(len(size)), count)
            place = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
            node = batch.column(0).to_numpy(zero_copy_only=False)
            yield pack([first, node[row], (size[row] << 32) + place, signatures(tokens, size)[row]], bits)

    def given(a, b, n=None, place=None):
        for at in range(0, len(a), 100_000):
            some = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(a[some]), pa.int64()) if c is None else pa.array(c[some]) for c in (a, b, n, place)], ["a", "b", "n", "place"]
            )

    def meet(arrow_batches):
        # rows of tokens with few sets so far wait; those of others go on
        waiting: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        limit: dict[int, int] = {}
        many: dict[int, np.ndarray] = {}

        def settle(block: int):
            every = np.concatenate(waiting[block], axis=1)
            every = every[:, np.argsort(every[0], kind="stable")]
            at = np.flatnonzero(np.append(True, every[0, 1:] != every[0, :-1]))
            count = np.diff(np.append(at, every.shape[1]))
            large = count > PAIRED
            if block in many:
                large |= np.isin(every[0, at], many[block])
            many[block] = np.union1d(many.get(block, every[0, :0]), every[0, at[large]])
            out = np.repeat(large, count)
            token, node, sized, _ = every[:, out]
            yield from given(token, node, sized >> 32, sized & 0xFFFFFFFF)
            waiting[block] = [every[:, ~out]]
            size[block] = waiting[block][0].shape[1]
            limit[block] = max(MOST_WAITING, 2 * size[block])

        for batch in arrow_batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.frombuffer(raw.as_py(), dtype=np.int64).reshape(4, -1)
                waiting.setdefault(block, []).append(rows)
                size[block] = size.get(block, 0) + rows.shape[1]
                if size[block] > limit.get(block, MOST_WAITING):
                    yield from settle(block)
        for block in [*waiting]:
            yield from settle(block)
            token, node, sized, sign = waiting.pop(block)[0]
            for a, b in _paired(token, node, sized >> 32, sized & 0xFFFFFFFF, sign.view(np.uint64), percent):
                yield from given(a, b)

    sent = sets.select("node", "tokens").mapInArrow(send, "block long, rows binary")
    return sent.repartition(1 << bits, "block").mapInArrow(meet, "a long, b long, n long, place long")


def set_components(sets: DataFrame, first_of, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes of ``sets`` (node, tokens: whole sets, not empty)
    that link with another one. Alike sets share one of their first tokens
    (``first_of``, see ``near``). Sets of a token that few have are compared pair by
    pair, where sizes and signatures allow a link. Those of a token that many have meet
    one of them, in each of some turns another, and what stays outside its main
    component meets all of the token in blocks."""
    met = scratch.keep(near(sets, first_of, percent, sets.count() // SETS_OF_BLOCK), "near")
    pairs = met.where("n IS NULL").select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")).distinct()
    edges = alike(pairs, sets, percent, scratch)
    scratch.release()
    known = components(edges, scratch)
    rows = met.where("n IS NOT NULL").select(F.col("a").alias("grp"), F.col("b").alias("node"), "n", "place")
    if rows.isEmpty():
        return known
    joined = lambda: rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    for turn in range(TURNS):
        now = scratch.keep(joined(), "now")
        pairs = scratch.keep(hub_pairs(now, percent, turn), "pairs")
        more = alike(pairs, sets, percent, scratch)
        known = known if more.isEmpty() else merged(known, more, scratch)
        scratch.drop(now, pairs, more)
    scratch.release()
    now = scratch.keep(reaching(joined(), percent), "parts")
    more = rest_pairs(now, sets.select("node", "tokens", F.lit(None).cast("binary").alias("first")), percent, scratch)
    scratch.drop(now, met)
    return known if more.isEmpty() else merged(known, more, scratch)
