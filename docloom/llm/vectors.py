"""Near copies among vectors: product quantisation over inverted lists.

A coarse quantiser of one or more levels deals unit vectors to lists; within a
list, the codes of their residuals in subspaces and table look-ups give the
distance of a query to each reconstructed member. The distance to a member itself
differs from that by at most the member's own error, which is stored, so the
look-ups drop no link; what is left is compared in double precision. A query
visits every list whose border is near enough, however many there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.session import Scratch, prepare

THRESHOLD = 0.95
#: Vectors of a list, centroids of a level, codes of a subspace and subspaces.
LIST, BRANCH, CODES, SUBSPACES = 1024, 256, 256, 8
#: Rows and bytes of the sample that the codebooks are fitted on.
SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20
#: Standard deviations of what a link's difference does across a border.
SPREAD = 2.5
#: Rows of either side of one task, cells of a distance table, slack for 32-bit rounding.
BLOCK, CELLS, SLACK = 2048, 1 << 20, 1e-4
_PLACED = "list long, node long, own boolean, core boolean, mult long, err float, code binary, vec binary"
_HITS = "node long, links long, root long"


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from k rows drawn with a fixed seed."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(0).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        order, count = np.argsort(at, kind="stable"), np.bincount(at, minlength=k)
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(count) - count, len(x) - 1))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    return centres


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, also of very large or small ones."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


@dataclass
class Quantiser:
    """Codebooks of the levels (each on the residuals of those above) and of the
    subspaces, and how near a list's border is for a visit. At most
    (levels * BRANCH + CODES) * dimension numbers."""

    levels: list[np.ndarray]
    books: list[np.ndarray]
    cuts: list[np.ndarray]
    border: float

    def places(self, x: np.ndarray):
        """row, list, whether it is the row's own, and residual there of every list
        that a row visits. A neighbour across the border of two centroids moves the
        row by no more than ``border`` along the line that joins them."""
        row, path, own, rest = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool), x
        for centres in self.levels:
            far = (rest**2).sum(1)[:, None] - 2 * rest @ centres.T + (centres**2).sum(1)
            best = far.argmin(axis=1)
            apart = _apart(centres)[best]
            near = far - far[np.arange(len(far)), best][:, None] <= 2 * self.border * apart + SLACK
            near[np.arange(len(near)), best] = True
            i, c = np.nonzero(near)
            row, path, own, rest = row[i], path[i] * len(centres) + c, own[i] & (c == best[i]), rest[i] - centres[c]
        return row, path, own, rest

    def centre(self, path: int) -> np.ndarray:
        total = np.zeros(self.levels[0].shape[1], dtype=np.float32)
        for centres in reversed(self.levels):
            path, c = divmod(path, len(centres))
            total += centres[c]
        return total

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and their distances to what the codes stand for."""
        codes, far = np.zeros((len(rest), len(self.books)), dtype=np.uint8), np.zeros(len(rest))
        for j, (book, cut) in enumerate(zip(self.books, self.cuts)):
            part = rest[:, cut]
            codes[:, j] = nearest(part, book)
            far += ((part - book[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(far).astype(np.float32)

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries (residuals) to coded members."""
        out = np.zeros((len(rest), len(codes)), dtype=np.float32)
        for j, (book, cut) in enumerate(zip(self.books, self.cuts)):
            part = rest[:, cut]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out += np.take(table, codes[:, j], axis=1)
        return out


def _apart(centres: np.ndarray) -> np.ndarray:
    size = (centres**2).sum(1)
    return np.sqrt(np.maximum(size[:, None] + size - 2 * centres @ centres.T, 0))


def fit(sample: np.ndarray, rows: int, threshold: float, list_rows: int = LIST) -> Quantiser:
    """Codebooks for ``rows`` vectors, from a sample of them (unit rows).

    Lists hold some ``list_rows`` vectors: more vectors make more lists, by more
    levels and not by larger codebooks. A link's difference is at most
    sqrt(2 - 2 * threshold) long; of that, 1 / sqrt(dimensions) is one standard
    deviation along any one line, with as many dimensions as the data really fill.
    ``SPREAD`` of these, or the whole length, is the border."""
    x = sample.astype(np.float32)
    lists = max(1, rows // list_rows)
    depth = max(1, math.ceil(math.log(lists) / math.log(BRANCH) - 1e-9))
    branch = max(1, math.ceil(lists ** (1 / depth) - 1e-9))
    levels, rest = [], x
    for _ in range(depth):
        levels.append(kmeans(rest, branch))
        rest = rest - levels[-1][nearest(rest, levels[-1])]
    cuts = [c for c in np.array_split(np.arange(x.shape[1]), SUBSPACES) if len(c)]
    books = [kmeans(np.ascontiguousarray(rest[:, c]), CODES) for c in cuts]
    spread = np.cov(x, rowvar=False).reshape(x.shape[1], -1) if len(x) > 1 else np.zeros((1, 1))
    squares = (spread**2).sum()
    filled = max(1.0, np.trace(spread) ** 2 / squares) if squares > 0 else 1.0
    length = math.sqrt(2 - 2 * threshold)
    return Quantiser(levels, books, cuts, length * min(1.0, SPREAD / math.sqrt(filled)))


def usable(col: str) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, one not zero."""
    v = F.col(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    edges = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, edges, pa.py_buffer(rows)])


def placed(nodes: DataFrame, sent, threshold: float) -> DataFrame:
    """A row for each list that a vector (embedding, node, mult) visits: its own,
    with its code, its error and whether it is in the list's core, and others that
    come after it. Vectors of a core are within half a link's angle of the list's
    centre, so they all link with each other."""
    half = math.cos(math.acos(threshold) / 2) + 1e-6

    def run(arrow_batches):
        model: Quantiser = sent.value
        for batch in arrow_batches:
            raw = _matrix(batch.column(0))
            if not len(raw):
                continue
            x = unit(raw).astype(np.float32)
            row, path, own, rest = model.places(x)
            home = np.zeros(len(x), dtype=np.int64)
            home[row[own]] = path[own]
            keep = own | (path > home[row])
            row, path, own, rest = row[keep], path[keep], own[keep], rest[keep]
            code, err = np.zeros((len(row), len(model.books)), dtype=np.uint8), np.zeros(len(row), dtype=np.float32)
            code[own], err[own] = model.encode(rest[own])
            core = np.zeros(len(row), dtype=bool)
            mine = np.flatnonzero(own)
            centre = x[row[mine]] - rest[mine]  # what the levels stand for
            size = np.sqrt((centre**2).sum(1))
            core[mine] = (x[row[mine]] * centre).sum(1) >= half * size
            core[mine[size == 0]] = False
            at = pa.array(row)
            columns = [pa.array(path), batch.column(1).take(at), pa.array(own), pa.array(core), batch.column(2).take(at), pa.array(err), _binary(code)]
            yield pa.RecordBatch.from_arrays([*columns, _binary(raw[row])], [c.split()[0] for c in _PLACED.split(", ")])

    return nodes.select("embedding", "node", "mult").mapInArrow(run, _PLACED)


def dealt(places: DataFrame, block: int = BLOCK) -> DataFrame:
    """``places`` with the tasks (list, i, j) that a row is in, as a member (side 0),
    a query (1) or both (2): each block of a list's members meets each of its
    queries, but core members no core queries."""
    mine, core = F.col("own"), F.col("core")
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = places.groupBy("list").agg(
        blocks(F.count_if(core)).alias("mc"), blocks(F.count_if(mine & ~core)).alias("mn"), blocks(F.count_if(~core)).alias("qa")
    )
    rows = places.join(sizes, "list")
    part = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    mc, mn, qa = F.col("mc"), F.col("mn"), F.col("qa")
    zero, place = F.lit(0), lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    i_core, i_rest, j_rest, j_core = part(mc, 1), mc + part(mn, 1), part(qa, 2), qa + part(mc, 2)
    query = lambda low, high, j, but=None: F.transform(
        upto(low, high) if but is None else F.filter(upto(low, high), lambda i: i != but), lambda i: place(i, j, 1)
    )
    of_core = F.concat(F.transform(upto(zero, qa), lambda j: place(i_core, j, 0)), query(mc, mc + mn, j_core))
    others = F.filter(upto(zero, qa + mc), lambda j: j != j_rest)
    of_rest = F.concat(F.array(place(i_rest, j_rest, 2)), F.transform(others, lambda j: place(i_rest, j, 0)), query(zero, mc + mn, j_rest, i_rest))
    at = F.when(core, of_core).when(mine, of_rest).otherwise(query(zero, mc + mn, j_rest))
    rows = rows.select(*places.columns, F.explode(at).alias("at"))
    return rows.select("list", "at.i", "at.j", "at.side", "node", "own", "mult", "err", "code", "vec")


class Forest:
    """Components of a task's own rows, with links added in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            if (x == y).all():
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def linked(sent, threshold: float, kind: str):
    """The links of one task: for each row that has some, their number (with copies)
    and the component's first row; never the pairs."""
    length = math.sqrt(2 - 2 * threshold)

    def run(key, rows):
        model: Quantiser = sent.value
        rows = rows.combine_chunks()
        get = lambda name: rows[name].to_numpy()
        side, node, own, mult, err = (get(c) for c in ("side", "node", "own", "mult", "err"))
        raw = np.frombuffer(b"".join(rows["vec"].to_pylist()), dtype=kind).reshape(len(node), -1)
        x = unit(raw)
        code = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        query, member = np.flatnonzero(side != 0), np.flatnonzero(side != 1)
        rest = x.astype(np.float32) - model.centre(key[0].as_py())
        most = (err[member].astype(np.float64) + length) ** 2 + SLACK
        links, forest = np.zeros(len(node), dtype=np.int64), Forest(len(node))
        step, some = max(1, CELLS // max(1, len(member))), max(1, (16 << 20) // (8 * x.shape[1]))
        for a in range(0, len(query) if len(member) else 0, step):
            q, m = np.nonzero(model.distances(rest[query[a : a + step]], code[member]) <= most)
            q, m = query[a + q], member[m]
            new = ~own[q] | (node[q] < node[m])  # within a list each pair once
            q, m = q[new], m[new]
            for b in range(0, len(q), some):
                i, j = q[b : b + some], m[b : b + some]
                good = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[good], j[good]
                np.add.at(links, i, mult[j])
                np.add.at(links, j, mult[i])
                forest.add(i, j)
        hit = np.flatnonzero(links)
        return pa.table({"node": node[hit], "links": links[hit], "root": node[forest.root[hit]]})

    return run


def links_of(nodes: DataFrame, rows: int, dim: int, kind: str, threshold: float, list_rows: int, scratch: Scratch) -> DataFrame:
    """node, links and root of the linked among ``nodes`` (embedding, node, mult), all
    of one length; several rows for a node."""
    spark = nodes.sparkSession
    wanted = min(SAMPLE, max(1, SAMPLE_BYTES // (4 * dim)))
    share = min(1 << 30, -(-wanted * (1 << 30) // rows))
    drawn = nodes.where(F.pmod(F.xxhash64("embedding", F.lit(1)), F.lit(1 << 30)) < share).select("embedding").toArrow()
    sample = _matrix(drawn["embedding"].combine_chunks())
    if not len(sample):  # a few rows, none of them drawn
        sample = _matrix(nodes.select("embedding").limit(1).toArrow()["embedding"].combine_chunks())
    sample = sample[np.lexsort(sample.T)]  # the same in whatever order rows come
    sent = spark.sparkContext.broadcast(fit(unit(sample), rows, threshold, list_rows))
    places = scratch.keep(placed(nodes, sent, threshold), "places")
    one = places.where("core").groupBy("list").agg(F.sum("mult").alias("all"), F.min("node").alias("root"))
    cores = places.where("core").join(one, "list").select("node", (F.col("all") - F.col("mult")).alias("links"), "root")
    met = dealt(places).groupBy("list", "i", "j").applyInArrow(linked(sent, threshold, kind), _HITS)
    found = scratch.keep(met.unionByName(cores.where("links > 0")), "hits")
    scratch.drop(places)
    return found


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, list_rows: int = LIST, scratch: Scratch | None = None
) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding): vec_id, n_links (rows
    of cosine ``threshold`` or more with it), component_id (the least vec_id that links reach,
    its own included) and kept (vec_id is component_id).

    Equal vectors are one vector with a count throughout. The codebooks are fitted on at
    most ``SAMPLE`` vectors (and ``SAMPLE_BYTES``), drawn by hash; every vector is
    indexed. Pairs are compared in both precisions as the module tells; a pair can be missed only
    where a list is not visited. Vectors that are null, empty, zero, or hold a null or
    a non-finite component link with nothing; so do vectors of different lengths.
    Null ids count as others and are no component's id unless all are null; repeated rows are rows each and link.
    An empty table gives no rows, other columns are ignored. Vectors of each length
    are an index of their own, one after another.
    """
    spark = prepare(vectors.sparkSession)
    scratch = scratch or Scratch(spark, "vectors")
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    value = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding"))
    good = rows.where(usable("embedding"))
    nodes = good.groupBy("embedding").agg(F.count("*").alias("mult"), F.min("vec_id").alias("first_id"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    hits = None
    for dim, n in sorted(map(tuple, nodes.groupBy(F.size("embedding")).count().collect())):
        some = links_of(nodes.where(F.size("embedding") == dim), n, dim, kind, threshold, list_rows, scratch)
        hits = some if hits is None else hits.unionByName(some)
    single = rows.where(~usable("embedding")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if hits is None:
        return single.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    known = components(hits.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    total = hits.groupBy("node").agg(F.sum("links").alias("links")).join(known, "node", "left")
    slim = nodes.select("node", "mult", "first_id").join(total, "node", "left").withColumn("component", F.coalesce("component", "node"))
    slim = scratch.keep(slim, "slim")
    least = slim.where("links > 0").groupBy("component").agg(F.min("first_id").alias("least"))
    ends = slim.join(least, "component", "left").select(
        "node", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first_id").alias("component_id")
    )
    of = nodes.select("node", "embedding").join(ends, "node").drop("node")
    found = good.join(of, "embedding").select("vec_id", "n_links", "component_id")
    return found.unionByName(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
