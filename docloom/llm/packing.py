"""Harmonic packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docloom.llm.tokens import byte_bpe
from docloom.session import prepare

CAPACITY = 2048
END_ID = 1
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long"
)
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class HarmonicBins:
    """The open bins of one worker, one for each class of lengths.

    A document of more than 1 / (k + 1) and at most 1 / k of the capacity is of
    class 1 / k, and k of them are a bin, whatever others a worker has seen. What a
    bin of k leaves, less than 1 / (k + 1), the next documents fill, the last of them
    cut; its other part is a document of its own length's class. So there is one
    bin to fill at a time, and most documents stay whole.
    """

    def __init__(self, capacity: int, first_id: int):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.short: list[tuple] = []  # the bin that is to fill, and what it lacks
        self.lacks = 0
        self.done: list[tuple] = []

    def add(self, doc_id, ids: memoryview) -> None:
        """Packs a document of so many 32-bit ids: whole bins of it first."""
        n, start = len(ids) // 4, 0
        while n - start >= self.capacity:
            self._close([(doc_id, start, ids[4 * start : 4 * (start + self.capacity)], n)])
            start += self.capacity
        if start and start < n:
            ids = memoryview(bytes(ids[4 * start :]))  # the rest alone is held
        elif start:
            return
        piece = (doc_id, start, ids, n)
        if self.lacks:
            filler, piece = self._split(piece, self.lacks)
            self.short.append(filler)
            self.lacks -= len(filler[2]) // 4
            if not self.lacks:
                self._close(self.short)
        if piece is not None:
            k = self.capacity // (len(piece[2]) // 4)
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                del self.open[k]
                self.lacks = self.capacity - sum(len(p[2]) for p in held) // 4
                if self.lacks:
                    self.short = held
                else:
                    self._close(held)

    @staticmethod
    def _split(piece: tuple, size: int) -> tuple[tuple, tuple | None]:
        doc_id, start, ids, n = piece
        if len(ids) <= 4 * size:
            return piece, None
        return (doc_id, start, ids[: 4 * size], n), (doc_id, start + size, ids[4 * size :], n)

    def _close(self, pieces: list[tuple]) -> None:
        at, length = 0, sum(len(p[2]) for p in pieces) // 4
        for doc_id, start, ids, n in pieces:
            self.done.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next_id, at, length))
            at += len(ids) // 4
        self.next_id += 1

    def flush(self) -> None:
        """Packs what is open, one after another: it is cut at the ends of bins, and the
        last one into bins whose lengths are powers of two."""
        left = [*(self.short if self.lacks else []), *(p for k in sorted(self.open) for p in self.open[k])]
        self.open, self.short, self.lacks = {}, [], 0
        whole, rest = divmod(sum(len(p[2]) for p in left) // 4, self.capacity)
        left.reverse()
        for size in [self.capacity] * whole + powers(rest):
            some = []
            while size:
                piece, more = self._split(left.pop(), size)
                some.append(piece)
                size -= len(piece[2]) // 4
                if more is not None:
                    left.append(more)
            self._close(some)

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        columns = zip(*rows) if rows else [[]] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row for each piece of each document (doc_id, text).

    A document is its ids and then ``end_id``; a null or empty text is that id
    alone, a null doc_id stays null, repeated rows are packed each. Whole
    sequences of a document come first, and what is left of it goes into the bin of its
    length's class, with as many others as the class has; only what such a bin
    leaves is filled with cut documents (``HarmonicBins``). Each partition is a
    worker with bins of its own, so nothing is shuffled. Sequences have no padding: a
    worker's last ones have lengths that are powers of two. A worker holds less than a sequence of
    ids for each class, and one document, however long its text; a
    task that runs again gives the same rows. An empty table gives none, other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    files = (
        public_tokenizers.path(f"{tokenizer}.json"),
        public_tokenizers.path(f"{tokenizer}.tiktoken"),
        public_tokenizers.PATTERN,
    )

    def run(arrow_batches):
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 32)
        encoder = byte_bpe(*files)
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in arrow_batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                bins.add(doc_id, memoryview(encoder.ids(text.as_py() or "") + last))
                if len(bins.done) >= 20_000:
                    yield bins.take()
        bins.flush()
        yield bins.take()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
