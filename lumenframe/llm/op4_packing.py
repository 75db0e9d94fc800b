"""Packing documents into training windows by multiway differencing.

A document's ids are cut into full windows and pieces of at most ``grain`` ids.  Full
windows stand alone.  The other pieces go in blocks of ``block`` documents to
Karmarkar-Karp differencing: each piece starts as a partition of k windows, and the two
partitions with the largest spread are merged, largest window with smallest, until one
is left.  If its largest window exceeds the capacity, k rises by one and the block is
dealt anew.

A block never spans tasks, so nothing is shuffled and a lost task is just run again.
Only the last block of a task can be small.

Defined results: a null or empty text has no ids but the end id; repeated rows are packed
each on their own; a null id stays null; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_groups
from .token_ids import word_ids

CAPACITY, GRAIN, BLOCK = 2048, 512, 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(lengths: list[int], k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each piece, by multiway differencing."""
    n = len(lengths)
    sums: list[np.ndarray | None] = [None] * n
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-length, i) for i, length in enumerate(lengths)]
    heapq.heapify(heap)

    def taken(i: int) -> np.ndarray:
        if i >= n:
            s, sums[i] = sums[i], None
            return s
        s = np.zeros(k, np.int64)
        s[0] = lengths[i]
        return s

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        s = taken(a) + taken(b)[::-1]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        s -= s[-1]
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(s[0]), len(sums)))
        sums.append(s)
    window = np.zeros(n, np.int64)
    slots: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)} if merges else {}
    for m in range(len(merges) - 1, -1, -1):
        a, b, order = merges[m]
        own = np.empty(k, np.int64)
        own[order] = slots.pop(n + m)
        for child, its in ((a, own), (b, own[::-1])):
            if child < n:
                window[child] = its[0]
            else:
                slots[child] = its
    return window


def windows(lengths: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece and the number of windows, none above ``capacity``."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        window = difference(lengths, k)
        if np.bincount(window, lengths, minlength=k).max(initial=0) <= capacity:
            return window, k
        k += 1


class _Block:
    """Pieces that wait for windows, and the rows of those that have them."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.waiting: list[tuple] = []
        self.rows: list[tuple] = []

    def place(self) -> None:
        if not self.waiting:
            return
        window, k = windows([p[2] for p in self.waiting], self.capacity)
        filled = [0] * k
        for piece, w in zip(self.waiting, window.tolist()):
            self.rows.append((*piece, self.next + w, filled[w]))
            filled[w] += piece[2]
        used = sorted({int(w) for w in window})
        if len(used) < k:  # fewer pieces than windows: leave no gap in the ids
            to = {self.next + w: self.next + i for i, w in enumerate(used)}
            self.rows = [(*r[:5], to.get(r[5], r[5]), r[6]) for r in self.rows]
        self.next += len(used)
        self.waiting = []

    def batch(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = list(zip(*self.rows)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grain: int = GRAIN, block: int = BLOCK, end_id: int = 1) -> DataFrame:
    """One row per piece: where it lies in its document and in its window.

    ``sequence_id`` is the task's number times 2^40 plus a count from 0; ``start`` and
    ``offset`` count ids before the piece in its document and in its window.
    """
    end = end_id.to_bytes(4, "little")

    def task(batches):
        encode = word_ids(tokenizer).encode
        out, docs_in_block = _Block(capacity, TaskContext.get().partitionId() << 40), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, group in text_groups(batch.column(1)):
                for i, data in enumerate(encode(group), first):
                    data += end
                    view, n, at = memoryview(data), len(data) // 4, 0
                    while n - at >= capacity:
                        out.rows.append((ids[i], at, capacity, zlib.crc32(view[4 * at : 4 * (at + capacity)]), n, out.next, 0))
                        out.next += 1
                        at += capacity
                    while at < n:
                        size = min(grain, n - at)
                        out.waiting.append((ids[i], at, size, zlib.crc32(view[4 * at : 4 * (at + size)]), n))
                        at += size
                    docs_in_block += 1
                    if docs_in_block >= block:
                        out.place()
                        docs_in_block = 0
                if len(out.rows) >= 10_000:
                    yield out.batch()
        out.place()
        yield out.batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text")).mapInArrow(task, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
