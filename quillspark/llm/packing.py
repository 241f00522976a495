"""Packing of tokenized documents into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Id that ends every document; the vocabulary's special token, whose id follows the ranks.
END_ID, SPECIAL = 0, "<|endoftext|>"


def tokenizer(name: str = "byte_bpe_50k"):
    """str -> ids of the byte-level BPE of that name.

    `<name>.json` (library tokenizers) and `<name>.tiktoken` hold one vocabulary and one pattern; the second library
    gives the same ids several times faster. The file's special token is one id wherever its string stands, as the
    first library has it by default."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda text: encoding.encode(text, allowed_special="all")


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: `windows` lists of indexes of `sizes` with near-equal sums.

    Each size starts as a partition with one filled window. The two partitions of largest imbalance merge, the fullest
    windows of one with the emptiest of the other, until one is left."""
    heap = []
    for i, n in enumerate(sizes):
        heap.append((-n, i, [0] * (windows - 1) + [n], [[] for _ in range(windows - 1)] + [[i]]))
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        _, _, a, xs = heapq.heappop(heap)
        _, _, b, ys = heapq.heappop(heap)
        both = sorted(((m + n, x + y) for m, n, x, y in zip(a, reversed(b), xs, reversed(ys))), key=lambda p: p[0])
        low = both[0][0]
        at += 1
        heapq.heappush(heap, (-(both[-1][0] - low), at, [p[0] for p in both], [p[1] for p in both]))
    return heap[0][3] if heap else [[] for _ in range(windows)]


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within capacity: as few as the sum needs, one more whenever the fullest exceeds it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        out = differencing(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in out) <= capacity:
            return [w for w in out if w]
        windows += 1


class _Packer:
    """Streams documents of one partition into full windows and balanced blocks; holds one block at most."""

    def __init__(self, first: int, capacity: int, windows: int, piece: int, slack: int):
        self.sequence, self.capacity, self.piece = first, capacity, piece
        self.room = self.block = windows * (capacity - slack)
        self.pool: list[tuple] = []
        self.out: list[list] = [[] for _ in range(7)]

    def _put(self, doc_id, start: int, ids: np.ndarray, total: int, offset: int) -> None:
        for column, value in zip(self.out, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset)):
            column.append(value)

    def add(self, doc_id, ids: np.ndarray) -> None:
        total = len(ids)
        full = total - total % self.capacity
        for start in range(0, full, self.capacity):
            self._put(doc_id, start, ids[start : start + self.capacity], total, 0)
            self.sequence += 1
        while full < total:
            # ever finer pieces at the end of a block even out what the others leave
            n = min(self.piece, total - full, max(1, self.room // 8))
            self.pool.append((doc_id, full, ids[full : full + n], total))
            full += n
            self.room -= n
            if not self.room:
                self.close()

    def close(self) -> None:
        for window in balanced([len(p[2]) for p in self.pool], self.capacity) if self.pool else ():
            offset = 0
            for i in window:
                doc_id, start, ids, total = self.pool[i]
                self._put(doc_id, start, ids, total, offset)
                offset += len(ids)
            self.sequence += 1
        self.pool, self.room = [], self.block

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, [[] for _ in range(7)]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)


def pack(docs: DataFrame, capacity: int = 1024, windows: int = 16, piece: int = 128, slack: int = 4, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row for each piece of a document: where it starts, its ids' CRC-32, and its sequence and offset there.

    Takes columns doc_id and text; a null text counts as empty, each document ends with END_ID, so an empty one has
    one id. What fills whole sequences is cut off first; the rest is cut into pieces of at most `piece` ids, gathered
    in blocks of `windows` sequences less `slack` ids each, and each block is balanced by differencing. Documents
    stay in the partition that read them: no shuffle, one block of ids in memory. Sequence ids are the partition's
    number and a counter. Rows with equal or null ids are packed apart. An empty table gives no rows; other columns
    are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, windows, piece, slack)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                packer.add(doc_id, ids)
                if len(packer.out[0]) >= 50_000:
                    yield packer.rows()
        packer.close()
        yield packer.rows()

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)
