"""Packing of documents into training sequences, balanced by attention cost.

The cost of a piece of n tokens is ``n + quadratic * n * n``. A block of documents gets as few
sequences as hold its tokens. Its documents, in descending length, go to the sequence of lowest
cost that has room for all of them; where none has, to the sequence of lowest cost with any room,
cut there, and the rest waits in its place of the order. Documents above the capacity are cut into
full pieces first.

A block is a bounded run of the rows of one partition, so packing is one pass without a shuffle, in
memory that neither a partition nor a document's group can grow. Every sequence is full but those of
a block's tail: its last tokens go to shorter sequences whose sizes are powers of two from 64 on, so
that a block pads fewer than 64 tokens.

Nulls and empty texts are the end id alone. Ties of length keep the order of rows; which documents share
a block, and so which share a sequence, follows the order and the partitions of the rows read. Repeated
rows are packed as often as they come. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batch_of, id_and_text, slices
from .word_bpe import SLICE, WordBpe

SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Tokens of a block at least; the last document may exceed it.
BLOCK_TOKENS = 1 << 20
#: The smallest sequence of a tail.
SMALLEST = 64


def capacities(total: int, capacity: int) -> np.ndarray:
    """Sizes of the sequences for so many tokens: full ones, then powers of two whose sum is the rest rounded up to SMALLEST."""
    full, rest = divmod(total, capacity)
    rest = -(-rest // SMALLEST) * SMALLEST
    tail = [1 << b for b in range(capacity.bit_length(), -1, -1) if rest >> b & 1] if capacity & (capacity - 1) == 0 and capacity >= SMALLEST else [capacity] * (rest > 0)
    return np.array([capacity] * full + tail, np.int64)


def pack(lengths: np.ndarray, capacity: int = 4096, quadratic: float = 1 / 2048) -> np.ndarray:
    """Rows (document's index, start, length, sequence, offset) that hold each token of each document once."""
    room = capacities(int(lengths.sum()), capacity)
    cost, used, out = np.zeros(len(room)), np.zeros(len(room), np.int64), []
    queue = [(-min(capacity, n - s), i, s, min(capacity, n - s)) for i, n in enumerate(lengths.tolist()) for s in range(0, n, capacity)]
    heapq.heapify(queue)
    while queue:
        _, i, start, n = heapq.heappop(queue)
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin())
        if fits[s] == np.inf:
            s = int(np.where(room > 0, cost, np.inf).argmin())
            left = n - int(room[s])
            n -= left
            heapq.heappush(queue, (-left, i, start + n, left))
        out.append((i, start, n, s, int(used[s])))
        used[s] += n
        room[s] -= n
        cost[s] += n + quadratic * n * n
    return np.array(out, np.int64).reshape(-1, 5)


def _packer(path: str, end_id: int, capacity: int, quadratic: float, block_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def packed(first: int, ids: list[int], coded: list[bytes]) -> tuple[int, pa.RecordBatch]:
        tokens = np.array([len(c) // 4 for c in coded], np.int64)
        rows = pack(tokens, capacity, quadratic)
        parts = [coded[i][4 * s : 4 * (s + n)] for i, s, n in rows[:, :3].tolist()]
        used = int(rows[:, 3].max()) + 1
        out = batch_of(SCHEMA, np.array(ids, object)[rows[:, 0]], rows[:, 1], rows[:, 2], [zlib.crc32(p) for p in parts], tokens[rows[:, 0]], rows[:, 3] + first, rows[:, 4], parts)
        return first + used, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = WordBpe.of(path), TaskContext.get().partitionId() << 32
        ids: list[int] = []
        coded: list[bytes] = []
        held = 0
        for part in slices(batches, most=SLICE):
            for i, c in zip(part.column("id").to_pylist(), coder.encode(part.column("text")), strict=True):
                ids.append(i)
                coded.append(c + end)
                held += len(c) // 4 + 1
                if held >= block_tokens:
                    first, out = packed(first, ids, coded)
                    yield out
                    ids, coded, held = [], [], 0
        if ids:
            yield packed(first, ids, coded)[1]

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, quadratic: float = 1 / 2048, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its token ids; see the module's text. ``sequence_id`` is unique over all partitions."""
    return id_and_text(docs, id_col, text_col, SLICE).mapInArrow(_packer(tokenizer_path, end_id, capacity, quadratic, block_tokens), DDL)
