"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Components are turned into ``floor(256 * x)``, so scores are exact integers and ties are real. The
candidates lie in shards; the task of a shard builds a ball tree over its vectors (a node holds a
centre and a radius; leaves hold about ``LEAF`` vectors) and answers a block of queries. A query takes
leaves in descending order of the upper bound ``q . centre + |q| * radius`` of their inner products,
first the best one, then runs that grow fourfold, until no bound reaches its current kth score; the
queries of a tile that take a leaf in one run are multiplied with it at once. Leaves answer exactly,
so results are those of a full comparison.

The kth score is shared. It starts at the kth best over a sample of the candidates, a lower bound of
the final one. A task carries it from tree to tree. A block of queries meets one shard in ``FIRST`` of the
candidates first; the kth scores merged over its tasks start the second round, over the others.

Queries come in blocks of about ``BLOCK_BYTES``, one at a time: a block is sent, answered, its results
written and its memory given up before the next. Each block is a pass over the candidates.

Vectors that are null, or hold a null or a component that is not finite, take no part, neither as
queries nor as candidates; nor do rows with a null id. Vectors of different length are compared as if
the shorter went on with zeros; an empty vector scores 0 with all. Repeated ids are rows of their own;
a query leaves out every candidate with its id. Ties of score go to the smaller id. Where products can
leave 64 bits, they are computed in whole numbers of any size without a tree and rank by their true
value; the score that is returned is then the largest or smallest long. Fewer candidates than k give
fewer rows, an empty table none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, cut, drop, release, small_batches

LEAF, SHARD_ROWS, BLOCK_BYTES, SEEDS, FIRST, TILE = 64, 16384, 16 << 20, 4096, 16, 256
#: query: the query's number in its block; over: 1, or 0 and 2 (and bytes that order as the values do) for scores below and above a long.
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("over", pa.binary())])
LEAST, NONE = -(1 << 63), (1 << 63) - 1
#: The order key of a score that is a long.
PLAIN = b"\x01"


def taking_part(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and vec (array of double, as it came) of the rows that take part."""
    values = F.col(vec_col).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & values.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), values.alias("vec"))


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of whole numbers floor(256 * x), filled with zeros to the longest or to width; Python's integers where a long is too small."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(sizes.max(initial=0)))
    if np.abs(flat).max(initial=0) < 1 << 53:
        numbers = np.floor(flat * 256).astype(np.int64)
    else:  # 256 times a double beyond 2**53 is a whole number, which need not be a double
        numbers = np.array([int(np.floor(x * 256)) if abs(x) < 1 << 53 else int(x) * 256 for x in flat.tolist()], object)
    out = np.zeros((len(sizes), width), numbers.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = numbers
    return out


def largest(a: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(a.max()), -int(a.min())) if a.size else 0


def products(a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    """Exact inner products of rows; top: a bound of their absolute values, below 2**63."""
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best candidates met so far of each query, by score and then the smaller id; NONE as an id where there are fewer."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, k), LEAST, np.int64), np.full((queries, k), NONE, np.int64)
        self.filled = np.zeros((queries, k), bool)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """scores and allowed: [rows, ids]."""
        filled = np.concatenate([self.filled[rows], allowed], axis=1)
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, allowed.shape)], axis=1)
        order = np.lexsort((ids, ~scores, ~filled), axis=-1)[:, : self.k]
        self.filled[rows], self.scores[rows], self.ids[rows] = (np.take_along_axis(x, order, axis=1) for x in (filled, scores, ids))

    def kth(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The kth score of queries; the smallest long where one has fewer."""
        return np.where(self.filled[rows, -1], self.scores[rows, -1], LEAST)

    def rows(self, query_ids: np.ndarray) -> list[np.ndarray]:
        q, n = np.nonzero(self.filled)
        return [q, query_ids[q], self.ids[q, n], self.scores[q, n], np.full(len(q), PLAIN, object)]


class BallTree:
    """Nodes in arrays: centre, radius, children or the range of rows of a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        exact = vectors.astype(np.float64)
        self.nodes: list[tuple[int, int]] = []  # rows [begin, end)
        self.parents: list[int] = []
        stack = [(0, len(ids), -1)]
        centres, radii, inner = [], [], set()
        while stack:
            begin, end, parent = stack.pop()
            rows = exact[order[begin:end]]
            centre = rows.mean(axis=0)
            apart = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append((begin, end))
            self.parents.append(parent)
            centres.append(centre)
            radii.append(float(apart.max()))
            if end - begin > leaf and radii[-1] > 0:
                inner.add(me)
                far = rows[int(apart.argmax())]  # split between the row farthest from the centre and the one farthest from it
                other = rows[int(((rows - far) ** 2).sum(axis=1).argmax())]
                half = np.argsort(rows @ (other - far), kind="stable")
                order[begin:end] = order[begin:end][half]
                middle = begin + (end - begin) // 2
                stack += [(begin, middle, me), (middle, end, me)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.leaves = np.array([k for k in range(len(self.nodes)) if k not in inner], np.int64)
        self.largest, self.visited = largest(vectors), 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: Best, kth: np.ndarray) -> None:
        """Adds this tree's candidates to best; kth: lower bounds of the kth scores, which rise in place."""
        top = self.largest * largest(queries) * max(queries.shape[1], 1)
        for a in range(0, len(queries), TILE):
            self._tile(np.arange(a, min(a + TILE, len(queries))), query_ids, queries, best, kth, top)

    def _tile(self, tile: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best, kth: np.ndarray, top: int) -> None:
        exact = queries[tile].astype(np.float64)
        norms = np.sqrt((exact**2).sum(axis=1))[:, None]
        bounds = exact @ self.centres.T + norms * self.radii[None, :]
        bounds += 1e-6 + 1e-9 * norms * (self.radii + np.sqrt((self.centres**2).sum(axis=1)))[None, :]  # for rounding
        for node, parent in enumerate(self.parents):  # a node's bound is its ancestors' at most
            if parent >= 0:
                np.minimum(bounds[:, node], bounds[:, parent], out=bounds[:, node])
        bounds = bounds[:, self.leaves]
        order = np.argsort(-bounds, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(self.leaves))[None, :], axis=1)
        begin, end = 0, 1
        while (waiting := (place >= begin) & (bounds >= kth[tile][:, None])).any():
            for n in np.flatnonzero((waiting & (place < end)).any(axis=0)).tolist():
                rows = np.flatnonzero(waiting[:, n] & (place[:, n] < end) & (bounds[:, n] >= kth[tile]))
                a, b = self.nodes[self.leaves[n]]
                self.visited += len(rows) * (b - a)
                got = products(queries[tile[rows]], self.vectors[a:b], top)
                allowed = (got >= kth[tile[rows]][:, None]) & (self.ids[a:b][None, :] != query_ids[tile[rows]][:, None])
                hit = np.flatnonzero(allowed.any(axis=1))
                at = tile[rows[hit]]
                best.add(at, self.ids[a:b], got[hit], allowed[hit])
                kth[at] = np.maximum(kth[at], best.kth(at))
            begin, end = end, end * 4


def _order_key(score: int) -> bytes:
    """Bytes that order as scores beyond a long do, among each other and against PLAIN."""
    size = (abs(score).bit_length() + 7) // 8
    magnitude = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + magnitude if score > 0 else b"\x00" + bytes(255 - b for b in magnitude)


def large(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[list]:
    """The k best rows of each query in whole numbers of any size, query by query."""
    columns = vectors.astype(object).T
    for n, (q, row) in enumerate(zip(query_ids.tolist(), queries.astype(object), strict=True)):
        scores = row @ columns if len(row) else np.zeros(len(ids), object)
        kept = sorted((-int(s), i) for s, i in zip(scores, ids.tolist(), strict=True) if i != q)[:k]
        if kept:
            yield [[n] * len(kept), [q] * len(kept), [i for _, i in kept], [max(LEAST, min(NONE, -s)) for s, _ in kept], [PLAIN if LEAST <= -s <= NONE else _order_key(-s) for s, _ in kept]]


def _padded(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _searcher(sent, k: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        query_ids, queries, kth = sent.value
        kth, best = kth.copy(), Best(len(queries), k)

        def answered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            ids, vectors = table.column("id").to_numpy(), matrix(table.column("vec"), queries.shape[1])
            own = _padded(queries, vectors.shape[1])
            if largest(vectors) * largest(queries) * max(vectors.shape[1], 1) >= 1 << 62:
                for rows in large(query_ids, own, ids, vectors, k):
                    yield batch_of(FOUND, *rows)
            else:
                BallTree(ids, vectors.astype(np.int64)).search(query_ids, own.astype(np.int64), best, kth)

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for a in range(0, batch.num_rows, shard_rows):
                held.append(batch.slice(a, shard_rows))
                count += held[-1].num_rows
                if count >= shard_rows:
                    yield from answered(held)
                    held, count = [], 0
        if held:
            yield from answered(held)
        if best.filled.any():
            yield batch_of(FOUND, *best.rows(query_ids))

    return run


def _seeds(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The kth score of each query over a sample; the smallest long where the sample has fewer or products can leave 64 bits."""
    best = Best(len(queries), k)
    width = max(queries.shape[1], vectors.shape[1], 1)
    top = largest(queries) * largest(vectors) * width
    if len(ids) and top < 1 << 62:
        queries, vectors = _padded(queries, width).astype(np.int64), _padded(vectors, width).astype(np.int64)
        for a in range(0, len(queries), 512):
            rows = np.arange(a, min(a + 512, len(queries)))
            for b in range(0, len(ids), 512):
                best.add(rows, ids[b : b + 512], products(queries[rows], vectors[b : b + 512], top), ids[b : b + 512][None, :] != query_ids[rows][:, None])
    return best.kth()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("over"), F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query; is_query is over the column ``id``."""
    spark = df.sparkSession
    small_batches(spark)
    vectors = cut(taking_part(df, id_col, vec_col), "vectors")
    queries = cut(vectors.where(is_query), "queries")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total = vectors.count()
    picked = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < max(1, (SEEDS << 20) // total)
    sample = vectors.where(picked).limit(4 * SEEDS).toArrow()
    sample_ids, sample_rows = sample.column("id").to_numpy(), matrix(sample.column("vec"))
    blocks = -(-size["n"] * 8 * max(size["width"], 1) // block_bytes)
    early = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(FIRST)) == 0
    rounds = [vectors.where(early), vectors.where(~early)] if total > FIRST * shard_rows else [vectors]
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        ids, rows = block.column("id").to_numpy(), matrix(block.column("vec"))
        kth = _seeds(ids, rows, sample_ids, sample_rows, k)
        merged = None
        for n, candidates in enumerate(rounds):
            sent = spark.sparkContext.broadcast((ids, rows, kth))
            some = candidates.mapInArrow(_searcher(sent, k, shard_rows), "query long, query_id long, vec_id long, score long, over binary")
            before, merged = merged, cut(_ranked(some if merged is None else some.unionByName(merged.drop("rank")), k), "best-of-block")
            drop(before)
            sent.destroy()
            if n + 1 < len(rounds):
                so_far = merged.where((F.col("rank") == k) & (F.col("over") == F.lit(PLAIN))).select("query", "score").toArrow()
                at = so_far.column("query").to_numpy()
                kth[at] = np.maximum(kth[at], so_far.column("score").to_numpy())
        found = merged if found is None else found.unionByName(merged)
    drop(vectors, queries)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
