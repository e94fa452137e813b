"""SimHash fingerprints and near-duplicate groups, exact for the given radius.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``words`` words joined by a
space (a shorter text is one shingle, a text without words has fingerprint zero), XXH64 with seed 42
of each shingle, repeats included; a bit is 1 if set in over half of them.

Links: two fingerprints at ``radius`` differing bits or fewer. Documents with one fingerprint are
represented by their smallest id, so copies cost one row. If the 64 bits are cut into
``radius + match`` blocks, linked fingerprints agree in ``match`` of them at least; each choice of
blocks is a table of buckets, and every link lies in some bucket. ``match`` grows with the number of
distinct fingerprints, which keeps buckets small and loses no link. A bucket above ``HOT`` rows is refined:
the bits that its rows need not share are cut into ``radius + 1`` blocks, of which linked fingerprints agree
in one at least, and each block makes a finer bucket, again and again until none is hot. Fingerprints are
distinct, so this ends; a hot bucket costs ``radius + 1`` rows a row and round, never a square.

Comparison is bit-sliced: 64 candidates lie in 64 vertical bit planes of a machine word; for a
query, each plane is inverted or not and added to carry-save bitwise counters, which updates 64
distances at once; a block of comparisons whose candidates all exceed the radius is abandoned. What
leaves a task is a spanning forest of the links it found, never all pairs of a group.

Components are found by alternating large and small stars, each round's edges a written table.

Nulls and empty texts have fingerprint zero and are linked like any other. Repeated rows give
repeated rows. An empty table gives an empty result. A null id is kept with its fingerprint and the
component of the others, null if there is none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, drop, id_and_text, release, slices, written_bytes

SEED = 42
#: Rows of a bucket at most.
HOT = 8192
#: Average rows of a bucket at which the next finer set of tables is taken.
BUCKET = 256
#: Rows that a task holds at once, besides a group that is larger.
HELD = 1 << 16
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
#: Bytes of a written table up to which it is broadcast.
BROADCAST_BYTES = 16 << 20
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, words: int = 4) -> np.ndarray:
    """The unsigned hashes of a text's shingles in order, repeats included; none of a text without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of a text with these hashes."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    return fingerprint_of(shingle_hashes(text, words))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            prints = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints.view(np.int64))], schema=FINGERPRINTS)

    return run


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the bit-sliced counts are above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def near_words(planes: np.ndarray, prints: np.ndarray, queries: np.ndarray, tiles: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of tiles (of 64 rows): the numbers of the pairs not abandoned and, for their 64 queries, words whose bit r tells that row r of the candidate tile is within the radius."""
    left = np.arange(len(queries))
    q, zero = prints.reshape(-1, 64)[queries], np.uint64(0)
    shape = q.shape
    counters = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint64)
    for b in range(0, 64, 2):
        x = planes[b][tiles][:, None] ^ (zero - (q >> np.uint64(b) & np.uint64(1)))
        y = planes[b + 1][tiles][:, None] ^ (zero - (q >> np.uint64(b + 1) & np.uint64(1)))
        if counters:
            both = counters[0] ^ x
            carry = (counters[0] & x) | (both & y)
            counters[0] = both ^ y
            for k in range(1, len(counters)):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        else:
            over |= x | y
        if b % 8 == 6:
            if counters:
                over |= _exceeds(counters, radius)
            alive = (over != ALL).any(axis=1)
            if (n := int(alive.sum())) < 0.75 * len(left):
                left, q, tiles, over, counters = left[alive], q[alive], tiles[alive], over[alive], [c[alive] for c in counters]
                if not n:
                    break
    return left, ~over


class Forest:
    """Links of numbered rows as a forest that grows; each union is reported once."""

    def __init__(self, n: int):
        self.root, self.made = np.arange(n), []

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.root, high, low)
            hooked = np.unique(high)
            self.made.append(np.stack([hooked, self.root[hooked]]))
            while (further := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = further


def links(prints: np.ndarray, groups: np.ndarray, radius: int, slab: int = 512) -> np.ndarray:
    """A spanning forest, as pairs of row numbers, of the links between rows of one group (rows of a group lie together)."""
    n = len(prints)
    rows = -(-n // 64) * 64
    padded = np.zeros(rows, np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # tile, row, bit
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").copy().view("<u8").reshape(64, -1)
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    ends = np.concatenate([begins[1:], [n]])
    several = ends - begins > 1
    first, last = begins[several] // 64, (ends[several] - 1) // 64
    pairs = [np.stack([first, first]), np.stack([last, last]), np.stack([first, last])]
    for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
        pairs.append(np.stack(np.triu_indices(b - a + 1)) + a)
    both = np.concatenate(pairs, axis=1)
    tiles = len(padded) // 64
    packed = np.unique(both[0] * tiles + both[1])
    queries, candidates = packed // tiles, packed % tiles
    forest = Forest(n)
    for k in range(0, len(queries), slab):
        left, words = near_words(planes, padded, queries[k : k + slab], candidates[k : k + slab], radius)
        p, r = np.nonzero(words)
        if not len(p):
            continue
        found, c = np.nonzero(np.unpackbits(words[p, r].reshape(-1, 1).view(np.uint8), axis=1, bitorder="little"))
        i, j = queries[k + left[p[found]]] * 64 + r[found], candidates[k + left[p[found]]] * 64 + c
        keep = (i < j) & (j < n)
        forest.link(i[keep], j[keep])
    return np.concatenate(forest.made, axis=1) if forest.made else np.empty((2, 0), np.int64)


def _linker(radius: int):
    def edges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        reps = table.column("rep").to_numpy()
        bucket = table.column("bucket").to_numpy()
        change = np.concatenate([[0], np.cumsum(bucket[1:] != bucket[:-1])])
        a, b = links(table.column("fp").to_numpy().view(np.uint64), change, radius)
        return batch_of(EDGES, reps[a], reps[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < HELD:
                continue
            bucket = batch.column("bucket").to_numpy()
            same = bucket == bucket[-1]
            begin = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if begin:  # the last group may go on in the next batch
                yield edges([*held[:-1], batch.slice(0, begin)])
                held, rows = [batch.slice(begin)], batch.num_rows - begin
        if held:
            yield edges(held)

    return run


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n runs, nearly even, of these bits."""
    at = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(at, at[1:], strict=False)]


def tables(distinct: int, radius: int) -> list[int]:
    """The tables for so many distinct fingerprints: for each, the mask of the bits that a bucket's rows share."""
    for match in range(1, 9):
        n = radius + match
        if distinct <= BUCKET << (64 * match // n) or match == 8:
            break
    return [sum(c) for c in combinations(_blocks(list(range(64)), n), match)]


def finer(mask: int, radius: int) -> list[int]:
    """The tables that refine a table; none if its rows differ in so few bits that all are linked."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in _blocks(free, radius + 1)] if len(free) > radius else []


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_forest(prints: DataFrame, radius: int = 4) -> DataFrame:
    """prints: fp and rep, one row per distinct fp. Returns pairs (a, b) of rep that connect what is linked, through one or more links."""
    number = count()
    masks = {next(number): m for m in tables(prints.count(), radius)}

    def dealt(rows: DataFrame, chosen: Column) -> DataFrame:
        """A row per table: its number, and the bucket by the bits that the table's mask leaves. Tables that share a hash share a bucket, which costs comparisons only."""
        rows = rows.select("fp", "rep", F.explode(chosen).alias("t"))
        return rows.select("fp", "rep", F.col("t.number").alias("number"), F.xxhash64("t.number", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("bucket"))

    def listed(found: dict[int, int]) -> Column:
        return F.array(*[F.struct(F.lit(k).cast("long").alias("number"), F.lit(_signed(m)).cast("long").alias("mask")) for k, m in found.items()])

    rows, done = dealt(prints, listed(masks)), None
    while True:
        hot = cut(rows.groupBy("bucket").count().where(F.col("count") > HOT).select("bucket"), "hot-buckets")
        if hot.isEmpty():
            break
        near = F.broadcast(hot) if written_bytes(hot) <= BROADCAST_BYTES else hot
        cold, left = rows.join(near, "bucket", "left_anti"), cut(rows.join(near, "bucket", "left_semi"), "hot-rows")
        parts = {k: {next(number): m for m in finer(masks[k], radius)} for k in sorted(r["number"] for r in left.select("number").distinct().collect())}
        final = [k for k, found in parts.items() if not found]
        cold = cold.unionByName(left.where(F.col("number").isin(final))).select("bucket", "fp", "rep") if final else cold.select("bucket", "fp", "rep")
        done = cold if done is None else done.unionByName(cold)
        refined = {k: found for k, found in parts.items() if found}
        if not refined:
            rows = left.where(F.lit(False))
            continue
        masks = {n: m for found in refined.values() for n, m in found.items()}
        by_number = F.create_map(*[c for k, found in refined.items() for c in (F.lit(k).cast("long"), listed(found))])
        rows = dealt(left.where(F.col("number").isin(list(refined))), by_number[F.col("number")])
    rows = rows.select("bucket", "fp", "rep")
    placed = rows if done is None else done.unionByName(rows)
    return placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_linker(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node of the edges (a, b)."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(edges)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id that it reaches over links) of every document."""
    prints = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = components(link_forest(distinct.where("rep is not null"), radius))
    named = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
