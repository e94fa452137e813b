"""Near copies by SimHash candidates and exact similarity: one document of each group stays.

Shingles: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, ``words`` words joined by a space (a shorter text
is one shingle, a text without words has none), as a set of XXH64 hashes. Links: two sets whose Jaccard
similarity is ``LEAST`` (four fifths) or more, compared in whole numbers, on the whole sets.

Candidates come in three steps, each confirmed. The first takes the SimHash fingerprints of the same shingles
(``simhash``: bit-sliced comparison within ``RADIUS`` bits). A fingerprint of 64 bits loses links at any radius
that separates anything, so two more steps find the rest, from the sets themselves, and none is lost: with all
hashes in one order, two linked sets share a hash among the first fifth (and one) of each. Rare hashes come
first, which keeps the candidates few; which hashes are common is estimated on a sample, and a poor estimate
costs work, never a link. The second step takes each set with the smallest id at a shared hash; the last
compares the others only where the links found have not already joined their groups, so a large group of near
copies does not yield all its pairs. Equal sets are represented by their smallest id. Only heads are kept and
moved. Candidates are first held against a histogram of each set's hashes: two sets share at most the sum of the
smaller counts, which rules out most pairs that share a passage. Whole sets are made again for the others alone.

Nulls and empty texts are copies of each other. Repeated rows give repeated rows, and rows of one id are
one document, also rows of a null id: they stay if one of them has no other in its group. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, drop, id_and_text, release, slices, written_bytes
from .simhash import BROADCAST_BYTES, components, fingerprint_of, link_forest, shingle_hashes

#: Bits in which fingerprints of the first step's candidates differ at most.
RADIUS = 4
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
#: Documents of the sample for common hashes, in expectation, and the most hashes that are called common.
SAMPLE_ROWS, COMMON = 10_000, 200_000
#: A count of this in a histogram stands for any larger one.
FULL = 255
LONGS = pa.list_(pa.int64())
HEADS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("fp", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("head", LONGS)])
WHOLE = pa.schema([("rep", pa.int64()), ("digest", pa.binary()), ("hashes", LONGS)])


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, words).view(np.int64))


def _hashes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, words))], names=["hash"])

    return run


def _heads(words: int, hashes: np.ndarray, places: np.ndarray):
    """hashes: the common ones, sorted; places: where each stands in the order, from 1."""
    over, under = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, most=1 << 20):
            made: list[list] = [[], [], [], [], []]
            for text in part.column("text").to_pylist():
                every = shingle_hashes(text, words)
                found = np.unique(every.view(np.int64))
                n, fp = len(found), fingerprint_of(every)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                counts = np.minimum(np.bincount(found.view(np.uint64) >> np.uint64(56), minlength=256), FULL).astype(np.uint8).tobytes()
                if n and len(hashes):
                    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    found = found[np.argsort(np.where(hashes[at] == found, places[at], 0), kind="stable")]
                head = n - -(-over * n // under) + 1 if n else 0
                for column, value in zip(made, (digest, fp - (fp >> 63 << 64), n, counts, found[:head]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, type=f.type) for c, f in zip(made, list(HEADS)[1:], strict=True)]], schema=HEADS)

    return run


def _whole(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, most=1 << 20):
            found = [shingles(t, words) for t in part.column("text").to_pylist()]
            yield batch_of(WHOLE, part.column("id"), [xxhash.xxh3_128_digest(h.tobytes()) for h in found], found)

    return run


def common_hashes(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several documents of a sample have, sorted, and their places by rising frequency. COMMON rows come to the driver at most."""
    rows = texts.count()
    share = max(1, (1 << 20) * SAMPLE_ROWS // rows) if rows else 1
    part = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).mapInArrow(_hashes(words), "hash long")
    found = part.groupBy("hash").count().where("count > 1").orderBy(F.desc("count"), "hash").limit(COMMON).select("hash").toArrow()
    hashes = found.column("hash").to_numpy()
    by_hash = np.argsort(hashes)
    return hashes[by_hash], len(hashes) - by_hash


def _possible(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of n and m hashes can be linked if the first hash they share is at these places of theirs."""
    over, under = LEAST
    return (over + under) * F.least(n - at, m - to) >= over * (n + m)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose histograms allow a link; a full count on both sides allows it."""
    release()
    over, under = LEAST
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("of_a", "of_b"))
        total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        least = np.minimum(one, two)
        may = ((over + under) * least.sum(axis=1, dtype=np.int64) >= over * total) | (least == FULL).any(axis=1)
        yield batch.select(["a", "b"]).filter(pa.array(may))


def _confirmed(pairs: DataFrame, histograms: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    over, under = LEAST
    one, two = (histograms.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"of_{c}")) for c in "ab")
    sized = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").where(under * F.least("n_a", "n_b") >= over * F.greatest("n_a", "n_b"))
    pairs = cut(sized.mapInArrow(_alike, "a long, b long").distinct(), "candidate-pairs")
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "candidates")
    few = F.broadcast(asked) if written_bytes(asked) <= BROADCAST_BYTES else asked
    whole = texts.join(few, texts["id"] == asked["rep"], "left_semi").mapInArrow(_whole(words), "rep long, digest binary, hashes array<long>")
    whole = cut(whole.groupBy("rep", "digest").agg(F.first("hashes").alias("hashes")).drop("digest"), "candidate-sets")
    one, two = (whole.select(F.col("rep").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
    same, total = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    found = cut(pairs.join(one, "a").join(two, "b").where((over + under) * same >= over * total).select("a", "b").distinct(), "links")
    drop(pairs, asked, whole)
    return found


def linked(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest doc_id that it reaches over links) of every document."""
    texts = id_and_text(docs, id_col, text_col)
    rows = cut(texts.mapInArrow(_heads(words, *common_hashes(texts, words)), "doc_id long, digest binary, fp long, n long, counts binary, head array<long>"), "shingle-heads")
    reps = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("rep")), "distinct-sets")
    sets = rows.join(reps, [rows["digest"] == reps["digest"], rows["doc_id"] == reps["rep"]], "left_semi").withColumnRenamed("doc_id", "rep")

    histograms = cut(sets.where("n > 0").select("rep", "fp", "n", "counts"), "histograms")
    prints = histograms.select("fp", "rep")
    distinct = cut(prints.groupBy("fp").agg(F.min("rep").alias("rep")), "distinct-fingerprints")
    same_print = prints.join(distinct.withColumnRenamed("rep", "first"), "fp").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    close = link_forest(distinct, RADIUS).unionByName(same_print).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    heads = sets.select("rep", "n", F.posexplode("head").alias("at", "hash"))
    first = heads.groupBy("hash").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").drop("last")
    shared = cut(heads.join(first, "hash"), "shared-hashes")
    stars = shared.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    found = _confirmed(close.unionByName(stars), histograms, texts, words)

    joined = cut(components(found), "joined")
    left = shared.join(joined, shared["rep"] == joined["node"], "left").select("hash", "rep", "n", "at", F.coalesce("component", "rep").alias("of"))
    left = cut(left, "shared-hashes-joined")
    drop(shared, joined)
    one, two = left.alias("one"), left.alias("two")
    near = _possible(F.col("one.n"), F.col("one.at"), F.col("two.n"), F.col("two.at"))
    rest = one.join(two, (F.col("one.hash") == F.col("two.hash")) & (F.col("one.rep") < F.col("two.rep")) & (F.col("one.of") != F.col("two.of")) & near)
    others = _confirmed(rest.select(F.col("one.rep").alias("a"), F.col("two.rep").alias("b")), histograms, texts, words)
    links = components(found.unionByName(others))
    drop(left, distinct, histograms, found, others)
    named = reps.join(links, reps["rep"] == links["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the document whose id names it, with the columns of docs; of rows with that id, all."""
    kept = linked(docs, words, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_kept"]), "left_semi")
