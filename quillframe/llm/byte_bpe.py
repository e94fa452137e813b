"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Texts are cut into pre-tokens by a pattern and each pre-token is encoded separately. Documents are
taken in chunks of about ``CHUNK_BYTES`` of text. A chunk's pre-tokens become a dictionary of its
distinct words and, document by document, positions in that dictionary. Only distinct words move:
each chunk sends its words, dealt by hash into buckets, one packed row per bucket; the task of a
bucket encodes each distinct word of all chunks once and sends the ids back; a chunk's dictionary
then has ids, which replace the positions.

The chunks are written to the shared folder before they are used twice, so both uses see the same
dictionary, whatever is recomputed. Buckets grow with the root of the bytes of text, so that the words of one fit the
``most`` words that its task remembers; beyond that it forgets and encodes some word again. The join
of chunks with their ids has a partition per ``JOIN_BYTES`` of chunks. Numbers travel compressed.

Decoding joins the ids with the token-byte table by id. The vocabulary bounds that table, so the join
is a map-side one: each task holds the table as an Arrow column and takes its rows in the order of the
ids; the values that result are the texts, end to end.

Null counts as empty: no ids, and the SHA-256 of nothing. Repeated rows give repeated rows, an empty
table an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, id_and_text, pieces, release, slices, written_bytes

CHUNK_BYTES = 48 << 20
#: Buckets are the root of the bytes of text in this unit: their words and the cells of chunks and buckets grow alike.
BUCKET_UNIT = 1 << 20
#: Bytes of written chunks for each task of the join.
JOIN_BYTES = 16 << 20
CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("words", pa.list_(pa.binary())), ("numbers", pa.list_(pa.binary()))])
CHUNKS_DDL = "chunk long, doc_ids binary, nulls binary, counts binary, places binary, words array<binary>, numbers array<binary>"
CODED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])
CODED_DDL = "chunk long, bucket int, sizes binary, ids binary"
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
ENCODED_DDL = "doc_id long, n_tokens long, ids binary"
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}


def coder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=6).compress(planes.tobytes())


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


#: Places below this are a byte of their own; above, a byte tells a place's size and two of its bits.
DIRECT, FIRST_BIT, LAST_BIT = 188, 8, 24


#: Places that are coded at once.
SEGMENT = 1 << 20


def _places_out(places: np.ndarray) -> bytes:
    """Places, frequent ones small, segment by segment."""
    done = [_segment_out(places[k : k + SEGMENT].astype(np.int64)) for k in range(0, len(places), SEGMENT)]
    return np.array([len(done), *map(len, done)], "<u4").tobytes() + b"".join(done)


def _places_in(data: bytes) -> np.ndarray:
    count_of = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", count_of, 4).tolist()
    out, at = [np.empty(0, "<u4")], 4 + 4 * count_of
    for n in sizes:
        out.append(_segment_in(data[at : at + n]).astype("<u4"))
        at += n
    return np.concatenate(out)


def _segment_out(places: np.ndarray) -> bytes:
    """A byte a place, and what it leaves open by size class; each part compressed. A first byte tells the form."""
    n = places - DIRECT + (1 << FIRST_BIT)
    if len(places) and int(n.max()) >= 1 << (LAST_BIT + 1):
        return b"\0" + _squeezed(places)
    large = places >= DIRECT
    bits = np.frexp(n[large].astype(np.float64))[1] - 1
    klass = places.astype(np.uint8)
    klass[large] = DIRECT + (bits - FIRST_BIT) * 4 + (n[large] >> (bits - 2) & 3)
    parts = [klass.tobytes()]
    for b in range(FIRST_BIT, LAST_BIT + 1):
        low = n[large][bits == b] & ((1 << (b - 2)) - 1)
        parts += [(low >> k).astype(np.uint8).tobytes() for k in range(0, b - 2, 8)]
    packer = zstandard.ZstdCompressor(level=3)
    done = [packer.compress(x) for x in parts]
    return b"\1" + np.array([len(places), *map(len, done)], "<u4").tobytes() + b"".join(done)


def _segment_in(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return _numbers(data[1:]).astype(np.int64)
    count_of = 1 + sum(-(-(b - 2) // 8) for b in range(FIRST_BIT, LAST_BIT + 1))
    head = np.frombuffer(data, "<u4", count_of + 1, 1).astype(np.int64)
    ends = np.cumsum(head[1:]) + 1 + 4 * (count_of + 1)
    unpack = zstandard.ZstdDecompressor()
    parts = iter([np.frombuffer(unpack.decompress(data[e - n : e]), np.uint8) for e, n in zip(ends.tolist(), head[1:].tolist(), strict=True)])
    klass = next(parts)
    places = klass.astype(np.int64)
    large = np.flatnonzero(klass >= DIRECT)
    code = places[large] - DIRECT
    bits = code // 4 + FIRST_BIT
    n = np.left_shift(1, bits) | np.left_shift(code % 4, bits - 2)
    for b in range(FIRST_BIT, LAST_BIT + 1):
        here = bits == b
        for k in range(0, b - 2, 8):
            n[here] |= next(parts).astype(np.int64) << k
    places[large] = n - (1 << FIRST_BIT) + DIRECT
    return places


def _packed(words: list[bytes]) -> bytes:
    """Lengths (32 bits each) and bytes of words, after their number; compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words))


def _unpacked(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    begins = [4 + 4 * n, *ends[:-1].tolist()]
    return [data[a:b] for a, b in zip(begins, ends.tolist(), strict=False)]


def _chunker(pattern: str, buckets: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        release()
        find, number = regex.compile(pattern).findall, count(TaskContext.get().partitionId() << 32)

        def chunk(ids: list, counts: list[int], places: list[np.ndarray], seen: dict[str, int]) -> pa.RecordBatch:
            # Frequent words get small places, which compress better.
            places = np.concatenate([*places, np.empty(0, "<u4")])
            often = np.argsort(-np.bincount(places, minlength=len(seen)), kind="stable")
            place = np.empty(len(often), "<u4")
            place[often] = np.arange(len(often))
            words = [w.encode() for w in seen]
            words = [words[k] for k in often.tolist()]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            parts = np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))
            packed = [_packed([words[k] for k in p]) for p in parts]
            numbers = [_squeezed(np.diff(p, prepend=0)) for p in parts]
            nulls = np.array([i is None for i in ids], np.uint8).tobytes()
            row = (next(number), np.array([i or 0 for i in ids], "<i8").tobytes(), nulls, _squeezed(np.array(counts)), _places_out(place[places]), packed, numbers)
            return batch_of(CHUNKS, *([x] for x in row))

        def fresh():
            return [], [], [], defaultdict(count().__next__), 0

        ids, counts, places, seen, held = fresh()
        for part in slices(batches):
            for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                text = (t or b"").decode("utf-8", "replace")
                found = find(text)
                ids.append(i)
                counts.append(len(found))
                places.append(np.fromiter(map(seen.__getitem__, found), "<u4", len(found)))
                held += len(text)
                if held >= chunk_bytes:
                    yield chunk(ids, counts, places, seen)
                    ids, counts, places, seen, held = fresh()
        if ids:
            yield chunk(ids, counts, places, seen)

    return run


def _encoder(path: str, pattern: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path, pattern)._encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                words = _unpacked(batch.column("words")[k].as_py())
                if len(known) > most:
                    known.clear()
                ids = []
                for w in words:
                    got = known.get(w)
                    if got is None:
                        known[w] = got = np.array(encode(w), "<u4").tobytes()
                    ids.append(got)
                yield batch_of(CODED, [batch.column("chunk")[k].as_py()], [batch.column("bucket")[k].as_py()], [_squeezed(np.fromiter(map(len, ids), "<u4", len(ids)))], [_squeezed(np.frombuffer(b"".join(ids), "<u4"))])

    return run


def _joiner():
    def dictionary(numbers: list[bytes], parts: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([np.cumsum(_numbers(numbers[bucket]), dtype=np.int64) for bucket, _, _ in parts])
        sizes = np.concatenate([_numbers(p[1]) for p in parts]).astype(np.int64) // 4
        flat = np.concatenate([_numbers(p[2]) for p in parts])
        size, begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        size[at], begin[at] = sizes, np.cumsum(sizes) - sizes
        return flat, size, begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("doc_ids", "nulls", "counts", "places", "numbers", "parts")}
                flat, size, begin = dictionary(row["numbers"], [(p["bucket"], p["sizes"], p["ids"]) for p in row["parts"]])
                places, counts = _places_in(row["places"]), _numbers(row["counts"])
                doc_ids, nulls = np.frombuffer(row["doc_ids"], "<i8").tolist(), np.frombuffer(row["nulls"], np.uint8).tolist()
                ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                step = 256
                for a in range(0, len(doc_ids), step):
                    b = min(a + step, len(doc_ids))
                    at = places[ends[a] : ends[b]]
                    n = size[at]
                    done = np.concatenate([[0], np.cumsum(n)])
                    place = np.repeat(begin[at] - done[:-1], n)
                    place += np.arange(len(place))
                    data = flat[place].tobytes()
                    cuts = done[ends[a : b + 1] - ends[a]].tolist()
                    ids = [data[4 * x : 4 * y] for x, y in zip(cuts, cuts[1:], strict=False)]
                    yield batch_of(ENCODED, [None if z else i for i, z in zip(doc_ids[a:b], nulls[a:b], strict=True)], [len(x) // 4 for x in ids], ids)

    return run


def encode(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES, most: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row."""
    texts = id_and_text(docs, id_col, text_col)
    if buckets is None:
        buckets = max(8, math.isqrt(pieces(texts, BUCKET_UNIT)))
    chunks = cut(texts.mapInArrow(_chunker(pattern, buckets, chunk_bytes), CHUNKS_DDL), "bpe-chunks")
    joins = max(texts.sparkSession.sparkContext.defaultParallelism, -(-written_bytes(chunks) // JOIN_BYTES))
    sent = chunks.select("chunk", F.posexplode("words").alias("bucket", "words"))
    coded = sent.repartition(buckets, "bucket").mapInArrow(_encoder(path, pattern, most), CODED_DDL)
    parts = coded.repartition(joins, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("parts"))
    joined = chunks.select("chunk", "doc_ids", "nulls", "counts", "places", "numbers").repartition(joins, "chunk").join(parts, "chunk").drop("chunk")
    return joined.mapInArrow(_joiner(), ENCODED_DDL)


def token_bytes(path: str) -> pa.Array:
    """The token-byte table: row n holds the bytes of id n, null where the file has none."""
    table = ranks(path)
    rows: list[bytes | None] = [None] * (max(table.values()) + 1)
    for word, rank in table.items():
        rows[rank] = word
    return pa.array(rows, pa.binary())


def join_bytes(table: pa.Array, ids: list[bytes | None]) -> list[bytes]:
    """The bytes of texts whose ids are little-endian unsigned 32-bit integers; an id that the table lacks is an error."""
    found: list[bytes] = []
    for a in range(0, len(ids), 64):
        part = [x or b"" for x in ids[a : a + 64]]
        taken = table.take(pa.array(np.frombuffer(b"".join(part), "<u4")))
        if taken.null_count:
            raise ValueError("an id that the vocabulary does not have")
        ends = np.frombuffer(taken.buffers()[1], "<i4", len(taken) + 1) if len(taken) else np.zeros(1, "<i4")
        data = taken.buffers()[2].to_pybytes() if len(taken) else b""
        cuts = ends[np.concatenate([[0], np.cumsum([len(x) // 4 for x in part])])].tolist()
        found += [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
    return found


def _digester(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for part in slices(batches, "ids"):
            ids = part.column("ids").to_pylist()
            decoded = [hashlib.sha256(x).hexdigest() for x in join_bytes(table, ids)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded)], schema=DIGESTS)

    return run


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes they decode to."""
    return encoded.mapInArrow(_digester(path), DIGESTS_DDL)


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for part in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(join_bytes(table, part.column("ids").to_pylist()), pa.binary())], ["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded (bytes) of rows with doc_id and ids: a join with the token-byte table, whose size the vocabulary bounds."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, decoded binary")
