"""Token ids as files of independent zstandard frames with a trailing seek table.

A shard file is a run of zstandard frames, each with its own content checksum, whose joined contents
are the shard's ids as little-endian unsigned 32-bit integers; then a skippable frame that holds the
document index (number of documents, ids, token counts, and a byte each that marks a null id); then a skippable frame with the seek table of the public
"zstd seekable format": compressed size, size and XXH64 checksum (low 32 bits) of each frame, the
number of frames, a descriptor and a magic number. Any zstandard decoder reads the whole file as
plain ids; a reader of some documents decompresses only the frames that hold them.

Documents lie in ascending id order over all shards, ties in order of the text's hash, then of the rows
read, so that even rows repeated without bound are dealt over shards. The number of shards follows the
bytes of text. Nulls and empty texts are the end id alone; a null id comes first. Repeated rows are written as often as they
come. An empty table gives no shard or empty ones. Other columns are not read.

Each task writes a file named by itself and its attempt and reports it; only reported files count,
so a lost executor or a second attempt leaves nothing that is read.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, id_and_text, pieces, slices
from .word_bpe import SLICE, WordBpe

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
#: Bytes of ids in a frame.
FRAME_BYTES = 256 << 10
#: Bytes of text of a shard, on average.
SHARD_BYTES = 32 << 20

MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64())])
MANIFEST_DDL = "shard long, file string, n_docs long, n_tokens long, first_id long"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
READ_DDL = "doc_id long, start long, n_tokens long, ids binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it; s3a and s3n count as s3."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://").replace("s3n://", "s3://"))


class ShardWriter:
    """Writes frames as ids come; memory holds a frame and the index (13 bytes a document)."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.buffer, self.held, self.table = [], 0, []
        self.doc_ids, self.counts, self.nulls = array("q"), array("q"), bytearray()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            data, k = b"".join(self.buffer), 0
            for k in range(0, len(data) - self.frame_bytes + 1, self.frame_bytes):
                self._frame(data[k : k + self.frame_bytes])
            rest = data[k + self.frame_bytes :]
            self.buffer, self.held = [rest], len(rest)

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.buffer))
        index = self.zstd.compress(struct.pack("<Q", len(self.counts)) + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + bytes(self.nulls))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.table.append((len(index) + 8, 0, 0))
        seek = b"".join(struct.pack("<III", *t) for t in self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class ShardReader:
    """Reads the seek table and the document index; decompresses a frame when a document of it is asked for."""

    def __init__(self, source, size: int):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or descriptor != WITH_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.sizes, self.checks = table[:-1, 1], table[:-1, 2]
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        index = self.zstd.decompress(self._at(int(self.begin[n - 1]) + 8, int(table[-1, 0]) - 8))
        docs = struct.unpack_from("<Q", index)[0]
        self.doc_ids, self.counts = np.frombuffer(index, "<i8", docs, 8), np.frombuffer(index, "<u4", docs, 8 + 8 * docs).astype(np.int64)
        self.nulls = np.frombuffer(index, np.bool_, docs, 8 + 12 * docs)
        self.starts = np.cumsum(self.counts) - self.counts
        self.decompressed = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, begin: int, n: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            data = self.zstd.decompress(self._at(int(self.begin[k]), int(self.begin[k + 1] - self.begin[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[k] or len(data) != self.sizes[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.decompressed += 1
            self._last = (k, data)
        return self._last[1]

    def ids(self, row: int) -> bytes:
        """The ids of the document of that row of the index."""
        a, b = 4 * int(self.starts[row]), 4 * int(self.starts[row] + self.counts[row])
        parts, k = [], int(np.searchsorted(self.first, a, side="right")) - 1
        while a < b:
            data, begin = self.frame(k), int(self.first[k])
            parts.append(data[a - begin : b - begin])
            a, k = begin + len(data), k + 1
        return b"".join(parts)


def _writer(path: str, end_id: int, out_dir: str, frame_bytes: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, coder, name, docs, tokens, first = TaskContext.get(), WordBpe.of(path), None, 0, 0, None
        files, base = opened(out_dir)
        for part in slices(batches, most=SLICE):
            if name is None:
                files.create_dir(base, recursive=True)
                name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
                out = files.open_output_stream(f"{base}/{name}", compression=None)
                shard = ShardWriter(out, frame_bytes)
                first = part.column("id")[0].as_py()
            for i, c in zip(part.column("id").to_pylist(), coder.encode(part.column("text")), strict=True):
                shard.add(i, c + end)
                docs, tokens = docs + 1, tokens + len(c) // 4 + 1
        if name is not None:
            shard.close()
            out.close()
            yield batch_of(MANIFEST, [task.partitionId()], [name], [docs], [tokens], [first])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 1, shards: int | None = None, frame_bytes: int = FRAME_BYTES, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the shards to out_dir and returns the manifest, a row per shard in order, with ``start``, the ids in the shards before it.

    The manifest has as many rows as the range exchange has partitions: one per SHARD_BYTES of text, unless shards says otherwise.
    """
    rows = id_and_text(docs, id_col, text_col, SLICE)
    n = shards or pieces(rows, SHARD_BYTES)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(n, "id", "tie", "row").sortWithinPartitions("id", "tie", "row").select("id", "text")
    found = sorted(placed.mapInArrow(_writer(tokenizer_path, end_id, out_dir, frame_bytes), MANIFEST_DDL).collect(), key=lambda r: r.shard)
    before = [0, *accumulate(r.n_tokens for r in found)]
    return [{"shard": k, "file": r.file, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": b} for k, (r, b) in enumerate(zip(found, before, strict=False))]


def _reader(out_dir: str, wanted: frozenset[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(out_dir)
        for name, start in ((n, s) for b in batches for n, s in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True)):
            path = f"{base}/{name}"
            with files.open_input_file(path) as source:
                reader = ShardReader(source, source.size())
                rows: Iterable[int] = range(len(reader.counts))
                if wanted is not None:
                    rows = np.flatnonzero(np.isin(reader.doc_ids, list(wanted)) & ~reader.nulls).tolist()
                held: list[tuple] = []
                size = 0
                for r in rows:
                    ids = reader.ids(r)
                    held.append((None if reader.nulls[r] else int(reader.doc_ids[r]), start + int(reader.starts[r]), len(ids) // 4, ids))
                    size += len(ids)
                    if size > 8 << 20:
                        yield batch_of(READ, *zip(*held, strict=True))
                        held, size = [], 0
                if held:
                    yield batch_of(READ, *zip(*held, strict=True))

    return run


def read_token_files(spark: SparkSession, out_dir: str, manifest: list[dict], doc_ids: Iterable[int] | None = None) -> DataFrame:
    """The documents of the shards (of doc_ids only, if given: a list for the driver's memory) with start and ids; a task per shard."""
    if not manifest:
        return spark.createDataFrame([], READ_DDL)
    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long").repartition(len(manifest), "file")
    return files.mapInArrow(_reader(out_dir, None if doc_ids is None else frozenset(doc_ids)), READ_DDL)


def with_crc32(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_token_files returns."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
