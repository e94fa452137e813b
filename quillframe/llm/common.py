"""Shared plumbing: the shared folder, lineage cuts, bounded Arrow batches and worker memories."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one slice of a batch holds at most, unless a single text is longer.
SLICE_BYTES = 4 << 20

#: What the Python worker keeps between tasks, by its owner: one owner at a time.
_KEPT: dict[str, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (local mode) a folder of this machine is used; on a
    cluster an unset folder is an error, since each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillframe-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    own = f"{shared_dir(spark)}/quillframe/{spark.sparkContext.applicationId}"
    system, path = _file_system(spark, own)
    system.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def written_bytes(df: DataFrame) -> int:
    """Bytes of the table that ``cut`` wrote."""
    system, path = _file_system(df.sparkSession, df._written)
    return system.getContentSummary(path).getLength()


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        if df is not None:
            system, path = _file_system(df.sparkSession, df._written)
            system.delete(path, True)


def kept(owner: str, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps for its owner from task to task; what another owner kept is given up first."""
    if owner not in _KEPT:
        release()
        _KEPT[owner] = make()
    return _KEPT[owner]


def release() -> None:
    """Gives up what this Python worker keeps, and returns the memory where the C library can."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def small_batches(spark: SparkSession, most: int = SLICE_BYTES) -> None:
    """Bounds what Spark puts into one Arrow batch for Python: about ``most`` bytes, a longer row alone. A lower setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = SLICE_BYTES) -> DataFrame:
    """Just the two columns that are read, as ``id`` (long) and ``text`` (UTF-8 bytes): other columns, clashing names included, stay out."""
    small_batches(df.sparkSession, batch_bytes)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def packed_row(df: DataFrame, name: str = "row") -> list[Column]:
    """All columns of df as one struct, so that names of an operator's own cannot clash with them; ``*unpacked(df)`` gives them back."""
    return [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)] if df.columns else []


def unpacked(df: DataFrame, name: str = "row", but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of df out of the struct, without those named."""
    return [F.col(name)[c].alias(c) for c in df.columns if c not in but]


def pieces(rows: DataFrame, size: int, bytes_col: str = "text") -> int:
    """The number of tasks that deal the column in parts of about ``size`` bytes; on small tables as many as run at once."""
    total = rows.agg(F.sum(F.octet_length(bytes_col))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // size))


def slices(batches: Iterator[pa.RecordBatch], bytes_col: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of the column at most, a longer single value alone."""
    for batch in batches:
        sizes = batch.column(bytes_col)
        begin, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(sizes).fill_null(0).to_pylist()):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
