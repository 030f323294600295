"""Row plumbing shared by the operators: column picking, Arrow batches, checkpoints."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.storage import settle, shared_folder  # noqa: F401

#: Bytes of text worked on at once inside a task, unless a single text is longer.
SLICE_BYTES = 4 << 20


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The input with columns _c0, _c1, ..., and which of those are the named ones (the first of equal names)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"input has no column {missing}; it has {df.columns}")
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), [f"_c{df.columns.index(n)}" for n in names]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched by exact name; the first wins among columns of equal name.

    Selecting by position keeps names that differ only in case, or that occur twice, from clashing.
    """
    plain, places = positional(df, *names)
    return plain.select(*[F.col(c).alias(n) for c, n in zip(places, names, strict=True)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives memory that isn't in use back to the system: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow whose workers keep no memory after a task."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(trimmed, schema)


def parts_of(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `limit` bytes of text, or of one row; text is the number of the text column."""
    for b in batches:
        for i, j in slices(buffers_of(b.column(text))[0], limit):
            yield b.slice(i, j - i)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_of_id(doc_id) % 4 == 2


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; a null is an empty text."""
    return pc.fill_null(column, "").to_pylist()


def raw_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; a null is an empty text."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and the UTF-8 bytes of a string column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks_of(column: pa.Array, change: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What stands between ASCII white space: the distinct chunks, the number of each chunk's among them, and how many each text has.

    `change` may put other bytes in the place of the chunks' bytes and of where each begins (and the last ends).
    """
    offsets, data = buffers_of(column)
    data = np.insert(data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0], 32)  # a blank after each text
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    opens = ~blank
    opens[1:] &= blank[:-1]
    kept = data[~blank]
    starts = np.append(np.nonzero(opens[~blank])[0], len(kept)).astype(np.int64)
    if change:
        kept, starts = change(kept, starts)
    coded = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(kept)).dictionary_encode()
    counts = np.concatenate([[0], np.cumsum(opens, dtype=np.int64)])[offsets - offsets[0] + np.arange(len(offsets))]
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(counts)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `limit` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j
