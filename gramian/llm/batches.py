"""Arrow batches as flat byte arrays, for operators that work on text inside tasks.

All functions treat a null text as an empty one.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrow batches that go to Python tasks have about so many bytes at most (one row at least).
BATCH_BYTES = 8 << 20

#: A slice of a batch holds about so many bytes of text (one row at least).
SLICE_BYTES = 1 << 21

#: The bytes 0x20 and 0x09-0x0D, which end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: glibc keeps freed memory unless it is told otherwise; other systems have no such function.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None

_BASE = 0x9E3779B97F4A7C15  # any large odd number
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Powers of the base are kept up to so many.
_KEPT = 1 << 22
#: Words of more bytes than this are hashed one by one: sums of powers modulo 2**64 are weak for long sequences made for it.
_LONG = 64


def lower_ascii(col):
    """``col`` with A-Z, and no other letters, in lower case."""
    return F.translate(col, UPPER, LOWER)


def bucket(id_col, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus


def small_batches(spark) -> None:
    """Bounds the bytes of Arrow batches in this session, as texts differ much in length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) != str(BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def by_id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, under fixed names, so that other columns can't clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of about ``most`` bytes of text."""
    if not batch.num_rows:
        return
    _, ends = byte_view(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with its texts compressed, for a shuffle that they cross whole; ``unpacked`` gives them back.  Null stays null."""
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(column)

    def run(it):
        codec = pa.Codec("zstd", compression_level=3)
        for batch in it:
            raw = batch.column(at).cast(pa.binary())
            small = [None if not x.is_valid else len(x.as_buffer()).to_bytes(4, "little") + codec.compress(x.as_buffer(), asbytes=True) for x in raw]
            yield batch.set_column(at, column, pa.array(small, pa.binary()))

    return df.mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch, column: str = "text") -> pa.RecordBatch:
    """``batch`` with the texts that ``packed`` has compressed."""
    codec, at = pa.Codec("zstd"), batch.schema.get_field_index(column)
    whole = [None if x is None else codec.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True) for x in batch.column(at).to_pylist()]
    return batch.set_column(at, column, pa.array(whole, pa.binary()).cast(pa.string()))


def release() -> None:
    """Gives memory that a batch has used and left back to the system, as workers are kept from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and the offset of each row and of the end."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and of its inverse."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size, made = 1 << (n - 1).bit_length(), []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=np.uint64))
    if size <= _KEPT:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of all rows, and the number of the first word of each row (and of the end)."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # a row starts or ends here
    edge[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    if n:
        np.logical_not(inside[:-1], out=before[1:])
        np.logical_not(inside[1:], out=after[:-1])
    before |= edge[:n]
    after |= edge[1 : n + 1]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal sequences have equal hashes."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    import xxhash

    h = span_hashes(data, starts, ends)
    for k in np.flatnonzero(ends - starts > _LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return h
