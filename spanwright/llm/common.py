"""Shared plumbing: tables in the cluster's shared folder, Arrow batching and vectorised word hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanwright.plans.materialise import settled, shared_folder

__all__ = ["Scratch", "hashed_words", "mix", "pieces", "release", "settled", "shared_folder", "sliding_min", "utf8", "windows"]

#: ASCII white space of the word contract, [\x20\x09-\x0D].
WORD_BREAKS = "\t\n\x0b\x0c\r "
#: Java pattern of one word.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that one vectorised step handles; only a single longer text exceeds it.
STEP_BYTES = 2 << 20


class Scratch:
    """Parquet tables in the shared folder, read with column pruning and deleted by close()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/spanwright-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.root}/{name}"
        df.write.parquet(at)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        self._delete(self.root)
        release(self.spark)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold about ``limit`` bytes, or one longer text."""
    sizes = np.diff(utf8(batch.column(text))[1])
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one array and its offsets from 0; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    for k, base in enumerate((_BASE, _INVERSE)):
        while len(have := _powers[k]) < n:
            _powers[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public-domain splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, each text's first word (one more at the end), and the words' byte ranges."""
    n = len(data)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = word & (first[:n] | ~np.concatenate([[False], word[:-1]])) if n else word
    ends = np.zeros(n + 1, bool)
    if n:
        ends[1:] = word & (first[1:] | np.concatenate([~word[1:], [True]]))
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, stops


def windows(hashes: np.ndarray, length: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each run of ``length`` successive hashes, by doubling; runs across texts are the caller's to mask."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    out, done, block, size = None, 0, hashes, 1
    count = len(hashes) - length + 1
    while True:
        if length & size:
            part = block[done : done + count]
            out = part.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        if size * 2 > length:
            return mix(out)
        block = block[:-size] * np.uint64(pow(base, size, 1 << 64)) + block[size:]
        size *= 2


def sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    """The least of each ``length`` successive values."""
    size = 1
    while size * 2 <= length:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (length - size)], values[length - size :]) if length > size else values
