"""Helpers of the corpus operators: reading tables, and hashing of words and bytes in Arrow batches.

Hashes are functions of the content only, so equal texts hash alike in every task. A null text counts as empty.
"""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.session import ensure_checkpoint_dir

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one job as Parquet in the shared folder of the session.

    They cut lineage as a checkpoint does, take less disk, and can be dropped as soon as nothing reads them any more. A
    table that is still read must not be dropped: a lost executor reads it again.
    """

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self._spark = spark
        self._folder = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4()}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self._folder}/{name}")
        return self._spark.read.schema(df.schema).parquet(f"{self._folder}/{name}")

    def drop(self, *names: str) -> None:
        context = self._spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clean_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of spans of a sequence in constant time each, from prefix sums modulo 2**64."""

    def __init__(self) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self._base, self._inverse = np.uint64(_BASE), np.uint64(inverse)
        self._power = np.ones(1, np.uint64)
        self._back = np.ones(1, np.uint64)
        self.bytes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def _grow(self, n: int) -> None:
        if len(self._power) < n:
            n = max(n, 1 << 20)
            for name, step in (("_power", self._base), ("_back", self._inverse)):
                values = np.full(n, step, np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums, one longer than ``values``."""
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._power[: len(values)], dtype=np.uint64, out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[begin]) * self._back[begin] + (end - begin).astype(np.uint64))

    def raw_windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of every window of ``width`` values by its start; only its high bits are good, until mixed."""
        n = len(sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = sums[width:] - sums[:n]
        out *= self._back[:n]
        return out

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of every window of ``width`` values, by its start."""
        return mix64(self.raw_windows(sums, width) + np.uint64(width))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its texts in them; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes together; a longer text stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def letters_only() -> list[int]:
    """Breaks of plain words: every ASCII byte but letters and digits."""
    return [b for b in range(128) if not chr(b).isalnum()]


def word_bounds(data: np.ndarray, offsets: np.ndarray, breaks=_SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word, and the n + 1 word offsets of the texts.

    Words are split at the break bytes, by default as ``[^\\x20\\x09-\\x0D]+``.
    """
    lookup = np.zeros(256, bool)
    lookup[list(breaks)] = True
    space = lookup[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edges] = True
    after[edges[edges > 0] - 1] = True
    begin = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return begin, end, np.searchsorted(begin, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def batch_words(rolling: Rolling, texts: pa.Array, lower: bool = False, limit: int = 2_000_000):
    """Word hashes of a string array, with the n + 1 word offsets of the texts."""
    data, offsets = flat(texts)
    hashes, counts = [], []
    for start, stop in pieces(offsets, limit):
        part = data[offsets[start] : offsets[stop]]
        own = offsets[start : stop + 1] - offsets[start]
        begin, end, at = word_bounds(part, own)
        sums = rolling.prefix(rolling.bytes[lower_ascii(part) if lower else part])
        hashes.append(rolling.spans(sums, begin, end))
        counts.append(np.diff(at))
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    per_text = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return words, np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)


def ragged(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the ranges ``begin[i] .. begin[i] + length[i]`` one after another, and the i of each."""
    owner = np.repeat(np.arange(len(length)), length)
    shift = np.cumsum(length) - length
    return np.arange(len(owner)) - shift[owner] + begin[owner], owner


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def held(key: tuple, build):
    """What ``build`` makes, kept under the key for the life of the worker process.

    Task code arrives anew with each task, so its own globals do not last; a module entry of the process does.
    """
    store = vars(sys.modules.setdefault("twinfold_held", types.ModuleType("twinfold_held"))).setdefault("store", {})
    if key not in store:
        store[key] = build()
    return store[key]
