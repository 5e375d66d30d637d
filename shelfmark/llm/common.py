"""Helpers that several operators share: texts as flat bytes, rolling sums, mixing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass takes at a time; a single longer text goes alone.
CHUNK_BYTES = 1 << 20

U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(df: DataFrame) -> int:
    """A number of partitions for a shuffle of ``df``, as the session sets it."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, which gives the memory it freed back to the system at the end of a task: a Python
    worker waits for further tasks, and otherwise keeps what the largest of them needed."""
    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim is not None:
            trim(0)

    return wrapped


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n+1 offsets into them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]] if len(offsets) else flat, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64); one-to-one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Rolling:
    """Fingerprints of substrings of a byte string, from prefix sums modulo 2**64.

    The fingerprint of ``data[s:e]`` is ``sum(table[data[s+k]] * base**k)``: equal bytes give
    equal values wherever they stand.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.seed = seed
        table = random_words(seed, 256)
        power, self.inverse = self._tables(seed, len(data) + 1)
        self.sums = np.empty(len(data) + 1, dtype=U64)
        self.sums[0] = 0
        np.cumsum(table[data] * power[: len(data)], out=self.sums[1:])

    @classmethod
    def _tables(cls, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls._powers.get(seed)
        if held is None or len(held[0]) < n:
            base = int(random_words(seed + 77, 1)[0]) | 1
            size = max(n, CHUNK_BYTES + 1)
            out = []
            for factor in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, factor, dtype=U64)
                steps[0] = 1
                out.append(np.cumprod(steps))
            held = (out[0], out[1])
            if size <= 4 * CHUNK_BYTES:
                cls._powers[seed] = held
        return held

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, length: int) -> np.ndarray:
        """Fingerprints of all substrings of ``length`` bytes, by start."""
        n = len(self.sums) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]
