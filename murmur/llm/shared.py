"""Helpers of the corpus operators: written stages, text buffers for numpy, word and window identities."""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_MASK = (1 << 64) - 1
_BLOCK = 1 << 20
#: Bytes of a row group in stored tables.
ROW_GROUP_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster in spark.checkpoint.dir.

    Only a local master with the setting unset gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, so a lost executor repeats no earlier stage."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    # small row groups: a writer holds one in memory
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array and the n + 1 row offsets; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, most: int):
    """Row ranges (first, end) whose texts sum to about `most` bytes; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end
        first = end


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(z)


def mixed(z: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


BYTE_CODES = _splitmix(256, 7)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "down" if inverse else "up"
    if len(_powers.get(key, ())) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True  # fixed: the separators of a word


def word_bounds(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes other than the six white-space bytes."""
    inside = ~_SPACE[flat]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    heads = edges[edges < len(flat)]
    starts[heads] = inside[heads]
    tails = edges[edges > 0] - 1
    ends[tails] = inside[tails]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(offsets, begin, "right") - 1


def word_hashes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: polynomial prefix sums, taken in blocks that never cut a word."""
    out, i, n = np.empty(len(begin), np.uint64), 0, len(begin)
    while i < n:
        low = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, low + _BLOCK, "right")))
        size = int(end[j - 1]) - low
        with np.errstate(over="ignore"):
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(BYTE_CODES[flat[low : low + size]] * _power(size, False)[:size], out=sums[1:])
            a, b = begin[i:j] - low, end[i:j] - low
            out[i:j] = (sums[b] - sums[a]) * _power(size, True)[np.minimum(a, size - 1)] + (b - a).astype(np.uint64)
        i = j
    return mixed(out)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive entries (n - k + 1 of them; none when n < k)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[:n].copy()
        for j in range(1, k):
            total *= np.uint64(_BASE)
            total += hashes[j : j + n]
    return mixed(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        if len(values) <= step:
            return values[:0]
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)
