"""Vector code compression in integers: each part of a vector becomes the index of its nearest codebook entry.

Components x become floor(SCALE * x); a vector is cut into PARTS equal parts. Parts and entries are padded with zeros to a
power of two and transformed by the integer Walsh-Hadamard transform, whose rows are taken in the order of their sign
changes (sequency). The transform multiplies squared distances by its size exactly, so differences are squared and summed
coefficient by coefficient; the entry that leads after the first coefficients is summed to the end, and every entry whose
sum already exceeds that leaves. What is left at the end is the exact minimum; ties go to the lower index. No floating
point enters after the floor.

Training starts from the first ENTRIES vectors by id and repeats: assign all parts, then replace each entry by the
componentwise floor of its parts' mean. Tasks add up sums and counts of their own rows, so that a round moves one row
per task, part and entry at most; the codebooks (PARTS x ENTRIES entries) pass through the driver and are sent to the tasks.

Defined cases: a vector that is null or holds null or non-finite components is left out; shorter vectors and lengths that
PARTS does not divide are filled with zero components at the end; null ids come last in the starting order, equal ids are
ordered by vector, and equal rows all stay; fewer than ENTRIES vectors give that many entries; no vectors give no rows;
extra columns are kept, those named like a result are replaced. Values whose error or sum leaves 64 bits end the job
with an overflow error; nothing is ever rounded."""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from murmur.llm.shared import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of parts that are compared with the entries at once.
BLOCK = 2048
#: Largest magnitude whose scaled squares sum up in 64 bits at part width w: see `_safe`.
_MOST_SUM = 1 << 62


class Codes(NamedTuple):
    """Rows with `code` (entry of each part) and `error`, and the final entries as array [part, entry, component]."""

    rows: DataFrame
    codebooks: np.ndarray


def walsh(width: int) -> np.ndarray:
    """The Walsh-Hadamard matrix for `width` components padded to a power of two; rows by number of sign changes."""
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < width:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    changes = (matrix[:, 1:] != matrix[:, :-1]).sum(axis=1)
    return matrix[np.argsort(changes, kind="stable")]


def _safe(most: int, size: int) -> bool:
    """Whether scaled squared differences of components up to `most` fit: size coefficients of at most 2 * size * most."""
    return size * (2 * size * most) ** 2 < _MOST_SUM


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part and the squared distance; integers of one kind, exact."""
    turn = walsh(parts.shape[1])
    size, width = len(turn), parts.shape[1]
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int64 if _safe(most, size) else object  # Python's own integers hold any size
    turn = turn[:, :width].astype(kind)  # the columns left out would meet the zeros of the padding
    turned, books = parts.astype(kind) @ turn.T, np.ascontiguousarray((entries.astype(kind) @ turn.T).T)
    best, far = np.empty(len(parts), np.int64), np.empty(len(parts), kind)
    for low in range(0, len(parts), BLOCK):
        best[low : low + BLOCK], far[low : low + BLOCK] = _nearest(turned[low : low + BLOCK], books)
    if kind is object and len(far) and max(far) // size > np.iinfo(np.int64).max:
        raise OverflowError("a squared distance leaves 64 bits")
    return best, (far // size).astype(np.int64)


def _nearest(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum over entries of the summed squares, coefficients in order, entries leaving early."""
    n, size, dense = len(rows), len(books), min(2, len(books))
    sums = np.zeros((n, books.shape[1]), books.dtype)
    for c in range(dense):
        away = rows[:, c, None] - books[c]
        sums += away * away
    # any entry bounds the minimum from above; the one leading so far is likely to bound it closely
    lead = sums.argmin(axis=1)
    rest = rows[:, dense:] - books[dense:, lead].T
    bound = sums[np.arange(n), lead] + (rest * rest).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    left = sums[row, entry]
    for c in range(dense, size):
        away = rows[row, c] - books[c, entry]
        left = left + away * away
        stays = left <= bound[row]
        if c + 1 == size or np.count_nonzero(stays) < 0.8 * len(stays):  # fewer copies of the lists
            row, entry, left = row[stays], entry[stays], left[stays]
    # rows ascend, and inside a row the entries: the first of the smallest sums wins
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.zeros(0, np.int64)
    far = np.minimum.reduceat(left, first) if n else left
    at = np.flatnonzero(left == far[row]) if n else np.zeros(0, np.int64)
    _, winner = np.unique(row[at], return_index=True)
    return entry[at[winner]], far


def integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of every component, rows filled with zeros to `dims`."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    # from 2 ** 52 on a component is a whole number, and the product might leave the doubles' range
    if (np.abs(values) < 2.0**52).all():
        whole = np.floor(values * SCALE).astype(np.int64)  # a product with a power of two is exact
    else:
        raise OverflowError("a component times the scale leaves 64 bits")
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def _by_part(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The integer vectors of a batch as [row, part, component]."""
    return batch.column(batch.schema.get_field_index("whole")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, PARTS, width)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> Codes:
    """Codebooks trained on all usable vectors, and every one of these rows with its code (array of PARTS ints) and error."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.drop("code", "error").where(F.col(vector).isNotNull() & finite)
    packed = kept.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(vector).alias("vector"))
    dims = packed.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-dims // PARTS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = integers(batch.column(2), PARTS * width)
            lists = pa.ListArray.from_arrays(np.arange(len(table) + 1, dtype=np.int32) * (PARTS * width), pa.array(table.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["row", "key", "whole"])

    schema = T.StructType([packed.schema["row"], packed.schema["key"], T.StructField("whole", T.ArrayType(T.LongType()))])
    stored = written(packed.mapInArrow(whole, schema), "vector-parts")
    start = stored.orderBy(F.col("key").asc_nulls_last(), "whole").limit(ENTRIES).select("whole").collect()
    books = np.array([r["whole"] for r in start], np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2)
    if len(start):
        for _ in range(rounds):
            books = _moved(stored, books)
    return Codes(_coded(stored, books), books)


def _moved(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every used entry becomes the floor of the mean of its parts."""
    width, entries = books.shape[2], books.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            parts = _by_part(batch, width)
            for p in range(PARTS):
                at, _ = nearest(parts[:, p], books[p])
                np.add.at(sums[p], at, parts[:, p])
                counts[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(counts)
        lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * width, pa.array(sums[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part * entries + entry), pa.array(counts[part, entry]), lists], names=["entry", "n", "sums"])

    found = stored.select("whole").mapInArrow(add, "entry bigint, n bigint, sums array<bigint>")
    # the places of a sum are added up one by one: sums of any width need no wide row of aggregates
    total = found.select("entry", "n", F.posexplode("sums").alias("place", "sum")).groupBy("entry", "place").agg(
        F.sum("sum").alias("sum"), F.sum("n").alias("n")
    )
    out = books.copy()
    for r in total.collect():  # PARTS x ENTRIES x width rows at most
        out[r["entry"] // entries, r["entry"] % entries, r["place"]] = r["sum"] // r["n"]
    return out


def _coded(stored: DataFrame, books: np.ndarray) -> DataFrame:
    width = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _by_part(batch, width)
            codes, errors = np.empty((len(parts), PARTS), np.int32), [0] * len(parts)
            for p in range(PARTS):
                codes[:, p], far = nearest(parts[:, p], books[p])
                errors = [e + f for e, f in zip(errors, far.tolist())]  # checked when they become 64-bit
            lists = pa.ListArray.from_arrays(np.arange(len(parts) + 1, dtype=np.int32) * PARTS, pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(errors, pa.int64())], names=["row", "code", "error"])

    schema = T.StructType([stored.schema["row"], T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return stored.select("row", "whole").mapInArrow(assign, schema).select("row.*", "code", "error")


def rebuilt(codes: DataFrame, codebooks: np.ndarray, code: str = "code", vector: str = "rebuilt") -> DataFrame:
    """Adds the vector that a code stands for: the entries' components over SCALE."""
    parts = [F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in book]) for book in codebooks]
    return codes.withColumn(vector, F.concat(*[F.get(book, F.col(code)[p]) for p, book in enumerate(parts)]))


def summed_by(rows: DataFrame, group: str, value: str, total: str, salts: int = 16) -> DataFrame:
    """Adds the sum of `value` over the rows of equal `group` (nulls together).

    Sums come from partial aggregates; rows meet them under a salt, so that a group of any share is dealt to many tasks.
    Helper columns start with `_sum_`."""
    sums = rows.groupBy(F.col(group).alias("_sum_of")).agg(F.sum(value).alias("_sum_total"))
    sums = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_sum_salt"))
    salted = rows.drop(total).withColumn("_sum_own", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    met = salted.join(sums, F.col(group).eqNullSafe(F.col("_sum_of")) & (F.col("_sum_own") == F.col("_sum_salt")))
    return met.withColumnRenamed("_sum_total", total).drop("_sum_of", "_sum_own", "_sum_salt")


def shown(codebooks: np.ndarray) -> str:
    """All components as decimals by part, entry and place, joined by commas."""
    return ",".join(map(str, codebooks.reshape(-1).tolist()))


def fingerprint(codebooks: np.ndarray) -> str:
    return hashlib.sha256(shown(codebooks).encode()).hexdigest()
