"""Language-model scoring from a log-frequency Bloom filter.

1. Tokens are counted over all training texts (hash and count, summed per batch before the exchange).
2. Every history, word and pair of them goes into the filter as (gram, 1) ... (gram, level), level = 1 + floor(log2 count).
   The filter is built in blocks of the gram hash, each sized for its own entries, and broadcast.
3. A gram's level is the last of the consecutive levels 1, 2, ... whose membership probes succeed; it stands for the middle
   of the counts of that level. A text's probability multiplies interpolated bigram estimates
   p(w | h) = WEIGHT * count(h w) / count(h) + (1 - WEIGHT) * (count(w) + 1) / (N + V + 1), an unseen history leaving the
   second part alone. False positives (about 1 in 150 per probe) can only raise a level.

The filter is broadcast up to MOST_FILTER_BYTES; beyond, texts are kept in chunks of some MB, and a chunk sends its distinct grams,
ascending, with the counts that its training rows give them, to the shards (runs of blocks). A shard builds its blocks of the same
filter, probes them and answers with one byte a gram in the same order, so a gram travels once per chunk and never back: the limit
moves the probes, not the scores. (A limit below zero means no filter: exact levels, the model that the tests hold the filter against.
No input reaches that form.) Grams travel packed, as differences in byte planes.
The exact add-one base score takes the counts of the FREQUENT most frequent tokens from a broadcast table of that fixed
size; the other tokens, which by that cannot be hot, meet their counts by shuffle. Tokens are known by 64-bit hashes.

Defined cases: null and empty text have the end token only; without training rows N = V = 0 and all scores are log10(1);
repeated rows are scored (and learned) each; no rows give no rows; only the named columns and the results are returned."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from murmur.llm.shared import flat_bytes, mixed, row_blocks, signed, word_bounds, word_hashes, written

WEIGHT, PROBES, BITS = 0.7, 4, 12
FREQUENT = 500_000
MOST_FILTER_BYTES = 384 << 20
#: Grams that one block of the filter holds on average.
BLOCK_GRAMS = 100_000
_BLOCK, _GATHER, _MODEL_GATHER = 1 << 20, 2_000_000, 4_000_000
#: Text bytes of a chunk, blocks of the filter that make a shard, bytes of grams that ask one shard at a time.
CHUNK_BYTES, SHARD_BLOCKS, ASK_BYTES = 8 << 20, 40, 64 << 20
END, START = np.uint64(0xE0D), np.uint64(0x57A27)  # no word hash has a meaning, so any two numbers do
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks `(first row, n + 1 row offsets, token hashes)`; a row's words, then its end."""
    flat, offsets = flat_bytes(column)
    for first, end in row_blocks(offsets, _BLOCK):
        part, bounds = _LOWER[flat[offsets[first] : offsets[end]]], offsets[first : end + 1] - offsets[first]
        begin, stop, row = word_bounds(part, bounds)
        hashes = word_hashes(part, begin, stop)
        counts = np.bincount(row, minlength=end - first) + 1
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.full(ends[-1], END, np.uint64)
        out[np.arange(len(row)) + row] = hashes  # each earlier row has put one end in between
        yield first, ends, out


def _histories(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    before = np.concatenate([[START], tokens[:-1]]).astype(np.uint64)
    before[ends[:-1]] = START
    return before


def _pair(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(history * np.uint64(0x9E3779B97F4A7C15) + word)


def _alone(word: np.ndarray) -> np.ndarray:
    return mixed(word ^ np.uint64(0x5BF03635))


def _gathered(batches: Iterator[pa.RecordBatch], grams: Callable, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams, ascending, with their counts, of each `most` grams of a task."""
    held, size = [], 0
    for batch in batches:
        for _, ends, tokens in _tokens(batch.column(0)):
            held.append(grams(tokens, ends))
            size += len(held[-1])
            if size >= most:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def _summed(docs: DataFrame, grams: Callable, text: str) -> DataFrame:
    """`(gram, n)` with the counts of each _GATHER grams of a task already summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in _gathered(batches, grams, _GATHER):
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n.astype(np.int32))], names=["gram", "n"])

    return docs.select(text).mapInArrow(run, "gram bigint, n int")


def _packed(values: np.ndarray) -> bytes:
    """Byte planes: the bytes that are alike stand together, so that the exchange can compress them."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _packed_grams(ascending: np.ndarray) -> bytes:
    return _packed(np.diff(ascending, prepend=np.uint64(0)))


def _unpacked_grams(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _model_grams(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the model counts: each word alone, each start, each history with its word."""
    return np.concatenate([_alone(tokens), np.full(len(ends) - 1, _alone(np.array([START]))[0]), _pair(_histories(tokens, ends), tokens)])


def _asked_grams(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What a text asks for: each history with its word, each history, each word."""
    before = _histories(tokens, ends)
    return np.concatenate([_pair(before, tokens), _alone(before), _alone(tokens)])


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 0, 1, then the middle of 2..3, 4..7, ..."""
    return np.where(level == 0, 0.0, (1.5 * 2.0 ** (level.astype(np.float64) - 1) - 0.5))


def _spots(grams: np.ndarray, level: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The bit of each of PROBES hash functions, within a block of `size` bits."""
    with np.errstate(over="ignore"):
        a = mixed(grams + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        b = mixed(a) | np.uint64(1)
        for i in range(PROBES):
            yield ((a + np.uint64(i) * b) >> np.uint64(33)) % size


def _block(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


class LogFrequencyFilter:
    """Blocks of bits; `starts` are their first bits, so that blocks may differ in size."""

    def __init__(self, blocks: list[bytes], first: int = 0, of: int | None = None):
        """All blocks, or those from `first` on of a filter of `of` blocks."""
        self.first, self.of = first, len(blocks) if of is None else of
        sizes = np.array([len(b) * 8 for b in blocks], np.int64)
        self.bits, self.sizes = np.frombuffer(b"".join(blocks), np.uint8), sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    def level(self, grams: np.ndarray) -> np.ndarray:
        """Levels by repeated probes: level n + 1 is asked of those that have level n."""
        out, asked, n = np.zeros(len(grams), np.int64), np.arange(len(grams)), 0
        if not len(self.sizes):
            return out
        block = _block(grams, self.of) - self.first
        while len(asked):
            n += 1
            at = block[asked]
            size = self.sizes[at].astype(np.uint64)
            member = size > 0
            for spot in _spots(grams[asked], np.full(len(asked), n), np.maximum(size, np.uint64(1))):
                bit = np.where(member, self.starts[at] + spot.astype(np.int64), 0)
                member &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool) if len(self.bits) else False
            asked = asked[member]
            out[asked] = n
        return out


def build_block(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of one block from its grams (repeats are summed): BITS bits for each (gram, level)."""
    grams, at = np.unique(grams, return_inverse=True)
    levels = _levels(np.bincount(at, counts))
    size = max(8, -(-int(levels.sum()) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    for n in range(1, int(levels.max(initial=0)) + 1):
        own = grams[levels >= n]
        for spot in _spots(own, np.full(len(own), n), np.uint64(size)):
            bits[spot.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _shards(blocks: int) -> int:
    return min(blocks, max(64, -(-blocks // SHARD_BLOCKS)))


def _first_block(shard: int, blocks: int) -> int:
    return -(-shard * blocks // _shards(blocks))


def _by_shard(grams: np.ndarray, blocks: int) -> Iterator[tuple[int, slice]]:
    """The shards that ascending grams fall into, and where."""
    shard = _block(grams, blocks) * _shards(blocks) // blocks
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    for first, end in zip(starts, [*starts[1:], len(grams)]):
        yield int(shard[first]), slice(first, end)


_MESSAGE = "_chunk bigint, shard int, grams binary, counts binary"


def _messages(chunk: int | None, grams: np.ndarray, counts: np.ndarray, blocks: int) -> pa.RecordBatch:
    """What goes to each shard: ascending grams and what was learned of them (no counts: nothing)."""
    rows = [(chunk, s, _packed_grams(grams[at]), _packed(counts[at].astype(np.int32)) if counts[at].any() else None) for s, at in _by_shard(grams, blocks)]
    kinds = (("_chunk", pa.int64()), ("shard", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def _learned(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    """Messages of the grams that the texts of a task give, one for each shard and _MODEL_GATHER grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in _gathered(batches, _model_grams, _MODEL_GATHER):
            yield _messages(None, found, n, blocks)

    return docs.select(text).mapInArrow(run, _MESSAGE)


def _all_learned(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of a shard's messages, ascending, what was learned of each, and the place of each gram sent."""
    lists = [_unpacked_grams(g.as_py()) for g in table.column("grams")]
    counts = [_unpacked(c.as_py(), np.int32) if c.is_valid else np.zeros(len(g), np.int32) for g, c in zip(lists, table.column("counts"))]
    grams, at = np.unique(np.concatenate(lists), return_inverse=True)
    return grams, np.bincount(at, np.concatenate(counts)).astype(np.int64), at


def _built(grams: np.ndarray, counts: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """The blocks that ascending distinct grams fall into, with their bits."""
    block = _block(grams, blocks)
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(grams)]):
        yield int(block[a]), build_block(grams[a:b], counts[a:b])


def _filter_blocks(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        block, bits = zip(*_built(*_all_learned(table)[:2], blocks))
        return pa.table({"block": pa.array(block, pa.int32()), "bits": pa.array(bits, pa.binary())})

    return written(_learned(docs, text, blocks).groupBy("shard").applyInArrow(build, "block int, bits binary"), "filter")


def _estimates(pair: np.ndarray, history: np.ndarray, word: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """log10 of the interpolated probabilities from three arrays of levels."""
    seen = middle(history)
    follows = np.minimum(np.divide(middle(pair), seen, out=np.zeros(len(pair)), where=seen > 0), 1.0)
    weight = np.where(seen > 0, WEIGHT, 0.0)
    return np.log10(weight * follows + (1 - weight) * (middle(word) + 1) / (total + kinds + 1))


def _of_unique(ask: Callable[[np.ndarray], np.ndarray], grams: np.ndarray) -> np.ndarray:
    found, at = np.unique(grams, return_inverse=True)
    return ask(found)[at]


def score(docs: DataFrame, training: DataFrame | Column, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every row with `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`.

    `training` are rows to learn from, or the condition for those of `docs`: then both jobs share one exchange of grams if the
    filter is not broadcast."""
    spark = docs.sparkSession
    learns, extra = F.lit(False), training
    if isinstance(training, Column):
        learns, extra, training = F.coalesce(training, F.lit(False)), None, docs.where(training)
    counts = written(_summed(training, lambda tokens, ends: tokens, text).groupBy("gram").agg(F.sum("n").alias("n")), "token-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # a training text gives two grams for each token and one start
    blocks = max(1, -(-3 * total // BLOCK_GRAMS))
    fits = total <= MOST_FILTER_BYTES  # the filter has about a byte for each token
    if fits:
        filters = _filter_blocks(training, text, blocks)
        fits = filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0] <= MOST_FILTER_BYTES
    known = counts.orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    order = np.argsort(known.column("gram").to_numpy())
    frequent = spark.sparkContext.broadcast((known.column("gram").to_numpy()[order], known.column("n").to_numpy()[order]))
    rows, at = docs.select(*keep, F.col(text).alias("_text")), len(keep)
    width = total + kinds + 1

    def judged(tokens: np.ndarray, ends: np.ndarray, pair: np.ndarray, history: np.ndarray, word: np.ndarray) -> tuple:
        """Per row: tokens, frequent ones and their base score, the model's score; the other tokens and how many."""
        hashes, n = frequent.value
        logs = _estimates(pair, history, word, total, kinds)
        spot = np.minimum(np.searchsorted(hashes, signed(tokens)), max(len(hashes) - 1, 0))
        hit = hashes[spot] == signed(tokens) if len(hashes) else np.zeros(len(tokens), bool)
        base = np.log10(np.where(hit, n[spot] + 1 if len(n) else 1, 1) / width)
        rest = np.flatnonzero(~hit)
        lists = np.searchsorted(rest, ends)
        return (
            np.diff(ends), np.add.reduceat(hit.astype(np.int64), ends[:-1]), np.add.reduceat(np.where(hit, base, 0.0), ends[:-1]),
            np.add.reduceat(logs, ends[:-1]), signed(tokens[rest]), np.diff(lists),
        )

    def results(kept: list[pa.Array], sums: list[tuple]) -> pa.RecordBatch:
        tokens_n, hits, base, logs, rare, rare_n = (np.concatenate(x) for x in zip(*sums))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare_n)]).astype(np.int32)), pa.array(rare))
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(tokens_n.astype(np.int64)), pa.array(hits), pa.array(base), pa.array(logs), lists],
            names=[*keep, "n_tokens", "_hits", "_base", "score", "_rare"],
        )

    kinds_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    kinds_of = f"{kinds_of}, n_tokens bigint, _hits bigint, _base double, score double, _rare array<bigint>"
    if fits:
        parts = [b""] * blocks
        for row in filters.toLocalIterator():
            parts[row["block"]] = bytes(row["bits"])
        sent = spark.sparkContext.broadcast(LogFrequencyFilter(parts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = []
                for _, ends, tokens in _tokens(batch.column(at)):
                    before, ask = _histories(tokens, ends), sent.value.level
                    sums.append(judged(tokens, ends, _of_unique(ask, _pair(before, tokens)), _of_unique(ask, _alone(before)), _of_unique(ask, _alone(tokens))))
                if sums:
                    yield results(batch.columns[:at], sums)

        scored = rows.mapInArrow(run, kinds_of)
    else:
        chunks = _chunks(docs.select(*keep, learns.alias("_learns"), F.col(text).alias("_text")))
        answers = _answers(chunks, None if extra is None else _learned(extra, text, blocks), blocks)

        def whole(chunk: pa.Table, answer: pa.Table) -> pa.Table:
            asking = _opened(chunk.column("packed")[0])
            levels = np.concatenate([np.frombuffer(x["levels"], np.uint8) for x in sorted(answer.select(["shard", "levels"]).to_pylist(), key=lambda x: x["shard"])])
            blocks_of = [(tokens, ends) for _, ends, tokens in _tokens(asking.column(at + 1))]
            spots = np.unique(np.concatenate([_asked_grams(*x) for x in blocks_of]), return_inverse=True)[1]
            sums, first = [], 0
            for tokens, ends in blocks_of:
                mine = levels[spots[first : first + 3 * len(tokens)]].astype(np.int64)
                first += 3 * len(tokens)
                sums.append(judged(tokens, ends, *np.split(mine, 3)))
            return pa.Table.from_batches([results(asking.columns[:at], sums)])

        scored = chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(whole, kinds_of)
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_row", F.explode("_rare").alias("gram")).join(counts, "gram", "left").groupBy("_row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(width)))).alias("_more"), F.count("n").alias("_also")
    )
    return scored.join(rare, "_row", "left").select(
        *keep, "n_tokens", (F.col("_hits") + F.coalesce("_also", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), "score",
    )


def _chunks(rows: DataFrame) -> DataFrame:
    """`(_chunk, size, packed)`: the rows (the text last) in runs of about CHUNK_BYTES of text, as compressed Arrow data."""

    def closed(batch: pa.RecordBatch, size: int) -> tuple[int, bytes]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as stream:
            stream.write_batch(batch)
        return size, sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        def close():
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            offsets = flat_bytes(joined.column(joined.num_columns - 1))[1]
            done = [closed(joined.slice(a, b - a), int(offsets[b] - offsets[a])) for a, b in row_blocks(offsets, CHUNK_BYTES)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.binary())], names=["size", "packed"])
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += int(flat_bytes(batch.column(batch.num_columns - 1))[1][-1])
            if size >= CHUNK_BYTES:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return written(rows.mapInArrow(run, "size bigint, packed binary").withColumn("_chunk", F.monotonically_increasing_id()), "asking")


def _opened(packed: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_py()).read_next_batch()


def _answers(chunks: DataFrame, learned: DataFrame | None, blocks: int) -> DataFrame:
    """`(_chunk, shard, levels)`: a byte for each distinct gram of a chunk, ascending.

    Grams that ask far outnumber those learned when the training rows are few, so a shard is met in parts of bounded size."""
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-2 * size // (_shards(blocks) * ASK_BYTES)))  # some four bytes of text to a distinct gram of eight
    exact = MOST_FILTER_BYTES < 0

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _opened(packed)
                learns = rows.column(rows.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
                grams, learned = [], []
                for first, ends, tokens in _tokens(rows.column(rows.num_columns - 1)):
                    mine = np.repeat(learns[first : first + len(ends) - 1], np.diff(ends))
                    heads = np.zeros(len(tokens), bool)
                    heads[ends[:-1]] = True
                    grams.append(_asked_grams(tokens, ends))
                    learned.append(np.concatenate([mine, mine & heads, mine]))  # a start counts once a text, as in _model_grams()
                found, spots = np.unique(np.concatenate(grams), return_inverse=True)
                yield _messages(chunk, found, np.bincount(spots[np.concatenate(learned)], minlength=len(found)), blocks)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        shard, part = (k.as_py() for k in key)
        grams, counts, at = _all_learned(table)
        if exact:
            levels = np.where(counts > 0, _levels(np.maximum(counts, 1)), 0)
        else:
            first = _first_block(shard, blocks)
            bits = [b""] * (_first_block(shard + 1, blocks) - first)
            for block, data in _built(grams[counts > 0], counts[counts > 0], blocks):
                bits[block - first] = data
            levels = LogFrequencyFilter(bits, first, blocks).level(grams)
        levels = levels.astype(np.uint8)[at]
        ends = np.cumsum([0, *(len(g.as_py()) // 8 for g in table.column("grams"))])
        out = [(c, shard, levels[a:b].tobytes()) for c, a, b in zip(table.column("_chunk").to_pylist(), ends, ends[1:]) if c is not None and c % parts == part]
        return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate((("_chunk", pa.int64()), ("shard", pa.int32()), ("levels", pa.binary())))})

    sent = chunks.select("_chunk", "packed").mapInArrow(asked, _MESSAGE)
    if learned is not None:
        sent = sent.unionAll(learned)
    if parts > 1:
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        sent = sent.where(F.col("counts").isNotNull() | (F.pmod("_chunk", F.lit(parts)) == F.col("part")))
    else:
        sent = sent.withColumn("part", F.lit(0))
    return sent.groupBy("shard", "part").applyInArrow(answer, "_chunk bigint, shard int, levels binary")
