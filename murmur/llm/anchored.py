"""Equal windows of a corpus meet by a shared anchor, without moving the corpus.

A window of L units (bytes or words) is filed under its anchor: the smallest hash among its runs of k units, the
rightmost between equals. Equal windows have equal anchors, and consecutive windows mostly the same one, so a text falls
into segments: runs of windows with one anchor. Only segments whose anchor occurs at two places or more can hold a
repeated window; of a random corpus few do. Equal segments are one variant, judged once for all its occurrences.

* No group grows with the copies of a text: equal texts take part once, equal segments are folded on the map side.
* Anchors with very many variants are left to the caller's second way (`hot`), window by window."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from murmur.llm.shared import mixed, sliding_min, written

#: Repeated anchors are sent to all executors up to so many (8 bytes each); more meet their texts by shuffle.
BROADCAST_ANCHORS = 4_000_000
#: Entries of a keyed side (rows, or the items of their lists) sent to all executors, some 50 bytes each.
BROADCAST_ROWS = 500_000
#: Variants of one anchor that are judged together.
MOST_VARIANTS = 4_096
_PIECE, _BITS = 1 << 22, np.uint64(24)
_MASK = np.uint64((1 << 24) - 1)


def small(df: DataFrame, entries: str = "1") -> DataFrame:
    """The (stored) side of a join, sent to all executors if it has BROADCAST_ROWS entries at most."""
    size = df.agg(F.coalesce(F.sum(F.expr(entries)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def identity(text: Column) -> Column:
    """Key of equal texts: the first 128 bits of their SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def anchor_runs(grams: np.ndarray, width: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor place of every run of usable windows with one anchor."""
    starts, ends, anchors = [], [], []
    for low in range(0, max(len(grams) - width + 1, 0), _PIECE):
        part = grams[low : low + _PIECE + width - 1]
        least = sliding_min((part >> _BITS << _BITS) | (_MASK - np.arange(len(part), dtype=np.uint64)), width)
        at = (_MASK - (least & _MASK)).astype(np.int64) + low
        fits = usable[low : low + len(at)]
        at = np.where(fits, at, -1)
        edge = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(at)]]) - 1
        use = at[first] >= 0
        starts.append(first[use] + low)
        ends.append(last[use] + low)
        anchors.append(at[first][use])
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(anchors)


def inside_rows(ends: np.ndarray, length: int) -> np.ndarray:
    """For units laid end to end (n + 1 row offsets): whether a window of `length` units at a place stays in its row."""
    usable = np.ones(int(ends[-1]), bool)
    for first, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        usable[max(first, end - length + 1) : end] = False
    return usable


@dataclass
class Units:
    """How a column of texts is read. `read(column)` yields blocks `(first row, row offsets in units, grams, segment)`;
    `segment(row, first, last)` is the content of the windows first..last of the block, as bytes."""

    read: Callable[[pa.Array], Iterator[tuple]]
    length: int
    width: int


@dataclass
class Anchored:
    """variants: vid, anchor, seg, n (windows), first and last (struct id order, node, start); occurrences: vid, id, node, start."""

    variants: DataFrame
    occurrences: DataFrame
    names: DataFrame
    repeated: DataFrame


def _node_tags(nodes: pa.Array) -> np.ndarray:
    return np.array([int(n[:16], 16) for n in nodes.to_pylist()], np.uint64)


def anchored(rows: DataFrame, units: Units) -> Anchored:
    """Segments of `rows(id, text)` whose anchor repeats. names: id, node, of every row; repeated: node, first, copies of
    texts that several rows have. Null text reads as empty."""
    rows = rows.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", identity(F.col("text")))
    order = F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"))
    names = written(rows.select("id", "node"), "names")
    repeated = written(
        names.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "repeated-texts"
    )

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = _node_tags(batch.column(0))
            for first_row, ends, grams, _ in units.read(batch.column(1)):
                starts, _, at = anchor_runs(grams, units.width, inside_rows(ends, units.length))
                row = np.searchsorted(ends, starts, "right") - 1
                with np.errstate(over="ignore"):
                    # place and text of the anchor: copies of a text give equal tags and so no repeat
                    tag = mixed(tags[first_row + row] + (at - ends[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first_row + row)), pa.array(grams[at].view(np.int64)), pa.array(tag.view(np.int64))], names=["node", "anchor", "tag"])

    found = rows.select("node", "text").mapInArrow(anchors, "node string, anchor bigint, tag bigint")
    shared = written(found.groupBy("anchor").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a < b").select("anchor"), "anchors")
    # one row of each text stands for its copies
    single = rows.join(small(repeated.select("node", "first")), "node", "left").where(F.col("first").isNull() | (F.col("first") == order))
    few = shared.count() <= BROADCAST_ANCHORS
    if few:
        keep = np.sort(shared.toArrow().column(0).to_numpy().astype(np.int64))
        sent = rows.sparkSession.sparkContext.broadcast(keep)
        single = single.select("id", "node", "text")
    else:
        own = found.join(shared, "anchor", "left_semi").groupBy("node").agg(F.collect_set("anchor").alias("own"))
        single = single.join(own, "node").select("id", "node", "text", "own")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, ends, grams, segment in units.read(batch.column(2)):
                starts, lasts, at = anchor_runs(grams, units.width, inside_rows(ends, units.length))
                anchor = grams[at].view(np.int64)
                row = np.searchsorted(ends, starts, "right") - 1
                if few:
                    all_kept = sent.value
                    spot = np.minimum(np.searchsorted(all_kept, anchor), max(len(all_kept) - 1, 0))
                    use = np.flatnonzero(all_kept[spot] == anchor) if len(all_kept) else np.zeros(0, np.int64)
                else:
                    lists = [np.asarray(v, np.int64) for v in batch.column(3).slice(first_row, len(ends) - 1).to_pylist()]
                    use = np.flatnonzero([np.any(lists[r] == x) for r, x in zip(row.tolist(), anchor.tolist())])
                row, begin, last = row[use], starts[use], lasts[use]
                took = pa.array(first_row + row)
                content = [segment(r, a, b) for r, a, b in zip(row.tolist(), begin.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(took), batch.column(1).take(took), pa.array(anchor[use]), pa.array(begin - ends[row]),
                     pa.array((last - begin + 1).astype(np.int32)), pa.array(content, pa.binary())],
                    names=["id", "node", "anchor", "start", "n", "seg"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    segments = single.mapInArrow(cut, f"id {kind}, node string, anchor bigint, start bigint, n int, seg binary")
    segments = written(segments.withColumn("vid", F.substring(F.sha2(F.concat(F.col("n").cast("string").cast("binary"), F.lit(b":"), F.col("seg")), 256), 1, 32)), "segments")
    place = F.struct(order.alias("who"), "node", "start")
    variants = segments.groupBy("vid", "anchor", "n").agg(
        F.first("seg").alias("seg"), F.min(place).alias("first"), F.max(place).alias("last")
    )
    return Anchored(variants, segments.select("vid", "id", "node", "start"), names, repeated)


def split_hot(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants of anchors that can hold a repeat, apart from those of anchors with more than MOST_VARIANTS variants."""
    stored = written(variants, "variants")
    counts = stored.groupBy("anchor").agg(F.count("*").alias("variants"))
    hot = written(counts.where(F.col("variants") > MOST_VARIANTS).select("anchor"), "hot-anchors")
    hot = small(hot)
    return stored.join(hot, "anchor", "left_anti"), stored.join(hot, "anchor", "left_semi")


def by_anchor(variants: DataFrame, judge: Callable[[pa.Table], pa.Table], schema: str, chunk: int = 2 << 20) -> DataFrame:
    """`judge(table)` on chunks of about `chunk` bytes of segments that never part the variants of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            anchor = table.column("anchor").to_numpy()
            size += table.column("seg").nbytes
            turn = np.flatnonzero(np.diff(anchor))
            if size >= chunk and len(turn):
                end = int(turn[-1]) + 1
                yield from judge(pa.concat_tables([*held, table.slice(0, end)]).combine_chunks()).to_batches()
                table = table.slice(end)
                held, size = [], table.column("seg").nbytes
            elif held and size >= chunk and held[-1].column("anchor")[-1].as_py() != int(anchor[0]):
                yield from judge(pa.concat_tables(held).combine_chunks()).to_batches()
                held, size = [], table.column("seg").nbytes
            held.append(table)
        if held:
            yield from judge(pa.concat_tables(held).combine_chunks()).to_batches()

    return variants.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema)


def equal_windows(units: np.ndarray, length: int, done: int = 1) -> dict[int, np.ndarray]:
    """Ranks of the contents of 1 x `done`, 2 x `done`, ... and `length` units from every place on, by prefix doubling.

    Equal ranks are equal contents, and ranks keep their order. `units` are the ranks (or values) at `done` units; a
    longer content fits at fewer places, so the arrays get shorter."""
    ranks = {done: units}
    while 2 * done <= length:
        ranks[2 * done] = _joined(ranks[done], ranks[done], done)
        done *= 2
    if done < length:
        ranks[length] = _joined(ranks[done], ranks[done], length - done)
    return ranks


def _joined(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    n = max(len(left) - step, 0)
    if not n:
        return np.zeros(0, np.int64)
    return np.unique(left[:n] * (int(right.max()) + 1) + right[step : step + n], return_inverse=True)[1]


def windows_of(counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For variants with `counts` windows whose content begins at `places`: variant, offset and place of every window."""
    variant = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(variant)) - np.repeat(np.cumsum(counts) - counts, counts)
    return variant, offset, places[variant] + offset


def runs_of(mask: np.ndarray, variant: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variant, first and last offset of every maximal run of marked windows."""
    at = np.flatnonzero(mask)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(variant[at]) != 0)) + 1
    first, last = at[np.concatenate([[0], breaks])], at[np.concatenate([breaks, [len(at)]]) - 1]
    return variant[first], offset[first], offset[last]
