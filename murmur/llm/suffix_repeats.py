"""Suffix-array de-duplication: byte strings that occur twice, found in enhanced suffix arrays of anchored segments.

Equal 200-byte strings meet under their anchor (see `anchored`). For the variants of an anchor the suffixes of all
window places are sorted (prefix doubling); neighbours with LENGTH common bytes form the top intervals of the common-prefix
tree, and every place in one covers LENGTH repeated bytes. Coverage needs no more than the top of the tree. For
`repeat_groups` a stack scan over the common prefixes of neighbours yields the whole tree: an interval whose members are
preceded by different bytes (or by the start of a document) is a maximal repeat, put out with all its occurrences.
Intervals that merely shift a longer repeat to the right are no groups.

The length of a group is seen up to the end of the segment (LENGTH + width bytes), which is enough to decide coverage.

Defined cases: null is empty; a text shorter than LENGTH loses nothing; strings never cross documents; repeated rows are
occurrences like any other; no rows give no rows; extra columns are kept, columns named like results are replaced."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from murmur.llm.anchored import (
    Anchored, Units, anchored, by_anchor, equal_windows, identity, runs_of, small, split_hot, windows_of,
)
from murmur.llm.shared import BYTE_CODES, flat_bytes, mixed, row_blocks, written

LENGTH, GRAM = 200, 32  # GRAM is a power of two
_BLOCK = 1 << 20


def _byte_grams(flat: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place on, by doubling."""
    runs, n = BYTE_CODES[flat], 1
    while n < GRAM:
        if len(runs) <= n:
            return runs[:0]
        with np.errstate(over="ignore"):
            runs = runs[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + runs[n:]
        n *= 2
    return mixed(runs)


def _read(column: pa.Array):
    flat, offsets = flat_bytes(column)
    for first, end in row_blocks(offsets, _BLOCK):
        part, ends = flat[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]

        def segment(row: int, a: int, b: int) -> bytes:
            # a flag byte, the byte before (if the document does not start here), the windows
            before = b"\1" + part[a - 1 : a].tobytes() if a > ends[row] else b"\0"
            return before + part[a : b + LENGTH].tobytes()

        yield first, ends, _byte_grams(part), segment


UNITS = Units(_read, LENGTH, LENGTH - GRAM + 1)
_FOUND = "vid string, low int, high int"
#: The tree in linear size: places in suffix order (`length` null), and intervals of places from `low` to `high`.
_TREE = "vid string, low int, high int, top string, length int"


class EnhancedSuffixes:
    """Sorted suffixes of the window places of some segments, with common prefixes of neighbours."""

    def __init__(self, flat: np.ndarray, place: np.ndarray, end: np.ndarray):
        padded = np.concatenate([flat, np.zeros(7, np.uint8)]).astype(np.uint64)
        eight = np.zeros(len(flat), np.uint64)
        for j in range(8):
            eight = eight << np.uint64(8) | padded[j : j + len(flat)]
        self.flat, self.place, self.end = flat, place, end
        self.ranks = equal_windows(np.unique(eight, return_inverse=True)[1], LENGTH, 8)
        self.kind = self.ranks[LENGTH][place]
        self.order = np.lexsort((self._rank(64, place + LENGTH + 128), self._rank(128, place + LENGTH), self.kind))

    def _rank(self, length: int, place: np.ndarray) -> np.ndarray:
        ranks = self.ranks[length]
        return np.where(place < len(ranks), ranks[np.minimum(place, len(ranks) - 1)], -1) if len(ranks) else np.full(len(place), -1)

    def common(self, i: int, j: int) -> int:
        """Length of the common prefix of two suffixes known to share LENGTH bytes, within their segments."""
        a, b, n = int(self.place[i]), int(self.place[j]), LENGTH
        most = min(int(self.end[i]) - a, int(self.end[j]) - b)
        for step in (128, 64, 32, 16, 8):
            ranks = self.ranks[step]
            if n + step <= most and max(a, b) + n < len(ranks) and ranks[a + n] == ranks[b + n]:
                n += step
        while n < most and self.flat[a + n] == self.flat[b + n]:
            n += 1
        return min(n, most)


def interval_tree(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Intervals (first member, last member, common length) of neighbours' common prefixes, innermost first."""
    stack = [(0, 0)]  # common length, first member
    for at in range(1, len(common) + 2):
        now = common[at - 1] if at <= len(common) else 0
        first = at - 1
        while stack[-1][0] > now:
            length, first = stack.pop()
            yield first, at - 1, length
        if stack[-1][0] < now:
            stack.append((now, first))


class _Chunk:
    """Window places of the variants of a chunk, their sorted suffixes, and how often each content occurs."""

    def __init__(self, table: pa.Table):
        self.vids = table.column("vid").to_pylist()
        seg = table.column("seg").chunk(0).cast(pa.large_binary())
        offsets = np.frombuffer(seg.buffers()[1], np.int64)[seg.offset : seg.offset + len(seg) + 1]
        self.flat = np.frombuffer(seg.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.led = self.flat[offsets[:-1]].astype(np.int64)
        self.variant, self.offset, self.place = windows_of(table.column("n").to_numpy().astype(np.int64), offsets[:-1] + 1 + self.led)
        self.weight = np.where(table.column("several").to_numpy(zero_copy_only=False), 2, 1)[self.variant]
        self.suffixes = EnhancedSuffixes(self.flat, self.place, offsets[1:][self.variant])
        self.total = np.bincount(self.suffixes.kind, self.weight)


def _covered(table: pa.Table) -> pa.Table:
    """Runs of places in top intervals of two occurrences or more.

    A variant alone under its anchor has all its repeats in its own copies: the windows of a segment hold one and the
    same anchor at different distances, so no two of them are equal."""
    _, name, held = np.unique(table.column("anchor").to_numpy(), return_inverse=True, return_counts=True)
    alone = held[name] == 1
    whole = table.filter(pa.array(alone & table.column("several").to_numpy(zero_copy_only=False)))
    copies = pa.table({"vid": whole.column("vid"), "low": pa.array(np.zeros(len(whole), np.int32)), "high": pc.cast(pc.subtract(whole.column("n"), 1), pa.int32())})
    table = table.filter(pa.array(~alone)).combine_chunks()
    if not len(table):
        return copies
    c = _Chunk(table)
    v, low, high = runs_of(c.total[c.suffixes.kind] >= 2, c.variant, c.offset)
    met = pa.table({"vid": pa.array([c.vids[i] for i in v], pa.string()), "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32))})
    return pa.concat_tables([copies, met])


def _tree(table: pa.Table) -> pa.Table:
    """Maximal repeats: the intervals with different bytes before their members."""
    c = _Chunk(table)
    kind, order = c.suffixes.kind, c.suffixes.order
    # 256: the start of a document, which differs from any byte and from another start
    before = np.where((c.offset == 0) & (c.led[c.variant] == 0), 256, c.flat[c.place - 1].astype(np.int64))[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(kind[order]) != 0]))
    tails = np.append(heads[1:], len(order))
    least, most = np.minimum.reduceat(before, heads), np.maximum.reduceat(before, heads)
    out = []
    for i in np.flatnonzero(((most > least) | (most == 256)) & (c.total[kind[order[heads]]] >= 2)):
        head, members = int(heads[i]), order[heads[i] : tails[i]].tolist()
        top = f"{c.vids[c.variant[members[0]]]}:{c.offset[members[0]]}"
        common = [c.suffixes.common(a, b) for a, b in zip(members[:-1], members[1:])]
        tree = list(interval_tree(common)) if common else [(0, 0, int(c.suffixes.end[members[0]] - c.place[members[0]]))]
        out += [(c.vids[c.variant[m]], int(c.offset[m]), at, top, None) for at, m in enumerate(members)]
        for a, b, length in tree:
            lefts = set(before[head + a : head + b + 1].tolist())
            if length >= LENGTH and (len(lefts) > 1 or 256 in lefts):
                out.append((None, a, b, top, length))
    columns = list(zip(*out)) or [()] * 5
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
    return pa.table({n: pa.array(list(v), k) for n, v, k in zip(("vid", "low", "high", "top", "length"), columns, kinds)})


def _hot_windows(variants: DataFrame) -> DataFrame:
    """`(vid, o, window, diverse)` of repeated windows, for anchors with very many variants: no group meets in a task."""
    led = F.ascii(F.substring(F.col("seg"), F.lit(1), F.lit(1)).cast("string"))
    place = variants.select("vid", "several", "seg", led.alias("led"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    window = F.sha2(F.substring("seg", F.col("o") + F.col("led") + 2, F.lit(LENGTH)), 256)
    before = F.when((F.col("o") == 0) & (F.col("led") == 0), F.concat(F.lit("start "), "vid")).otherwise(F.hex(F.substring("seg", F.col("o") + F.col("led") + 1, F.lit(1))))
    each = written(place.select("vid", "o", "several", window.alias("window"), before.alias("before")), "hot-windows")
    kinds = each.groupBy("window").agg(
        F.count("*").alias("places"), F.max("several").alias("several"), F.min("before").alias("a"), F.max("before").alias("b")
    ).where("places > 1 or several").select("window", F.expr("a < b or a like 'start %'").alias("diverse"))
    return each.join(kinds, "window").select("vid", "o", "window", "diverse")


def _met(rows: DataFrame) -> tuple[Anchored, DataFrame, DataFrame]:
    met = anchored(rows, UNITS)
    variants = met.variants.select("vid", "anchor", "n", "seg", (F.col("first") != F.col("last")).alias("several"))
    return met, *split_hot(variants)


def repeat_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeats of LENGTH bytes or more among different texts: group, length, and every (node, first byte).
    `node` is the key of the text, shared by its copies (see `anchored.identity`). A nested repeat lists its own places, so
    the listing can be larger than the tree it is read from. Repeats filed under an anchor with very many variants are
    listed window by window (length LENGTH)."""
    met, calm, hot = _met(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    tree = written(by_anchor(calm, _tree, _TREE), "tree")
    places = tree.where("length is null").select("top", F.col("high").alias("at"), "vid", F.col("low").alias("o"))
    groups = tree.where("length is not null").select("top", "low", "high", "length")
    listed = groups.join(places, "top").where("at between low and high").select(
        F.concat_ws(":", "top", "low", "high", "length").alias("group"), "length", "vid", "o"
    )
    single = _hot_windows(hot).where("diverse").select(F.col("window").alias("group"), F.lit(LENGTH).alias("length"), "vid", "o")
    return listed.unionByName(single).join(met.occurrences, "vid").select("group", "length", "node", (F.col("start") + F.col("o")).alias("at"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds `n_bytes`, `removed` (maximal removed byte ranges [from, to)) and `kept` (remaining bytes) to every row."""
    met, calm, hot = _met(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    single = _hot_windows(hot).select("vid", F.col("o").alias("low"), F.col("o").alias("high"))
    found = written(by_anchor(calm, _covered, _FOUND).unionByName(single), "repeats")
    spans = met.occurrences.join(found, "vid").groupBy("node").agg(
        F.collect_set(F.struct((F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high") + LENGTH).alias("b"))).alias("_spans")
    )
    kept = docs.drop(*[c for c in ("n_bytes", "removed", "kept") if c not in (doc_id, text)])
    keyed = kept.withColumn("_node", identity(F.coalesce(text, F.lit(""))))
    spans, several = small(written(spans.withColumnRenamed("node", "_node"), "spans"), "size(_spans)"), small(met.repeated.select(F.col("node").alias("_node"), "copies"))
    joined = keyed.join(spans, "_node", "left").join(several, "_node", "left").drop("_node")
    at, last = kept.columns.index(text), len(kept.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, rest = [], [], []
            for value, ranges, copies in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), batch.column(last + 1).to_pylist()):
                data = (value or "").encode()
                if copies and len(data) >= LENGTH:
                    ranges = [{"a": 0, "b": len(data)}]
                merged: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *[x for pair in merged for x in pair], len(data)]
                counts.append(len(data))
                removed.append([{"from": a, "to": b} for a, b in merged])
                rest.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(rest, pa.binary())],
                names=[*batch.schema.names[:last], "n_bytes", "removed", "kept"],
            )

    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string("n_bytes bigint, removed array<struct<from:bigint,to:bigint>>, kept binary").fields])
    return joined.mapInArrow(cut, schema)
