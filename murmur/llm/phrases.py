"""Substring de-duplication by repeated-phrase automata: later copies of word windows go, the first stays.

1. Windows of LENGTH words meet under their anchor (see `anchored`); anchors are the shards of the automata.
2. Confirm: in a shard, windows that occur at two places are recurring; neighbouring windows with the same occurrences
   are joined to one passage, so a passage is a phrase as long as all its occurrences agree.
3. Compile: the passages of a shard form one Aho-Corasick automaton (pyahocorasick; each word is one symbol).
4. Stream: all segments of all documents filed in the shard run through it, each distinct one once for all its copies,
   and every occurrence is located. The earliest (smallest id, then place) stays, the words of the others are removed.

Defined cases: null has no words; a text of fewer than LENGTH words loses none; copies of a whole text lose all their
words but for the smallest id (null ids come first); rows of equal id and text are one document and are treated alike;
of different texts with one id the smaller text key is the earlier; no rows give no rows; extra columns are kept, columns
named like results are replaced. Kept words are joined by one space; a text that loses nothing is returned by
`clean_texts` as it was."""

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from murmur.llm.anchored import (
    Anchored, Units, anchored, by_anchor, equal_windows, identity, runs_of, small, split_hot, windows_of,
)
from murmur.llm.shared import flat_bytes, gram_hashes, row_blocks, word_bounds, word_hashes, written

LENGTH, GRAM = 20, 8
_BLOCK = 1 << 20
_FOUND = "vid string, low int, high int, every boolean, node string, start bigint"


def _read(column: pa.Array):
    flat, offsets = flat_bytes(column)
    for first, end in row_blocks(offsets, _BLOCK):
        part, bounds = flat[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        begin, stop, row = word_bounds(part, bounds)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=end - first))])

        def segment(_row: int, a: int, b: int) -> bytes:
            return b" ".join(part[begin[a] : stop[b + LENGTH - 1]].tobytes().split())

        yield first, ends, gram_hashes(word_hashes(part, begin, stop), GRAM), segment


UNITS = Units(_read, LENGTH, LENGTH - GRAM + 1)


def _symbol(word: int) -> str:
    return chr(word + 1 if word < 0xD000 else word + 0x1000)  # passes over the surrogates


def passages(kind: np.ndarray, joined: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Marks the windows that begin a passage. `kind`: content of each window, `joined`: the next window is in the same
    segment, `weight`: occurrences of the window's segment.

    A window continues its left neighbour's passage if all occurrences of both are side by side."""
    total = np.bincount(kind, weight)
    pair = np.flatnonzero(joined)
    left, right = kind[pair], kind[pair + 1]
    name, both = np.unique(left * (int(kind.max()) + 1) + right, return_inverse=True)
    together = np.bincount(both, weight[pair])[both]
    goes_on = np.zeros(len(kind), bool)
    goes_on[pair + 1] = (together == total[left]) & (together == total[right])
    return (total[kind] >= 2) & ~goes_on, goes_on


def _judge(table: pa.Table) -> pa.Table:
    vids, segs = table.column("vid").to_pylist(), table.column("seg").to_pylist()
    words: dict[bytes, int] = {}
    coded = [[words.setdefault(w, len(words)) for w in s.split(b" ")] for s in segs]
    places = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    units = np.array([w for c in coded for w in c], np.int64)
    variant, offset, place = windows_of(table.column("n").to_numpy().astype(np.int64), places[:-1])
    kind = equal_windows(units, LENGTH)[LENGTH][place]
    copies = table.column("copies").to_numpy().astype(np.int64)
    # confirm: recurring windows, joined to passages
    begins, goes_on = passages(kind, np.append(np.diff(variant) == 0, False), copies[variant])
    text = ["".join(map(_symbol, c)) for c in coded]
    automaton, lengths, seen = ahocorasick.Automaton(), [], set()
    heads = np.flatnonzero(begins)
    stops = np.append(np.flatnonzero(~goes_on), len(kind))
    for at, until in zip(heads.tolist(), stops[np.searchsorted(stops, heads, "right")].tolist()):
        if kind[at] not in seen:
            seen.add(kind[at])
            low = int(offset[at])
            automaton.add_word(text[variant[at]][low : low + (until - at) + LENGTH - 1], len(lengths))
            lengths.append(until - at + LENGTH - 1)
    out = [[], [], [], []]
    if lengths:
        automaton.make_automaton()
        # stream: every occurrence of every passage
        where = [(phrase, v, end) for v, t in enumerate(text) for end, phrase in automaton.iter(t)]
        phrase, v, end = np.array(where, np.int64).T
        length = np.array(lengths)[phrase]
        low = end - length + 1
        first = table.column("first").to_pylist()
        key = [((f["who"]["known"], f["who"]["id"] if f["who"]["known"] else 0), f["node"]) for f in first]
        rank = {k: r for r, k in enumerate(sorted(set(key)))}
        who = np.array([rank[k] for k in key])[v]
        start = np.array([f["start"] for f in first], np.int64)[v] + low
        order = np.lexsort((start, who, phrase))
        earliest = np.zeros(len(order), bool)
        earliest[order[np.concatenate([[True], np.diff(phrase[order]) != 0])]] = True
        out = [v, low, low + length - LENGTH, ~earliest]
    nodes, starts = [f["node"] for f in table.column("first").to_pylist()], [f["start"] for f in table.column("first").to_pylist()]
    return pa.table({
        "vid": pa.array([vids[i] for i in out[0]], pa.string()), "low": pa.array(np.asarray(out[1], np.int32)), "high": pa.array(np.asarray(out[2], np.int32)),
        "every": pa.array(np.asarray(out[3], bool)), "node": pa.array([nodes[i] for i in out[0]], pa.string()),
        "start": pa.array([starts[i] for i in out[0]], pa.int64()),
    })


def _judge_hot(variants: DataFrame) -> DataFrame:
    """The same answer window by window, for anchors with very many variants: one row per window and no group in a task."""
    words = F.split(F.col("seg").cast("string"), " ")
    place = variants.select("vid", "copies", "first", words.alias("w"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    at = F.struct(F.col("first.who").alias("who"), F.col("first.node").alias("node"), (F.col("first.start") + F.col("o")).alias("start"))
    window = F.sha2(F.concat_ws(" ", F.slice("w", F.col("o") + 1, F.lit(LENGTH))), 256)
    each = written(place.select("vid", "o", "copies", "first", window.alias("window"), at.alias("at")), "hot-windows")
    kinds = each.groupBy("window").agg(F.sum("copies").alias("n"), F.min("at").alias("earliest")).where("n > 1")
    return each.join(kinds, "window").select(
        "vid", F.col("o").alias("low"), F.col("o").alias("high"), (F.col("at") != F.col("earliest")).alias("every"),
        F.col("first.node").alias("node"), F.col("first.start").alias("start"),
    )


def _spans(rows: DataFrame) -> tuple[Anchored, DataFrame]:
    """Removed word ranges per text (one row of a text stands for its copies)."""
    met = anchored(rows, UNITS)
    # 2 stands for any number of occurrences above one
    variants = met.variants.select("vid", "anchor", "n", "seg", "first", F.when(F.col("first") != F.col("last"), 2).otherwise(1).alias("copies"))
    calm, hot = split_hot(variants)
    found = written(by_anchor(calm, _judge, _FOUND).unionByName(_judge_hot(hot)), "passages")
    hits = met.occurrences.select("vid", F.col("node").alias("_node"), F.col("start").alias("_start")).join(found, "vid").where(
        F.col("every") | (F.col("_node") != F.col("node")) | (F.col("_start") != F.col("start"))
    )
    return met, hits.groupBy("_node").agg(
        F.collect_set(F.struct((F.col("_start") + F.col("low")).alias("a"), (F.col("_start") + F.col("high") + LENGTH).alias("b"))).alias("_spans")
    )


def remove_later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds `n_words`, `removed` (removed word ranges [from, to), maximal) and `kept` (kept words) to every row."""
    met, spans = _spans(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    kept = docs.drop(*[c for c in ("n_words", "removed", "kept") if c not in (doc_id, text)])
    keyed = kept.withColumn("_node", identity(F.coalesce(text, F.lit(""))))
    spans, several = small(written(spans, "spans"), "size(_spans)"), small(met.repeated.select(F.col("node").alias("_node"), F.col("first.id").alias("_first")))
    copy = F.col("_known").isNotNull() & ~F.col(doc_id).eqNullSafe(F.col("_first"))
    joined = keyed.join(spans, "_node", "left").join(several.withColumn("_known", F.lit(True)), "_node", "left")
    joined = joined.select(*kept.columns, "_spans", F.coalesce(copy, F.lit(False)).alias("_copy"))
    at, last = kept.columns.index(text), len(kept.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, rest = [], [], []
            for value, ranges, copy in zip(*(batch.column(c).to_pylist() for c in (at, last, last + 1))):
                words = (value or "").encode().split()
                found = [(0, len(words))] if copy and len(words) >= LENGTH else sorted((r["a"], r["b"]) for r in ranges or ())
                merged: list[list[int]] = []
                for a, b in found:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *[x for pair in merged for x in pair], len(words)]
                counts.append(len(words))
                removed.append([{"from": a, "to": b} for a, b in merged])
                rest.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(rest, pa.string())],
                names=[*batch.schema.names[:last], "n_words", "removed", "kept"],
            )

    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string("n_words bigint, removed array<struct<from:bigint,to:bigint>>, kept string").fields])
    return joined.mapInArrow(cut, schema)


def removed_units(ranges: str) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])


def clean_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with the later copies cut out of their texts; a document of which nothing is left goes."""
    cut = remove_later_copies(docs, doc_id, text)
    changed = F.size("removed") > 0
    return cut.where(~changed | (F.col("kept") != "")).withColumn(text, F.when(changed, F.col("kept")).otherwise(F.col(text))).select(*docs.columns)
