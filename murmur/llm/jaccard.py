"""N-gram Jaccard join: MinHash LSH forest for candidates, exact verification, classes and link counts.

1. A text is the set of its runs of SHINGLE words (fewer words: one run of all). Equal texts are one node.
2. Each of TREES prefix tries labels a node by DEPTH min-hashes. The matched prefix is shortened from DEPTH, one hash at a
   time, until a pair at the threshold meets in some trie with the target recall: 1 - (1 - t^depth)^TREES.
3. Nodes below one trie node are tied to the smallest of them (never paired); tied nodes form candidate groups, which by
   transitivity also hold pairs that met in no trie.
4. Groups are cut into blocks of bounded size; every two blocks meet once, all pairs inside are verified exactly on the
   64-bit hashes of the shingles, and only counts and a spanning forest of the links leave the task.

Defined cases: null or wordless text has no shingle, no link and a class of its own row; repeated rows are copies of each
other; no rows give no rows; a null id takes part, and its class is named by the smallest known id; extra columns are not
returned by `near_duplicates`. Blocks bound the memory of a task, not the work: a group of n different texts costs n^2
comparisons of hash sets in blocks, which counting its links needs."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from murmur.llm.shared import flat_bytes, gram_hashes, mixed, row_blocks, signed, word_bounds, word_hashes, written
from murmur.operators.dedup import connected_components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.998
#: Texts and shingles that one block holds at most (a longer text is a block of its own).
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1_000_000
#: Keys are sent to all executors up to so many; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_READ = 1 << 20


def matched_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with the wanted recall at the threshold; 1 if none has it."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def identity(text: Column) -> Column:
    """Key of equal texts: the first 128 bits of their SHA-256."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, in order and with repeats, and the n + 1 row offsets."""
    flat, offsets = flat_bytes(column)
    begin, end, row = word_bounds(flat, offsets)
    hashes, n = word_hashes(flat, begin, end), len(offsets) - 1
    words = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    counts = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(ends[-1], np.uint64)
    long_row = (words >= k)[row] if len(row) else np.zeros(0, bool)
    whole = gram_hashes(hashes, k)
    # a run starts at every word that has k - 1 more words of its row behind it
    fits = long_row & (np.arange(len(row)) + k <= first[1:][row]) if len(row) else long_row
    at = np.flatnonzero(fits)
    out[ends[:-1][row[at]] + at - first[:-1][row[at]]] = whole[at]
    for r in np.flatnonzero((words > 0) & (words < k)):
        out[ends[r]] = gram_hashes(hashes[first[r] : first[r + 1]], int(words[r]))[0]
    return out, ends


def _labels(column: pa.Array, trees: int, depth: int) -> np.ndarray:
    """Per row and trie the first `depth` min-hashes, folded into one number."""
    out, offsets = np.zeros((len(column), trees), np.uint64), flat_bytes(column)[1]
    factors = mixed(np.arange(1, trees * depth + 1, dtype=np.uint64)) | np.uint64(1)
    for first, end in row_blocks(offsets, _READ):
        hashes, ends = shingles(column.slice(first, end - first))
        rows = np.flatnonzero(np.diff(ends)) + first
        starts = ends[:-1][np.diff(ends) > 0]
        for tree in range(trees):
            label = np.full(len(rows), tree, np.uint64)
            for level in range(depth):
                with np.errstate(over="ignore"):
                    least = np.minimum.reduceat(hashes * factors[tree * depth + level], starts) if len(rows) else np.zeros(0, np.uint64)
                    label = mixed(label * np.uint64(0x9E3779B97F4A7C15) + least)
            out[rows, tree] = label
    return out


def forest(docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """`(node, labels, size)` per row with a shingle: its prefix in each trie at the depth of the target recall."""
    depth = matched_depth(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            labels = signed(_labels(texts, TREES, depth))
            flat, offsets = flat_bytes(texts)
            words = np.bincount(word_bounds(flat, offsets)[2], minlength=len(texts))
            keep = np.flatnonzero(words)
            values = pa.array(labels[keep].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * TREES), values)
            size = pa.array(np.maximum(words[keep] - SHINGLE + 1, 1), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), lists, size], names=["node", "labels", "size"])

    return docs.select(identity(F.col(text)).alias("node"), text).mapInArrow(run, "node string, labels array<bigint>, size bigint")


def candidate_groups(labels: DataFrame) -> DataFrame:
    """`(node, component)` of nodes that share a trie node with another one, directly or through others."""
    flat = labels.select("node", F.posexplode("labels").alias("tree", "label"))
    heads = flat.groupBy("tree", "label").agg(F.min("node").alias("head"), F.max("node").alias("_last")).where("head < _last")
    heads = written(heads.select("tree", "label", "head"), "forest-heads")
    ties = flat.join(heads, ["tree", "label"]).where("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst")).distinct()
    return connected_components(ties)


def _intersections(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Shared shingles of every two rows: incidence matrix times its transpose, over shingles of two rows at least."""
    found, at, held = np.unique(hashes, return_inverse=True, return_counts=True)
    use = held[at] > 1
    column = np.cumsum(held > 1)[at[use]] - 1
    row, shared = rows[use], np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = max(256, (8 << 20) // max(n, 1))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        shared += part @ part.T
    return shared


def _verify(threshold: float):
    """All pairs between two blocks (or inside one): links per node, and a spanning forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes = np.array(table.column("node").to_pylist(), object)
        nodes, first = np.unique(nodes, return_index=True)  # a repeated row is the same node
        table = table.take(pa.array(first))
        left, right = int(table.column("left")[0].as_py()), int(table.column("right")[0].as_py())
        block = table.column("block").to_numpy()
        hashes, ends = shingles(table.column("text").chunk(0))
        n, parts, rows = len(nodes), [], []
        for r in range(n):
            own = np.unique(hashes[ends[r] : ends[r + 1]])
            parts.append(own)
            rows.append(np.full(len(own), r))
        sizes = np.array([len(p) for p in parts], np.float32)
        shared = _intersections(np.concatenate(parts), np.concatenate(rows), n)
        linked = shared >= np.float32(threshold) * (sizes[:, None] + sizes[None, :] - shared) - 1e-4
        exact = np.argwhere(linked & (np.abs(shared - threshold * (sizes[:, None] + sizes[None, :] - shared)) <= 1e-2))
        for i, j in exact:  # near the border in whole numbers
            union = int(sizes[i]) + int(sizes[j]) - int(shared[i, j])
            linked[i, j] = int(shared[i, j]) >= threshold * union - 1e-9
        np.fill_diagonal(linked, False)
        if left != right:
            linked &= block[:, None] != block[None, :]
        copies = table.column("copies").to_numpy()
        root = np.arange(n)
        while True:  # smallest label around, until nothing moves: blocks are small
            around = np.where(linked, root[None, :], n).min(axis=1, initial=n)
            lower = np.minimum(root, around)
            lower = np.minimum(lower, lower[lower])
            if (lower == root).all():
                break
            root = lower
        return pa.table({
            "node": pa.array(nodes.tolist(), pa.string()), "root": pa.array(nodes[root].tolist(), pa.string()),
            "links": pa.array(linked.sum(axis=1), pa.int64()), "doc_links": pa.array((linked * copies[None, :]).sum(axis=1), pa.int64()),
        })

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, `node` (key of its text), `class_id` (smallest id of its class), `class_size`,
    `n_links` (other texts at the threshold), `n_doc_links` (other documents at the threshold, copies included)."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    labels = written(forest(rows, "text", threshold), "forest")
    names = written(rows.select("id", identity(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded")), "names")
    copies = written(names.where("worded").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "copies")
    groups = candidate_groups(labels)
    sizes = labels.groupBy("node").agg(F.max("size").alias("size"))
    line = Window.partitionBy("component").orderBy("node")
    whole = Window.partitionBy("component")
    # a block ends after BLOCK_TEXTS texts or BLOCK_SHINGLES shingles
    blocks = groups.join(sizes, "node").join(copies, "node").withColumns({
        "_at": F.row_number().over(line), "_sum": F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).withColumn("block", (F.floor((F.col("_at") - 1) / BLOCK_TEXTS) + F.floor(F.col("_sum") / BLOCK_SHINGLES)).cast("int"))
    blocks = blocks.withColumn("blocks", F.max("block").over(whole) + 1)
    member = written(blocks.select(F.col("node").alias("member"), "first", "component", "block", "blocks", "copies"), "blocks")
    few = member.count() <= BROADCAST_ROWS
    texts = rows.withColumn("node", identity(F.col("text")))
    held = texts.join(F.broadcast(member) if few else member, (F.col("node") == F.col("member")) & F.col("id").eqNullSafe(F.col("first")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = held.select("node", "text", "component", "block", "copies", other.alias("_other")).select(
        "node", "text", "component", "block", "copies", F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right")
    )
    out = met.groupBy("component", "left", "right").applyInArrow(_verify(threshold), "node string, root string, links bigint, doc_links bigint")
    found = written(out, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    classes = connected_components(found.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct())
    placed = copies.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    heads = placed.groupBy("class").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    known = placed.join(heads, "class").join(links, "node", "left").select(
        "node", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"),
        (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("doc_links"),
    )
    return names.join(known, "node", "left").select(
        F.col("id").alias(doc_id), "node", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("doc_links", F.lit(0)).alias("n_doc_links"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The row with the smallest id of every class (of repeated rows, one); texts without words all stay."""
    found = near_duplicates(docs, doc_id, text, threshold)
    stay = found.where(F.col(doc_id).eqNullSafe(F.col("class_id"))).select(F.col(doc_id).alias("_id"), F.col("node").alias("_node"), "class_size").distinct()
    # one node of the class, should two rows of different text share the smallest id
    first = stay.groupBy("_id", F.when(F.col("class_size") > 1, F.lit(0)).otherwise(F.xxhash64("_node")).alias("_c")).agg(F.min("_node").alias("_node"), F.max("class_size").alias("_size"))
    kept = docs.withColumn("_key", identity(F.col(text))).join(first, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_node")))
    single = kept.where("_size = 1").select(*docs.columns)
    repeated = kept.where("_size > 1").dropDuplicates(["_id", "_node"]).select(*docs.columns)
    return single.unionByName(repeated)
