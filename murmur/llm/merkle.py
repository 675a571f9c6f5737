"""Merkle manifest of a dataset over nested-interval labels.

Every leaf has a rank in its tree (one tree per key, say a language); a node carries the interval [lo, hi) of leaf ranks
that it covers, and the digests and intervals of its children. Levels are built bottom up, `FANOUT` neighbours a run.
Ancestors are attached top down: a node meets the one of the level above that contains its interval, where both are
bucketed by that level's width, so the join is an equality on (tree, bucket). Siblings are the parent's children outside
the node's own interval: those that end before it and those that begin behind it. The roots of all trees are the leaves
of one more tree, built the same way.

Ranks come from a sort by ranges with offsets; no window or list holds more than the ranges of a tree or one run, and a
tree may hold any share of the rows. What a node hands down (its siblings' digests up to the root) is joined to its own
few children, level by level, never to whole trees.

Defined cases: null values of a field count as `-`; a null tree is a tree of its own, the first; null orders come first;
rows of equal order are placed by digest, so repeated rows are leaves of their own and stand side by side; a lone leaf is
the root of its tree; no rows give no rows; extra columns are kept, an own `subroot`, `root` or `path` is replaced."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from murmur.llm.shared import written

#: Children of a node; a power of two, as buckets are cut by shifting.
FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
_LOW_33 = (1 << 33) - 1


class Manifest(NamedTuple):
    """Leaves with `subroot`, `root` and `path` (siblings left and right of each ancestor, upwards), and all inner nodes."""

    leaves: DataFrame
    nodes: DataFrame


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*values), 256)


def sized(value: Column) -> Column:
    """A field as it enters a leaf: its UTF-8 byte count, a colon and the value, or `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return digest(*[sized(f) for f in fields])


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest leads to along a path."""
    return F.aggregate(path, leaf, lambda own, s: digest(s["left"], own, s["right"]))


def manifest(leaves: DataFrame, tree: str, order: str, leaf: str) -> Manifest:
    """Trees of the leaf digests in column `leaf`, one per value of `tree`, and the tree of their roots."""
    kept = leaves.drop("subroot", "root", "path")
    rows = kept.select(
        F.struct("*").alias("row"), F.col(tree).alias("tree"), F.col(order).alias("key"), F.col(leaf).alias("digest"),
    )
    levels, depths = _levels(rows)
    subroots = _union([levels[h].where(_ends(h)).select("tree", "digest") for h in depths]) if depths else rows.select("tree", "digest")
    top, _ = _levels(subroots.select(
        F.struct(F.col("tree").alias("of")).alias("row"), F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"
    ))
    crown = _with_paths(top, None, [len(top) - 1])
    ends = written(crown.select(F.col("row.of").alias("tree"), F.col("path"), F.col("subroot").alias("root")), "merkle-top")
    found = _with_paths(levels, ends, depths).select("row.*", "subroot", "root", "path")
    nodes = _union([
        inner.select(F.lit(scope).alias("scope"), F.col("tree").cast("string").alias("tree"), F.lit(h).alias("level"), "lo", "hi", "digest")
        for scope, grown in (("tree", levels), ("top", top)) for h, inner in enumerate(grown) if h
    ] or [levels[0].limit(0).select(
        F.lit("tree").alias("scope"), F.col("tree").cast("string").alias("tree"), F.lit(0).alias("level"), "lo", "hi", "digest"
    )])
    return Manifest(found, nodes)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def _width(level: int) -> int:
    """Leaves that a full node of the level covers."""
    return 1 << FANOUT_BITS * level


def _ends(level: int) -> Column:
    """Whether the node of this level is the last of its tree."""
    return F.col("n") <= _width(level)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows as leaves: `lo` is the rank in the tree, `n` the leaves of the tree. Stored."""
    stored = written(rows.withColumn("id", F.monotonically_increasing_id()), "merkle-rows")
    place = ["tree", "key", "digest", "id"]
    ranged = stored.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged, "merkle-ranges").withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(_LOW_33))
    tree, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("rows"), F.min("at").alias("first")).select(
        F.col("tree").alias("in_tree"), F.col("range").alias("in_range"), F.sum("rows").over(tree).alias("n"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    met = ranged.join(counts, F.col("tree").eqNullSafe(F.col("in_tree")) & (F.col("range") == F.col("in_range")))
    lo = F.col("at") + F.col("shift")
    return written(met.select("row", "tree", "n", "digest", lo.alias("lo"), (lo + 1).alias("hi")), "merkle-leaves")


def _levels(rows: DataFrame) -> tuple[list[DataFrame], list[int]]:
    """The stored nodes of every level, leaves first, and the levels on which trees end."""
    levels, depths = [_ranked(rows)], []
    depth = F.expr(f"cast(size(filter(sequence(0, 20), h -> shiftleft(1L, {FANOUT_BITS} * h) < n)) as int)")
    depths = sorted(r["depth"] for r in levels[0].where("lo = 0").select(depth.alias("depth")).distinct().collect())
    for h in range(depths[-1] if depths else 0):
        runs = levels[h].where(~_ends(h)).groupBy("tree", "n", F.shiftright("lo", FANOUT_BITS * (h + 1))).agg(
            F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children")
        )
        levels.append(written(runs.select(
            "tree", "n", F.sha2(F.array_join("children.digest", ""), 256).alias("digest"),
            F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), "children",
        ), "merkle-level"))
    return levels, depths


def _with_paths(levels: list[DataFrame], ends: DataFrame | None, depths: list[int]) -> DataFrame:
    """Leaves with `path`, `subroot` and `root`; `ends` holds what lies above the root of each tree."""
    empty = F.array().cast("array<struct<left:string,right:string>>")
    above = None
    for h in reversed(range(len(levels))):
        own = [c for c in levels[h].columns if c != "n"]
        parts = []
        if h in depths or above is None:
            last = levels[h].where(_ends(h))
            if ends is None:
                last = last.select(*own, empty.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
            else:
                tops = ends.select(F.col("tree").alias("of"), "path", "root")
                last = last.join(tops, F.col("tree").eqNullSafe(F.col("of"))).select(*own, "path", F.col("digest").alias("subroot"), "root")
            parts.append(last)
        if above is not None:
            inner = levels[h].where(~_ends(h)).withColumn("bucket", F.shiftright("lo", FANOUT_BITS * (h + 1)))
            met = inner.alias("own").join(
                above.withColumn("bucket", F.shiftright("lo", FANOUT_BITS * (h + 1))).alias("up"),
                F.col("own.tree").eqNullSafe(F.col("up.tree")) & (F.col("own.bucket") == F.col("up.bucket"))
                & (F.col("up.lo") <= F.col("own.lo")) & (F.col("own.hi") <= F.col("up.hi")),
            )
            outside = lambda side: F.array_join(F.transform(F.filter("up.children", side), lambda c: c["digest"]), "")
            step = F.struct(
                outside(lambda c: c["hi"] <= F.col("own.lo")).alias("left"), outside(lambda c: c["lo"] >= F.col("own.hi")).alias("right")
            )
            parts.append(met.select(*[F.col(f"own.{c}") for c in own], F.concat(F.array(step), F.col("up.path")).alias("path"), "subroot", "root"))
        above = _union(parts)
    return above
