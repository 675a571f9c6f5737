"""De-duplication: content hashes, 64-bit similarity hashes, near-copy edges, representatives, audits.

Near copies must agree on the title (bigram overlap >= .85) and on the body (Hamming distance <= 3).
Both tests are turned into equality joins that miss no pair:

* titles: two sets with overlap >= j differ in few elements, so when a set is cut into two more parts than
  the largest possible difference, at least two parts are identical on both sides;
* bodies: 64 bits cut into six blocks and at most three flipped bits leave three blocks intact.

Joins run over distinct titles and distinct (title, hash) variants; identical copies are linked to their
first row by an aggregate and never paired with each other."""

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from murmur.functions.ranking import top_per_group
from murmur.functions.text import SPACE, effective_length, jaccard, title_features
from murmur.session import cut_lineage, fence

TITLE_OVERLAP = 0.85
MAX_DISTANCE = 3
SHORT_TITLE = 10


def content_hash(text: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    return F.sha2(F.regexp_replace(flat, "^ | $", ""), 256)


def _sign_row(char: str) -> np.ndarray:
    digest = int.from_bytes(hashlib.blake2b(char.encode(), digest_size=8).digest(), "big")
    return np.array([1 if digest >> i & 1 else -1 for i in range(64)], dtype=np.int64)


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """Signed 64-bit similarity hash of a text: one vote per Han, latin or digit character and hash bit.

    Characters of a text are counted first, so each distinct one is hashed and weighed once."""
    signs: dict[int, np.ndarray] = {}
    powers = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))

    def one(text: str | None) -> int:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        keep = (
            ((codes >= 0x4E00) & (codes <= 0x9FFF)) | ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
        )
        found, counts = np.unique(codes[keep], return_counts=True)
        votes = np.zeros(64, dtype=np.int64)
        for code, count in zip(found.tolist(), counts.tolist()):
            if code not in signs:
                signs[code] = _sign_row(chr(code))
            votes += signs[code] * count
        return int(powers[votes >= 0].sum(dtype=np.uint64).astype(np.int64))

    return texts.map(one)


def simhash_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def pair_verdict(pairs: DataFrame) -> DataFrame:
    """Verdict for rows with `(title_a, title_b, hash_a, hash_b, sim_a, sim_b)`."""
    same = F.col("hash_a") == F.col("hash_b")
    short = F.least(effective_length(F.col("title_a")), effective_length(F.col("title_b"))) < SHORT_TITLE
    rows = pairs.withColumns({
        "_j": jaccard(title_features(F.col("title_a")), title_features(F.col("title_b")), 1.0, 0.0),
        "_h": hamming(F.col("sim_a"), F.col("sim_b")),
    })
    j, h = F.col("_j"), F.col("_h")
    near = 1 - h / 64
    dup = (j >= TITLE_OVERLAP) & (h <= MAX_DISTANCE)
    return rows.withColumns({
        "is_duplicate": same | (~short & dup),
        "method": F.when(same, "hash").when(~short & dup, "simhash"),
        "score": F.when(same, 1.0).when(short, F.round(near, 4)).when(dup, F.round((j + near) / 2, 4)).otherwise(F.round(j, 4)),
        "dedup_pending": F.when(same | (~short & dup), False).when(short, h <= MAX_DISTANCE)
        .otherwise((j >= TITLE_OVERLAP) | (h <= MAX_DISTANCE)),
    }).drop("_j", "_h")


def _part_keys(titles: DataFrame) -> DataFrame:
    """One row per key `_sig` of a title set: its size class and two of its parts.

    Size classes grow by 1/j, so overlapping sets lie in the same or in neighbouring classes; a set is
    cut for its own class and for the next one. Within a class sizes are below `limit`, which bounds the
    possible difference. A set is cut into two more parts than that, so two parts are intact on both sides;
    one part alone holds about six bigrams, often none, and would bring together a share of all titles."""
    n = F.size("features").cast("double")
    step = -float(np.log(TITLE_OVERLAP))
    own = F.floor(F.log(n) / step + 1e-9)
    keep = [c for c in titles.columns if c != "features"]
    classes = titles.select(*keep, F.transform("features", lambda f: F.xxhash64(f)).alias("_h"), F.explode(F.array(own, own + 1)).alias("_class"))
    # sizes joined in class c reach up to (1/j)^(c+1); the difference is at most 2 (1-j)/(1+j) of that
    limit = F.exp((F.col("_class") + 1) * step)
    cut = classes.withColumn("_parts", (F.floor(2 * limit * (1 - TITLE_OVERLAP) / (1 + TITLE_OVERLAP) + 1e-9) + 2).cast("int"))
    part = lambda p: F.aggregate(F.filter("_h", lambda h: F.pmod(h, F.col("_parts")) == p), F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(h))
    cut = fence(cut.withColumn("_p", F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), part)).drop("_h"))
    rest = lambda p: F.sequence(p + 1, F.col("_parts") - 1)
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_parts") - 2), lambda p: F.transform(
        rest(p), lambda q: F.xxhash64("_class", p, q, F.get("_p", p), F.get("_p", q)))))
    return cut.select(*keep, F.explode(keys).alias("_sig"))


def similar_titles(titles: DataFrame) -> DataFrame:
    """Pairs `(a, b)`, a < b, of title keys whose bigram overlap reaches the threshold.

    `titles(title_key, features)` holds one row per distinct feature set."""
    return _title_pairs(titles).select("a", "b")


def _title_pairs(titles: DataFrame) -> DataFrame:
    """The pairs of similar_titles() with their overlap.

    Titles that share two parts are many more than similar ones. Each key carries its set's size and the parity, bit by bit, of
    its bigrams' hashes folded to 64 bits: two sets differ in at least as many bigrams as their parities do in bits, so pairs with
    more bits than an overlap at the threshold allows are left out inside the join, before any pair is moved."""
    titles = titles.where(F.size("features") > 0)
    bit = lambda f: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(f, F.lit(1)), F.lit(64)).cast("int"))
    parity = F.aggregate("features", F.lit(0).cast("long"), lambda x, f: x.bitwiseXOR(bit(f)))
    keys = _part_keys(titles.select("title_key", "features", F.size("features").alias("n"), parity.alias("parity")))
    side = lambda c: keys.select(F.col("title_key").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"), "_sig")
    most = (F.col("n_a") + F.col("n_b")) * ((1 - TITLE_OVERLAP) / (1 + TITLE_OVERLAP)) + 1e-9
    met = side("a").join(side("b"), "_sig").where((F.col("a") < F.col("b")) & (hamming(F.col("p_a"), F.col("p_b")) <= most))
    return _overlapping(met.select("a", "b").distinct(), titles.select(F.col("title_key").alias("k"), "features"))


def _overlapping(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs `(a, b, ..)` whose sets `(k, features)` overlap enough, with their overlap."""
    sides = pairs.join(sets.select(F.col("k").alias("a"), F.col("features").alias("_fa")), "a").join(sets.select(F.col("k").alias("b"), F.col("features").alias("_fb")), "b")
    scored = sides.withColumn("_overlap", jaccard(F.col("_fa"), F.col("_fb"), 1.0, 0.0)).drop("_fa", "_fb")
    return scored.where(F.col("_overlap") >= TITLE_OVERLAP)


_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def block_keys(value: Column) -> Column:
    """Twenty keys of a 64-bit hash: each choice of three of its six blocks. Hashes within three bits share one."""
    blocks = [F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1)) for start, width in _BLOCKS]
    keys = [
        F.struct(F.lit(i).alias("no"), F.xxhash64(F.lit(i), *[blocks[b] for b in chosen]).alias("bits"))
        for i, chosen in enumerate(combinations(range(6), 3))
    ]
    return F.array(*keys)


def similar_hashes(hashes: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct hash pairs `(sim_a < sim_b)` within three bits inside the same `scope` columns."""
    keyed = hashes.select(*scope, "sim", F.explode(block_keys(F.col("sim"))).alias("_k")).select(*scope, "sim", "_k.*")
    right = keyed.select(*scope, F.col("sim").alias("_b"), "no", "bits")
    near = keyed.join(right, [*scope, "no", "bits"]).where(
        (F.col("sim") < F.col("_b")) & (hamming(F.col("sim"), F.col("_b")) <= MAX_DISTANCE)
    )
    return near.select(*scope, F.col("sim").alias("sim_a"), F.col("_b").alias("sim_b")).distinct()


def fingerprinted(articles: DataFrame) -> DataFrame:
    """Articles `(article_id, title, clean_content)` with content hash, similarity hash and title set."""
    feats = F.array_sort(title_features(F.col("title")))
    return articles.withColumns({
        "content_hash": content_hash(F.col("clean_content")), "sim": simhash(F.col("clean_content")),
        "features": feats,
        "title_length": effective_length(F.col("title")),
    }).withColumn("title_key", F.md5(F.array_join("features", "\u0001")))


def duplicate_edges(prints: DataFrame) -> DataFrame:
    """Edges `(src, dst, method, score)` between article ids, enough to connect every group of duplicates.

    Equal bodies form a star around their first id. Near copies are found between variants, i.e. distinct
    (title set, similarity hash) combinations, and link the first ids of both variants."""
    cols = cut_lineage(prints.select("article_id", "content_hash", "sim", "title_key", "features", "title_length"))
    first = cols.groupBy("content_hash").agg(F.min("article_id").alias("dst"))
    star = cols.join(first, "content_hash").where(F.col("article_id") != F.col("dst")).select(
        F.col("article_id").alias("src"), "dst", F.lit("hash").alias("method"), F.lit(1.0).alias("score")
    )
    long_titles = cols.where(F.col("title_length") >= SHORT_TITLE)
    variants = long_titles.groupBy("title_key", "sim").agg(
        F.min("article_id").alias("id"), F.first("features").alias("features")
    )
    inside = long_titles.join(variants.select("title_key", "sim", "id"), ["title_key", "sim"]).where(
        F.col("article_id") != F.col("id")
    ).select(F.col("article_id").alias("src"), F.col("id").alias("dst"), F.lit("simhash").alias("method"), F.lit(1.0).alias("score"))

    # variants of one title meet on their hashes; of the titles only distinct ones meet, and their variants then
    variants = cut_lineage(variants)
    titles = variants.groupBy("title_key").agg(F.min("id").alias("t"), F.first("features").alias("features"))
    named = variants.join(titles.select("title_key", "t"), "title_key").select("id", "sim", "t")
    side = lambda c: named.select(F.col("t").alias("t" if c == "a" else "_t"), F.col("sim").alias(f"sim_{c}"), F.col("id").alias(f"id_{c}"))
    same = similar_hashes(named.select("t", "sim"), ["t"]).join(side("a"), ["t", "sim_a"])
    same = same.join(side("b").withColumnRenamed("_t", "t"), ["t", "sim_b"]).withColumn("_overlap", F.lit(1.0))
    met = _title_pairs(titles.select(F.col("t").alias("title_key"), "features"))
    met = met.join(side("a"), F.col("a") == F.col("t")).join(side("b"), (F.col("b") == F.col("_t")) & (hamming(F.col("sim_a"), F.col("sim_b")) <= MAX_DISTANCE))
    needed = ["id_a", "id_b", "sim_a", "sim_b", "_overlap"]
    edges = same.select(*needed).unionByName(met.select(*needed)).select(
        F.greatest("id_a", "id_b").alias("src"), F.least("id_a", "id_b").alias("dst"), F.lit("simhash").alias("method"),
        F.round((F.col("_overlap") + 1 - hamming(F.col("sim_a"), F.col("sim_b")) / 64) / 2, 4).alias("score"))
    return star.unionByName(inside).unionByName(edges)


def pending_reviews(prints: DataFrame) -> DataFrame:
    """Article ids that resemble an earlier one in title or in body only, to be reviewed.

    A body resemblance counts for every article; a title resemblance needs two long titles. Only the first id
    of each distinct hash and title set takes part in the pairing."""
    prints = cut_lineage(prints.select("article_id", "sim", "title_key", "features", "title_length"))
    body = prints.groupBy("sim").agg(F.min("article_id").alias("first"))
    near = similar_hashes(body.select("sim"), [])
    earliest_near = (
        near.select("sim_a", "sim_b").unionByName(near.select(F.col("sim_b").alias("sim_a"), F.col("sim_a").alias("sim_b")))
        .unionByName(body.select(F.col("sim").alias("sim_a"), F.col("sim").alias("sim_b")))
        .join(body.withColumnRenamed("sim", "sim_b"), "sim_b")
        .groupBy(F.col("sim_a").alias("sim")).agg(F.min("first").alias("_body"))
    )
    long_titles = prints.where(F.col("title_length") >= SHORT_TITLE)
    title = long_titles.groupBy("title_key").agg(F.min("article_id").alias("first"), F.first("features").alias("features"))
    # a title is named by its first id, so the smaller name of a pair is what an earlier title gives
    pairs = similar_titles(title.select(F.col("first").alias("title_key"), "features"))
    earlier = pairs.groupBy(F.col("b").alias("first")).agg(F.min("a").alias("_a"))
    earliest_title = title.select("title_key", "first").join(earlier, "first", "left").select("title_key", F.least("first", F.coalesce("_a", "first")).alias("_title"))
    joined = prints.select("article_id", "sim", "title_key", "title_length").join(earliest_near, "sim").join(
        earliest_title, "title_key", "left"
    )
    hit = (F.col("_body") < F.col("article_id")) | (
        (F.col("title_length") >= SHORT_TITLE) & (F.coalesce("_title", "article_id") < F.col("article_id"))
    )
    return joined.where(hit).select("article_id")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """`(node, component)` with the smallest reachable id as component.

    Each round lowers a node to the smallest label around it and then jumps to its label's label, so
    chains collapse in logarithmically many rounds. Labels are pre-aggregated; lineage is cut every round."""
    both = cut_lineage(
        edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        .unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct()
    )
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component")))
    for _ in range(max_rounds):
        around = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("component").alias("_near")
        )
        lowered = labels.join(around, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        moved = cut_lineage(
            lowered.join(jump, "component", "left").select(
                "node", "_old", F.least(F.col("component"), F.coalesce("_next", "component")).alias("component")
            )
        )
        done = moved.where(F.col("_old") != F.col("component")).isEmpty()
        labels = moved.select("node", "component")
        if done:
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")


def elect_representatives(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Best article of every duplicate group, and the pointer of each member to it.

    Order: quality score, not degraded, number of known fields among title, author and time, earliest time, id."""
    groups = connected_components(edges)
    members = articles.join(groups.select(F.col("node").alias("article_id"), "component"), "article_id", "left")
    members = members.withColumn("group_id", F.coalesce("component", "article_id")).drop("component")
    known = sum(
        (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int") for c in ("title", "author", "publish_time")
    )
    rank = F.struct(
        F.coalesce(F.col("quality_score"), F.lit(0.0)), (~F.coalesce("extraction_degraded", F.lit(False))).cast("int"),
        known, -F.coalesce(F.unix_micros("publish_time"), F.lit((1 << 62))), -F.col("article_id"),
    )
    best = members.groupBy("group_id").agg(
        F.max_by("article_id", rank).alias("representative_id"), F.count("*").alias("group_size")
    )
    return members.select("article_id", "group_id").join(best, "group_id").select(
        "article_id", "group_id", "group_size", "representative_id",
        (F.col("article_id") != F.col("representative_id")).alias("is_duplicate"),
        F.when(F.col("article_id") != F.col("representative_id"), F.col("representative_id")).alias("duplicate_of_id"),
    )


def resolve_chains(pointers: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Follow `(article_id, duplicate_of_id)` to the end of each chain; ids on or behind a cycle are flagged.

    A jump doubles the distance covered, so the rounds grow with the logarithm of the longest chain."""
    state = cut_lineage(pointers.select("article_id", F.coalesce("duplicate_of_id", "article_id").alias("root_id")))
    last_moved = None
    for _ in range(max_rounds):
        ahead = state.select(F.col("article_id").alias("root_id"), F.col("root_id").alias("_next"))
        moved = cut_lineage(
            state.join(ahead, "root_id", "left").select(
                "article_id", F.coalesce("_next", "root_id").alias("root_id"), F.col("root_id").alias("_old")
            )
        )
        state = moved.select("article_id", "root_id")
        # every round settles at least one chained id, so a standing count means only cycles still turn
        count = moved.where(F.col("_old") != F.col("root_id")).count()
        if count in (0, last_moved):
            break
        last_moved = count
    else:
        raise RuntimeError("chains did not settle; raise max_rounds")
    # a settled root points at itself; on a cycle no id ever does
    settled = pointers.where("duplicate_of_id is null or duplicate_of_id = article_id").select(
        F.col("article_id").alias("root_id"), F.lit(True).alias("_ok")
    )
    absent = pointers.select(F.col("article_id").alias("root_id"), F.lit(True).alias("_known"))
    return (
        state.join(settled, "root_id", "left").join(absent, "root_id", "left")
        .select("article_id", "root_id",
                (F.col("_known").isNotNull() & F.col("_ok").isNull()).alias("in_cycle"))
    )


def url_collisions(rows: DataFrame) -> DataFrame:
    """Rows `(id, url_hash)` whose canonical address already belongs to a smaller id."""
    owner = rows.groupBy("url_hash").agg(F.min("id").alias("owner_id"), F.count("*").alias("rows"))
    return rows.join(owner.where("rows > 1"), "url_hash").where(F.col("id") != F.col("owner_id")).select(
        "id", "url_hash", "owner_id"
    )


def two_key_dedup(rows: DataFrame, order: str, max_rounds: int = 60) -> DataFrame:
    """Keep a row unless its url key or its (platform, source id) key is held by an earlier kept row.

    Rows are edges between two kinds of keys, settled in row order. In a round a row that is first of the open rows under
    all its keys is kept. One that is first under one key and second under the other is kept exactly if the row before it
    falls; such dependencies form chains that alternate, and their ends are found by pointer doubling with a parity, so a
    chain of any length costs a logarithm of steps in one round. Settled rows go, with all rows under the keys of kept
    ones. The earliest open row is always settled, so the rounds end; `order` must be unique."""
    keyed = rows.select(
        F.col(order).alias("at"), F.concat(F.lit("url:"), F.lower(F.trim(F.coalesce("source_url", F.lit(""))))).alias("u"),
        F.when(F.coalesce("source_article_id", F.lit("")) != "", F.concat_ws(":", F.lit("source"), "platform", "source_article_id")).alias("s"))
    open_rows = cut_lineage(keyed)
    kept = []
    for _ in range(max_rounds):
        marked = open_rows
        for key in ("u", "s"):
            own = marked.where(F.col(key).isNotNull())
            first = own.groupBy(key).agg(F.min("at").alias(f"{key}1"))
            marked = marked.join(first, key, "left")
        marked = cut_lineage(marked)
        for key in ("u", "s"):
            second = marked.where(F.col("at") > F.col(f"{key}1")).groupBy(key).agg(F.min("at").alias(f"{key}2"))
            marked = marked.join(second, key, "left")
        leads = lambda key: F.coalesce(F.col("at") == F.col(f"{key}1"), F.lit(True))
        follows = lambda key: F.coalesce(F.col("at") == F.col(f"{key}2"), F.lit(False))
        waits_for = F.when(leads("u") & follows("s"), F.col("s1")).when(leads("s") & follows("u"), F.col("u1"))
        # under both keys second to one and the same row: that row decides alone
        waits_for = F.coalesce(waits_for, F.when(follows("u") & follows("s") & (F.col("u1") == F.col("s1")), F.col("u1")))
        state = cut_lineage(marked.select("at", "u", "s", (leads("u") & leads("s")).alias("free"), waits_for.alias("before")))
        known = _alternating(state.where("free or before is not null").select("at", "free", "before"))
        now = cut_lineage(state.select("at", "u", "s").join(known.where("stays"), "at").select("at", "u", "s"))
        kept.append(now.select("at"))
        rest = open_rows.join(known.select("at"), "at", "left_anti")
        rest = rest.join(now.select("u"), "u", "left_anti").join(now.where("s is not null").select("s"), "s", "left_anti")
        open_rows = cut_lineage(rest.select("at", "u", "s"))
        if open_rows.isEmpty():
            whole = kept[0]
            for more in kept[1:]:
                whole = whole.unionByName(more)
            return rows.join(whole.withColumnRenamed("at", order), order, "left_semi")
    raise RuntimeError("two-key rows did not settle; raise max_rounds")


def _alternating(nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`(at, stays)` of the nodes whose chain `before` ends in a free node: those at an even distance stay.

    A node that is free stays, its follower falls, the next one stays. Distances double every step."""
    state = cut_lineage(nodes.select("at", F.coalesce("before", "at").alias("end"), F.col("before").isNotNull().alias("odd")))
    for _ in range(max_rounds):
        ahead = state.where("end <> at").select(F.col("at").alias("end"), F.col("end").alias("_end"), F.col("odd").alias("_odd"))
        moved = cut_lineage(state.join(ahead, "end", "left").select(
            "at", F.coalesce("_end", "end").alias("end"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"), F.col("_end").isNotNull().alias("_moved")))
        state = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            free = nodes.where("free").select(F.col("at").alias("end"))
            return state.join(free, "end", "left_semi").select("at", (~F.col("odd")).alias("stays"))
    raise RuntimeError("chains did not settle; raise max_rounds")
