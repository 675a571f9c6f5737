"""Run identities, reuse and attempts, and the article upsert with its snapshot history."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmur.functions.ranking import top_per_group
from murmur.functions.text import SPACE
from murmur.operators.dedup import connected_components
from murmur.session import cut_lineage

FAN_BITS = 12
FAN_OUT = 1 << FAN_BITS


def query_fingerprint(mode: Column, keyword: Column, platforms: Column) -> Column:
    """sha256 of the canonical JSON of a search: keys sorted, platforms lower case, sorted and distinct."""
    names = F.array_sort(F.array_distinct(F.filter(
        F.transform(F.coalesce(platforms, F.array().cast("array<string>")), lambda p: F.lower(F.trim(p))), lambda p: p != "")))
    word = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(keyword, F.lit("")), SPACE, " "), "^ | $", ""))
    kind = F.lower(F.trim(F.coalesce(mode, F.lit("search"))))
    return F.sha2(F.to_json(F.struct(word.alias("keyword"), kind.alias("mode"), names.alias("platforms"))), 256)


def dataset_hash(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Order-free digest of the `(article_id, identity)` rows of each run.

    Identities are hashed in a tree of id ranges with a fixed fan-out, so no task ever concatenates more than `FAN_OUT`
    entries (unless ids repeat) however many articles one run freezes. Six levels of 12 bits take in every 64-bit id,
    negative ones read as unsigned, so each run ends in one node."""
    level = rows.groupBy(run, F.shiftrightunsigned("article_id", FAN_BITS).alias("_node")).agg(_digest("article_id", "identity"))
    for _ in range(5):
        level = level.groupBy(run, F.shiftrightunsigned("_node", FAN_BITS).alias("_up")).agg(_digest("_node", "_hash")).withColumnRenamed("_up", "_node")
    return level.select(run, F.col("_hash").alias("dataset_hash"))


def _digest(key: str, value: str) -> Column:
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.format_string("%020d", F.col(key)), F.col(value))))
    return F.sha2(F.array_join(parts, "\n"), 256).alias("_hash")


def changed_identities(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Frozen rows whose content identity is gone or differs now; an empty result lets the run go on."""
    now = current.select("article_id", F.col("identity").alias("_now"))
    return frozen.join(now, "article_id", "left").where(~F.col("identity").eqNullSafe(F.col("_now"))).drop("_now")


def search_cache(runs: DataFrame, versions: dict[str, str], config_hash: str, now: Column) -> DataFrame:
    """Newest successful shared run per query fingerprint under the same configuration and model versions."""
    same = (F.col("scope") == "search_shared") & (F.col("status") == "success") & (F.col("config_hash") == config_hash)
    for name, value in versions.items():
        same = same & (F.col("versions")[name] == value)
    newest = top_per_group(runs.where(same), ["query_fingerprint"], [F.desc_nulls_last("completed_at"), F.desc("run_id")], 1, "_rn")
    stale = F.coalesce(now >= F.col("cache_expires_at"), F.lit(True))
    return newest.drop("_rn").withColumns({"stale": stale, "cached": ~stale})


def next_attempt(requests: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """For each requested key: reuse the last attempt unless it failed, else the number of a new attempt."""
    last = runs.groupBy(*key).agg(F.max_by(F.struct("run_id", "status", "attempt"), "attempt").alias("_l"))
    joined = requests.join(last, key, "left")
    reuse = F.col("_l").isNotNull() & (F.col("_l.status") != "failed")
    return joined.select(
        *requests.columns, F.coalesce(reuse, F.lit(False)).alias("reused"), F.when(reuse, F.col("_l.run_id")).alias("run_id"),
        F.when(reuse, F.col("_l.attempt")).otherwise(F.coalesce(F.col("_l.attempt"), F.lit(0)) + 1).alias("attempt"),
    )


def best_cluster(clusters: DataFrame) -> DataFrame:
    """Largest, then most confident, then first cluster of each run."""
    order = [F.desc("member_count"), F.desc("confidence"), F.asc("cluster_id")]
    return top_per_group(clusters, ["run_id"], order, 1, "_rn").drop("_rn")


# ---- articles and snapshots

_METRICS = ("comments_count", "reposts_count", "likes_count", "views_count")


def match_existing(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Attach the id of the stored article with the same address hash or the same platform and source id.

    The two ways to match are two equality joins, united before the smallest id is taken."""
    by_url = incoming.join(existing.select("url_hash", F.col("article_id").alias("_m")), "url_hash").select("doc_id", "_m")
    keyed = existing.where("source_article_id is not null").select("platform", "source_article_id", F.col("article_id").alias("_m"))
    by_source = incoming.where("source_article_id is not null").join(keyed, ["platform", "source_article_id"]).select("doc_id", "_m")
    matched = by_url.unionByName(by_source).groupBy("doc_id").agg(F.min("_m").alias("matched_id"))
    return incoming.join(matched, "doc_id", "left")


def upsert_articles(existing: DataFrame, incoming: DataFrame, id_base: Column | None = None) -> DataFrame:
    """Article table after a batch: identity fields survive, content fields are replaced by the newest post,
    the content version counts raw-content changes. New articles get `article_id = doc_id` unless told otherwise.

    `existing(article_id, platform, source_article_id, url_hash, raw_hash, content_version, title, ...)`,
    `incoming(doc_id, platform, source_article_id, url_hash, raw_hash, title, crawled_at)`."""
    found = match_existing(incoming, existing)
    # new rows are one article if an address or a (platform, source id) connects them
    by_url, by_source = F.concat(F.lit("u"), F.col("url_hash")), F.concat_ws(":", F.lit("s"), "platform", "source_article_id")
    ties = found.where("matched_id is null and url_hash is not null and platform is not null and source_article_id is not null")
    groups = connected_components(ties.select(by_url.alias("src"), by_source.alias("dst")).distinct())
    single = F.when(F.col("url_hash").isNotNull(), by_url).when(F.col("source_article_id").isNotNull(), by_source).otherwise(F.concat(F.lit("d"), F.col("doc_id")))
    matched = found.withColumn("_node", single).join(groups.select(F.col("node").alias("_node"), "component"), "_node", "left").withColumn(
        "_key", F.coalesce(F.concat(F.lit("a"), F.col("matched_id").cast("string")), "component", "_node")).drop("_node", "component")
    latest = matched.groupBy("_key").agg(
        F.max_by(F.struct("doc_id", "platform", "source_article_id", "url_hash", "raw_hash", "title", "crawled_at"),
                 F.struct("crawled_at", "doc_id")).alias("n"),
        F.min("doc_id").alias("_first"), F.max("matched_id").alias("article_id"),
    )
    old = existing.alias("o")
    updated = old.join(latest.alias("l"), F.col("o.article_id") == F.col("l.article_id"), "left").select(
        "o.article_id", "o.platform", "o.source_article_id", "o.url_hash",
        F.coalesce("l.n.title", "o.title").alias("title"), F.coalesce("l.n.raw_hash", "o.raw_hash").alias("raw_hash"),
        (F.coalesce("o.content_version", F.lit(1)) + F.when(F.col("l.n.raw_hash") != F.col("o.raw_hash"), 1).otherwise(0)).cast("int").alias("content_version"),
        F.when(F.col("l.n").isNull(), "kept").otherwise("updated").alias("action"),
    )
    fresh = latest.where("article_id is null").select(
        F.col("_first").alias("article_id"), "n.platform", "n.source_article_id", "n.url_hash", "n.title", "n.raw_hash",
        F.lit(1).alias("content_version"), F.lit("created").alias("action"),
    )
    return updated.unionByName(fresh)


#: Visits of a post are cut into slices of this many seconds; windows see one slice, or the list of a post's slices.
SLICE_SECONDS = 900


def snapshot_rows(observations: DataFrame, throttle_seconds: int = 3600, max_rounds: int = 60) -> DataFrame:
    """Observations worth storing: the first, every content or status change, and metric changes at least one
    hour after the last stored one. Raw content is kept only where it changed.

    A visit whose state differs from the visit before is always stored, so a post falls into stretches of equal state. In a
    stretch every visit points to the one that would be stored after it: the first an hour on whose metrics differ, either
    that visit or the next change of metrics behind it. The stored ones are those that the pointers reach from the heads of
    the stretches, found by doubling. Slices of time bound the windows, so a post may have any number of visits."""
    order = ["_t", "observation_id"]
    o = observations.select(
        "article_id", "observation_id", F.unix_micros("crawled_at").alias("_t"), "content_hash",
        F.xxhash64(F.col("content_hash"), F.coalesce("http_status", F.lit(-1)), F.coalesce("fetch_status", F.lit("")), F.coalesce("fetch_error", F.lit(""))).alias("_state"),
        F.xxhash64(*[F.coalesce(F.col(m).cast("long"), F.lit(-1)) for m in _METRICS]).alias("_metrics"))
    width = SLICE_SECONDS * 1_000_000
    o = o.withColumns({"_slice": F.floor(F.col("_t") / width), "_at": F.struct(*order)})
    key = ["article_id", "_slice"]
    inside = W.partitionBy(*key).orderBy(*order)
    slices = o.groupBy(*key).agg(F.max_by(F.struct("_state", "_metrics", "content_hash"), "_at").alias("_last"))
    slices = slices.withColumn("_before", F.lag("_last").over(W.partitionBy("article_id").orderBy("_slice")))
    own = F.struct("_state", "_metrics", "content_hash")
    v = o.withColumn("_prev", F.lag(own).over(inside)).join(slices.drop("_last"), key).withColumn("_prev", F.coalesce("_prev", "_before")).drop("_before")
    v = cut_lineage(v.withColumns({
        "_head": F.col("_prev").isNull() | (F.col("_prev._state") != F.col("_state")), "_turn": F.col("_prev").isNull() | (F.col("_prev._metrics") != F.col("_metrics")),
        "_renewed": F.col("_prev").isNull() | F.coalesce(F.col("_prev.content_hash") != F.col("content_hash"), F.lit(True))}).drop("_prev"))
    # behind every visit: the next head and the next change of metrics, in its slice or the first of a later slice
    later, behind = inside.rowsBetween(1, W.unboundedFollowing), W.partitionBy("article_id").orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    firsts = v.groupBy(*key).agg(F.min("_at").alias("_first"), F.min(F.when(F.col("_head"), F.col("_at"))).alias("_h"), F.min(F.when(F.col("_turn"), F.col("_at"))).alias("_m"))
    firsts = firsts.select(*key, *[F.min(c).over(behind).alias(f"{c}_behind") for c in ("_first", "_h", "_m")])
    v = v.withColumns({"_next_head": F.min(F.when(F.col("_head"), F.col("_at"))).over(later), "_next_turn": F.min(F.when(F.col("_turn"), F.col("_at"))).over(later)})
    v = v.join(firsts, key).withColumns({"_next_head": F.coalesce("_next_head", "_h_behind"), "_next_turn": F.coalesce("_next_turn", "_m_behind")})
    v = cut_lineage(v.drop("_h_behind", "_m_behind"))
    # an hour on: the first visit at or behind that moment, in the moment's slice or the first of a later one
    due = F.col("_t") + throttle_seconds * 1_000_000
    asked = v.select("article_id", F.floor(due / width).alias("_slice"), F.struct(due.alias("_t"), F.lit(-(1 << 63)).alias("observation_id")).alias("_at"), F.col("_at").alias("_from"))
    every = v.select("article_id", "_slice", "_at", F.lit(None).cast(v.schema["_at"].dataType).alias("_from"), F.col("_at").alias("_visit")).unionByName(
        asked.withColumn("_visit", F.lit(None).cast(v.schema["_at"].dataType)))
    met = every.withColumn("_found", F.min("_visit").over(W.partitionBy(*key).orderBy("_at").rowsBetween(W.currentRow, W.unboundedFollowing)))
    met = met.where("_from is not null").select("article_id", "_slice", "_from", "_found")
    # slices without visits have no row of their own: the next one is looked up in the order of slices
    marks = firsts.select(*key).join(v.groupBy(*key).agg(F.min("_at").alias("_low")), key)
    wanted = met.where("_found is null").select(*key).distinct().withColumn("_low", F.lit(None).cast(v.schema["_at"].dataType))
    ahead = marks.unionByName(wanted).groupBy(*key).agg(F.min("_low").alias("_low"))
    ahead = ahead.withColumn("_ahead", F.min("_low").over(behind)).select(*key, "_ahead")
    met = met.join(ahead, key, "left").select("article_id", F.col("_from").alias("_at"), F.coalesce("_found", "_ahead").alias("_due"))
    there = v.select("article_id", F.col("_at").alias("_due"), F.col("_metrics").alias("_then"), F.col("_next_turn").alias("_then_turn"))
    to = F.when(F.col("_then") != F.col("_metrics"), F.col("_due")).otherwise(F.col("_then_turn"))
    pointers = v.join(met, ["article_id", "_at"]).join(there, ["article_id", "_due"]).withColumn("_to", to).where(
        F.col("_to").isNotNull() & (F.col("_next_head").isNull() | (F.col("_to") < F.col("_next_head"))))
    jumps = cut_lineage(pointers.select("article_id", "_at", "_to"))
    stored = cut_lineage(v.where("_head").select("article_id", "_at"))
    for _ in range(max_rounds):
        if jumps.isEmpty():
            break
        stored = cut_lineage(stored.unionByName(stored.join(jumps, ["article_id", "_at"]).select("article_id", F.col("_to").alias("_at"))).distinct())
        onward = jumps.select("article_id", F.col("_at").alias("_to"), F.col("_to").alias("_beyond"))
        jumps = cut_lineage(jumps.join(onward, ["article_id", "_to"]).select("article_id", "_at", F.col("_beyond").alias("_to")))
    else:
        raise RuntimeError("stored rows did not settle; raise max_rounds")
    # the content of the last stored row is that of the visit before: inside a stretch of one state it never changes
    kept = v.join(stored, ["article_id", "_at"]).select("observation_id", "_renewed")
    return observations.join(kept.withColumnRenamed("_renewed", "content_changed"), "observation_id")


def processing_log(preprocessed: DataFrame, key: str) -> DataFrame:
    """One row per stage and document, followed by the row of the write itself."""
    done = F.struct(F.lit("persist").alias("stage"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_code"))
    entries = F.concat("logs", F.array(done))
    return preprocessed.select(key, F.posexplode(entries).alias("step", "e")).select(key, "step", "e.*")
