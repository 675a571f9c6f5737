"""Hot lists: title keys, reciprocal rank fusion, seed merging, daily runs, seed expansion."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmur.functions.ranking import top_overall, top_per_group
from murmur.functions.text import hot_key, normalize_hot_title, normalize_seed_title


def fuse_rankings(items: DataFrame, rrf_k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of `items(source, rank, title, source_url, payload)`.

    Titles are normalised to a key; a source contributes its best row per key, the shown title is the
    smallest (rank, source, title) over all rows of the key."""
    clean = items.select(
        F.lower(F.trim("source")).alias("source"), F.col("rank").cast("long").alias("rank"),
        normalize_hot_title(F.col("title")).alias("title"), "source_url", "payload",
    ).withColumn("key", hot_key(F.col("title")))
    clean = clean.where((F.col("source") != "") & (F.col("rank") >= 1) & (F.col("key") != ""))
    per_source = clean.groupBy("key", "source").agg(
        F.min_by(F.struct("rank", "source_url", "payload"), F.struct("rank", "title")).alias("best"),
        F.min(F.struct("rank", "source", "title")).alias("shown"),
    )
    # one row per source remains, so the collected lists are bounded by the number of hot-list sources
    entry = F.struct("source", F.col("best.rank").alias("rank"), F.col("best.source_url").alias("url"),
                     F.col("best.payload").alias("payload"))
    fused = per_source.groupBy("key").agg(
        F.min("shown").alias("shown"),
        F.sum(1.0 / (rrf_k + F.col("best.rank"))).alias("fused_score"),
        F.count("*").alias("source_count"),
        F.min("best.rank").alias("best_rank"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    linked = F.filter("entries", lambda e: F.coalesce(e["url"], F.lit("")) != "")
    out = fused.select(
        "key", F.col("shown.title").alias("title"), F.round("fused_score", 12).alias("fused_score"),
        "source_count", "best_rank",
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["source"], e["rank"]))).alias("source_ranks"),
        F.map_from_entries(F.transform(linked, lambda e: F.struct(e["source"], e["url"]))).alias("source_urls"),
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["source"], e["payload"])))
        .alias("source_payloads"),
    )
    order = [F.desc("fused_score"), F.desc("source_count"), F.asc("best_rank"), F.asc("title")]
    return out if limit is None else top_overall(out, order, limit)


def list_rank(raw_json: Column, position: Column) -> Column:
    """Rank told by the payload (`rank`, else `realpos`), else the position in the list."""
    told = F.coalesce(
        F.nullif(F.get_json_object(raw_json, "$.rank"), F.lit("0")), F.get_json_object(raw_json, "$.realpos")
    ).try_cast("int")
    return F.when(told > 0, told).otherwise(position)


def daily_run(
    landed: DataFrame, requested: list[str], run_date: Column, previous_runs: DataFrame | None = None,
    source_limit: int = 30, result_limit: int = 10, rrf_k: int = 60,
) -> tuple[DataFrame, DataFrame]:
    """One refresh over landed hot lists `(source, position, title, source_url, raw_json)`.

    Returns the run header (status, available and failed sources, attempt) and the fused items."""
    spark = landed.sparkSession
    source_limit, result_limit = max(1, min(source_limit, 100)), max(1, min(result_limit, 100))
    wanted = spark.createDataFrame([(s,) for s in sorted({s.strip().casefold() for s in requested})], "source string")
    pool = landed.withColumn("source", F.lower(F.trim("source"))).join(F.broadcast(wanted), "source", "left_semi")
    head = top_per_group(pool, ["source"], [F.asc("position")], source_limit, "_rn")
    usable = head.where(normalize_hot_title(F.col("title")) != "").select(
        "source", list_rank(F.col("raw_json"), F.col("_rn")).alias("rank"), "title", "source_url",
        F.col("raw_json").alias("payload"),
    )
    items = fuse_rankings(usable, rrf_k, result_limit)
    counts = wanted.join(usable.groupBy("source").agg(F.count("*").alias("n")), "source", "left")
    header = counts.agg(
        F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("source")))).alias("available_sources"),
        F.array_sort(F.collect_set(F.when(F.col("n").isNull(), F.col("source")))).alias("failed_sources"),
    )
    status = (
        F.when(F.size("available_sources") == 0, "failed")
        .when(F.size("failed_sources") > 0, "partial").otherwise("success")
    )
    attempt = F.lit(1)
    if previous_runs is not None:
        last = previous_runs.groupBy("run_date").agg(F.max("attempt").alias("_last"))
        header = header.withColumn("run_date", run_date).join(last, "run_date", "left")
        attempt = F.coalesce("_last", F.lit(0)) + 1
    header = header.select(
        run_date.alias("run_date"), status.alias("status"), attempt.alias("attempt"),
        "available_sources", "failed_sources",
    )
    return header, items


def reusable_run(runs: DataFrame, now: Column, ttl_seconds: int = 900) -> DataFrame:
    """Newest attempt per (date, config) that is still fresh enough to be served instead of a refresh."""
    newest = top_per_group(runs, ["run_date", "config_hash"], [F.desc("attempt"), F.desc("run_id")], 1, "_rn")
    age = F.unix_seconds(now) - F.unix_seconds("completed_at")
    return newest.where(F.col("status").isin("success", "partial") & (age <= ttl_seconds)).drop("_rn")


def latest_run(runs: DataFrame, items: DataFrame, now: Column, limit: int = 10, ttl_seconds: int = 900) -> DataFrame:
    """Items of the newest run with a staleness flag."""
    newest = runs.orderBy(F.desc("run_date"), F.desc("attempt"), F.desc("run_id")).limit(1)
    stale = F.coalesce(F.unix_seconds(now) - F.unix_seconds("completed_at") > ttl_seconds, F.lit(True))
    served = newest.select("run_id", "run_date", "status", stale.alias("stale")).join(items, "run_id")
    return served.orderBy("rank").limit(max(1, min(int(limit), 100)))


def merge_seeds(seeds: DataFrame) -> DataFrame:
    """Group hot-list rows `(seed_id, platform, title, rank, snapshot_time)` by normalised title.

    Platforms are de-duplicated before they are collected; seed ids stay countable through `seed_count`."""
    clean = seeds.withColumn("query", normalize_seed_title(F.col("title"))).where("query <> ''")
    per_platform = clean.groupBy("query", "platform").agg(
        F.min("rank").alias("rank"), F.countDistinct("seed_id").alias("_seeds"),
        F.min("snapshot_time").alias("first"), F.max("snapshot_time").alias("last"),
    )
    return per_platform.groupBy("query").agg(
        F.array_sort(F.collect_list("platform")).alias("platforms"),
        F.min("rank").alias("best_rank"), F.sum("_seeds").alias("seed_count"),
        F.min("first").alias("first_seen_at"), F.max("last").alias("last_seen_at"),
    )


def seed_order() -> list[Column]:
    return [F.asc_nulls_last("best_rank"), F.desc(F.size("platforms")), F.asc("query")]


def seed_members(seeds: DataFrame) -> DataFrame:
    """Bridge (query, seed_id): which list rows a merged seed came from."""
    return seeds.select(normalize_seed_title(F.col("title")).alias("query"), "seed_id").where("query <> ''").distinct()


def expansion_bridge(seeds: DataFrame, found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Seed x found article rows, unique per (seed, query, article), without those already stored.

    `found(search_query, article_id, platform)` is what searching each merged seed brought in."""
    best = merge_seeds(seeds).select("query", F.col("best_rank").alias("source_rank"))
    bridge = (
        seed_members(seeds).join(best, "query")
        .join(found.withColumnRenamed("search_query", "query"), "query")
        .select(F.col("seed_id").alias("seed_article_id"), F.col("query").alias("search_query"),
                "article_id", "platform", "source_rank")
        .dropDuplicates(["seed_article_id", "search_query", "article_id"])
    )
    if existing is None:
        return bridge
    return bridge.join(existing, ["seed_article_id", "search_query", "article_id"], "left_anti")
