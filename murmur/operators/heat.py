"""Event heat: engagement percentiles, windowed report counts, spread, fused heat, eligibility, ranking.

Inputs: `articles(event_id, article_id, platform, publish_time, observed_at, is_representative,
comments_count, reposts_count, likes_count, views_count, duplicate_weight, spam_weight)` and
`ranks(event_id, hot_rank)`. `calculated_at` is a timestamp literal, never the wall clock."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmur.config import METRICS, HeatConfig
from murmur.functions.ranking import percentile_table, top_overall, top_per_group, with_percentile
from murmur.session import cut_lineage

HOUR_US = 3_600_000_000


def effective_time(df_time: str = "publish_time", fallback: str = "observed_at") -> Column:
    return F.coalesce(F.col(df_time), F.col(fallback))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(HOUR_US))


def freshness(hours: Column, half_life_hours: float) -> Column:
    """100 at age zero, halved every half life; the future counts as age zero."""
    decayed = 100 * F.exp(-F.log(F.lit(2.0)) * F.greatest(F.lit(0.0), hours) / F.lit(float(half_life_hours)))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), decayed))


def time_confidence(reliable: Column, total: Column) -> Column:
    ratio = reliable / total
    return (
        F.when(total == 0, "low").when(ratio >= 0.8, "high").when(ratio >= 0.5, "medium").otherwise("low")
    )


def coalesce_metrics(articles: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest snapshot metric where known, else the article's; unknown weights are 1, explicit 0 stays."""
    snap = snapshots.select(
        F.col("snapshot_id").alias("latest_snapshot_id"), *[F.col(m).alias(f"_s_{m}") for m in METRICS]
    )
    joined = articles.join(snap, "latest_snapshot_id", "left")
    return joined.withColumns(
        {m: F.coalesce(f"_s_{m}", m) for m in METRICS}
        | {w: F.coalesce(F.col(w).cast("double"), F.lit(1.0)) for w in ("duplicate_weight", "spam_weight")}
    ).drop(*[f"_s_{m}" for m in METRICS])


def _json_empty(value: Column) -> Column:
    """Absent, null, zero, false or empty text: the next key is asked instead."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    zero = F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False)) & (kind != "STRING") & (kind != "BOOLEAN")
    return value.isNull() | (kind == "VOID") | zero | ((kind == "STRING") & (text == "")) | ((kind == "BOOLEAN") & (text == "false"))


def _json_int(value: Column) -> Column:
    """A whole JSON number; a number in quotes or any other text is no rank."""
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "int"))


def hotlist_ranks(expansions: DataFrame, hot_articles: DataFrame) -> DataFrame:
    """Rank evidence per event: seed expansion rows plus the list position in a hot-list article's payload."""
    payload = F.try_parse_json("raw_json")
    rank, place = (F.try_variant_get(payload, f"$.{k}", "variant") for k in ("rank", "realpos"))
    own = _json_int(F.when(_json_empty(rank), place).otherwise(rank))
    from_payload = hot_articles.where(F.col("source_type") == "hotlist").select(
        "event_id", own.alias("hot_rank")
    )
    from_seeds = expansions.select("event_id", F.col("source_rank").cast("int").alias("hot_rank"))
    return from_seeds.unionByName(from_payload).where("hot_rank is not null")


def engagement_percentiles(articles: DataFrame, population: Sequence[str] = ()) -> DataFrame:
    """Long table (article, metric, score): percentile of ln(1+metric) inside each platform and metric."""
    keys = list(dict.fromkeys(["event_id", "article_id", "platform", *population]))
    long = (
        articles.select(*keys, *[F.col(m).cast("double").alias(m) for m in METRICS])
        .withColumn("platform", F.coalesce("platform", F.lit("")))
        .unpivot(keys, list(METRICS), "metric", "value")
        .where("value is not null")
        .withColumn("value", F.log1p(F.greatest(F.lit(0.0), F.col("value"))))
    )
    return with_percentile(long, "value", [*population, "platform", "metric"])


def _own_signal(articles: DataFrame, population: Sequence[str]) -> DataFrame:
    """Weighted mean percentile of all articles of an event that is ranked within itself, `(event_id, _own)`.

    An article's weight times the mean of its scores is the sum of its scores, each with its share of the weight. So
    shares are summed with the value counts and meet their percentile there; no score travels back to its article."""
    present = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0))
    of_id = W.partitionBy("event_id", "article_id")  # the rows of one article id
    keys = list(dict.fromkeys(["event_id", *population, "platform"]))
    rows = (
        articles.select(*dict.fromkeys([*keys, "article_id", "_weight"]), *[F.when(F.col(m).isNotNull(), F.log1p(F.greatest(F.lit(0.0), F.col(m).cast("double")))).alias(m) for m in METRICS])
        .where("event_id is not null and article_id is not null").withColumn("platform", F.coalesce("platform", F.lit("")))
        .withColumn("_share", F.try_divide(F.sum("_weight").over(of_id), F.sum(present).over(of_id)))
    )
    long = rows.select(*keys, "_share", *METRICS).unpivot([*keys, "_share"], list(METRICS), "metric", "value").where("value is not null")
    table = percentile_table(long, "value", [*keys, "metric"], total="_share")
    return table.groupBy("event_id").agg(F.sum(F.col("score") * F.col("_share")).alias("_own"))


def report_statistics(articles: DataFrame, calculated_at: Column, cfg: HeatConfig = HeatConfig()) -> DataFrame:
    """Independent report counts, growth, platforms and latest activity of every event."""
    age = hours_between(calculated_at, effective_time())
    inside = (age >= 0) & (age <= cfg.window_days * 24)
    rep = F.coalesce(F.col("is_representative") & inside, F.lit(False))
    flagged = articles.select(
        "event_id", "publish_time", "observed_at",
        F.when(rep, F.nullif("platform", F.lit(""))).alias("_platform"),
        rep.alias("_rep"), age.alias("_age"),
        F.when(inside, effective_time()).alias("_active"),
    )
    counts = flagged.groupBy("event_id").agg(
        F.count_if("_rep").alias("reports_7d"),
        F.count_if(F.col("_rep") & (F.col("_age") <= 24)).alias("reports_24h"),
        F.count_if(F.col("_rep") & (F.col("_age") > 24) & (F.col("_age") <= 48)).alias("reports_prev_24h"),
        F.count_if(F.col("_rep") & F.col("publish_time").isNull() & F.col("observed_at").isNotNull())
        .alias("observed_time_count"),
        F.count_if(F.col("_rep") & F.col("publish_time").isNotNull()).alias("_reliable"),
        F.countDistinct("_platform").alias("platform_count"),
        F.max("_active").alias("latest_activity"),
    )
    growth = (F.col("reports_24h") - F.col("reports_prev_24h")) / F.greatest(F.col("reports_prev_24h"), F.lit(1))
    return counts.withColumns({
        "growth_rate": growth,
        "time_confidence": time_confidence(F.col("_reliable"), F.col("reports_7d")),
    }).drop("_reliable")


def spread_raw(
    articles: DataFrame, ranks: DataFrame, calculated_at: Column, cfg: HeatConfig = HeatConfig(),
    population: Sequence[str] = (),
) -> DataFrame:
    """Decayed, weighted engagement of all articles plus the mean hot-list score; null when neither exists.

    The sum is rounded to 9 digits so that the order of summation cannot split ties."""
    # the age is measured on the article row once; duplicates of an id inside an event stay apart rows
    age = hours_between(calculated_at, F.coalesce(effective_time(), calculated_at))
    weight = (
        freshness(age, cfg.half_life_hours) / 100
        * F.greatest(F.lit(0.0), F.coalesce(F.col("duplicate_weight").cast("double"), F.lit(0.0)))
        * F.greatest(F.lit(0.0), F.coalesce(F.col("spam_weight").cast("double"), F.lit(0.0)))
    )
    if "event_id" in population:
        own = _own_signal(articles.withColumn("_weight", weight), population)
    else:
        signal = (
            engagement_percentiles(articles, population).groupBy("event_id", "article_id")
            .agg(F.avg("score").alias("_signal"))
        )
        own = (
            articles.select("event_id", "article_id", weight.alias("_weight"))
            .join(signal, ["event_id", "article_id"])
            .groupBy("event_id").agg(F.sum(F.col("_signal") * F.col("_weight")).alias("_own"))
        )
    listed = ranks.groupBy("event_id").agg(
        F.avg(F.greatest(F.lit(0.0), 100.0 - (F.greatest(F.lit(1), F.col("hot_rank")) - 1) * 5.0)).alias("_listed"),
        F.count("*").alias("hotlist_count"),
        F.min("hot_rank").alias("best_hotlist_rank"),
    )
    return own.join(listed, "event_id", "full").select(
        "event_id",
        F.round(F.coalesce("_own", F.lit(0.0)) + F.coalesce("_listed", F.lit(0.0)), 9).alias("spread_raw"),
        F.coalesce("hotlist_count", F.lit(0)).alias("hotlist_count"),
        "best_hotlist_rank",
    )


def heat_scores(events: DataFrame, calculated_at: Column, cfg: HeatConfig = HeatConfig(),
                population: Sequence[str] = ()) -> DataFrame:
    """Core, spread and final heat from per-event statistics.

    The four percentile columns go through one long table, so the statistics are ranked in one pass."""
    by = list(population)
    measures = ["reports_7d", "growth_rate", "platform_count", "spread_raw"]
    long = events.select(
        "event_id", *[c for c in by if c != "event_id"], *[F.col(m).cast("double").alias(m) for m in measures]
    ).unpivot(list(dict.fromkeys(["event_id", *by])), measures, "measure", "value")
    ranked = with_percentile(long.where("value is not null"), "value", [*by, "measure"])
    scores = ranked.groupBy("event_id").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("score"))).alias(f"_p_{m}") for m in measures]
    )
    hours = F.coalesce(
        hours_between(calculated_at, F.col("latest_activity")), F.lit(float(cfg.window_days * 24))
    )
    joined = events.join(scores, "event_id").withColumns({
        "report_score": F.col("_p_reports_7d"),
        "growth_score": F.col("_p_growth_rate"),
        "platform_score": F.col("_p_platform_count"),
        "freshness_score": F.round(freshness(hours, cfg.half_life_hours), 6),
        "spread_heat": F.col("_p_spread_raw"),
    })
    core = F.round(
        (F.col("report_score") + F.col("growth_score") + F.col("platform_score") + F.col("freshness_score")) / 4, 6
    )
    joined = joined.withColumn("core_heat", core)
    final = F.when(F.col("spread_heat").isNull(), F.col("core_heat")).otherwise(
        F.round(cfg.core_weight * F.col("core_heat") + cfg.spread_weight * F.col("spread_heat"), 6)
    )
    warnings = F.when(F.col("spread_heat").isNull(), F.array(F.lit("SPREAD_DATA_UNAVAILABLE"))).otherwise(
        F.array().cast("array<string>")
    )
    return joined.withColumns({"final_heat": final, "warnings": warnings}).drop(*[f"_p_{m}" for m in measures])


def eligibility(calculated_at: Column, cfg: HeatConfig = HeatConfig()) -> Column:
    recent = hours_between(calculated_at, F.col("latest_activity")) <= cfg.recent_activity_hours
    return (
        (F.col("reports_7d") >= cfg.minimum_reports)
        & ((F.col("platform_count") >= cfg.minimum_platforms) | (F.col("hotlist_count") > 0))
        & F.coalesce(recent, F.lit(False))
    )


def rank_hot(events: DataFrame, cfg: HeatConfig = HeatConfig(), population: Sequence[str] = ()) -> DataFrame:
    """Number the hottest eligible events; all others keep a null rank."""
    order = [F.desc("final_heat"), F.asc("event_id")]
    pool = events.where("eligible_as_hot").select("event_id", "final_heat", *population)
    if population:
        top = top_per_group(pool, population, order, cfg.ranking_limit, "hot_rank")
    else:
        top = top_overall(pool, order, cfg.ranking_limit, "hot_rank")
    return events.join(top.select("event_id", "hot_rank"), "event_id", "left")


def event_heat(
    articles: DataFrame, ranks: DataFrame, calculated_at: Column, cfg: HeatConfig = HeatConfig(),
    population: Sequence[str] = (),
) -> DataFrame:
    """All heat columns of every event. The percentile population is the whole input, or one slice of it
    per `population` value; `population=["event_id"]` scores each event on its own."""
    stats = report_statistics(articles, calculated_at, cfg)
    spread = spread_raw(articles, ranks, calculated_at, cfg, population)
    joined = stats.join(spread, "event_id", "left").withColumn(
        "hotlist_count", F.coalesce("hotlist_count", F.lit(0))
    )
    slices = [c for c in population if c != "event_id"]
    if slices:
        joined = joined.join(articles.select("event_id", *slices).distinct(), "event_id")
    # one row per event, read by the ranking pass and by the join back: written once instead of scanning articles again
    joined = cut_lineage(joined)
    scored = heat_scores(joined, calculated_at, cfg, population)
    scored = cut_lineage(scored.withColumn("eligible_as_hot", eligibility(calculated_at, cfg)))
    return rank_hot(scored, cfg, population)


def status_changes(snapshots: DataFrame) -> DataFrame:
    """Label each heat snapshot against the event's previous one."""
    window = W.partitionBy("event_id").orderBy("calculated_at", "snapshot_id")
    was = F.lag("eligible_as_hot").over(window)
    before = F.lag("final_heat").over(window)
    now, heat = F.col("eligible_as_hot"), F.col("final_heat")
    label = (
        F.when(was.isNull(), F.when(now, "new_hot").otherwise("stable"))
        .when(~now & was, "left_hot")
        .when(now & ~was, "reheated")
        .when(heat > before + 5, "rising")
        .when(heat < before - 5, "cooling")
        .otherwise("stable")
    )
    return snapshots.withColumn("status_change", label)


def left_hot_sweep(current: DataFrame, run_heat: DataFrame, calculated_at: Column) -> DataFrame:
    """Zero snapshots for hot events a newer global run did not see, unless they hold newer state."""
    gone = current.where("is_hot").join(run_heat.select("event_id"), "event_id", "left_anti")
    return gone.where(F.col("calculated_at") <= calculated_at).select(
        "event_id", calculated_at.alias("calculated_at"), F.lit(0.0).alias("core_heat"),
        F.lit(None).cast("double").alias("spread_heat"), F.lit(0.0).alias("final_heat"),
        F.lit(False).alias("eligible_as_hot"), F.lit(None).cast("int").alias("hot_rank"),
        F.lit("left_hot").alias("status_change"),
    )


def current_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per event, whatever order the runs were written in."""
    columns = [c for c in snapshots.columns if c != "event_id"]
    newest = F.max_by(F.struct(*columns), F.struct("calculated_at", "snapshot_id")).alias("_s")
    return snapshots.groupBy("event_id").agg(newest).select("event_id", "_s.*")


def dominant_topic(members: DataFrame) -> DataFrame:
    """Most frequent primary topic of an event; equal counts fall to the smaller topic."""
    counts = members.where("topic is not null").groupBy("event_id", "topic").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("topic", "n"), F.struct(F.col("n"), -F.col("topic"))).alias("_b")
    return counts.groupBy("event_id").agg(best).select(
        "event_id", F.col("_b.topic").alias("topic"), F.col("_b.n").alias("topic_articles")
    )


def current_hot_list(heat: DataFrame, events: DataFrame, limit: int = 20) -> DataFrame:
    """Served hot list: ranked events with their titles."""
    head = heat.where("hot_rank is not null").orderBy("hot_rank", "event_id").limit(max(1, min(int(limit), 100)))
    return head.join(events, "event_id", "left")
