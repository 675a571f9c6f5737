"""Daily trend features and lifecycle stages.

A day is one row of `daily(event_id, day, count)`; empty days are absent and never filled. Windows are
partitioned by event over days, so a partition is bounded by the calendar, not by the article volume."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LATENT, GROWTH, PEAK, DECLINE = "潜伏期", "成长期", "高潮期", "消退期"
def _by_day():
    return W.partitionBy("event_id").orderBy("day")


def daily_counts(articles: DataFrame, fallback: str | None = "observed_at") -> DataFrame:
    """Articles per event and day of publication, or of first sight when that is unknown."""
    moment = F.coalesce("publish_time", fallback) if fallback else F.col("publish_time")
    return (
        articles.select("event_id", F.to_date(moment).alias("day")).where("day is not null")
        .groupBy("event_id", "day").agg(F.count("*").alias("count"))
    )


def smoothed(daily: DataFrame, window: int = 3) -> DataFrame:
    """Centred moving average, cut at both ends."""
    radius = max(1, window) // 2
    return daily.withColumn(
        "smoothed", F.avg(F.greatest(F.col("count"), F.lit(0))).over(_by_day().rowsBetween(-radius, radius))
    )


def growth_rates(daily: DataFrame) -> DataFrame:
    before = F.lag(F.greatest(F.col("count"), F.lit(0))).over(_by_day())
    now = F.greatest(F.col("count"), F.lit(0))
    rate = (
        F.when(before.isNull(), 0.0).when(before == 0, F.when(now > 0, 1.0).otherwise(0.0))
        .otherwise((now - before) / before)
    )
    return daily.withColumn("growth_rate", rate)


def prefix_features(daily: DataFrame) -> DataFrame:
    """Stage features of the series up to and including each day, with the stage they suggest."""
    y = F.greatest(F.lit(0.0), F.col("count").cast("double"))
    base = daily.withColumns({"y": y, "n": F.row_number().over(_by_day())})
    upto = _by_day().rowsBetween(W.unboundedPreceding, 0)
    last4, last3 = _by_day().rowsBetween(-3, 0), _by_day().rowsBetween(-2, 0)
    lag = lambda k: F.lag("y", k).over(_by_day())
    feats = base.withColumns({
        "first": F.first("y").over(upto), "total": F.sum("y").over(upto), "peak": F.max("y").over(upto),
        "peak_index": F.max_by(F.col("n") - 1, F.struct("y", -F.col("n"))).over(upto),
        "recent_average": F.avg("y").over(last3),
        "recent_min": F.min("y").over(last4), "recent_max": F.max("y").over(last4),
        "y1": lag(1), "y2": lag(2), "y3": lag(3),
    })
    scale = F.greatest(F.lit(1.0), F.col("peak"))
    slope = (-1.5 * F.col("y3") - 0.5 * F.col("y2") + 0.5 * F.col("y1") + 1.5 * F.col("y")) / 5
    # a least-squares slope needs two points; shorter recent windows only occur before stages exist
    enough = F.col("n") >= 4
    feats = feats.withColumns({
        "slope": F.when(enough, slope),
        "norm_slope": F.when(enough, slope / scale),
        "peak_ratio": F.when(F.col("peak") > 0, F.col("y") / F.col("peak")).otherwise(0.0),
        "recent_peak_ratio": F.when(F.col("peak") > 0, F.col("recent_average") / F.col("peak")).otherwise(0.0),
        "recent_variation": (F.col("recent_max") - F.col("recent_min")) / scale,
        "sustained_decline": F.coalesce(
            (F.col("y3") > F.col("y2")) & (F.col("y2") > F.col("y1")) & (F.col("y1") > F.col("y"))
            & (F.col("y") <= F.col("y3") * (1.0 - 0.15)), F.lit(False)),
    })
    fallen = (F.col("peak") > 0) & (F.col("peak_index") < F.col("n") - 2) & (F.col("y") <= F.col("peak") * 0.5)
    react = (
        (F.col("y2") < F.col("y1")) & (F.col("y1") < F.col("y"))
        & (F.col("norm_slope") >= 0.08) & (F.col("peak_ratio") >= 0.5)
    )
    low = (F.col("peak") <= 5) & (F.col("total") <= F.greatest(F.lit(25.0), F.col("n") * 5.0))
    plateau = (
        (F.col("recent_peak_ratio") >= 0.85) & (F.col("recent_variation") <= 0.20)
        & (F.abs("norm_slope") <= 0.08)
    )
    rising = (F.col("norm_slope") > 0.05) & (F.col("y") >= F.col("first"))
    decline = F.col("sustained_decline") | fallen

    def choose(*values):
        d, l, p, r, s, o = values
        return F.when(~enough, F.lit(None)).when(decline, d).when(low, l).when(plateau, p).when(rising, r).when(
            F.col("peak") <= 9, s).otherwise(o)

    return feats.withColumns({
        "low_volume": low,
        "reactivates": F.coalesce(react, F.lit(False)),
        "raw_stage": choose(DECLINE, LATENT, PEAK, GROWTH, LATENT, GROWTH),
        "raw_confidence": choose(0.82, 0.68, 0.78, F.least(F.lit(0.90), 0.62 + F.col("norm_slope")), 0.56, 0.55),
    }).drop("y1", "y2", "y3", "recent_min", "recent_max")


def _settle(raw: Column, previous: Column, reactivates: Column) -> Column:
    """Stage after hysteresis; without a raw stage the previous one stands."""
    return (
        F.when(raw.isNull(), F.coalesce(previous, F.lit(LATENT)))
        .when((previous == PEAK) & raw.isin(LATENT, GROWTH), PEAK)
        .when(previous == DECLINE, F.when(reactivates, GROWTH).otherwise(DECLINE))
        .when((previous == GROWTH) & (raw == LATENT), GROWTH)
        .otherwise(raw)
    )


def lifecycle_stage(daily: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Stage, status and confidence of each event on its last day.

    `previous(event_id, previous_stage)` carries the stage stored by the last run."""
    feats = prefix_features(daily)
    last = feats.groupBy("event_id").agg(
        F.max_by(F.struct(*[c for c in feats.columns if c != "event_id"]), "day").alias("_l")
    ).select("event_id", "_l.*")
    if previous is None:
        last = last.withColumn("previous_stage", F.lit(None).cast("string"))
    else:
        last = last.join(previous.select("event_id", "previous_stage"), "event_id", "left")
    prev = F.when(F.col("previous_stage").isin(LATENT, GROWTH, PEAK, DECLINE), F.col("previous_stage"))
    raw, conf, react = F.col("raw_stage"), F.col("raw_confidence"), F.col("reactivates")
    settled = (
        F.when(raw.isNull(), F.least(F.lit(0.45), 0.15 + F.col("n") * 0.08))
        .when((prev == PEAK) & raw.isin(LATENT, GROWTH), F.least(conf, F.lit(0.60)))
        .when(prev == DECLINE, F.when(react, F.greatest(conf, F.lit(0.72))).otherwise(F.greatest(conf, F.lit(0.70))))
        .when((prev == GROWTH) & (raw == LATENT), F.least(conf, F.lit(0.60)))
        .otherwise(conf)
    )
    return last.withColumns({
        "stage": _settle(raw, prev, react),
        "status": F.when(raw.isNull(), "data_insufficient").otherwise("sufficient"),
        "confidence": F.round(settled, 3),
        "reactivated": F.coalesce(raw.isNotNull() & (prev == DECLINE) & react, F.lit(False)),
    })


def change_points(daily: DataFrame) -> DataFrame:
    """Days on which the stage changes when the series is read from its start, hysteresis included.

    Only the days of one event are folded, as a small array of raw stages."""
    feats = prefix_features(daily).select("event_id", "day", "n", "raw_stage", "reactivates")
    series = feats.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("day", "n", "raw_stage", "reactivates"))).alias("days")
    )
    zero = F.struct(
        F.lit(LATENT).alias("stage"),
        F.array().cast("array<struct<day:date,from_stage:string,to_stage:string,idx:int>>").alias("points"),
    )

    def step(acc, d):
        now = _settle(d["raw_stage"], acc["stage"], d["reactivates"])
        point = F.struct(
            d["day"].alias("day"), acc["stage"].alias("from_stage"), now.alias("to_stage"),
            (d["n"] - 1).cast("int").alias("idx"),
        )
        return F.struct(
            now.alias("stage"),
            F.when(now != acc["stage"], F.concat(acc["points"], F.array(point))).otherwise(acc["points"]).alias("points"),
        )

    folded = series.withColumn("_f", F.aggregate("days", zero, step))
    return folded.select("event_id", F.explode("_f.points").alias("_p")).select("event_id", "_p.*")


def key_points(daily: DataFrame) -> DataFrame:
    """First day, first peak day and last day of each series, without repeated coordinates."""
    picked = daily.groupBy("event_id").agg(
        F.min(F.struct("day", "count")).alias("a"),
        F.max_by(F.struct("day", "count"), F.struct(F.col("count"), -F.unix_date("day"))).alias("b"),
        F.max(F.struct("day", "count")).alias("c"),
    )
    name = lambda label, p: F.concat(F.lit(label + "（"), F.col(p)["count"].cast("string"), F.lit("篇）"))
    points = F.array(
        F.struct(F.lit(1).alias("ord"), name("首次出现", "a").alias("name"), F.col("a").alias("p")),
        F.when(F.col("b") != F.col("a"), F.struct(F.lit(2).alias("ord"), name("峰值", "b").alias("name"), F.col("b").alias("p"))),
        F.when((F.col("c") != F.col("a")) & (F.col("c") != F.col("b")),
               F.struct(F.lit(3).alias("ord"), name("最近", "c").alias("name"), F.col("c").alias("p"))),
    )
    return picked.select("event_id", F.explode(F.array_compact(points)).alias("k")).select(
        "event_id", F.col("k.ord").alias("ord"), F.col("k.name").alias("name"),
        F.col("k.p.day").alias("day"), F.col("k.p.count").alias("count"),
    )


def trend_series(articles: DataFrame, heat_snapshots: DataFrame, last_days: int = 14) -> DataFrame:
    """Day counts by publication beside the heat of the last snapshot of that day, newest `last_days` days.

    An event without dated articles falls back to its snapshot days with their report counts."""
    counts = daily_counts(articles, fallback=None)
    heat = (
        heat_snapshots.withColumn("day", F.to_date("calculated_at"))
        .groupBy("event_id", "day").agg(
            F.max_by("final_heat", F.struct("calculated_at", "snapshot_id")).alias("heat"),
            F.max_by("reports_24h", F.struct("calculated_at", "snapshot_id")).alias("_reports"),
        )
    )
    dated = counts.select("event_id").distinct().withColumn("_dated", F.lit(True))
    joined = counts.join(heat, ["event_id", "day"], "full").join(dated, "event_id", "left")
    shown = joined.withColumn(
        "count", F.when(F.col("_dated").isNull(), F.col("_reports")).otherwise(F.col("count"))
    ).where("count is not null")
    window = W.partitionBy("event_id").orderBy(F.desc("day"))
    return shown.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= last_days).select(
        "event_id", "day", "count", "heat"
    )
