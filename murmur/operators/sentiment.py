"""Sentiment: result validation, weighting, summaries by event, day and platform, reuse and inheritance.

Items: `(event_id, article_id, label, score, platform, publish_time, observed_time, is_representative,
nlp_weight, spam_weight, duplicate_weight, heat_contribution)`."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmur.config import SENTIMENT_LABELS, SentimentConfig
from murmur.functions.ranking import top_per_group
from murmur.functions.text import collapse, fixed_point
from murmur.operators.heat import time_confidence


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value.cast("double"))))


def _base_weight() -> Column:
    duplicate = F.when(F.col("is_representative"), 1.0).otherwise(clamp(F.col("duplicate_weight")))
    return clamp(F.col("nlp_weight")) * clamp(F.col("spam_weight")) * duplicate


def _heat() -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(F.col("heat_contribution").cast("double"), F.lit(0.0)))


def article_weights(items: DataFrame) -> DataFrame:
    """Weight factors of each article against the hottest article of its event."""
    hottest = items.groupBy("event_id").agg(F.max(_heat()).alias("_max"))
    spread = F.when(
        (F.col("_max") > 0) & (_heat() > 0),
        F.least(F.lit(1.5), 1.0 + F.log1p(_heat()) / F.log1p(F.col("_max")) * 0.5),
    ).otherwise(1.0)
    out = items.join(hottest, "event_id").withColumns({
        "quality_weight": clamp(F.col("nlp_weight")), "spam_factor": clamp(F.col("spam_weight")),
        "duplicate_factor": F.when(F.col("is_representative"), 1.0).otherwise(clamp(F.col("duplicate_weight"))),
        "spread_factor": spread,
    })
    return out.withColumn(
        "final_weight", F.col("quality_weight") * F.col("spam_factor") * F.col("duplicate_factor") * F.col("spread_factor")
    ).drop("_max")


def summarize(items: DataFrame, by: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Counts, weighted ratios, weighted mean score and dominant label per group, in one aggregation.

    The spread factor 1 + ln(1+h) / (2 ln(1+h_max)) is linear in ln(1+h), and h_max belongs to the group:
    summing the plain weights and the weights times ln(1+h) separately lets h_max come out of the same pass."""
    valid = F.col("label").isin(*SENTIMENT_LABELS)
    rows = items.withColumns({"_w": _base_weight(), "_wl": _base_weight() * F.log1p(_heat()), "_ok": valid})
    pick = lambda cond, value: F.sum(F.when(cond, value).otherwise(0.0))
    sums = []
    for label in SENTIMENT_LABELS:
        hit = F.col("label") == label
        sums += [
            F.count_if(hit).alias(f"{label}_count"),
            pick(hit, F.col("_w")).alias(f"_w_{label}"), pick(hit, F.col("_wl")).alias(f"_wl_{label}"),
        ]
    score = clamp(F.col("score"), -1.0, 1.0)
    grouped = rows.groupBy(*by).agg(
        F.count_if("_ok").alias("article_count"),
        F.count_if(F.col("_ok") & F.col("is_representative")).alias("representative_count"),
        *sums,
        pick(F.col("_ok"), F.col("_w") * score).alias("_ws"),
        pick(F.col("_ok"), F.col("_wl") * score).alias("_wls"),
        F.max(F.when(F.col("_ok"), _heat())).alias("_hmax"),
        *extra,
    )
    boost = F.when(F.col("_hmax") > 0, 0.5 / F.log1p(F.col("_hmax"))).otherwise(0.0)
    weight = {label: F.col(f"_w_{label}") + boost * F.col(f"_wl_{label}") for label in SENTIMENT_LABELS}
    total = sum(weight.values(), F.lit(0.0))
    out = grouped.withColumns({"effective_weight": total})
    share = lambda value: F.when(F.col("effective_weight") > 0, value / F.col("effective_weight")).otherwise(0.0)
    out = out.withColumns(
        {f"{label}_ratio": share(weight[label]) for label in SENTIMENT_LABELS}
        | {"average_score": share(F.col("_ws") + boost * F.col("_wls"))}
    )
    p, n, u = (F.round(f"{label}_ratio", 12) for label in SENTIMENT_LABELS)
    dominant = (
        F.when(F.col("article_count") == 0, F.lit(None).cast("string"))
        .when((p >= n) & (p >= u), "positive").when(n >= u, "negative").otherwise("neutral")
    )
    out = out.withColumn("dominant_label", dominant)
    return out.drop("_ws", "_wls", "_hmax", *[f"_{x}_{label}" for label in SENTIMENT_LABELS for x in ("w", "wl")])


def event_summary(items: DataFrame) -> DataFrame:
    return summarize(items, ["event_id"])


def daily_summary(items: DataFrame) -> DataFrame:
    """Per event and day; days that lean on observation time carry a warning."""
    moment = F.coalesce("publish_time", "observed_time")
    dated = items.withColumn("day", F.to_date(moment)).where("day is not null")
    extra = [
        F.count_if(F.col("publish_time").isNotNull()).alias("publish_time_count"),
        F.count_if(F.col("publish_time").isNull()).alias("observed_time_count"),
    ]
    return summarize(dated, ["event_id", "day"], extra).withColumn(
        "warning", F.when(F.col("observed_time_count") > 0, "TIME_SOURCE_DEGRADED")
    )


def platform_summary(items: DataFrame, cfg: SentimentConfig = SentimentConfig()) -> DataFrame:
    named = items.withColumn("platform", F.coalesce(F.nullif("platform", F.lit("")), F.lit("unknown")))
    small = (F.col("article_count") < cfg.platform_min_articles) | (
        F.col("representative_count") < cfg.platform_min_representatives
    )
    return summarize(named, ["event_id", "platform"]).withColumn("sample_insufficient", small)


def summary_sentence(reasons: Column | None = None) -> Column:
    """Readable summary of a `summarize` row, optionally with up to three distinct reasons."""
    name = (
        F.when(F.col("dominant_label") == "positive", "正面").when(F.col("dominant_label") == "negative", "负面")
        .when(F.col("dominant_label") == "neutral", "中立").otherwise("暂无")
    )
    percent = lambda label: fixed_point(F.col(f"{label}_ratio") * 100, 1)
    text = F.format_string(
        "共分析%d篇文章，主导情感为%s；正面%s%%、负面%s%%、中立%s%%，加权平均分%s。",
        F.col("article_count"), name, percent("positive"), percent("negative"), percent("neutral"),
        fixed_point(F.col("average_score"), 3),
    )
    if reasons is None:
        return text
    cleaned = F.filter(F.transform(reasons, lambda r: collapse(F.coalesce(r, F.lit("")))), lambda r: r != "")
    first = F.transform(F.slice(F.array_distinct(cleaned), 1, 3), lambda r: F.substring(r, 1, 120))
    return F.concat(
        text,
        F.when(F.size(first) > 0, F.concat(F.lit("代表性判断依据："), F.array_join(first, "；"), F.lit("。"))).otherwise(""),
    )


#: Every code point with the Unicode property White_Space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_fence(content: Column) -> Column:
    """Body of a ```json fenced answer, or the answer itself. Cut at the ends: a pattern would try every place of the text."""
    text = F.btrim(F.coalesce(content, F.lit("")), F.lit(_BLANKS))
    body = F.substring(text, F.lit(4), F.length(text) - 6)
    body = F.when(F.lower(F.substring(body, 1, 4)) == "json", F.substring(body, 5, 1 << 30)).otherwise(body)
    return F.when(text.startswith("```") & text.endswith("```") & (F.length(text) >= 6), F.btrim(body, F.lit(" \t\n\x0b\x0c\r"))).otherwise(text)


def validated_results(responses: DataFrame) -> DataFrame:
    """Landed model answers `(article_id, content)` as typed columns with an error code per bad answer."""
    fields = ("label", "dimension", "score", "confidence", "target", "reason")
    body = strip_fence(F.col("content"))
    parsed = responses.withColumn("_b", F.when(body.rlike("(?s)^\\{.*\\}$"), body))
    got = {f: F.get_json_object("_b", f"$.{f}") for f in fields}
    rows = parsed.withColumns({
        "label": F.lower(F.trim(F.coalesce(got["label"], F.lit("")))),
        "dimension": F.lower(F.trim(F.coalesce(got["dimension"], F.lit("")))),
        "score": got["score"].try_cast("double"), "confidence": got["confidence"].try_cast("double"),
        "target": F.substring(collapse(F.coalesce(got["target"], F.lit(""))), 1, 200),
        "reason": F.substring(collapse(F.coalesce(got["reason"], F.lit(""))), 1, 500),
    })
    score, conf = F.col("score"), F.col("confidence")
    error = (
        F.when(F.col("_b").isNull() | F.get_json_object("_b", "$").isNull(), "NOT_JSON_OBJECT")
        .when(~F.col("label").isin(*SENTIMENT_LABELS), "BAD_LABEL")
        .when(~F.col("dimension").isin("stance", "impact", "factual"), "BAD_DIMENSION")
        .when(score.isNull() | conf.isNull(), "BAD_NUMBER")
        .when(~score.between(-1, 1) | ~conf.between(0, 1), "OUT_OF_RANGE")
        .when((F.col("label") == "positive") & (score < 0), "SIGN_CONFLICT")
        .when((F.col("label") == "negative") & (score > 0), "SIGN_CONFLICT")
        .when((F.col("target") == "") | (F.col("reason") == ""), "EMPTY_TARGET_OR_REASON")
    )
    return rows.withColumns({
        "error": error, "score": F.round(score, 6), "confidence": F.round(conf, 6),
    }).drop("_b")


def from_probability(rows: DataFrame, probability: str = "probability", cfg: SentimentConfig = SentimentConfig()) -> DataFrame:
    """Label, score, confidence and dimension from a positive-class probability column."""
    p = clamp(F.col(probability))
    score = F.round(2 * p - 1, 6)
    return rows.withColumns({
        "score": score,
        "label": F.when(p >= cfg.positive_threshold, "positive").when(p <= cfg.negative_threshold, "negative")
        .otherwise("neutral"),
        "confidence": F.round(F.least(F.lit(cfg.confidence_cap), F.abs(score)), 6),
        "dimension": F.when(F.col("topic_category").isin("自然灾害", "社会事件"), "impact").otherwise("factual"),
    })


def eligible_articles(articles: DataFrame) -> DataFrame:
    """Articles worth scoring: clean, with a title or body, weighted, neither advertisement nor hot-list entry."""
    return articles.where(
        (F.col("clean_status") == "success") & (F.col("nlp_weight") > 0)
        & (F.trim(F.concat(F.coalesce("title", F.lit("")), F.coalesce("clean_content", F.lit("")))) != "")
        & ~F.coalesce("is_advertisement", F.lit(False)) & (F.coalesce("source_type", F.lit("")) != "hotlist")
    )


def reusable_results(targets: DataFrame, stored: DataFrame, cfg: SentimentConfig, model_name: str) -> DataFrame:
    """Latest stored success per content identity under the same versions, for the targets that have one."""
    same = stored.where(
        (F.col("status") == "success") & (F.col("prompt_version") == cfg.prompt_version)
        & (F.col("preprocess_version") == cfg.preprocess_version) & (F.col("model_name") == model_name)
        & F.col("method").isin("llm", "snownlp")
    )
    newest = top_per_group(same, ["content_identity"], [F.desc("result_id")], 1, "_rn").drop("_rn")
    return targets.join(
        newest.select("content_identity", "label", "score", "method", "result_id"), "content_identity", "left"
    )


def with_inherited(targets: DataFrame, results: DataFrame) -> DataFrame:
    """Duplicates copy the result of their representative; without one they are skipped with a warning."""
    # a target reads one result, its own or its representative's, so one join does; targets without such an id
    # would all meet in one task and go round it, and results grow with the articles, so nothing is broadcast
    copy = F.coalesce(~F.col("is_representative"), F.lit(False))
    found = results.select(F.col("article_id").alias("_key"), F.col("label").alias("_label"), F.col("score").alias("_score"), F.col("method").alias("_method"))
    keyed = targets.withColumn("_key", F.when(copy, F.col("duplicate_of_id")).otherwise(F.col("article_id")))
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("_label", "_score", "_method")]
    joined = keyed.where("_key is not null").join(found.hint("merge"), "_key", "left").unionByName(keyed.where("_key is null").select("*", *none))
    return joined.select(
        *targets.columns, F.col("_label").alias("label"), F.col("_score").alias("score"),
        F.when(copy & F.col("_label").isNotNull(), "inherited").when(F.col("is_representative"), F.col("_method")).alias("method"),
        F.when(copy & F.col("_label").isNull(), "INHERITANCE_SOURCE_MISSING").alias("warning"),
    )


def success_gate(results: DataFrame, by: Sequence[str], cfg: SentimentConfig = SentimentConfig()) -> DataFrame:
    """Share of scored targets per run and whether the run may stand."""
    ratio = F.count_if(F.col("label").isNotNull()) / F.count("*")
    return results.groupBy(*by).agg(ratio.alias("success_ratio")).withColumn(
        "passed", F.col("success_ratio") >= cfg.minimum_success_ratio
    )


def event_snapshot(items: DataFrame, cfg: SentimentConfig = SentimentConfig()) -> DataFrame:
    """One row per event: totals, day series and platform breakdown as sorted arrays, time confidence.

    The arrays hold days and platforms, never articles."""
    total = summarize(items, ["event_id"], [F.count_if(F.col("publish_time").isNotNull() & F.col("is_representative")).alias("_reliable")])
    fields = ["article_count", "positive_ratio", "negative_ratio", "neutral_ratio", "average_score", "dominant_label"]
    days = daily_summary(items)
    platforms = platform_summary(items, cfg)
    day_list = days.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("day", *fields, "warning"))).alias("days"),
        F.max("warning").alias("_day_warning"),
    )
    platform_list = platforms.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("platform", *fields, "sample_insufficient"))).alias("platforms"),
        F.max("sample_insufficient").alias("_small"),
    )
    joined = total.join(day_list, "event_id", "left").join(platform_list, "event_id", "left")
    warnings = F.array_compact(F.array(
        F.col("_day_warning"), F.when(F.col("_small"), "PLATFORM_SAMPLE_INSUFFICIENT"),
    ))
    return joined.withColumns({
        "warnings": warnings, "summary": summary_sentence(),
        "time_confidence": time_confidence(F.col("_reliable"), F.col("representative_count")),
    }).drop("_reliable", "_day_warning", "_small")


def current_sentiment(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Served sentiment: the event's pinned snapshot, else its newest one, else the event's own columns."""
    values = ["positive_ratio", "negative_ratio", "neutral_ratio"]
    pinned = snapshots.select(
        F.col("snapshot_id").alias("current_snapshot_id"), *[F.col(v).alias(f"_p_{v}") for v in values]
    )
    newest = snapshots.groupBy("event_id").agg(
        F.max_by(F.struct(*values), F.struct("calculated_at", "snapshot_id")).alias("_n")
    )
    joined = events.join(pinned, "current_snapshot_id", "left").join(newest, "event_id", "left")
    source = (
        F.when(F.col("_p_positive_ratio").isNotNull(), "current").when(F.col("_n").isNotNull(), "latest")
        .otherwise("event")
    )
    picked = {v: F.coalesce(f"_p_{v}", f"_n.{v}", F.col(v)) for v in values}
    return joined.select("event_id", source.alias("sentiment_source"), *[c.alias(v) for v, c in picked.items()])
