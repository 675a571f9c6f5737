"""Served tables: event list, event detail, metadata, question context, quality gate, HTML report, deletion."""

from pyspark.sql import Column, DataFrame, functions as F

from murmur.config import LIFECYCLE_STAGES, PLATFORM_DISPLAY, SENTIMENT_DISPLAY
from murmur.functions.ranking import top_per_group
from murmur.functions.text import literal_map


def clamp_ratio(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def clamp_heat(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def normalized_triple(positive: Column, negative: Column, neutral: Column) -> Column:
    """Three clamped shares scaled to sum 1; all neutral when nothing is known."""
    parts = [clamp_ratio(c) for c in (positive, negative, neutral)]
    total = parts[0] + parts[1] + parts[2]
    empty = (0.0, 0.0, 1.0)
    return F.struct(*[
        F.when(total <= 0, F.lit(d)).otherwise(p / total).alias(n)
        for p, d, n in zip(parts, empty, ("positive", "negative", "neutral"))
    ])


def platform_name(code: Column) -> Column:
    return literal_map(PLATFORM_DISPLAY)[F.lower(F.coalesce(code, F.lit("")))]


def shown_stage(stage: Column) -> Column:
    return F.when(stage.isin(*LIFECYCLE_STAGES), stage).otherwise("潜伏期")


def shown_label(label: Column) -> Column:
    return F.coalesce(literal_map(SENTIMENT_DISPLAY)[F.coalesce(label, F.lit(""))], F.lit("中立"))


def short_date(day: Column) -> Column:
    return F.date_format(day, "M/d")


# ---- event list and detail

def event_list(events: DataFrame, platforms: DataFrame, keywords: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page of events, hot ones first, with shown values, platform names and their three first keywords.

    The page is cut before anything is joined. Unranked events come first among equals, as null sorts first."""
    from murmur.sources.readers import page

    order = [F.desc("is_hot"), F.asc_nulls_first("hot_rank"), F.desc("heat_index"), F.desc("event_id")]
    head = page(events, order, number, size)
    names = platforms.join(head.select("event_id"), "event_id", "left_semi").select("event_id", platform_name(F.col("platform")).alias("n")).where("n is not null").distinct()
    names = names.groupBy("event_id").agg(F.array_sort(F.collect_list("n")).alias("platforms"))
    top = top_per_group(keywords.join(head.select("event_id"), "event_id", "left_semi"), ["event_id"], [F.desc("weight"), F.asc("term")], 3, "_k")
    top = top.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("_k", "term"))).alias("t")).select("event_id", F.transform("t", lambda x: x["term"]).alias("top_keywords"))
    empty = F.array().cast("array<string>")
    triple = normalized_triple(F.col("sentiment_positive"), F.col("sentiment_negative"), F.col("sentiment_neutral"))
    rows = head.join(names, "event_id", "left").join(top, "event_id", "left")
    return rows.withColumns({
        "heat_index": clamp_heat(F.col("heat_index")), "lifecycle_stage": shown_stage(F.col("lifecycle_stage")), "sentiment": triple,
        "platforms": F.coalesce("platforms", empty), "top_keywords": F.coalesce("top_keywords", empty)})


def platform_distribution(articles: DataFrame) -> DataFrame:
    """Count and share of every known platform of an event; unknown ones count in the whole."""
    counts = articles.groupBy("event_id", "platform").agg(F.count("*").alias("count"))
    whole = counts.groupBy("event_id").agg(F.sum("count").alias("_all"))
    named = counts.join(whole, "event_id").withColumn("platform_name", platform_name(F.col("platform")))
    return named.where("platform_name is not null").select("event_id", "platform", "platform_name", "count", (F.col("count") / F.col("_all")).alias("percentage"))


def newest_articles(articles: DataFrame, count: int = 200) -> DataFrame:
    return top_per_group(articles, ["event_id"], [F.desc_nulls_last("publish_time"), F.asc("article_id")], count, "position")


def event_reports(
    events: DataFrame, trend: DataFrame, platforms: DataFrame, sentiment: DataFrame, risk: DataFrame, keywords: DataFrame, articles: DataFrame | None = None,
) -> DataFrame:
    """One nested row per event from the finished tables; every array holds days, platforms, keywords or the newest articles."""
    listed = lambda df, name, *cols: df.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    rows = events.join(listed(trend, "trend", "day", "count", "heat"), "event_id", "left")
    rows = rows.join(listed(platforms, "platform_share", "platform_name", "count", "percentage"), "event_id", "left")
    rows = rows.join(listed(keywords, "keywords", (-F.col("weight")).alias("w"), "term"), "event_id", "left")
    if articles is not None:
        shown = [c for c in ("article_id", "title", "platform", "publish_time") if c in articles.columns]
        rows = rows.join(listed(newest_articles(articles), "articles", "position", *shown), "event_id", "left")
    rows = rows.join(sentiment.select("event_id", "positive_ratio", "negative_ratio", "neutral_ratio", F.col("summary").alias("sentiment_summary")), "event_id", "left")
    return rows.join(risk.select("event_id", F.struct("score", "level", "suspicious_count", "total_count", "factors").alias("risk")), "event_id", "left")


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_reports(reports: DataFrame, generated_at: Column) -> DataFrame:
    """HTML page per event: overview, risk, trend table, sentiment shares. The same page serves as printable form."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = F.array_join(F.transform(
        F.coalesce("trend", F.array().cast("array<struct<day:date,count:bigint,heat:double>>")),
        lambda d: F.concat(F.lit("<tr><td>"), F.date_format(d["day"], "M/d"), F.lit("</td><td>"), number(d["count"]), F.lit("</td><td>"), number(d["heat"]), F.lit("</td></tr>"))), "")
    score = F.coalesce("risk.score", F.lit(0.0))
    css = F.when(score >= 70, "high").when(score >= 40, "mid").otherwise("low")
    percent = lambda c: F.bround(F.coalesce(c, F.lit(0.0)) * 100, 0).cast("int").cast("string")
    page = F.concat(
        F.lit("<!DOCTYPE html><html lang=\"zh-CN\"><head><meta charset=\"utf-8\"><title>事件报告 - "), F.col("event_id").cast("string"),
        F.lit("</title></head><body><h1>事件分析报告</h1><p>生成时间："), F.date_format(generated_at, "yyyy-MM-dd HH:mm"), F.lit(" UTC</p><h2>事件概述</h2><p>"),
        _escape(F.coalesce("summary", F.lit(""))), F.lit("</p><h2>风险评估</h2><p><span class=\"risk risk-"), css, F.lit("\">"), F.coalesce("risk.level", F.lit("未知")),
        F.lit("（"), score.cast("string"), F.lit(" 分）</span></p><p>可疑报道："), number(F.coalesce("risk.suspicious_count", F.lit(0))), F.lit(" / "), number(F.coalesce("risk.total_count", F.lit(0))),
        F.lit("</p><h2>发展趋势</h2><table><tr><th>日期</th><th>报道量</th><th>热度指数</th></tr>"), rows, F.lit("</table><h2>情感分析</h2><p>正面："), percent(F.col("positive_ratio")),
        F.lit("% 负面："), percent(F.col("negative_ratio")), F.lit("% 中性："), percent(F.col("neutral_ratio")), F.lit("%</p></body></html>"))
    return reports.select("event_id", page.alias("html"))


# ---- metadata, questions, quality, deletion

def event_metadata(events: DataFrame, articles: DataFrame, answers: DataFrame) -> DataFrame:
    """Validated time, place, people and cause of each event from landed answers `(event_id, content)`.

    A known first publication gives the time; empty answers keep the old value; evidence ids must be members of
    the event; events whose article set is unchanged since the last success are left out.
    `events(event_id, first_publish_time, location, key_figures, cause, source_hash)`."""
    from murmur.operators.sentiment import strip_fence

    limits = {"time_code": 50, "location": 100, "key_figures": 500, "cause": 500}
    # an order-free digest of the member ids tells whether the set changed
    members = articles.where("is_representative").groupBy("event_id").agg(
        F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64("article_id").cast("decimal(38,0)")).cast("string")).alias("new_hash"))
    due = events.join(members, "event_id").where(~F.col("source_hash").eqNullSafe(F.col("new_hash")))
    rows = due.join(answers.withColumn("_b", strip_fence(F.col("content"))).select("event_id", "_b"), "event_id", "left")
    get = lambda name, part: F.get_json_object("_b", f"$.{name}.{part}")
    from murmur.functions.text import collapse

    value = {n: F.substring(collapse(F.coalesce(get(n, "value"), F.lit(""))), 1, k) for n, k in limits.items()}
    conf = {n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(get(n, "confidence").try_cast("double"), F.lit(0.0)))) for n in limits}
    known = F.date_format("first_publish_time", "yyyy年MM月dd日 HH:mm")
    rows = rows.withColumns({f"_v_{n}": c for n, c in value.items()} | {f"_c_{n}": c for n, c in conf.items()} | {"_known": known})
    evidence = rows.select("event_id", F.explode(F.from_json(get("location", "evidence_article_ids"), "array<bigint>")).alias("article_id")).join(
        articles.select("event_id", "article_id"), ["event_id", "article_id"], "left_semi").distinct().groupBy("event_id").agg(F.count("*").alias("location_evidence"))
    found = [F.col(f"_v_{n}") != "" for n in ("location", "key_figures", "cause")]
    time_conf = F.when(F.col("_known").isNotNull(), 1.0).when(F.col("_v_time_code") != "", F.col("_c_time_code"))
    confs = F.array_compact(F.array(time_conf, *[F.when(F.col(f"_v_{n}") != "", F.col(f"_c_{n}")) for n in ("location", "key_figures", "cause")]))
    mean = F.when(F.size(confs) > 0, F.aggregate(confs, F.lit(0.0), lambda s, x: s + x) / F.size(confs)).otherwise(0.0)
    return rows.join(evidence, "event_id", "left").select(
        "event_id", F.coalesce("_known", F.nullif("_v_time_code", F.lit(""))).alias("time_code"),
        *[F.coalesce(F.nullif(f"_v_{n}", F.lit("")), F.col(n)).alias(n) for n in ("location", "key_figures", "cause")],
        F.when(found[0] | found[1] | found[2], "success").otherwise("fallback").alias("metadata_status"), F.round(mean, 6).alias("metadata_confidence"),
        F.when((F.col("_v_time_code") != "") & F.col("_known").isNotNull() & (F.col("_v_time_code") != F.col("_known")), "TIME_CODE_CONFLICT").alias("warning"),
        F.coalesce("location_evidence", F.lit(0)).alias("location_evidence"), F.col("new_hash").alias("source_hash"))


def question_context(events: DataFrame, articles: DataFrame, count: int = 20, length: int = 300) -> DataFrame:
    """Text shown to a question answerer: event header and the first articles, each cut."""
    head = top_per_group(articles, ["event_id"], [F.asc("article_id")], count, "_rn")
    line = F.concat(F.lit("- ["), F.col("platform"), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), F.lit("无标题")), F.lit("："), F.substring(F.coalesce("clean_content", F.lit("")), 1, length))
    lines = head.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("_rn", line.alias("l")))).alias("x")).select("event_id", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("_lines"))
    joined = events.join(lines, "event_id", "left")
    share = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return joined.select("event_id", F.concat_ws(
        "\n", F.concat(F.lit("事件标题："), F.coalesce("title", F.lit("未命名事件"))), F.concat(F.lit("事件概述："), F.coalesce("summary", F.lit("暂无概述"))),
        F.concat(F.lit("生命周期："), F.coalesce("lifecycle_stage", F.lit("未知"))),
        F.format_string("情感比例：正面 %.3f，负面 %.3f，中立 %.3f", share("sentiment_positive"), share("sentiment_negative"), share("sentiment_neutral")),
        F.lit("相关报道："), F.coalesce("_lines", F.lit("- 暂无报道正文"))).alias("context"))


def quality_gate(rows: DataFrame) -> DataFrame:
    """One row per (event, rule, passed) over finished event rows.

    Columns: summary, lifecycle_stage, heat_index, article_total, relevant_articles, inspected_articles, platform_count,
    platform_article_total, sentiment_positive/negative/neutral, trend_dates, trend_counts, keyword_count,
    non_query_keyword_count, risk_score, risk_level, coverage_status, limitation."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    finite = lambda c: F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.lit(False))
    ratio = F.when(F.col("inspected_articles") > 0, F.col("relevant_articles") / F.col("inspected_articles")).otherwise(0.0)
    total = F.col("sentiment_positive") + F.col("sentiment_negative") + F.col("sentiment_neutral")
    rules = {
        "SUMMARY_PRESENT": text("summary"), "LIFECYCLE_PRESENT": text("lifecycle_stage"), "HEAT_FINITE": finite("heat_index"),
        "ARTICLE_COUNT_SUFFICIENT": F.col("article_total") >= 3, "ARTICLE_RELEVANCE_LOW": ratio >= 0.7,
        "SINGLE_PLATFORM_WITHOUT_LIMITATION": (F.col("platform_count") >= 2) | text("limitation"),
        "PLATFORM_COUNT_ALIGNED": (F.col("article_total") == 0) | (F.col("platform_article_total") == F.col("article_total")),
        "SENTIMENT_SUM_INVALID": F.abs(total - 1.0) <= 0.05,
        "TREND_LENGTH_MISMATCH": (F.col("trend_dates") > 0) & (F.col("trend_dates") == F.col("trend_counts")),
        "KEYWORD_DIVERSITY_LOW": (F.col("keyword_count") >= 2) & (F.col("non_query_keyword_count") >= 1),
        "RISK_DATA_PRESENT": finite("risk_score") & text("risk_level"),
        "PROPAGATION_LIMITATION_EXPLAINED": (F.col("coverage_status") != "insufficient") | text("limitation"),
    }
    flags = rows.select("event_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()])
    return flags.unpivot("event_id", list(rules), "rule", "passed")


def delete_events(doomed: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The given tables without any row of the events to delete."""
    return {name: df.join(doomed.select("event_id"), "event_id", "left_anti") for name, df in tables.items()}
