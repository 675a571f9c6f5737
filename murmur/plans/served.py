"""Served tables: event list, detail, reports, metadata, question context, quality gate, deletion."""

from pyspark.sql import functions as F

from murmur.operators import lifecycle, reports, sentiment
from murmur.plans.heat import at
from murmur.plans.registry import query, with_views

_EV = """SELECT user_id AS event_id, concat('event ', CAST(user_id AS STRING)) AS title, 'sum' AS summary, user_id % 4 = 0 AS is_hot, CASE WHEN user_id % 8 = 0 THEN user_id END AS hot_rank, sum(CAST(floor(value) AS BIGINT)) / 100.0 AS heat_index,
    CASE WHEN user_id % 3 = 0 THEN '高潮期' ELSE 'other' END AS lifecycle_stage, 0.5 AS sentiment_positive, 0.25 AS sentiment_negative, 0.25 AS sentiment_neutral FROM {events} GROUP BY user_id"""


def event_rows(t):
    rows = t.spark.sql(_EV, events=t.events)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("heat_index", "sentiment_positive", "sentiment_negative", "sentiment_neutral")})


_NAMED = "CASE event_type WHEN 'view' THEN 'weibo' WHEN 'click' THEN 'bilibili' ELSE 'other' END"


@query("Q1_event_list", "WITH e AS (" + _EV.replace("{events}", "events").replace("STRING", "VARCHAR") + f""")
    SELECT event_id, least(100e0, CAST(heat_index AS DOUBLE)) AS heat_index, CASE WHEN lifecycle_stage = 'other' THEN '潜伏期' ELSE lifecycle_stage END AS lifecycle_stage,
      (SELECT string_agg(DISTINCT CASE event_type WHEN 'view' THEN '微博搜索' ELSE 'B站' END, ',' ORDER BY CASE event_type WHEN 'view' THEN '微博搜索' ELSE 'B站' END) FROM events z WHERE z.user_id = e.event_id AND event_type IN ('view', 'click')) AS platforms,
      'k0,k1,k2' AS top_keywords FROM e ORDER BY is_hot DESC, hot_rank ASC NULLS FIRST, heat_index DESC, event_id DESC LIMIT 20 OFFSET 20""")
def _(t):
    platforms = t.events.selectExpr("user_id AS event_id", f"{_NAMED} AS platform")
    keywords = t.events.select(F.col("user_id").alias("event_id")).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).selectExpr("event_id", "concat('k', i) AS term", "1.0D - i / 10 AS weight")
    out = reports.event_list(event_rows(t), platforms, keywords, 2, 20)
    return out.select("event_id", "heat_index", "lifecycle_stage", F.nullif(F.array_join("platforms", ","), F.lit("")).alias("platforms"), F.array_join("top_keywords", ",").alias("top_keywords"))


def _report(t):
    items = t.sentiment_item
    trend = lifecycle.trend_series(t.heat_article, t.heat_snapshot)
    platforms = reports.platform_distribution(t.events.selectExpr("user_id AS event_id", f"{_NAMED} AS platform"))
    mood = sentiment.event_summary(items)
    mood = mood.withColumn("summary", sentiment.summary_sentence())
    ids = t.events.select(F.col("user_id").alias("event_id")).distinct()
    risk = ids.selectExpr("event_id", "CAST(event_id % 90 AS DOUBLE) AS score", "'低风险' AS level", "1L AS suspicious_count", "2L AS total_count", "array('x') AS factors")
    keywords = ids.selectExpr("event_id", "'k' AS term", "1.0D AS weight")
    articles = t.heat_article.select("event_id", "article_id", "platform", "publish_time")
    return reports.event_reports(event_rows(t).select("event_id", "title", "summary"), trend, platforms, mood, risk, keywords, articles)


@query("Q2_event_report", with_views("heat_article", f"""SELECT user_id AS event_id, (SELECT least(14, count(DISTINCT CAST(publish_time AS DATE))) FROM heat_article h WHERE h.event_id = e.user_id) AS trend_days,
    count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN event_type END) AS platform_count, CAST(user_id % 90 AS DOUBLE) AS risk_score,
    (SELECT string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY p) FROM (SELECT event_id, article_id, row_number() OVER (PARTITION BY event_id ORDER BY publish_time DESC NULLS LAST, article_id) AS p FROM heat_article) n
      WHERE n.event_id = e.user_id AND p <= 200) AS newest FROM events e GROUP BY user_id"""))
def _(t):
    return _report(t).select("event_id", F.size("trend").cast("long").alias("trend_days"), F.size(F.coalesce("platform_share", F.array())).cast("long").alias("platform_count"), F.col("risk.score").alias("risk_score"),
                             F.array_join(F.transform("articles", lambda a: a["article_id"].cast("string")), ",").alias("newest"))


@query("Q3_platform_distribution", f"""SELECT event_id, platform, CASE platform WHEN 'weibo' THEN '微博搜索' ELSE 'B站' END AS platform_name, count, round(percentage, 6) AS percentage FROM (
    SELECT user_id AS event_id, {_NAMED} AS platform, count(*) AS count, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS percentage FROM events GROUP BY 1, 2) x WHERE platform <> 'other'""".replace("PARTITION BY user_id", "PARTITION BY user_id"))
def _(t):
    rows = t.events.selectExpr("user_id AS event_id", f"{_NAMED} AS platform")
    return reports.platform_distribution(rows).withColumn("percentage", F.round("percentage", 6))


@query("Q4_event_metadata", """SELECT user_id AS event_id, CASE WHEN user_id % 2 = 0 THEN '2024年01月31日 00:00' ELSE 'noon' END AS time_code, CASE WHEN user_id % 5 = 0 THEN 'old' ELSE 'the place' END AS location,
    CASE WHEN user_id % 5 = 0 THEN 'fallback' ELSE 'success' END AS metadata_status, CASE WHEN user_id % 2 = 0 THEN 'TIME_CODE_CONFLICT' END AS warning,
    round(CASE WHEN user_id % 5 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 1e0 ELSE 0.5e0 END ELSE (CASE WHEN user_id % 2 = 0 THEN 1e0 ELSE 0.5e0 END + 0.8e0) / 2 END, 6) AS metadata_confidence,
    count(*) FILTER (WHERE event_id IN (10, 11, 12)) AS location_evidence FROM events GROUP BY user_id HAVING user_id % 7 <> 0""")
def _(t):
    articles = t.events.selectExpr("user_id AS event_id", "event_id AS article_id", "true AS is_representative")
    done = articles.groupBy("event_id").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64("article_id").cast("decimal(38,0)")).cast("string")).alias("h"))
    events = done.select("event_id", F.when(F.col("event_id") % 2 == 0, at()).alias("first_publish_time"), F.lit("old").alias("location"), F.lit(None).cast("string").alias("key_figures"),
                         F.lit(None).cast("string").alias("cause"), F.when(F.col("event_id") % 7 == 0, F.col("h")).alias("source_hash"))
    body = F.concat(F.lit('{"time_code":{"value":"noon","confidence":0.5},"location":{"value":"'), F.when(F.col("event_id") % 5 == 0, "").otherwise(" the   place "), F.lit('","confidence":0.8,"evidence_article_ids":[10,11,12,10]}}'))
    out = reports.event_metadata(events, articles, done.select("event_id", body.alias("content")))
    return out.select("event_id", "time_code", "location", "metadata_status", "warning", "metadata_confidence", "location_evidence")


@query("Q5_question_context", """SELECT e.doc_id % 25 AS event_id, concat_ws(chr(10), '事件标题：t', '事件概述：暂无概述', '生命周期：未知', '情感比例：正面 0.000，负面 0.000，中立 0.000', '相关报道：',
    string_agg('- [' || source || '] ' || substr(split_part(text, chr(10), 1), 1, 80) || '：' || substr(text, 1, 300), chr(10) ORDER BY doc_id)) AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY doc_id) AS rn FROM documents) e WHERE rn <= 20 GROUP BY 1""")
def _(t):
    none = F.lit(None).cast("string")
    events = t.article.select("event_id").distinct().select("event_id", F.lit("t").alias("title"), none.alias("summary"), none.alias("lifecycle_stage"), *[none.alias(f"sentiment_{x}") for x in ("positive", "negative", "neutral")])
    return reports.question_context(events, t.article)


@query("Q6_quality_gate", """WITH g AS (SELECT d.source, count(*) AS n, count(*) FILTER (WHERE l.quality = 1) AS rel, count(l.doc_id) AS insp, count(DISTINCT d.lang) AS p FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)
    SELECT source AS event_id, rule, CASE rule WHEN 'ARTICLE_COUNT_SUFFICIENT' THEN n >= 3 WHEN 'ARTICLE_RELEVANCE_LOW' THEN insp > 0 AND rel / CAST(greatest(1, insp) AS DOUBLE) >= 0.7 WHEN 'SINGLE_PLATFORM_WITHOUT_LIMITATION' THEN p >= 2
      WHEN 'SENTIMENT_SUM_INVALID' THEN false WHEN 'KEYWORD_DIVERSITY_LOW' THEN false WHEN 'PROPAGATION_LIMITATION_EXPLAINED' THEN false ELSE true END AS passed
    FROM g, (SELECT unnest(['SUMMARY_PRESENT', 'LIFECYCLE_PRESENT', 'HEAT_FINITE', 'ARTICLE_COUNT_SUFFICIENT', 'ARTICLE_RELEVANCE_LOW', 'SINGLE_PLATFORM_WITHOUT_LIMITATION', 'PLATFORM_COUNT_ALIGNED', 'SENTIMENT_SUM_INVALID',
      'TREND_LENGTH_MISMATCH', 'KEYWORD_DIVERSITY_LOW', 'RISK_DATA_PRESENT', 'PROPAGATION_LIMITATION_EXPLAINED']) AS rule) r""")
def _(t):
    g = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("article_total"), F.count_if(F.col("quality") == 1).alias("relevant_articles"), F.count("quality").alias("inspected_articles"), F.countDistinct("lang").alias("platform_count"))
    rows = g.selectExpr("source AS event_id", "'s' AS summary", "'高潮期' AS lifecycle_stage", "1.5D AS heat_index", "article_total", "relevant_articles", "inspected_articles", "platform_count", "article_total AS platform_article_total",
                        "0.5D AS sentiment_positive", "0.2D AS sentiment_negative", "0.1D AS sentiment_neutral", "3 AS trend_dates", "3 AS trend_counts", "1 AS keyword_count", "1 AS non_query_keyword_count",
                        "12.5D AS risk_score", "'低风险' AS risk_level", "'insufficient' AS coverage_status", "CAST(NULL AS STRING) AS limitation")
    return reports.quality_gate(rows)


@query("Q7_delete_events", """SELECT event_id AS article_id, user_id AS event_id FROM events WHERE user_id % 10 <> 3""")
def _(t):
    members = t.events.selectExpr("event_id AS article_id", "user_id AS event_id")
    doomed = members.where("event_id % 10 = 3").select("event_id").distinct()
    return reports.delete_events(doomed, memberships=members)["memberships"].select("article_id", "event_id")


@query("S9_html_reports", """SELECT user_id AS event_id, true AS has_overview, true AS has_score, true AS closed FROM (SELECT DISTINCT user_id FROM events) x""")
def _(t):
    pages = reports.html_reports(_report(t), at())
    score = F.concat(F.lit("（"), (F.col("event_id") % 90).cast("double").cast("string"), F.lit(" 分）"))
    return pages.select("event_id", F.col("html").contains("<p>sum</p>").alias("has_overview"), F.col("html").contains(score).alias("has_score"), F.col("html").endswith("</body></html>").alias("closed"))
