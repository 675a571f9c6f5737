"""Sentiment queries."""

from pyspark.sql import functions as F

from murmur.config import SentimentConfig
from murmur.operators import sentiment
from murmur.plans.registry import query, with_views

_C = "greatest(0e0, least(1e0, {}))"
_BASE = "least(1e0, nlp_weight) * least(1e0, spam_weight) * CASE WHEN is_representative THEN 1e0 ELSE least(1e0, duplicate_weight) END"


def weighted(part: str) -> str:
    """Item weights against the hottest item of the partition, written out directly."""
    return f"""weighted AS (
      SELECT *, {_BASE} * CASE WHEN hm > 0 AND heat_contribution > 0
        THEN least(1.5e0, 1 + ln(1 + heat_contribution) / ln(1 + hm) * 0.5e0) ELSE 1e0 END AS w
      FROM (SELECT *, max(heat_contribution) OVER (PARTITION BY {part}) AS hm FROM item) x)"""


def summary(keys: str, extra: str = "") -> str:
    share = lambda l: f"coalesce(sum(w) FILTER (WHERE label = '{l}'), 0) / sum(w)"
    return f"""SELECT {keys}, count(*) AS article_count, count(*) FILTER (WHERE is_representative) AS representative_count,
      count(*) FILTER (WHERE label = 'positive') AS positive_count, count(*) FILTER (WHERE label = 'negative') AS negative_count,
      count(*) FILTER (WHERE label = 'neutral') AS neutral_count,
      round({share('positive')}, 6) AS positive_ratio, round({share('negative')}, 6) AS negative_ratio,
      round({share('neutral')}, 6) AS neutral_ratio, round(sum(score * w) / sum(w), 6) AS average_score,
      round(sum(w), 6) AS effective_weight,
      CASE WHEN round({share('positive')}, 9) >= round({share('negative')}, 9) AND round({share('positive')}, 9) >= round({share('neutral')}, 9) THEN 'positive'
        WHEN round({share('negative')}, 9) >= round({share('neutral')}, 9) THEN 'negative' ELSE 'neutral' END AS dominant_label
      {extra} FROM weighted GROUP BY {keys}"""


_OUT = ["article_count", "representative_count", "positive_count", "negative_count", "neutral_count"]
_ROUND = ["positive_ratio", "negative_ratio", "neutral_ratio", "average_score", "effective_weight"]


def shown(df, *keys, extra=()):
    return df.select(*keys, *_OUT, *[F.round(c, 6).alias(c) for c in _ROUND], "dominant_label", *extra)


@query("M3_article_weight", with_views("sentiment_item", f"""WITH item AS (SELECT * FROM sentiment_item), {weighted('event_id')}
    SELECT article_id, round(w, 6) AS final_weight FROM weighted"""))
def _(t):
    return sentiment.article_weights(t.sentiment_item).select("article_id", F.round("final_weight", 6).alias("final_weight"))


@query("M4_event_summary", with_views("sentiment_item", f"""WITH item AS (SELECT * FROM sentiment_item), {weighted('event_id')}
    {summary('event_id')}"""))
def _(t):
    return shown(sentiment.event_summary(t.sentiment_item), "event_id")


@query("M4_label_summary", """
    WITH item AS (SELECT d.source AS platform, CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
      CASE WHEN l.toxic = 1 THEN -0.5e0 ELSE 0.25e0 END AS score, true AS is_representative, 1e0 AS nlp_weight, 1e0 AS spam_weight,
      1e0 AS duplicate_weight, CAST(d.n_chars AS DOUBLE) AS heat_contribution FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    """ + weighted("platform") + summary("platform"))
def _(t):
    items = t.documents.join(t.labels, "doc_id").selectExpr(
        "source AS platform", "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label",
        "CASE WHEN toxic = 1 THEN -0.5D ELSE 0.25D END AS score", "true AS is_representative", "1.0D AS nlp_weight",
        "1.0D AS spam_weight", "1.0D AS duplicate_weight", "n_chars AS heat_contribution")
    return shown(sentiment.summarize(items, ["platform"]), "platform")


@query("M5_summary_sentence", with_views("sentiment_item", f"""WITH item AS (SELECT * FROM sentiment_item), {weighted('event_id')},
    s AS ({summary('event_id')})
    SELECT event_id, printf('共分析%d篇文章，主导情感为%s；正面%.1f%%、负面%.1f%%、中立%.1f%%，加权平均分%.3f。', article_count,
      CASE dominant_label WHEN 'positive' THEN '正面' WHEN 'negative' THEN '负面' ELSE '中立' END,
      positive_ratio * 100, negative_ratio * 100, neutral_ratio * 100, average_score) AS summary FROM s"""))
def _(t):
    # a small negative number stays negative: round() gives 0.0, the sentence has -0.000
    signed = lambda c: F.when((F.col(c) < 0) & (F.round(c, 6) == 0), F.lit(-0.0)).otherwise(F.round(c, 6))
    rows = sentiment.event_summary(t.sentiment_item).withColumns({c: signed(c) for c in _ROUND})
    return rows.select("event_id", sentiment.summary_sentence().alias("summary"))


@query("M6_daily_summary", with_views("sentiment_item", f"""
    WITH item AS (SELECT *, CAST(coalesce(publish_time, observed_time) AS DATE) AS day FROM sentiment_item), {weighted('event_id, day')}
    {summary('event_id, day', ''', count(*) FILTER (WHERE publish_time IS NULL) AS observed_time_count,
      CASE WHEN count(*) FILTER (WHERE publish_time IS NULL) > 0 THEN 'TIME_SOURCE_DEGRADED' END AS warning''')}"""))
def _(t):
    return shown(sentiment.daily_summary(t.sentiment_item), "event_id", "day", extra=("observed_time_count", "warning"))


@query("M7_platform_summary", with_views("sentiment_item", f"""WITH item AS (SELECT * FROM sentiment_item), {weighted('event_id, platform')}
    {summary('event_id, platform', ", count(*) < 3 OR count(*) FILTER (WHERE is_representative) < 2 AS sample_insufficient")}"""))
def _(t):
    return shown(sentiment.platform_summary(t.sentiment_item), "event_id", "platform", extra=("sample_insufficient",))


# answers as a model would land them, some of them broken, one per event row
_ANSWER = """SELECT event_id AS article_id, concat(CASE WHEN event_id % 9 = 0 THEN '```json ' ELSE '' END,
    '{"label":"', CASE event_id % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'mixed' ELSE 'positive' END,
    '","dimension":"', CASE WHEN event_id % 8 = 0 THEN 'other' ELSE 'stance' END,
    '","score":', CASE event_id % 5 WHEN 0 THEN '0.4' WHEN 1 THEN '-0.3' WHEN 2 THEN '0.0' WHEN 3 THEN '0.1' ELSE '-0.2' END,
    ',"confidence":', CASE WHEN event_id % 7 = 0 THEN '1.5' ELSE '0.8' END,
    ',"target":" t  ', event_type, ' ","reason":"', CASE WHEN event_id % 11 = 0 THEN '' ELSE 'r' END, '"}',
    CASE WHEN event_id % 9 = 0 THEN ' ```' ELSE '' END) AS content FROM {events}"""


def _ans(t):
    import re
    parts = re.split(r"\{events\}", _ANSWER)
    t.events.createOrReplaceTempView("murmur_answer_events")
    return t.spark.sql("murmur_answer_events".join(parts))


@query("M1_result_validation", """
    SELECT event_id AS article_id, CASE WHEN event_id % 5 = 3 THEN 'BAD_LABEL' WHEN event_id % 8 = 0 THEN 'BAD_DIMENSION'
      WHEN event_id % 7 = 0 THEN 'OUT_OF_RANGE' WHEN event_id % 5 = 4 THEN 'SIGN_CONFLICT'
      WHEN event_id % 11 = 0 THEN 'EMPTY_TARGET_OR_REASON' END AS error,
      CASE event_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'mixed' ELSE 'positive' END AS label,
      concat('t ', event_type) AS target FROM events""")
def _(t):
    return sentiment.validated_results(_ans(t)).select("article_id", "error", "label", "target")


@query("M2_probability_label", """
    SELECT event_id AS article_id, round(2 * p - 1, 6) AS score, CASE WHEN p >= 0.6e0 THEN 'positive' WHEN p <= 0.4e0 THEN 'negative' ELSE 'neutral' END AS label,
      round(least(0.75e0, abs(round(2 * p - 1, 6))), 6) AS confidence, CASE WHEN event_type = 'error' THEN 'impact' ELSE 'factual' END AS dimension
    FROM (SELECT *, (event_id % 1001) / 1000e0 AS p FROM events) x""")
def _(t):
    rows = t.events.selectExpr("event_id AS article_id", "(event_id % 1001) / 1000.0D AS probability",
                               "CASE WHEN event_type = 'error' THEN '自然灾害' ELSE '其他' END AS topic_category")
    return sentiment.from_probability(rows).select("article_id", "score", "label", "confidence", "dimension")


_STORED = """SELECT event_id AS result_id, concat('article:', CAST(user_id AS STRING), ':v1') AS content_identity,
    CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status, 'sentiment-prompt-v1' AS prompt_version,
    'sentiment-text-v1' AS preprocess_version, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS model_name,
    CASE WHEN event_id % 5 = 0 THEN 'inherited' ELSE 'llm' END AS method, 'neutral' AS label, value AS score FROM {events}"""


@query("M8_result_reuse", """
    WITH s AS (SELECT * FROM (""" + _STORED.replace("{events}", "events").replace("STRING", "VARCHAR") + """) q
      WHERE status = 'success' AND model_name = 'a' AND method = 'llm'),
    n AS (SELECT content_identity, max(result_id) AS result_id, arg_max(score, result_id) AS score FROM s GROUP BY 1)
    SELECT t.content_identity, n.result_id, n.score FROM (
      SELECT DISTINCT concat('article:', CAST(user_id + 20 AS VARCHAR), ':v1') AS content_identity FROM events) t
    LEFT JOIN n ON t.content_identity = n.content_identity""")
def _(t):
    targets = t.events.selectExpr("concat('article:', user_id + 20, ':v1') AS content_identity").distinct()
    stored = t.spark.sql(_STORED, events=t.events)
    return sentiment.reusable_results(targets, stored, SentimentConfig(), "a").select("content_identity", "result_id", "score")


_INHERIT = """
    WITH t AS (SELECT event_id AS article_id, event_id % 4 <> 0 AS rep, event_id - event_id % 10 + 1 AS origin FROM events),
    r AS (SELECT event_id AS article_id, CASE WHEN value > 100 THEN 'positive' ELSE 'negative' END AS label FROM events WHERE event_id % 3 <> 0)
    SELECT t.article_id, CASE WHEN rep THEN a.label ELSE b.label END AS label,
      CASE WHEN NOT rep AND b.label IS NOT NULL THEN 'inherited' WHEN rep AND a.label IS NOT NULL THEN 'llm' END AS method,
      CASE WHEN NOT rep AND b.label IS NULL THEN 'INHERITANCE_SOURCE_MISSING' END AS warning
    FROM t LEFT JOIN r a ON a.article_id = t.article_id LEFT JOIN r b ON NOT rep AND b.article_id = t.origin"""


def _inherited(t):
    targets = t.events.selectExpr("event_id AS article_id", "event_id % 4 <> 0 AS is_representative",
                                  "CASE WHEN event_id % 4 = 0 THEN event_id - event_id % 10 + 1 END AS duplicate_of_id")
    results = t.events.where("event_id % 3 <> 0").selectExpr(
        "event_id AS article_id", "CASE WHEN value > 100 THEN 'positive' ELSE 'negative' END AS label", "value AS score", "'llm' AS method")
    return sentiment.with_inherited(targets, results)


@query("M9_duplicate_inheritance", _INHERIT)
def _(t):
    return _inherited(t).select("article_id", "label", "method", "warning")


@query("M10_success_gate", f"""SELECT article_id % 10 AS run_id, round(avg(CASE WHEN label IS NULL THEN 0e0 ELSE 1e0 END), 6) AS success_ratio,
    avg(CASE WHEN label IS NULL THEN 0e0 ELSE 1e0 END) >= 0.8e0 AS passed FROM ({_INHERIT}) x GROUP BY 1""")
def _(t):
    runs = _inherited(t).withColumn("run_id", F.col("article_id") % 10)
    return sentiment.success_gate(runs, ["run_id"]).withColumn("success_ratio", F.round("success_ratio", 6))


@query("M11_event_snapshot", with_views("sentiment_item", """
    SELECT event_id, count(*) AS article_count, count(DISTINCT CAST(coalesce(publish_time, observed_time) AS DATE)) AS day_count,
      count(DISTINCT platform) AS platform_count,
      concat_ws(',', CASE WHEN count(*) FILTER (WHERE publish_time IS NULL) > 0 THEN 'TIME_SOURCE_DEGRADED' END,
        CASE WHEN min(pn) < 3 OR min(pr) < 2 THEN 'PLATFORM_SAMPLE_INSUFFICIENT' END) AS warnings,
      any_value(days) AS days, any_value(platforms) AS platforms,
      CASE WHEN count(*) FILTER (WHERE is_representative AND publish_time IS NOT NULL) / CAST(count(*) FILTER (WHERE is_representative) AS DOUBLE) >= 0.8 THEN 'high'
        WHEN count(*) FILTER (WHERE is_representative AND publish_time IS NOT NULL) / CAST(count(*) FILTER (WHERE is_representative) AS DOUBLE) >= 0.5 THEN 'medium' ELSE 'low' END AS time_confidence
    FROM (SELECT *, count(*) OVER (PARTITION BY event_id, platform) AS pn,
      count(*) FILTER (WHERE is_representative) OVER (PARTITION BY event_id, platform) AS pr FROM sentiment_item) x
    JOIN (SELECT event_id, string_agg(concat(d, ':', n), ',' ORDER BY d) AS days FROM (SELECT event_id, CAST(coalesce(publish_time, observed_time) AS DATE) AS d, count(*) AS n FROM sentiment_item GROUP BY 1, 2) GROUP BY 1) USING (event_id)
    JOIN (SELECT event_id, string_agg(concat(platform, ':', n), ',' ORDER BY platform) AS platforms FROM (SELECT event_id, platform, count(*) AS n FROM sentiment_item GROUP BY 1, 2) GROUP BY 1) USING (event_id)
    GROUP BY event_id"""))
def _(t):
    return sentiment.event_snapshot(t.sentiment_item).select(
        "event_id", "article_count", F.size("days").cast("long").alias("day_count"),
        F.size("platforms").cast("long").alias("platform_count"), F.array_join("warnings", ",").alias("warnings"), "time_confidence",
        F.array_join(F.transform("days", lambda d: F.concat_ws(":", d["day"].cast("string"), d["article_count"])), ",").alias("days"),
        F.array_join(F.transform("platforms", lambda p: F.concat_ws(":", p["platform"], p["article_count"])), ",").alias("platforms"))


@query("M12_current_sentiment", with_views("sentiment_item", """
    WITH s AS (SELECT event_id AS event_id, CAST(max(article_id) AS BIGINT) AS snapshot_id, CAST(platform AS VARCHAR) AS platform,
        round(avg(score), 6) AS v FROM sentiment_item WHERE event_id % 3 <> 2 GROUP BY event_id, platform),
    e AS (SELECT event_id, max(article_id) AS pin FROM sentiment_item GROUP BY event_id)
    SELECT e.event_id, CASE WHEN p.v IS NOT NULL THEN 'current' WHEN n.v IS NOT NULL THEN 'latest' ELSE 'event' END AS sentiment_source,
      coalesce(p.v, n.v, 0.25e0) AS positive_ratio
    FROM e LEFT JOIN s p ON p.snapshot_id = e.pin AND e.event_id % 3 = 0
    LEFT JOIN (SELECT event_id, arg_max(v, snapshot_id) AS v FROM s GROUP BY event_id) n ON n.event_id = e.event_id"""))
def _(t):
    items = t.sentiment_item
    snapshots = items.where("event_id % 3 <> 2").groupBy("event_id", "platform").agg(
        F.max("article_id").alias("snapshot_id"), F.round(F.avg("score"), 6).alias("positive_ratio"),
        F.lit(0.0).alias("negative_ratio"), F.lit(0.0).alias("neutral_ratio"), F.lit(0).alias("calculated_at"))
    events = items.groupBy("event_id").agg(
        F.max(F.when(F.col("event_id") % 3 == 0, F.col("article_id"))).alias("current_snapshot_id")).withColumns(
        {"positive_ratio": F.lit(0.25), "negative_ratio": F.lit(0.25), "neutral_ratio": F.lit(0.5)})
    return sentiment.current_sentiment(events, snapshots).select("event_id", "sentiment_source", "positive_ratio")


@query("N20_sentiment_triple", """
    SELECT event_id, CASE WHEN s <= 0 THEN 0e0 ELSE round(p / s, 6) END AS positive, CASE WHEN s <= 0 THEN 0e0 ELSE round(n / s, 6) END AS negative,
      CASE WHEN s <= 0 THEN 1e0 ELSE round(u / s, 6) END AS neutral
    FROM (SELECT *, p + n + u AS s FROM (SELECT event_id, least(1e0, value / 100) AS p, least(1e0, greatest(0e0, value / 300 - 0.1e0)) AS n,
      CASE WHEN event_id % 2 = 0 THEN 0e0 ELSE 0.3e0 END AS u FROM events) x) y""")
def _(t):
    from murmur.operators.reports import normalized_triple

    triple = normalized_triple(F.col("value") / 100, F.least(F.lit(1.0), F.col("value") / 300 - 0.1),
                               F.when(F.col("event_id") % 2 == 1, 0.3))
    return t.events.select("event_id", triple.alias("t")).select(
        "event_id", *[F.round(f"t.{c}", 6).alias(c) for c in ("positive", "negative", "neutral")])
