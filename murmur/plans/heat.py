"""Heat, hot-list and lifecycle queries."""

from pyspark.sql import functions as F

from murmur.config import HeatConfig
from murmur.functions import ranking
from murmur.operators import heat, hotlist, lifecycle
from murmur.plans.registry import query, with_views

AT = "TIMESTAMP '2024-01-31 00:00:00'"


def at():
    return F.expr(AT)


CFG = HeatConfig()


def pct(value: str, part: str = "") -> str:
    """SQL of the average-rank percentile."""
    by = f"PARTITION BY {part}" if part else ""
    both = f"PARTITION BY {part + ', ' if part else ''}{value}"
    return (
        f"CASE WHEN count(*) OVER ({by}) = 1 THEN 50e0 ELSE round(((rank() OVER ({by} ORDER BY {value}) - 1)"
        f" + (count(*) OVER ({both}) - 1) / 2e0) / (count(*) OVER ({by}) - 1) * 100, 6) END"
    )


def hours(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 3600000000e0)"


def fresh(h: str) -> str:
    return f"greatest(0e0, least(100e0, 100 * exp(-ln(2e0) * greatest(0e0, {h}) / 24e0)))"


_METRICS = """
metric AS (
  SELECT event_id, article_id, platform, metric, ln(1 + greatest(0, value)) AS v FROM (
    SELECT event_id, article_id, platform, 'comments_count' AS metric, comments_count AS value FROM heat_article
    UNION ALL SELECT event_id, article_id, platform, 'reposts_count', reposts_count FROM heat_article
    UNION ALL SELECT event_id, article_id, platform, 'likes_count', likes_count FROM heat_article
    UNION ALL SELECT event_id, article_id, platform, 'views_count', views_count FROM heat_article) x
  WHERE value IS NOT NULL)"""
_PERCENTILES = f"{_METRICS}, percentile AS (SELECT *, {pct('v', '{slice}platform, metric')} AS score FROM metric)"

_STATS = f"""
timed AS (SELECT *, coalesce(publish_time, observed_at) AS t FROM heat_article),
flagged AS (
  SELECT *, t >= {AT} - INTERVAL 7 DAY AND t <= {AT} AS inside FROM timed),
stats AS (
  SELECT event_id,
    count(*) FILTER (WHERE is_representative AND inside) AS reports_7d,
    count(*) FILTER (WHERE is_representative AND inside AND t >= {AT} - INTERVAL 24 HOUR) AS reports_24h,
    count(*) FILTER (WHERE is_representative AND inside AND t >= {AT} - INTERVAL 48 HOUR
                       AND t < {AT} - INTERVAL 24 HOUR) AS reports_prev_24h,
    count(DISTINCT platform) FILTER (WHERE is_representative AND inside) AS platform_count,
    count(*) FILTER (WHERE is_representative AND inside AND publish_time IS NULL) AS observed_time_count,
    count(*) FILTER (WHERE is_representative AND inside AND publish_time IS NOT NULL) AS reliable,
    max(t) FILTER (WHERE inside) AS latest_activity
  FROM flagged GROUP BY event_id),
growth AS (
  SELECT *, (reports_24h - reports_prev_24h) / CAST(greatest(reports_prev_24h, 1) AS DOUBLE) AS growth_rate,
    CASE WHEN reports_7d = 0 THEN 'low' WHEN reliable / CAST(reports_7d AS DOUBLE) >= 0.8 THEN 'high'
         WHEN reliable / CAST(reports_7d AS DOUBLE) >= 0.5 THEN 'medium' ELSE 'low' END AS time_confidence
  FROM stats)"""
_SPREAD = f"""
signal AS (SELECT event_id, article_id, avg(score) AS s FROM percentile GROUP BY event_id, article_id),
own AS (
  SELECT a.event_id, sum(s.s * {fresh(hours(AT, 'coalesce(a.publish_time, a.observed_at)'))} / 100
                         * a.duplicate_weight * a.spam_weight) AS own
  FROM heat_article a JOIN signal s ON a.event_id = s.event_id AND a.article_id = s.article_id GROUP BY a.event_id),
listed AS (
  SELECT event_id, avg(greatest(0e0, 100 - (greatest(1, hot_rank) - 1) * 5e0)) AS listed, count(*) AS hotlist_count,
    min(hot_rank) AS best_hotlist_rank FROM hot_rank GROUP BY event_id),
spread AS (
  SELECT coalesce(o.event_id, l.event_id) AS event_id,
    round(coalesce(own, 0) + coalesce(listed, 0), 9) AS spread_raw,
    coalesce(hotlist_count, 0) AS hotlist_count, best_hotlist_rank
  FROM own o FULL JOIN listed l ON o.event_id = l.event_id)"""


def _heat_sql(slice_: str = "") -> str:
    part = slice_.rstrip(", ")
    scores = lambda c: pct(c, part)
    return f"""WITH {_PERCENTILES.replace('{slice}', slice_)}, {_STATS}, {_SPREAD},
joined AS (SELECT g.*, s.spread_raw, coalesce(s.hotlist_count, 0) AS hotlist_count, s.best_hotlist_rank
  FROM growth g LEFT JOIN spread s ON g.event_id = s.event_id),
spread_score AS (SELECT event_id, {scores('spread_raw')} AS spread_heat FROM joined WHERE spread_raw IS NOT NULL),
scored AS (
  SELECT j.*, {scores('j.reports_7d')} AS report_score, {scores('growth_rate')} AS growth_score,
    {scores('platform_count')} AS platform_score,
    round({fresh(f"coalesce({hours(AT, 'latest_activity')}, 168e0)")}, 6) AS freshness_score
  FROM joined j),
core AS (
  SELECT c.*, s.spread_heat, round((report_score + growth_score + platform_score + freshness_score) / 4, 6) AS core_heat
  FROM scored c LEFT JOIN spread_score s ON c.event_id = s.event_id),
final AS (
  SELECT *, CASE WHEN spread_heat IS NULL THEN core_heat
      ELSE round(0.7e0 * core_heat + 0.3e0 * spread_heat, 6) END AS final_heat,
    reports_7d >= 3 AND (platform_count >= 2 OR hotlist_count > 0)
      AND coalesce(latest_activity >= {AT} - INTERVAL 24 HOUR, false) AS eligible_as_hot
  FROM core),
ranked AS (
  SELECT event_id, CAST(rn AS INT) AS hot_rank FROM (
    SELECT event_id, row_number() OVER ({'PARTITION BY ' + part if part else ''} ORDER BY final_heat DESC, event_id) AS rn
    FROM final WHERE eligible_as_hot) x WHERE rn <= 20)"""


def _heat(t, population=()):
    return heat.event_heat(t.heat_article, t.hot_rank, at(), CFG, population)


@query("H1_average_rank_percentile", with_views("", f"""
    SELECT event_id, round(value, 6) AS value, {pct('value')} AS score FROM events""").replace("WITH  ", ""))
def _(t):
    return ranking.with_percentile(t.events.select("event_id", "value"), "value").withColumn(
        "value", F.round("value", 6))


@query("H2_engagement_percentiles", with_views("heat_article", f"""
    WITH {_PERCENTILES.replace('{slice}', '')} SELECT article_id, platform, metric, score FROM percentile"""))
def _(t):
    return heat.engagement_percentiles(t.heat_article).select("article_id", "platform", "metric", "score")


@query("H3_freshness_decay", with_views("heat_article", f"""
    SELECT article_id, round({fresh(hours(AT, 'coalesce(publish_time, observed_at)'))}, 6) AS freshness
    FROM heat_article"""))
def _(t):
    age = heat.hours_between(at(), heat.effective_time())
    return t.heat_article.select("article_id", F.round(heat.freshness(age, 24), 6).alias("freshness"))


@query("H4_time_confidence", with_views("heat_article", """
    SELECT event_id, platform, CASE WHEN count(*) FILTER (WHERE is_representative) = 0 THEN 'low'
      WHEN avg(CASE WHEN publish_time IS NULL THEN 0e0 ELSE 1e0 END) FILTER (WHERE is_representative) >= 0.8 THEN 'high'
      WHEN avg(CASE WHEN publish_time IS NULL THEN 0e0 ELSE 1e0 END) FILTER (WHERE is_representative) >= 0.5 THEN 'medium'
      ELSE 'low' END AS time_confidence
    FROM heat_article GROUP BY event_id, platform"""))
def _(t):
    rep = F.col("is_representative")
    return t.heat_article.groupBy("event_id", "platform").agg(
        F.count_if(rep & F.col("publish_time").isNotNull()).alias("a"), F.count_if(rep).alias("b")
    ).select("event_id", "platform", heat.time_confidence(F.col("a"), F.col("b")).alias("time_confidence"))


_STAT_COLUMNS = ("event_id, reports_7d, reports_24h, reports_prev_24h, platform_count, observed_time_count, "
                 "round(growth_rate, 6) AS growth_rate, time_confidence")


@query("H5_report_statistics", with_views("heat_article", f"""WITH {_STATS}
    SELECT {_STAT_COLUMNS}, strftime(latest_activity, '%Y-%m-%d %H:%M:%S') AS latest_activity FROM growth"""))
def _(t):
    return heat.report_statistics(t.heat_article, at()).selectExpr(
        *[c.strip() for c in _STAT_COLUMNS.replace("round(growth_rate, 6)", "round(growth_rate; 6)").split(",")][:6],
        "round(growth_rate, 6) AS growth_rate", "time_confidence",
        "date_format(latest_activity, 'yyyy-MM-dd HH:mm:ss') AS latest_activity")


@query("H6_spread_raw", with_views("heat_article hot_rank", f"""
    WITH {_PERCENTILES.replace('{slice}', '')}, {_SPREAD}
    SELECT event_id, round(spread_raw, 6) AS spread_raw, hotlist_count, best_hotlist_rank FROM spread"""))
def _(t):
    return heat.spread_raw(t.heat_article, t.hot_rank, at()).withColumn("spread_raw", F.round("spread_raw", 6))


# the six-digit values are sums of six-digit parts, so their last digit sits on rounding ties: compare four
_SCORES = ("event_id, report_score, growth_score, platform_score, freshness_score, round(core_heat, 4) AS core_heat, "
           "spread_heat, round(final_heat, 4) AS final_heat")


def _split(columns):
    return [c.strip().replace("; 4)", ", 4)") for c in columns.replace(", 4)", "; 4)").split(",")]


@query("H7_event_heat", with_views("heat_article hot_rank", f"{_heat_sql()} SELECT {_SCORES} FROM final"))
def _(t):
    return _heat(t).selectExpr(*_split(_SCORES))


@query("H8_hot_eligibility", with_views("heat_article hot_rank", f"{_heat_sql()} SELECT event_id, eligible_as_hot FROM final"))
def _(t):
    return _heat(t).select("event_id", "eligible_as_hot")


@query("H9_hot_ranking", with_views("heat_article hot_rank", f"""{_heat_sql()}
    SELECT f.event_id, round(final_heat, 4) AS final_heat, r.hot_rank FROM final f LEFT JOIN ranked r ON f.event_id = r.event_id"""))
def hot_ranking(t):
    return _heat(t).select("event_id", F.round("final_heat", 4).alias("final_heat"), "hot_rank")


@query("H10_single_event_heat", with_views("heat_article hot_rank", f"""{_heat_sql('event_id, ')}
    SELECT {_SCORES} FROM final"""))
def _(t):
    return _heat(t, ["event_id"]).selectExpr(*_split(_SCORES))


@query("H11_metric_coalesce", with_views("heat_article", """
    SELECT a.article_id, coalesce(s.comments_count, a.comments_count) AS comments_count,
      coalesce(s.likes_count, a.likes_count) AS likes_count, coalesce(a.duplicate_weight, 1) AS duplicate_weight
    FROM heat_article a LEFT JOIN (
      SELECT article_id, CASE WHEN article_id % 4 = 0 THEN NULL ELSE comments_count + 1 END AS comments_count,
        likes_count * 2 AS likes_count FROM heat_article WHERE article_id % 3 = 0) s ON a.article_id = s.article_id"""))
def _(t):
    articles = t.heat_article.withColumn(
        "latest_snapshot_id", F.when(F.col("article_id") % 3 == 0, F.col("article_id")))
    snapshots = t.heat_article.where("article_id % 3 = 0").selectExpr(
        "article_id AS snapshot_id", "CASE WHEN article_id % 4 <> 0 THEN comments_count + 1 END AS comments_count",
        "reposts_count", "likes_count * 2 AS likes_count", "views_count")
    return heat.coalesce_metrics(articles, snapshots).select(
        "article_id", "comments_count", "likes_count", "duplicate_weight")


@query("H12_hotlist_ranks", """
    SELECT event_id, hot_rank, count(*) AS n FROM (
      SELECT user_id AS event_id, CAST(json_extract_string(props, '$.k') AS INT) AS hot_rank FROM events
      WHERE event_type = 'signup' AND CAST(json_extract_string(props, '$.k') AS INT) <> 0
      UNION ALL SELECT user_id, CAST(event_id % 50 AS INT) FROM events WHERE event_type <> 'signup') x
    GROUP BY event_id, hot_rank""")
def _(t):
    seeds = t.events.where("event_type <> 'signup'").selectExpr("user_id AS event_id", "event_id % 50 AS source_rank")
    listed = t.events.where("event_type = 'signup'").selectExpr(
        "user_id AS event_id", "'hotlist' AS source_type", "replace(props, '\"k\"', '\"rank\"') AS raw_json")
    return heat.hotlist_ranks(seeds, listed).groupBy("event_id", "hot_rank").agg(F.count("*").alias("n"))


_CHANGES = """WITH prev AS (
  SELECT *, lag(eligible_as_hot) OVER w AS was, lag(final_heat) OVER w AS before FROM heat_snapshot
  WINDOW w AS (PARTITION BY event_id ORDER BY calculated_at, snapshot_id))
SELECT event_id, snapshot_id, CASE WHEN was IS NULL THEN CASE WHEN eligible_as_hot THEN 'new_hot' ELSE 'stable' END
  WHEN NOT eligible_as_hot AND was THEN 'left_hot' WHEN eligible_as_hot AND NOT was THEN 'reheated'
  WHEN final_heat > before + 5 THEN 'rising' WHEN final_heat < before - 5 THEN 'cooling' ELSE 'stable' END AS status_change
FROM prev"""


@query("H13_heat_status_change", with_views("heat_snapshot", _CHANGES))
def _(t):
    return heat.status_changes(t.heat_snapshot).select("event_id", "snapshot_id", "status_change")


@query("H14_left_hot_sweep", with_views("heat_snapshot", f"""
    SELECT event_id, 0e0 AS final_heat, 'left_hot' AS status_change FROM (
      SELECT event_id, max_by(eligible_as_hot, calculated_at) AS hot, max(calculated_at) AS seen_at
      FROM heat_snapshot WHERE calculated_at < TIMESTAMP '2024-01-30' GROUP BY event_id) c
    WHERE hot AND seen_at <= {AT} AND event_id NOT IN (SELECT event_id FROM heat_snapshot
      WHERE calculated_at = TIMESTAMP '2024-01-30' AND eligible_as_hot)"""))
def _(t):
    day = F.expr("TIMESTAMP '2024-01-30'")
    past = heat.current_snapshot(t.heat_snapshot.where(F.col("calculated_at") < day)).withColumnRenamed(
        "eligible_as_hot", "is_hot")
    seen = t.heat_snapshot.where((F.col("calculated_at") == day) & F.col("eligible_as_hot"))
    return heat.left_hot_sweep(past, seen, at()).select("event_id", "final_heat", "status_change")


@query("H15_current_snapshot", with_views("heat_snapshot", """
    SELECT event_id, arg_max(snapshot_id, calculated_at) AS snapshot_id, arg_max(final_heat, calculated_at) AS final_heat
    FROM heat_snapshot GROUP BY event_id"""))
def _(t):
    return heat.current_snapshot(t.heat_snapshot).select("event_id", "snapshot_id", "final_heat")


@query("H16_dominant_topic", """
    SELECT event_id, topic, n AS topic_articles FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, topic) AS rn FROM (
        SELECT user_id AS event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS topic, count(*) AS n
        FROM events GROUP BY 1, 2) x) y WHERE rn = 1""")
def _(t):
    members = t.events.selectExpr("user_id AS event_id", "CAST(get_json_object(props, '$.k') AS BIGINT) % 7 AS topic")
    return heat.dominant_topic(members)


@query("H17_current_hot_list", with_views("heat_article hot_rank", f"""{_heat_sql()}
    SELECT r.hot_rank, r.event_id, concat('event ', CAST(r.event_id AS VARCHAR)) AS title, round(f.final_heat, 4) AS final_heat
    FROM ranked r JOIN final f ON r.event_id = f.event_id"""))
def _(t):
    titles = t.events.select(F.col("user_id").alias("event_id")).distinct().withColumn(
        "title", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    return heat.current_hot_list(_heat(t), titles).select(
        "hot_rank", "event_id", "title", F.round("final_heat", 4).alias("final_heat"))


_RRF = """WITH keyed AS (
  SELECT lower(source) AS source, rank, title, lower(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) AS key
  FROM (SELECT source, rank, trim(title) AS title, source_url FROM {items}) i),
best AS (SELECT key, source, min(rank) AS rank, min(title) AS title FROM keyed GROUP BY key, source),
fused AS (
  SELECT key, sum(1 / (60e0 + rank)) AS s, count(*) AS source_count, min(rank) AS best_rank,
    string_agg(source || '=' || CAST(rank AS VARCHAR), ',' ORDER BY source) AS ranks FROM best GROUP BY key),
shown AS (SELECT key, arg_min(title, (rank, source, title)) AS title FROM keyed GROUP BY key)
SELECT f.key, s.title, round(f.s, 9) AS fused_score, source_count, best_rank, ranks
FROM fused f JOIN shown s ON f.key = s.key"""
_MAP = "array_join(transform(map_entries(source_ranks), e -> concat(e.key, '=', e.value)), ',') AS ranks"


@query("H18_rank_fusion", with_views("hot_rank_item", _RRF.replace("{items}", "hot_rank_item")))
def _(t):
    return hotlist.fuse_rankings(t.hot_rank_item).selectExpr(
        "key", "title", "round(fused_score, 9) AS fused_score", "source_count", "CAST(best_rank AS INT) AS best_rank", _MAP)


_LANDED = """
  SELECT event_type AS source, concat('item ', CAST(user_id AS STRING), ' x') AS title, props AS raw_json,
    concat('https://list.example.com/', CAST(event_id AS STRING)) AS source_url,
    row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS position FROM events"""


def _landed(t):
    t.events.createOrReplaceTempView("murmur_landed_events")
    return t.spark.sql(_LANDED.replace("FROM events", "FROM murmur_landed_events"))


@query("H19_daily_hot_run", f"""WITH hot_rank_item AS (
    SELECT source, title, source_url, CAST(position AS INT) AS rank FROM ({_LANDED.replace('STRING', 'VARCHAR')}) l
    WHERE position <= 30 AND source IN ('view', 'click', 'purchase')), {_RRF[5:].replace('{items}', 'hot_rank_item')}
    ORDER BY round(f.s, 12) DESC, source_count DESC, best_rank, title LIMIT 10""")
def _(t):
    header, items = hotlist.daily_run(_landed(t), ["view", "click", "purchase"], F.expr("DATE '2024-01-31'"))
    return items.selectExpr(
        "key", "title", "round(fused_score, 9) AS fused_score", "source_count", "CAST(best_rank AS INT) AS best_rank", _MAP)


@query("H19_daily_hot_run_header", """
    SELECT DATE '2024-01-31' AS run_date, 'partial' AS status, string_agg(s, ',' ORDER BY s) AS available, 'nothere' AS failed
    FROM (SELECT DISTINCT event_type AS s FROM events WHERE event_type IN ('view', 'click')) x""")
def _(t):
    header, _items = hotlist.daily_run(_landed(t), ["view", "click", "nothere"], F.expr("DATE '2024-01-31'"))
    return header.select("run_date", "status", F.array_join("available_sources", ",").alias("available"),
                         F.array_join("failed_sources", ",").alias("failed"))


_RUNS = """SELECT CAST(ts AS DATE) AS run_date, user_id % 3 AS config_hash, event_id AS run_id, event_id % 50 AS attempt,
  CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'success' END AS status, CAST(ts AS TIMESTAMP) AS completed_at FROM {events}"""


def _runs(t):
    return t.spark.sql(_RUNS, events=t.events)


@query("H19_reusable_run", f"""
    SELECT run_date, config_hash, run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_date, config_hash
      ORDER BY attempt DESC, run_id DESC) AS rn FROM ({_RUNS.format(events='events')}) r) x
    WHERE rn = 1 AND status IN ('success', 'partial')
      AND floor(epoch(TIMESTAMP '2024-01-30 23:59:00')) - floor(epoch(completed_at)) <= 864000""")
def _(t):
    return hotlist.reusable_run(_runs(t), F.expr("TIMESTAMP '2024-01-30 23:59:00'"), 864000).select(
        "run_date", "config_hash", "run_id")


@query("H20_latest_run", f"""
    SELECT r.run_id, r.run_date, r.status,
      floor(epoch({AT})) - floor(epoch(completed_at)) > 900 AS stale, i.rank FROM (
      SELECT * FROM ({_RUNS.format(events='events')}) r ORDER BY run_date DESC, attempt DESC, run_id DESC LIMIT 1) r
    JOIN (SELECT event_id AS run_id, value AS rank FROM events) i ON r.run_id = i.run_id""")
def _(t):
    items = t.events.selectExpr("event_id AS run_id", "value AS rank")
    return hotlist.latest_run(_runs(t), items, at()).select("run_id", "run_date", "status", "stale", "rank")


@query("H21_merge_hot_seeds", with_views("hot_seed", """
    SELECT trim(title, '#') AS query, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms,
      min(rank) AS best_rank, count(DISTINCT seed_id) AS seed_count,
      strftime(min(snapshot_time), '%Y-%m-%d %H:%M:%S') AS first_seen_at,
      strftime(max(snapshot_time), '%Y-%m-%d %H:%M:%S') AS last_seen_at
    FROM hot_seed GROUP BY 1"""))
def _(t):
    return hotlist.merge_seeds(t.hot_seed).select(
        "query", F.array_join("platforms", ",").alias("platforms"), "best_rank", "seed_count",
        F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen_at"),
        F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen_at"))


@query("H21_seed_members", with_views("hot_seed", """SELECT DISTINCT trim(title, '#') AS query, seed_id FROM hot_seed"""))
def _(t):
    return hotlist.seed_members(t.hot_seed)


@query("H21_seed_order", with_views("hot_seed", """SELECT query, CAST(row_number() OVER (ORDER BY best, platforms DESC, query) AS INT) AS rank FROM (
      SELECT trim(title, '#') AS query, coalesce(min(rank), 1000000) AS best, count(DISTINCT platform) AS platforms FROM hot_seed GROUP BY 1) x QUALIFY rank <= 50"""))
def _(t):
    # the list that is served: the first fifty merged seeds
    return ranking.top_overall(hotlist.merge_seeds(t.hot_seed), hotlist.seed_order(), 50).select("query", "rank")


@query("H22_seed_expansion", with_views("hot_seed", """
    WITH q AS (SELECT trim(title, '#') AS query, seed_id, rank FROM hot_seed),
    best AS (SELECT query, min(rank) AS source_rank FROM q GROUP BY query),
    found AS (SELECT DISTINCT concat('topic ', CAST(user_id AS VARCHAR)) AS query, event_id AS article_id, event_type AS platform
      FROM events),
    bridge AS (SELECT DISTINCT seed_id AS seed_article_id, q.query AS search_query, article_id, platform, source_rank
      FROM q JOIN best b ON q.query = b.query JOIN found f ON f.query = q.query)
    SELECT * FROM bridge WHERE article_id % 10 <> 0"""))
def _(t):
    found = t.events.selectExpr(
        "concat('topic ', user_id) AS search_query", "event_id AS article_id", "event_type AS platform")
    stored = hotlist.expansion_bridge(t.hot_seed, found.where("article_id % 10 = 0"))
    return hotlist.expansion_bridge(t.hot_seed, found, stored)


# ---- trend and lifecycle

@query("L1_daily_counts", with_views("heat_article", """
    SELECT event_id, CAST(coalesce(publish_time, observed_at) AS DATE) AS day, count(*) AS count
    FROM heat_article GROUP BY 1, 2"""))
def _(t):
    return lifecycle.daily_counts(t.heat_article)


@query("L2_moving_average", with_views("daily", """
    SELECT event_id, day, round(avg(count) OVER (PARTITION BY event_id ORDER BY day
      ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smoothed FROM daily"""))
def _(t):
    return lifecycle.smoothed(t.daily).select("event_id", "day", F.round("smoothed", 6).alias("smoothed"))


@query("L3_growth_rate", with_views("daily", """
    SELECT event_id, day, round(CASE WHEN p IS NULL THEN 0 WHEN p = 0 THEN CASE WHEN count > 0 THEN 1 ELSE 0 END
      ELSE (count - p) / CAST(p AS DOUBLE) END, 6) AS growth_rate
    FROM (SELECT *, lag(count) OVER (PARTITION BY event_id ORDER BY day) AS p FROM daily) x"""))
def _(t):
    return lifecycle.growth_rates(t.daily).select("event_id", "day", F.round("growth_rate", 6).alias("growth_rate"))


_FEATS = """WITH idx AS (SELECT event_id, day, CAST(count AS DOUBLE) AS y, row_number() OVER w AS n,
    lag(CAST(count AS DOUBLE), 1) OVER w AS y1, lag(CAST(count AS DOUBLE), 2) OVER w AS y2, lag(CAST(count AS DOUBLE), 3) OVER w AS y3
  FROM daily WINDOW w AS (PARTITION BY event_id ORDER BY day)),
run AS (SELECT *, first_value(y) OVER w AS f, sum(y) OVER w AS total, max(y) OVER w AS peak,
    regr_slope(y, n) OVER (PARTITION BY event_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS slope,
    avg(y) OVER (PARTITION BY event_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ra,
    max(y) OVER (PARTITION BY event_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
      - min(y) OVER (PARTITION BY event_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rv
  FROM idx WINDOW w AS (PARTITION BY event_id ORDER BY n)),
pk AS (SELECT r.event_id, r.n, min(i.n) - 1 AS pi FROM run r JOIN idx i ON i.event_id = r.event_id AND i.n <= r.n AND i.y = r.peak
  GROUP BY r.event_id, r.n),
feat AS (SELECT r.*, pi, CASE WHEN r.n >= 4 THEN slope / greatest(1, peak) END AS ns,
    coalesce(y3 > y2 AND y2 > y1 AND y1 > y AND y <= y3 * 0.85e0, false) AS decline
  FROM run r JOIN pk ON r.event_id = pk.event_id AND r.n = pk.n),
stage AS (SELECT *, CASE WHEN n < 4 THEN NULL
    WHEN decline OR (peak > 0 AND pi < n - 2 AND y <= peak * 0.5e0) THEN '消退期'
    WHEN peak <= 5 AND total <= greatest(25, 5 * n) THEN '潜伏期'
    WHEN ra / peak >= 0.85e0 AND rv / greatest(1, peak) <= 0.2e0 AND abs(ns) <= 0.08e0 THEN '高潮期'
    WHEN ns > 0.05e0 AND y >= f THEN '成长期' WHEN peak <= 9 THEN '潜伏期' ELSE '成长期' END AS raw_stage,
    coalesce(y2 < y1 AND y1 < y AND ns >= 0.08e0 AND y / peak >= 0.5e0, false) AS react FROM feat)"""


@query("L4_linear_slope", with_views("daily", f"{_FEATS} SELECT event_id, day, round(slope, 6) AS slope FROM feat WHERE n >= 4"))
def _(t):
    return lifecycle.prefix_features(t.daily).where("n >= 4").select("event_id", "day", F.round("slope", 6).alias("slope"))


@query("L5_sustained_decline", with_views("daily", f"{_FEATS} SELECT event_id, day, decline AS sustained_decline FROM feat"))
def _(t):
    return lifecycle.prefix_features(t.daily).select("event_id", "day", "sustained_decline")


@query("L6_lifecycle_stage", with_views("daily", f"""{_FEATS}, last AS (
    SELECT *, CASE event_id % 4 WHEN 0 THEN '高潮期' WHEN 1 THEN '消退期' WHEN 2 THEN '成长期' END AS prev FROM stage
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC) = 1),
  base AS (SELECT *, CASE WHEN decline OR (peak > 0 AND pi < n - 2 AND y <= peak * 0.5e0) THEN 0.82e0
    WHEN peak <= 5 AND total <= greatest(25, 5 * n) THEN 0.68e0
    WHEN ra / peak >= 0.85e0 AND rv / greatest(1, peak) <= 0.2e0 AND abs(ns) <= 0.08e0 THEN 0.78e0
    WHEN ns > 0.05e0 AND y >= f THEN least(0.9e0, 0.62e0 + ns) WHEN peak <= 9 THEN 0.56e0 ELSE 0.55e0 END AS c FROM last)
  SELECT event_id, CASE WHEN raw_stage IS NULL THEN coalesce(prev, '潜伏期')
      WHEN prev = '高潮期' AND raw_stage IN ('潜伏期', '成长期') THEN '高潮期'
      WHEN prev = '消退期' THEN CASE WHEN react THEN '成长期' ELSE '消退期' END
      WHEN prev = '成长期' AND raw_stage = '潜伏期' THEN '成长期' ELSE raw_stage END AS stage,
    CASE WHEN raw_stage IS NULL THEN 'data_insufficient' ELSE 'sufficient' END AS status,
    round(CASE WHEN raw_stage IS NULL THEN least(0.45e0, 0.15e0 + n * 0.08e0)
      WHEN prev = '高潮期' AND raw_stage IN ('潜伏期', '成长期') THEN least(c, 0.6e0)
      WHEN prev = '消退期' THEN CASE WHEN react THEN greatest(c, 0.72e0) ELSE greatest(c, 0.7e0) END
      WHEN prev = '成长期' AND raw_stage = '潜伏期' THEN least(c, 0.6e0) ELSE c END, 3) AS confidence,
    coalesce(raw_stage IS NOT NULL AND prev = '消退期' AND react, false) AS reactivated FROM base"""))
def _(t):
    daily = t.daily
    previous = daily.select("event_id").distinct().selectExpr(
        "event_id", "CASE event_id % 4 WHEN 0 THEN '高潮期' WHEN 1 THEN '消退期' WHEN 2 THEN '成长期' END AS previous_stage")
    return lifecycle.lifecycle_stage(daily, previous).select("event_id", "stage", "status", "confidence", "reactivated")


@query("L7_stage_change_points", with_views("daily", f"""{_FEATS.replace('WITH idx', 'WITH RECURSIVE idx', 1)},
  walk AS (SELECT event_id, n, day, '潜伏期' AS stage, CAST(NULL AS VARCHAR) AS from_stage FROM stage WHERE n = 1
    UNION ALL SELECT s.event_id, s.n, s.day, CASE WHEN s.raw_stage IS NULL THEN w.stage
      WHEN w.stage = '高潮期' AND s.raw_stage IN ('潜伏期', '成长期') THEN '高潮期'
      WHEN w.stage = '消退期' THEN CASE WHEN s.react THEN '成长期' ELSE '消退期' END
      WHEN w.stage = '成长期' AND s.raw_stage = '潜伏期' THEN '成长期' ELSE s.raw_stage END, w.stage
    FROM walk w JOIN stage s ON s.event_id = w.event_id AND s.n = w.n + 1)
  SELECT event_id, day, from_stage, stage AS to_stage, CAST(n - 1 AS INT) AS idx FROM walk
  WHERE from_stage IS NOT NULL AND from_stage <> stage""").replace("WITH daily", "WITH RECURSIVE daily", 1).replace("RECURSIVE idx", "idx"))
def _(t):
    return lifecycle.change_points(t.daily)


@query("L8_trend_key_points", with_views("daily", """
    WITH p AS (SELECT event_id, 1 AS ord, '首次出现' AS label, arg_min(count, day) AS count, min(day) AS day FROM daily GROUP BY event_id
      UNION ALL SELECT event_id, 2, '峰值', count, day FROM (SELECT *, row_number() OVER (PARTITION BY event_id
        ORDER BY count DESC, day) AS rn FROM daily) x WHERE rn = 1
      UNION ALL SELECT event_id, 3, '最近', arg_max(count, day), max(day) FROM daily GROUP BY event_id)
    SELECT event_id, CAST(ord AS INT) AS ord, label || '（' || CAST(count AS VARCHAR) || '篇）' AS name, day, count FROM p
    QUALIFY row_number() OVER (PARTITION BY event_id, day, count ORDER BY ord) = 1"""))
def _(t):
    return lifecycle.key_points(t.daily)


@query("L9_event_trend_series", with_views("heat_article heat_snapshot", """
    WITH c AS (SELECT event_id, CAST(publish_time AS DATE) AS day, count(*) AS count FROM heat_article
      WHERE publish_time IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT event_id, CAST(calculated_at AS DATE) AS day, arg_max(final_heat, snapshot_id) AS heat FROM heat_snapshot GROUP BY 1, 2)
    SELECT event_id, day, count, heat FROM (
      SELECT c.event_id, c.day, c.count, h.heat, row_number() OVER (PARTITION BY c.event_id ORDER BY c.day DESC) AS rn
      FROM c LEFT JOIN h ON c.event_id = h.event_id AND c.day = h.day) x WHERE rn <= 14"""))
def _(t):
    return lifecycle.trend_series(t.heat_article, t.heat_snapshot)
