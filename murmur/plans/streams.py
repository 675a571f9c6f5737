"""Streaming queries over the event table read as a file stream."""

from pyspark.sql import functions as F

from murmur.operators import hotlist
from murmur.plans.heat import _RRF
from murmur.plans.registry import ORACLE, VIEWS, query, with_views
from murmur.plans.sources import _OBS
from murmur.streaming import streams


def event_stream(t):
    """The event file as a stream."""
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def published(t):
    return event_stream(t).select(F.col("user_id").alias("event_id"), F.col("event_id").alias("article_id"), F.col("ts").cast("timestamp").alias("published"))


def stateful(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    return t


_MARK = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("T1_distinct_documents", "SELECT count(DISTINCT user_id) AS documents FROM events")
def _(t):
    docs = event_stream(t).select(F.sha2(F.col("user_id").cast("string"), 256).alias("url_hash"), F.col("ts").cast("timestamp").alias("crawled_at"))
    return streams.drain(streams.distinct_documents(docs, late="40 days"), "documents").agg(F.count("*").alias("documents"))


@query("T2_daily_counts", f"""SELECT user_id AS event_id, CAST(ts AS DATE) AS day, count(*) AS count FROM events GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {_MARK}""".replace("HAVING CAST(ts AS DATE)", "HAVING max(CAST(ts AS DATE))"))
def _(t):
    return streams.drain(streams.daily_counts(published(t)), "daily")


@query("T2_daily_sentiment", with_views("sentiment_item", f"""SELECT event_id, CAST(publish_time AS DATE) AS day, count(*) AS article_count, count(*) FILTER (WHERE label = 'positive') AS positive_count FROM sentiment_item
    WHERE publish_time IS NOT NULL GROUP BY 1, 2 HAVING max(CAST(publish_time AS DATE)) + INTERVAL 1 DAY <= (SELECT max(publish_time) FROM sentiment_item) - INTERVAL 1 HOUR"""))
def _(t):
    items = t.spark.sql(VIEWS["sentiment_item"], events=event_stream(t)).where("publish_time is not null")
    return streams.drain(streams.daily_sentiment(items), "sentiment").select("event_id", "day", "article_count", "positive_count")


@query("T3_snapshot_throttle", ORACLE["S8b_snapshot_throttle"])
def _(t):
    stateful(t)
    rows = t.spark.sql(_OBS, events=event_stream(t))
    return streams.drain(streams.throttled_snapshots(rows), "throttle").select("observation_id", "article_id", "content_changed")


@query("T4_sliding_reports", f"""SELECT user_id AS event_id, strftime(u, '%Y-%m-%d %H:%M:%S') AS until, count(*) AS reports_24h FROM (SELECT user_id, ts, date_trunc('hour', ts) + INTERVAL 1 HOUR * (k + 1) AS u FROM events, (SELECT unnest(range(0, 24)) AS k) r) x
    WHERE u > ts AND u - INTERVAL 24 HOUR <= ts GROUP BY 1, u HAVING u <= {_MARK}""")
def _(t):
    out = streams.drain(streams.sliding_reports(published(t)), "sliding")
    return out.select("event_id", F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"), "reports_24h")


@query("T5_hot_list_fusion", _RRF.replace("{items}", """(SELECT event_type AS source, CAST(1 + event_id % 30 AS INT) AS rank, 'topic ' || CAST(user_id AS VARCHAR) || ' x' AS title, NULL AS source_url FROM events) e""").replace(", ranks\nFROM", "\nFROM")
       + " ORDER BY round(f.s, 12) DESC, source_count DESC, best_rank, s.title LIMIT 10")
def _(t):
    items = t.spark.sql("""SELECT event_type AS source, CAST(1 + event_id % 30 AS INT) AS rank, concat('topic ', user_id, ' x') AS title,
        CAST(NULL AS STRING) AS source_url, props AS payload FROM {events}""", events=event_stream(t))
    folder = streams.scratch_folder(t.spark, "fusion")
    streams.fuse_batches(items, f"{folder}/runs", f"{folder}/state", availableNow=True).awaitTermination()
    runs = t.spark.read.parquet(f"{folder}/runs")
    return runs.select("key", "title", F.round("fused_score", 9).alias("fused_score"), "source_count", F.col("best_rank").cast("int").alias("best_rank"))


@query("T6_request_coalescing", "SELECT count(DISTINCT user_id % 20) AS requests FROM events")
def _(t):
    requests = event_stream(t).select((F.col("user_id") % 20).cast("string").alias("fingerprint"), F.col("ts").cast("timestamp").alias("requested_at"))
    return streams.drain(streams.coalesced_requests(requests, "40 days"), "requests").agg(F.count("*").alias("requests"))


@query("T7_activity_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 86400000000 THEN 0 ELSE 1 END AS brk FROM events),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id AS event_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS reports FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 24 HOUR <= {_MARK}""")
def _(t):
    out = streams.drain(streams.activity_sessions(published(t)), "sessions")
    return out.select("event_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "reports")


@query("T8_out_of_order_guard", """SELECT event_id, snapshot_id FROM (SELECT user_id AS event_id, event_id AS snapshot_id, CAST(floor(value) AS BIGINT) AS v,
      max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) x WHERE before IS NULL OR v >= before""")
def _(t):
    stateful(t)
    rows = event_stream(t).selectExpr("user_id AS event_id", "event_id AS snapshot_id", "event_id AS arrival", "timestamp_seconds(CAST(floor(value) AS BIGINT)) AS calculated_at")
    return streams.drain(streams.in_order_snapshots(rows), "ordered")
