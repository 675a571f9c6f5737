"""Structured Streaming forms: the same rules on unbounded input, with watermarks bounding the state.

Each function maps a streaming DataFrame to a streaming DataFrame (or starts a micro-batch writer); callers
choose the sink. State is keyed by article, event or fingerprint, so it spreads with the keys."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from murmur.operators.sentiment import summarize

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def distinct_documents(docs: DataFrame, key: str = "url_hash", time: str = "crawled_at", late: str = "1 hour") -> DataFrame:
    """First document per address within the watermark."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_counts(articles: DataFrame, late: str = "1 hour") -> DataFrame:
    """Articles per event and day; a day is emitted once no more late rows can join it."""
    windowed = articles.withWatermark("published", late).groupBy("event_id", F.window("published", "1 day"))
    return windowed.agg(F.count("*").alias("count")).select("event_id", F.to_date("window.start").alias("day"), "count")


def daily_sentiment(items: DataFrame, late: str = "1 hour") -> DataFrame:
    """Weighted daily sentiment on a stream: the one-pass summary grouped by event and day window."""
    marked = items.withWatermark("publish_time", late).withColumn("w", F.window("publish_time", "1 day"))
    return summarize(marked, ["event_id", "w"]).withColumn("day", F.to_date("w.start")).drop("w")


def sliding_reports(articles: DataFrame, late: str = "1 hour") -> DataFrame:
    """Reports of the last 24 hours, every hour."""
    windowed = articles.withWatermark("published", late).groupBy("event_id", F.window("published", "24 hours", "1 hour"))
    return windowed.agg(F.count("*").alias("reports_24h")).select("event_id", F.col("window.end").alias("until"), "reports_24h")


def coalesced_requests(requests: DataFrame, window: str = "60 seconds") -> DataFrame:
    """Equal requests within a minute of each other become one."""
    return requests.withWatermark("requested_at", window).dropDuplicatesWithinWatermark(["fingerprint"])


def activity_sessions(articles: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Bursts of reports of an event, ended by a quiet gap."""
    windowed = articles.withWatermark("published", late).groupBy("event_id", F.session_window("published", gap))
    return windowed.agg(F.count("*").alias("reports")).select(
        "event_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "reports")


class _Throttle(StatefulProcessor):
    """Keeps the last stored observation of one article and lets through what is worth storing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t bigint, state string, content string, metrics string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["t", "observation_id"])
        last = self.last.get() if self.last.exists() else None
        kept = []
        for r in frame.itertuples():
            due = last is not None and r.metrics != last[3] and r.t - last[0] >= 3_600_000_000
            if last is None or r.state != last[1] or due:
                kept.append((key[0], r.observation_id, last is None or r.content_hash != last[2]))
                last = (int(r.t), r.state, r.content_hash, r.metrics)
        if kept:
            self.last.update(last)
        yield pd.DataFrame(kept, columns=["article_id", "observation_id", "content_changed"])

    def close(self) -> None:
        pass


def throttled_snapshots(observations: DataFrame) -> DataFrame:
    """Stored observations per article; rows of one micro-batch are read in time order."""
    text = lambda *cols: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    rows = observations.select(
        "article_id", "observation_id", F.unix_micros("crawled_at").alias("t"), "content_hash",
        text("content_hash", "http_status", "fetch_status", "fetch_error").alias("state"), text("comments_count", "reposts_count", "likes_count", "views_count").alias("metrics"))
    schema = "article_id bigint, observation_id bigint, content_changed boolean"
    return rows.groupBy("article_id").transformWithStateInPandas(_Throttle(), schema, "Append", "None")


class _Newest(StatefulProcessor):
    """Remembers the newest calculation time of an event and drops older snapshots."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("arrival")
        newest = self.seen.get()[0] if self.seen.exists() else None
        kept = []
        for r in frame.itertuples():
            if newest is None or r.at >= newest:
                newest = int(r.at)
                kept.append((key[0], r.snapshot_id))
        if kept:
            self.seen.update((newest,))
        yield pd.DataFrame(kept, columns=["event_id", "snapshot_id"])

    def close(self) -> None:
        pass


def in_order_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots `(event_id, snapshot_id, calculated_at, arrival)` that are no older than any seen before."""
    rows = snapshots.select("event_id", "snapshot_id", "arrival", F.unix_micros("calculated_at").alias("at"))
    return rows.groupBy("event_id").transformWithStateInPandas(_Newest(), "event_id bigint, snapshot_id bigint", "Append", "None")


def fuse_batches(items: DataFrame, path: str, checkpoint: str, limit: int = 10, **trigger):
    """Fuse the hot lists of every trigger and write them as one run partition.

    A batch overwrites only its own partition, so a replayed batch leaves no second copy."""
    from murmur.operators.hotlist import fuse_rankings

    def write(batch: DataFrame, number: int) -> None:
        fused = fuse_rankings(batch, limit=limit).select("key", "title", "fused_score", "source_count", "best_rank", "rank")
        fused.write.mode("overwrite").parquet(f"{path}/run={number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 minutes"})).start()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder; below /tmp only where none is set on a local master."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now into a Parquet table and return that table."""
    spark = stream.sparkSession
    folder = scratch_folder(spark, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
