"""Registry of runnable queries and the tables they read."""

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmur.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Key and most stored bytes that one task may hold of a text table; a page takes far more work per byte than a document.
TEXT_TABLES = {"documents": ("doc_id", 160 << 20), "pages": ("page_id", 16 << 20)}

# Logical inputs over the given tables. The same text runs in Spark and in the checking engine.
VIEWS: dict[str, str] = {
    "heat_article": """
        SELECT user_id AS event_id, event_id AS article_id, event_type AS platform,
          CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS publish_time,
          CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR AS observed_at,
          event_id % 7 <> 0 AS is_representative,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 97 END AS comments_count,
          CAST(NULL AS BIGINT) AS reposts_count, CAST(floor(value) AS BIGINT) AS likes_count,
          CASE WHEN event_id % 3 = 0 THEN (event_id * 7) % 1009 END AS views_count,
          CAST(CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS duplicate_weight,
          CAST(CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS spam_weight
        FROM {events}""",
    "hot_rank": """
        SELECT user_id AS event_id, CAST(1 + event_id % 30 AS INT) AS hot_rank
        FROM {events} WHERE event_type = 'signup' AND value > 150""",
    "heat_snapshot": """
        SELECT user_id AS event_id, CAST(max(event_id) AS BIGINT) AS snapshot_id,
          CAST(CAST(ts AS DATE) AS TIMESTAMP) AS calculated_at,
          round(avg(value), 6) AS final_heat, count(*) >= 3 AS eligible_as_hot, count(*) AS reports_24h
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "sentiment_item": """
        SELECT user_id AS event_id, event_id AS article_id, event_type AS platform,
          (CAST(event_id % 201 AS DOUBLE) - 100) / 100 AS score,
          CASE WHEN event_id % 201 >= 120 THEN 'positive' WHEN event_id % 201 <= 80 THEN 'negative'
               ELSE 'neutral' END AS label,
          CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS publish_time,
          CAST(ts AS TIMESTAMP) AS observed_time, event_id % 7 <> 0 AS is_representative,
          CAST(CASE WHEN event_id % 4 = 0 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS nlp_weight,
          CAST(CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS spam_weight,
          CAST(0.3 AS DOUBLE) AS duplicate_weight, value AS heat_contribution
        FROM {events}""",
    "hot_rank_item": """
        SELECT source, rank, title, source_url, payload FROM (
          SELECT event_type AS source, concat('topic ', CAST(user_id AS STRING), ' x') AS title,
            concat('https://list.example.com/', CAST(event_id AS STRING)) AS source_url, props AS payload,
            CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INT) AS rank
          FROM {events}) x WHERE rank <= 30""",
    "hot_seed": """
        SELECT event_id AS seed_id, event_type AS platform, concat('#topic ', CAST(user_id AS STRING), '#') AS title,
          CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(1 + event_id % 50 AS INT) END AS rank,
          CAST(ts AS TIMESTAMP) AS snapshot_time
        FROM {events} WHERE value > 60""",
    "daily": """
        SELECT user_id AS event_id, CAST(ts AS DATE) AS day, count(*) AS count
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "article": """
        SELECT doc_id AS article_id, doc_id % 25 AS event_id, source AS platform,
          substr(split(text, '\n')[{first}], 1, 80) AS title, text AS clean_content,
          CASE WHEN doc_id % 17 = 0 THEN NULL
               WHEN doc_id % 50 = 3 THEN '新华社' WHEN doc_id % 50 = 4 THEN '匿名'
               ELSE concat('author ', CAST(doc_id % 40 AS STRING)) END AS author,
          {epoch} AS publish_time, n_chars,
          doc_id % 97 AS comments_count, doc_id % 31 AS reposts_count, doc_id % 211 AS likes_count
        FROM {documents}""",
    "vectors": "SELECT vec_id AS article_id, embedding AS vector, CAST(label AS STRING) AS topic_category FROM {embeddings}",
}
_DIALECT = {
    "spark": {"first": "0", "epoch": "timestamp_seconds(1704067200 + doc_id * 3600)"},
    "duck": {"first": "1", "epoch": "CAST(to_timestamp(1704067200 + doc_id * 3600) AT TIME ZONE 'UTC' AS TIMESTAMP)"},
}


class Tables:
    """The tables of one scale-factor folder, as base tables or logical views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder
        self._parts: dict[str, int | None] = {}

    def _base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in TEXT_TABLES:
            if name not in self._parts:
                self._parts[name] = self._spread(name, df)
            if self._parts[name]:
                return df.repartition(self._parts[name], TEXT_TABLES[name][0])
        return df

    def _spread(self, name: str, df: DataFrame) -> int | None:
        """Number of partitions a text table is dealt to, or nothing if it lies in enough even ones.

        Splits are cut by bytes, but a row group goes to one of them whole: the others are empty, and a table of few
        row groups would keep all but a few cores idle. So the rows of each split are counted (from the footers)."""
        stored = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.folder}/{name}.parquet")
        size = stored.agg(F.sum("length")).first()[0] or 0
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("split")).count().collect()]
        cores, most = self.spark.sparkContext.defaultParallelism, TEXT_TABLES[name][1]
        if len(rows) >= cores and size * max(rows) / sum(rows) <= most:
            return None
        return max(cores, math.ceil(4 * size / most))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            used = {t: self._base(t) for t in BASE_TABLES if "{" + t + "}" in text}
            for key, value in _DIALECT["spark"].items():
                text = text.replace("{" + key + "}", value)
            return self.spark.sql(text, **used)
        if name in BASE_TABLES:
            return self._base(name)
        raise AttributeError(name)


def sql_view(name: str) -> str:
    text = VIEWS[name]
    for key, value in {**_DIALECT["duck"], **{t: t for t in BASE_TABLES}}.items():
        text = text.replace("{" + key + "}", value)
    return text.replace("split(text, '\n')", "string_split(text, chr(10))").replace("AS STRING", "AS VARCHAR")


def with_views(names: str, body: str) -> str:
    """SELECT text with the named logical views in front; `body` may continue the WITH list."""
    views = ", ".join(f"{n} AS ({sql_view(n)})" for n in names.split())
    if body.lstrip().startswith("WITH "):
        return f"WITH {views}, {body.lstrip()[5:]}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under a name, with its SQL counterpart if there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
