"""How text tables are dealt to tasks."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from murmur.plans import registry


@pytest.fixture
def folder(tmp_path):
    noise = lambda i: "".join(chr(97 + (i * 7919 + j * j * 31 + i * j) % 26) for j in range(300))
    table = pa.table({"doc_id": list(range(4000)), "text": [noise(i) * 4 for i in range(4000)]})
    return tmp_path, table


def shares(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_one_row_group_is_dealt_to_all_cores(spark, folder):
    """Split by bytes, the file has enough partitions, but its only row group lies in one of them."""
    path, table = folder
    pq.write_table(table, path / "documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 15)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 10)
    try:
        plain = spark.read.parquet(str(path / "documents.parquet"))
        assert plain.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and len(shares(plain)) == 1
        got = registry.Tables(spark, str(path)).documents
        assert len(shares(got)) == spark.sparkContext.defaultParallelism and max(shares(got)) < 1300
        assert sorted(r.doc_id for r in got.collect()) == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tasks_follow_the_size(spark, folder, monkeypatch):
    """A larger table has more tasks, not larger ones; an evenly stored one is not moved."""
    path, table = folder
    (path / "documents.parquet").mkdir()
    for i in range(8):
        pq.write_table(table.slice(500 * i, 500), path / "documents.parquet" / f"part-{i}.parquet")
    size = sum(f.stat().st_size for f in (path / "documents.parquet").iterdir())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // 8 + 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert registry.Tables(spark, str(path)).documents.rdd.getNumPartitions() == 8
        monkeypatch.setitem(registry.TEXT_TABLES, "documents", ("doc_id", size // 10))
        assert len(shares(registry.Tables(spark, str(path)).documents)) >= 35
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
