"""Session settings and lineage cutting."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

RUNTIME_CONF = {
    # naive times are UTC throughout
    "spark.sql.session.timeZone": "UTC",
    # skewed sort-merge joins are split even when that costs one more shuffle
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # text columns make Arrow batches heavy: bound them by rows and by bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume; sizes and parallelism stay the cluster's."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", name: str = "murmur", **conf: str) -> SparkSession:
    """Session for tests and the benchmark; on a cluster the submitter builds the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder the cluster names in spark.checkpoint.dir: lost executors cost no recomputation.

    A table is read back without what the planner knew of the plan before it; a checkpoint hands that on, and in a loop
    of self joins it doubles every round. A private folder is made only for a local master with no folder configured."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fence(df: DataFrame) -> DataFrame:
    """The same rows behind a generator. Expressions between two Python steps are otherwise copied into the
    second step once per use, which makes long text projections grow exponentially."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
