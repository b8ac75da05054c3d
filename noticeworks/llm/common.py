"""What several training-data operators share: inputs, intermediate tables, bounded batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; texts are long, so batches stay short.
BATCH_ROWS = 500
#: A side of a join is broadcast only if its row count was checked to be at most this.
BROADCAST_ROWS = 200_000
#: A key of more rows than this is spread over so many parts of a join.
HOT_ROWS, SPREAD = 5_000, 64
_SEEN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="noticeworks-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The application's part of the shared folder; it is removed when the driver's JVM ends, because lazy results may read from it until then."""
    path = f"{shared_folder(spark)}/noticeworks/{spark.sparkContext.applicationId}"
    if path not in _SEEN:
        _SEEN.add(path)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(hadoop)
        files.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the counted rows are within the bound; otherwise Spark joins by shuffling."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_hot(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """many (a scan of a written table) joined with one, which has at most one row per key: keys of more than HOT_ROWS rows are spread over SPREAD parts."""
    spread, part = (free_name(many, base, one) for base in ("spread", "part"))
    hot = written(many.groupBy(*keys).agg(F.count("*").alias(spread)).where(F.col(spread) > HOT_ROWS).select(*keys, F.lit(SPREAD).alias(spread)), "hot-keys")
    n = hot.count()
    if not n:
        return many.join(one, keys)
    hot = maybe_broadcast(hot, n)
    # Numbers of the rows of a scan are the same in every attempt of a task.
    left = many.withColumn(part, F.monotonically_increasing_id()).join(hot, keys, "left").withColumn(part, F.pmod(F.col(part), F.coalesce(spread, F.lit(1))))
    # A generator stands alone in a select, so the numbers are long before it.
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(spread, F.lit(1)).cast("long") - 1))
    right = one.join(hot, keys, "left").select(*one.columns, parts.alias(part))
    return left.drop(spread).join(right, [*keys, part]).drop(part)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str, *more: DataFrame) -> str:
    """A column name that none of the frames has, so that extra columns never clash with helper columns."""
    taken = {c.lower() for each in (df, *more) for c in each.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name
