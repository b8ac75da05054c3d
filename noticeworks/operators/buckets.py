"""Tables that are written bucket by bucket: a change rewrites only the buckets in which a row differs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeworks.operators import staging

BUCKETS = 256


class BucketedTable:
    """A Parquet table of one row a key, partitioned by a bucket of the key.

    Keys may be null and are then compared as equal; of incoming rows with one key the greatest counts.  The number of buckets is fixed when the table is made; the buckets
    that a change touches are the only list that comes to the driver, so it has as many entries as there are buckets at most.  New contents are staged
    as a whole before any bucket is replaced, so lost executors cost repeated tasks only; the replacement itself is Spark's dynamic overwrite, which is not atomic over
    several buckets if the driver is lost in it.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], buckets: int = BUCKETS, bucket: Column | None = None):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = schema
        self.columns = [f.name for f in schema]
        self.bucket = F.coalesce(bucket if bucket is not None else F.pmod(F.xxhash64(*keys), F.lit(buckets)), F.lit(0)).cast("int")

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, bucket: Column | None = None) -> BucketedTable:
        table = cls(rows.sparkSession, path, rows.schema, keys, buckets, bucket)
        table._write(table._unique(rows), "errorifexists")
        return table

    def read(self) -> DataFrame:
        """Rows with their bucket."""
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def files(self) -> DataFrame:
        """The files of each bucket."""
        return self.read().select("bucket", F.col("_metadata.file_name").alias("file")).distinct()

    def upsert(self, incoming: DataFrame) -> DataFrame:
        """Puts rows in, or in place of those of their keys; rows that are the same already are left. Gives the rows that changed, with their `change`."""
        return self._merge(incoming, F.lit(True), "left", ("inserted", "updated"))

    def update(self, incoming: DataFrame) -> DataFrame:
        """Puts rows in place of those of their keys where a value differs; rows of other keys are not taken."""
        return self._merge(incoming, F.lit(True), "left", ("updated",))

    def replace(self, within: Column, fresh: DataFrame) -> DataFrame:
        """Fresh rows stand for all rows within a condition; a row outside it stays, and keeps a fresh one of its key out."""
        return self._merge(fresh, F.coalesce(within, F.lit(False)), "full_outer", ("inserted", "updated", "deleted"))

    def _unique(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest) if rest else F.lit(1)).alias("_best"))
        values = [F.col(c) if c in self.keys else F.col(f"_best.{c}").alias(c) for c in self.columns]
        return best.select(*values).withColumn("bucket", self.bucket)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _merge(self, incoming: DataFrame, within: Column, how: str, wanted: tuple[str, ...]) -> DataFrame:
        new = self._unique(incoming.select(*self.columns)).select(*[F.col(c).alias(f"new_{c}") for c in [*self.columns, "bucket"]], F.lit(True).alias("is_new"))
        old = self.read().withColumn("is_within", within).withColumn("is_old", F.lit(True))
        same = reduce(Column.__and__, [F.col(f"new_{k}").eqNullSafe(F.col(k)) for k in self.keys], F.col("new_bucket") == F.col("bucket"))
        differs = reduce(Column.__or__, [~F.col(f"new_{c}").eqNullSafe(F.col(c)) for c in self.columns])
        change = F.when(F.col("is_old").isNull(), "inserted").when(~F.col("is_within"), None).when(F.col("is_new").isNull(), "deleted").when(differs, "updated")
        held = lambda c: F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        found = new.join(old, same, how).withColumn("change", change).where(F.col("change").isin(*wanted))
        changes = staging.written(found.select(*map(held, [*self.columns, "bucket"]), "change"), "changes")
        touched = [r.bucket for r in changes.select("bucket").distinct().collect()]
        if touched:
            self._rewrite(changes, touched)
        return changes

    def _rewrite(self, changes: DataFrame, touched: list[int]) -> None:
        gone = changes.select(*[F.col(c).alias(f"new_{c}") for c in [*self.keys, "bucket"]])
        same = reduce(Column.__and__, [F.col(f"new_{k}").eqNullSafe(F.col(k)) for k in self.keys], F.col("new_bucket") == F.col("bucket"))
        rest = self.read().where(F.col("bucket").isin(touched)).join(gone, same, "left_anti")
        after = staging.written(rest.unionByName(changes.where("change <> 'deleted'").drop("change")), "buckets")
        left = {r.bucket for r in after.select("bucket").distinct().collect()}
        self._write(after, "overwrite")
        # A bucket that has become empty is not part of a dynamic overwrite.
        for bucket in set(touched) - left:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
