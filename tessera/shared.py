"""Tables that cut lineage: Parquet in the folder that all executors share, so that a lost executor loses nothing."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or the context names. A session in one process may go without and
    gets a folder of its own; a cluster may not, as no executor would see the driver's local files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


class Scratch:
    """Named tables of one job under the shared folder.

    `save` writes a table and returns what reads it: a plan without a past, with the size of the files as its
    estimate. (A DataFrame's own checkpoint() carries the estimates of the plan that it cut, and each join
    multiplies those.) `drop` deletes a table that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}", {}

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete every table saved under these names."""
        for name in names:
            for path in self.paths.pop(name, []):
                self._delete(path)

    def drop_older(self, name: str) -> None:
        """Delete all tables saved under a name but the last."""
        for path in self.paths[name][:-1]:
            self._delete(path)
        self.paths[name] = self.paths[name][-1:]

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def save(df: DataFrame) -> DataFrame:
    """Write a table and read it back, for loops that keep no names."""
    return Scratch(df.sparkSession).save("table", df)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place from 1 in a total order, no task holding more than a range of it: rows are dealt by range and
    saved, numbered inside their range, and moved by the counts of the ranges before, of which there are as many as
    shuffle partitions."""
    dealt = save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_start")
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_range", "_start")
