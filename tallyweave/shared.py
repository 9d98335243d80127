"""Tables written on the way in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session without that
    setting gets a temporary folder, kept for its lifetime; on a cluster it is an error, as
    executors can't read what the driver or another executor has on its own disk."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not getattr(context, "_tallyweave_dir", None):
            context._tallyweave_dir = f"file://{tempfile.mkdtemp(prefix='tallyweave-')}"
        folder = context._tallyweave_dir
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once as Parquet and read back: later steps neither compute
    them again nor depend on an executor that made them."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables that one operator writes on the way, and deletes when nothing reads them more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As `written`; the table can be dropped by its name."""
        path = new_folder(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        """A table that was written under this name."""
        return self.spark.read.parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        """Deletes the named tables, and lets Spark's cleaner delete the shuffle
        files of finished plans, which it does when the driver collects garbage."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()
