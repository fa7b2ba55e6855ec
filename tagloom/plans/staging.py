"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary
    folder is made and set on a local master; a cluster must name one that all machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tagloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


_written: dict[str, Staged] = {}


class Staged:
    """A DataFrame written once as Parquet and read again: short lineage, no
    recomputation, and safe against lost executors. `drop()` removes the files
    once nothing reads them any more; `drop_staged()` those of all that is left.

    With `buckets`, a column and a number, it is a table of so many buckets by that column: what groups or joins it by
    that column shuffles none of it. Hand it rows that are dealt by the column to as many tasks, or each task writes a file a bucket."""

    def __init__(self, df: DataFrame, name: str = "t", buckets: tuple[str, int] | None = None) -> None:
        self.spark, self.table = df.sparkSession, None
        self.path = f"{shared_folder(self.spark)}/tagloom-{name}-{uuid.uuid4().hex}"
        if buckets:
            self.table = f"tagloom_{uuid.uuid4().hex}"
            df.write.bucketBy(buckets[1], buckets[0]).format("parquet").saveAsTable(self.table, path=self.path)
            self.df = self.spark.table(self.table)
        else:
            df.write.parquet(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _written[self.path] = self

    @property
    def kept(self) -> bool:
        return self.path in _written

    def drop(self) -> None:
        _written.pop(self.path, None)
        if self.spark.sparkContext._jsc is None:  # stopped
            return
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    return Staged(df, name).df


def drop_staged() -> int:
    """Removes the folders of all tables staged so far and returns how many. For
    between jobs of a long session, when the results that read them are written."""
    left = list(_written.values())
    for s in left:
        s.drop()
    return len(left)
