"""Tables written to the folder that all executors share.

Iterative jobs cut their lineage with these instead of cached or local
blocks, so a lost executor costs at most the running stage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only where that is unset and the master is local."""
    root = spark.conf.get(KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    else:
        raise RuntimeError(f"{KEY} is not set: name a folder that the driver and all executors share")
    spark.conf.set(KEY, root)
    return root


class Scratch:
    """Written tables of one job, each in a folder of its own below `shared_dir`."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Writes `df` as Parquet and returns a scan of it."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def bucketed(self, df: DataFrame, buckets: int, *columns: str, dealt: bool = False) -> DataFrame:
        """Writes `df` once as a table bucketed by `columns`, a file a bucket, so that later joins and groups on them don't exchange it.

        `dealt` says that `df` is hashed by `columns` already (it ends in a
        group by them): it isn't exchanged again.
        """
        self._n += 1
        name = f"scratch_{uuid.uuid4().hex}"
        (df if dealt else df.repartition(buckets, *columns)).write.bucketBy(buckets, *columns).option("path", f"{self.root}/{self._n}").format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        out.scratch_table = name
        return out

    def forget(self, table: DataFrame) -> None:
        """Drops a bucketed table's name; its files go with the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {table.scratch_table}")

    def drop(self, table: DataFrame) -> None:
        """Deletes a saved table that no later step reads."""
        self._delete(table.scratch_path)

    def close(self) -> None:
        """Deletes all tables of the job, once nothing reads what it returned; also at the end of a `with` block."""
        self._delete(self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
