"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests, one machine), a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one job, in zstd, which takes little more than two bits a base. ``save`` cuts the lineage: a lost executor costs a reread, not the job so far.

    ``drop`` deletes tables that nothing reads any more; those a result still reads stay until the cluster clears the folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def save_by(self, df: DataFrame, name: str, key: str | list[str], buckets: int) -> DataFrame:
        """A table in buckets of ``key``, one column or several: a join or group by that key doesn't shuffle it again.

        Only the catalog knows of buckets, so the files get an entry there until the frame is analysed.
        """
        path = new_path(self.spark, name)
        table = f"strandlake_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
        out = self.spark.table(table)
        out.schema  # noqa: B018
        self.spark.sql(f"DROP TABLE {table}")
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)
