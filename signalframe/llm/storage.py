"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a counted table is sent to every task.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/signalframe/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, column: str) -> DataFrame:
    """written(), dealt to spark.sql.shuffle.partitions buckets by a column, so that joins and groups on it needn't move the table."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, column).sortBy(column).option("path", new_path(spark, tag)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def dealt_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers that repartition(n, number) deals to n partitions, one each, so that no two groups share a task."""
    tried = 8
    while True:
        ids = spark.range(tried * n + 64).select(F.col("id").cast("int").alias("k"))
        found = ids.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).orderBy("p").collect()
        if len(found) == n:
            return [r["k"] for r in found]
        tried *= 2


def sent_if_small(table: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table of known row size, with a broadcast hint if its counted rows fit in `most` bytes.

    A larger one is joined by shuffling, where Spark splits keys that hold many rows.
    """
    return F.broadcast(table) if table.count() * row_bytes <= most else table


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for file in df.inputFiles()[:1]:
        folder = hadoop.Path(file).getParent()
        while not folder.getParent().getName() == "signalframe":
            folder = folder.getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
