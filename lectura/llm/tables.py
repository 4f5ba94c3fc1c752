"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a key needs at least to be joined apart from the others.
HOT_ROWS = 10_000
#: Bytes of a batch of rows for a Python worker.
BATCH_BYTES = 4 << 20
A_TO_Z, a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session takes one of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lectura-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, codec: str = "zstd", folder: str | None = None) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/lectura-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that nothing needs any more when the block ends; the block's own result has to be written elsewhere by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        return written(df, codec, self.folder)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *failure) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Rows go to Python workers in batches of at most about so many bytes: a batch stands in the executor's own memory and the worker's."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def hot_limit(total: int) -> int:
    return max(HOT_ROWS, total // 1000)


def is_one_of(hot: DataFrame, *keys: str) -> Column:
    """Whether a row's keys are among those of hot, which are known to be some thousand at most: as a list of their hashes.

    Another key of the same hash counts as hot too, which is why both sides of a join have to be parted by this.
    """
    return F.xxhash64(*keys).isin([r[0] for r in hot.select(F.xxhash64(*keys)).distinct().collect()])


def join_hot(many: DataFrame, few: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """many joined with few on keys, without a hot key's rows meeting in one task.

    `times` is a column of few: how many rows of many, of `total`, have the key. Keys with over a thousandth of them are at most
    a thousand, whatever the input, so their rows of few are broadcast; all others go through a shuffle.
    """
    hot = is_one_of(few.filter(F.col(times) > hot_limit(total)), *keys)
    return many.filter(hot).join(F.broadcast(few.filter(hot)), keys).unionByName(many.filter(~hot).join(few.filter(~hot), keys))


def lower_ascii(col):
    return F.translate(col, A_TO_Z, a_to_z)


def byte_size(df: DataFrame, *cols: str) -> int:
    """Bytes that the string columns hold; what a broadcast of df would carry, about."""
    total = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 for c in cols), F.lit(0)))).first()[0]
    return int(total or 0)
