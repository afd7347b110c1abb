"""Tables written once to the folder that all machines share, and ranks that need no single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A temporary folder of its own only where that is unset in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="trackloom-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/trackloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def shared_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, in whatever store it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop))


def shared_remove(spark: SparkSession, path: str) -> None:
    """Remove the folder ``path``, in whatever store it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of a narrow table that one file holds where the number of rows is known before it is written.
ROWS_PER_FILE = 250_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows``: about how many narrow rows come, if known; it sets the number of files, so that small tables that are
    written over and over are not spread over as many tiny files as there are shuffle partitions.
    """
    path = shared_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(rows // ROWS_PER_FILE + 1)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over all shuffle partitions: few bytes, but a kernel's or a join's work for each, so they aren't to be coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


#: Narrow rows that one task of :func:`dealt` gets, about.
ROWS_PER_TASK = 250_000


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Rows by ``columns`` over as many partitions as ``rows`` ask for, and shuffle partitions at least.

    Narrow rows compress well, so that partitions sized by their bytes would hold many millions of them.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, rows // ROWS_PER_TASK + 1), *columns)


def meet_all(asked: DataFrame, rows: DataFrame, size: int = 500) -> DataFrame:
    """Every row of a stated set with every one of ``rows``: a join by block, of about ``size`` asked rows each.

    Work and rows grow as the product of both sides; a task holds one block and streams its copy of ``rows``.
    """
    blocks = asked.count() // size + 1
    left = asked.withColumn("__block", F.pmod(F.xxhash64(*asked.columns), F.lit(blocks)))
    right = rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return left.join(right, "__block").drop("__block")


def with_prefix(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    spread: Column,
    value: Column | None = None,
    rows_per_bucket: int = 50_000,
    rank: str = "rank",
    before: str | None = None,
) -> DataFrame:
    """Number rows from 0 within ``keys``, and sum ``value`` over earlier rows, whatever the size of a key.

    Rows of a key are dealt into buckets by the hash of ``spread``; each bucket is numbered on its own and starts
    where the buckets before it end, so no task holds more than about ``rows_per_bucket`` rows of one key. The order
    is (bucket, ``order``): fixed by the data alone. ``df`` is read three times: pass a table that is cheap to read.
    """
    value = F.lit(0) if value is None else value
    sizes = df.groupBy(*keys).agg((F.count(F.lit(1)) / rows_per_bucket + 1).cast("long").alias("__n"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    dealt = (
        df.alias("l")
        .join(sizes.alias("r"), same[0] if len(same) == 1 else same, "inner")
        .select("l.*", F.pmod(F.xxhash64(spread), F.col("r.__n")).alias("__b"))
    )
    counted = dealt.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"), F.sum(value).alias("__v"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        *keys,
        "__b",
        F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__c0"),
        F.coalesce(F.sum("__v").over(earlier), F.lit(0)).alias("__v0"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    numbered = dealt.withColumn("__r", F.row_number().over(inside) - 1)
    if before:
        running = inside.rowsBetween(Window.unboundedPreceding, -1)
        numbered = numbered.withColumn("__s", F.coalesce(F.sum(value).over(running), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l.__b") == F.col("r.__b")]
    out = [F.col(f"l.{c}") for c in df.columns] + [(F.col("l.__r") + F.col("r.__c0")).alias(rank)]
    if before:
        out.append((F.col("l.__s") + F.col("r.__v0")).alias(before))
    return numbered.alias("l").join(starts.alias("r"), same, "inner").select(*out)
