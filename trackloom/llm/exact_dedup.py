"""Exact deduplication: a stream of digests into disk-backed keyed state, full bytes compared on hits.

Every row becomes a small record (digest, row id, length) in the shared folder. Structured Streaming reads the
records into state kept in RocksDB on the executors' disks and in the checkpoint folder: for each digest the number
of rows, the smallest id, and the locator (id and length) of the text that stays. There is no watermark, so no key
expires, and a later stream with the same ``state_path`` continues where an earlier one ended: the folder also keeps all
records, and the texts that a locator stands for. Whatever shares a digest is then compared byte by byte, with texts of
earlier streams too: a group whose smallest and largest text differ holds a collision, and is grouped anew by the texts
themselves. Text moves only for rows that share a digest, one text for each digest and task at most.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.operators.shared import materialise, shared_exists, shared_path

SPACE = r"[\x20\x09-\x0D]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Most hit digests (32 bytes each) that are sent to every executor; beyond, the texts are shuffled by digest.
BROADCAST_HITS = 200_000


def normalised(text: Column) -> Column:
    """White-space runs become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: RocksDB keeps its memory outside the JVM's heap: one budget for all open stores of an executor, small write buffers.
BOUNDED = {"boundedMemoryUsage": "true", "maxMemoryUsageMB": "128", "writeBufferSizeMB": "8"}


@contextlib.contextmanager
def _rocksdb(spark):
    """State in RocksDB; each store is closed when its task ends, so open stores are as many as running tasks."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    wanted |= {f"spark.sql.streaming.stateStore.rocksdb.{k}": v for k, v in BOUNDED.items()}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def update_state(records: DataFrame, out_path: str, state_path: str) -> None:
    """Run the stream of ``records`` (digest, doc_id, n_bytes) to its present end; changed keys go to ``out_path``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_bytes")).alias("keep")
    state = records.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    with _rocksdb(records.sparkSession):
        (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", state_path)
            .foreachBatch(write)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )


def next_run(spark: SparkSession, path: str, run_id: str | None) -> tuple[int, bool]:
    """The number of this call's run, and whether ``run_id`` is marked as written already."""
    if not shared_exists(spark, path):
        return 0, False
    runs = spark.read.schema("run int, run_id string").option("recursiveFileLookup", "true").parquet(path)
    same = runs.where(F.col("run_id") == F.lit(run_id)).agg(F.max("run")).first()[0]
    return (same, True) if same is not None else ((runs.agg(F.max("run")).first()[0] or 0) + (0 if runs.isEmpty() else 1), False)


def exact_dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    files_per_trigger: int = 1000,
    state_path: str | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after each run of white space is one space; a null text counts as empty. Of equal
    texts the row with the smallest doc_id stays (a null doc_id is last); of repeated rows with that same doc_id one
    stays. An empty table gives an empty result; other columns of ``docs`` are ignored. Any ``digest`` gives the same
    result: rows that share one are compared in full.

    With a ``state_path`` (a folder that driver and executors share) groups reach over all calls with that path: the
    rows of this call get the smallest id and the number of rows of all calls so far, and a row that an earlier call
    has had (same doc_id and text) is not kept again. One call at a time.

    A call's rows count from the moment that its marker is written, after its texts and records and before the stream.
    What a call that failed earlier has left is overwritten by the next one. A call that failed later is repeated with
    the same ``run_id``: rows already marked under it are not written again, and the result is that of one whole call.
    """
    spark = docs.sparkSession
    base = state_path.rstrip("/") if state_path else shared_path(spark, "dedup")
    path, out = f"{base}/records", f"{base}/changes"
    keyed = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    record = "doc_id long, digest binary, n_bytes long, run int"
    run, marked = 0, False
    if state_path:
        run, marked = next_run(docs.sparkSession, f"{base}/runs", run_id)
        if not marked:
            keyed.write.mode("overwrite").parquet(f"{base}/texts/run={run}")
        keyed = spark.read.schema("doc_id long, norm string, digest binary, run int").parquet(f"{base}/texts")
        new = keyed.where(F.col("run") == run).drop("run")
    else:
        new, keyed = keyed, keyed.withColumn("run", F.lit(0))
    if not marked:
        new.select("doc_id", "digest", F.octet_length("norm").cast("long").alias("n_bytes")).write.mode("overwrite").parquet(f"{path}/run={run}")
        if state_path:
            spark.createDataFrame([(run, run_id)], "run int, run_id string").coalesce(1).write.mode("overwrite").parquet(f"{base}/runs/{run}")
    records = spark.read.schema(record).parquet(path)
    stream = spark.readStream.schema(record).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    update_state(stream, out, f"{base}/stream")
    schema = "digest binary, keep struct<none: boolean, doc_id: bigint, n_bytes: bigint>, group_size bigint, batch int"
    changes = spark.read.schema(schema).parquet(out)
    # a later batch holds the whole count and the smallest id so far
    groups = changes.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))
    groups = materialise(groups.select("digest", F.col("keep.doc_id").alias("keep_id"), "group_size"), "groups")

    hits = groups.where("group_size > 1").select("digest")
    small = hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    suspects = keyed.join(F.broadcast(hits) if small else hits, "digest")
    bytes_of = suspects.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    mixed = materialise(bytes_of.where("lo <> hi").select("digest"), "collisions")

    once = Window.partitionBy("digest", "doc_id").orderBy("run", "n_bytes")
    rows = records.withColumn("nth", F.row_number().over(once)).where(F.col("run") == run)
    same = rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "digest"
    )
    if mixed.isEmpty():
        return same
    apart = keyed.join(mixed, "digest").withColumn("none", F.col("doc_id").isNull())
    by_text = apart.groupBy("digest", "norm").agg(F.min(F.struct("none", "doc_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    nth = F.row_number().over(Window.partitionBy("digest", "norm", "doc_id").orderBy("run"))
    resolved = apart.withColumn("nth", nth).where(F.col("run") == run).join(by_text, ["digest", "norm"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("nth") == 1)).alias("kept"),
        "digest",
    )
    return same.join(mixed, "digest", "left_anti").unionByName(resolved)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, that :func:`exact_dedup` keeps. Rows that are equal in doc_id and text leave one."""
    verdict = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    keyed = docs.withColumn("__digest2", sha256(normalised(F.col("text"))))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest2") == F.col("__digest"))
    # a doc_id that stands twice with one text keeps one of its rows
    nth = F.row_number().over(Window.partitionBy("doc_id", "__digest2").orderBy("text"))
    return keyed.join(verdict, same).withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
