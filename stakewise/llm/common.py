"""Helpers shared by the text operators: durable intermediate tables, ranks, size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an id table that may be broadcast (8 to 40 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Bytes of an Arrow batch handed to a Python worker.
BATCH_BYTES = 4_000_000


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session's ``spark.checkpoint.dir`` names it.

    Where the setting is absent, a local session (as in tests) gets a temporary folder; on a cluster, whose executors
    would each write to a disk of their own, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stakewise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the work folder that goes when the driver's JVM ends."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_columns(docs: DataFrame, replaced: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``docs``, whatever characters their names have, those in ``replaced`` by its values."""
    named = ((c, (replaced or {}).get(c)) for c in docs.columns)
    return [F.col("`" + c.replace("`", "``") + "`") if new is None else new.alias(c) for c, new in named]


def plain_columns(docs: DataFrame, used: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns other than those ``used`` named column_0, column_1 and so on, so that they can't meet the
    names of intermediate columns; and what gives a result's columns their own names again."""
    names = {f"column_{i}": c for i, c in enumerate(docs.columns) if c not in used}
    own = {c: n for n, c in names.items()}
    plain = docs.toDF(*[own.get(c, c) for c in docs.columns])
    return plain, lambda out: out.toDF(*[names.get(c, c) for c in out.columns])


def small_or_shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` hinted for broadcast if its counted rows are within the bound, otherwise for a join by shuffle and sort."""
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most from now on, where the session has Spark's default of 64 MB.

    Two batches of a worker and their decoded texts otherwise take several hundred MB beside the executor's heap.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, BATCH_BYTES)


def byte_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, A-Z lower-cased; ``bytes.split`` splits at just these."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the same columns: a 128-bit key for equality."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def buckets_for(rows: int) -> int:
    """Hash buckets that ``rows`` fill with at most a few hundred thousand each."""
    return max(2048, -(-rows // BROADCAST_ROWS))


def ranked(df: DataFrame, groups: list[str], key: list[Column], out: str, rows: int, total: str | None = None) -> DataFrame:
    """Add ``out``: ranks 0, 1, 2... within ``groups`` without bringing a group to one task; ``total`` names a column
    for the group's number of rows.

    Rows get a hash bucket; ranks are exact inside (group, bucket), and a bucket starts where the counts of the
    earlier buckets end. Only the counts meet in one place, at most one row per bucket of a group, and the buckets
    grow with ``rows``, the rows of ``df``. Rows that agree in ``key`` should be alike, or their order is not repeatable.
    """
    from pyspark.sql import Window

    b = f"__{out}_bucket"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*key), F.lit(buckets_for(rows))).cast("int"))
    counts = dealt.groupBy(*groups, b).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*groups) if groups else Window.partitionBy()
    before = group.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        starts = starts.withColumn(total, F.sum("__n").over(group))
    within = Window.partitionBy(*groups, b).orderBy(*key)
    dealt = dealt.withColumn("__at", F.row_number().over(within) - 1)
    joined = dealt.join(starts.drop("__n"), [b, *groups])
    return joined.withColumn(out, (F.col("__from") + F.col("__at")).cast("long")).drop(b, "__from", "__at")
