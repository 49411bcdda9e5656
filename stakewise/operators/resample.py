"""Folds, whole-group bootstraps and the bands made of them. Resampling is by hash, so any engine can repeat it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakewise.operators.stats import ratio


def hashed(*parts: Column) -> Column:
    """48 bits of an MD5 of the parts joined by "|", as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10).cast("long")


def bootstrap_seed(seed: int, replicate: int, source: str = "__replicate__") -> int:
    """Seed of a replicate and source: plain integer arithmetic modulo 2147483646."""
    offset = sum(ord(c) * i for i, c in enumerate(source, 1))
    return 1 + (seed + replicate * 1_000_003 + 9176 * offset) % 2_147_483_646


def balanced_folds(groups: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """(group, fold 1..folds): groups in the order of their hashes are dealt in turn, so folds differ by one at most.

    ``groups`` has one row per group; there are as many as games, not as rows of data.
    """
    w = Window.orderBy(hashed(F.lit(seed), F.col(group)), group)
    return groups.select(group).distinct().withColumn("fold", ((F.row_number().over(w) - 1) % folds + 1).cast("int"))


def dense_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """``rows`` with ``fold``: the group's dense rank less one, modulo ``folds``, plus one. Ranks only distinct groups."""
    ranked = rows.select(group).distinct().withColumn("fold", ((F.row_number().over(Window.orderBy(group)) - 1) % folds + 1).cast("int"))
    return rows.join(ranked, group)


def bootstrap_weights(groups: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, group, weight > 0): each replicate draws as many groups as there are, with replacement."""
    w = Window.orderBy(group)
    numbered = groups.select(group).distinct().withColumn("place", F.row_number().over(w) - 1)
    n = numbered.agg(F.count("*").alias("n"))
    draws = numbered.select(F.col("place").alias("draw")).crossJoin(F.broadcast(n)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = draws.select("replicate", (hashed(F.lit(seed), F.col("replicate"), F.col("draw")) % F.col("n")).alias("place"))
    weights = drawn.groupBy("replicate", "place").agg(F.count("*").alias("weight"))
    return weights.join(numbered, "place").select("replicate", group, "weight")


def bootstrap_totals(sums: DataFrame, weights: DataFrame, group: str, by: list[str], values: list[str]) -> DataFrame:
    """Weighted totals of group-level ``sums`` for each replicate: rows were reduced to groups before."""
    joined = sums.join(weights, group)
    return joined.groupBy("replicate", *by).agg(*[F.sum(F.col(v) * F.col("weight")).alias(v) for v in values])


def interval(draws: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    p = (1 - level) / 2
    return draws.groupBy(*by).agg(F.percentile(value, p).alias("lower"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 1 - p).alias("upper"))


def bootstrap_interval(rows: DataFrame, group: str, by: list[str], value: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """Mean by ``by`` with the interval of its whole-group bootstrap."""
    sums = rows.groupBy(group, *by).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    point = sums.groupBy(*by).agg((F.sum("s") / F.sum("c")).alias("estimate"))
    draws = bootstrap_totals(sums, bootstrap_weights(rows, group, replicates, seed), group, by, ["s", "c"]).withColumn("m", ratio(F.col("s"), F.col("c")))
    return point.join(interval(draws, by, "m", level), by) if by else point.crossJoin(interval(draws, by, "m", level))


def simultaneous_band(points: DataFrame, draws: DataFrame, scenario: str, value: str, level: float = 0.95) -> DataFrame:
    """Band around every scenario's point that holds for all at once: the quantile over replicates of the largest deviation."""
    joined = draws.join(points.select(scenario, F.col(value).alias("__p")), scenario)
    worst = joined.groupBy("replicate").agg(F.max(F.abs(F.col(value) - F.col("__p"))).alias("d"))
    width = worst.agg(F.percentile("d", level).alias("width"))
    return points.crossJoin(F.broadcast(width)).select(scenario, F.col(value).alias("estimate"), (F.col(value) - F.col("width")).alias("lower"), (F.col(value) + F.col("width")).alias("upper"))


def worst_bound(draws: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """One-sided lower bound of the worst scenario: the quantile over replicates of each one's minimum."""
    return draws.groupBy("replicate").agg(F.min(value).alias("w")).agg(F.percentile("w", 1 - level).alias("bound"))


def replicated(rows: DataFrame, weights: DataFrame, group: str) -> DataFrame:
    """Whole groups repeated by ``weight``; copies get the suffix __bootstrap_001 and so on."""
    copies = rows.join(weights, group).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    return copies.withColumn(group, F.format_string("%s__bootstrap_%03d", F.col(group).cast("string"), F.col("__i"))).drop("__i", "weight")


def checkpointed(spark: SparkSession, folder: str, fingerprint: str, compute) -> DataFrame:
    """The table that ``compute()`` gives, kept under its fingerprint: read again where it was written before."""
    path = f"{folder}/{fingerprint}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resumed(folder: str, keys: DataFrame, compute: Callable[[DataFrame], DataFrame], parts: int = 4, most_parts: int | None = None) -> DataFrame:
    """The rows of ``compute`` for all ``keys``, kept below ``folder`` so that a later run fills gaps only.

    Keys are dealt to ``parts`` by their hash. A part's rows are written to a folder of their own, and only then its keys are
    appended to the table of finished ones with that folder's name: what a lost run left behind is in no such row and is
    never read. A run starts from the keys that an anti-join with the finished ones leaves, whatever parts they were
    dealt to before, and stops after ``most_parts`` of them if that is given. Rows must not depend on what other keys are
    computed beside them.
    """
    import uuid

    spark = keys.sparkSession
    results, done = f"{folder}/results", f"{folder}/finished"
    finished_schema = keys.select("*", F.lit("").alias("part")).schema

    def finished() -> DataFrame:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(done)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(finished_schema).parquet(done) if there else spark.createDataFrame([], finished_schema)

    missing = keys.join(finished().drop("part"), keys.columns, "left_anti").withColumn("part", F.pmod(F.xxhash64(*keys.columns), F.lit(parts)))
    todo = sorted(r["part"] for r in missing.select("part").distinct().collect())
    for at in todo[:most_parts]:
        name = uuid.uuid4().hex
        # the finished table changes below the plan of what is missing, so a part's keys are written first
        missing.filter(F.col("part") == at).drop("part").write.parquet(f"{folder}/keys/part={name}")
        own = spark.read.schema(keys.schema).parquet(f"{folder}/keys/part={name}")
        compute(own).write.parquet(f"{results}/part={name}")
        own.withColumn("part", F.lit(name)).write.mode("append").parquet(done)
    parts_done = [r["part"] for r in finished().select("part").distinct().collect()]
    empty = compute(keys.limit(0))
    return spark.read.schema(empty.schema).parquet(*[f"{results}/part={p}" for p in parts_done]) if parts_done else empty.limit(0)
