"""Expectation tables: shrunken cells on a full grid, leave-one-group-out means, runs to come, hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal_grid(spark, domains: dict[str, list]) -> DataFrame:
    """Every combination of listed values, exploded from one row: no join, and its size is that of the lists."""
    grid = spark.range(1).select()
    for name, values in domains.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid


def shrunken_cells(rows: DataFrame, grid: DataFrame, parent: list[str], child: list[str], value: str, strength: float = 20.0, weight: str | None = None) -> DataFrame:
    """(sum + strength * parent mean) / (n + strength) in each cell of ``grid`` (parent + child columns).

    Parents without rows take the overall mean. With ``weight``, sums and counts are weighted. Rows are reduced to
    cells once; parents and the overall mean come from the cells.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    cells = rows.groupBy(*parent, *child).agg(F.sum(F.col(value) * w).alias("sum"), F.sum(w).alias("n")).cache()
    above = cells.groupBy(*parent).agg((F.sum("sum") / F.sum("n")).alias("parent_mean"))
    overall = cells.agg((F.sum("sum") / F.sum("n")).alias("overall"))
    joined = grid.join(cells, [*parent, *child], "left").join(above, parent, "left").crossJoin(F.broadcast(overall))
    mean = F.coalesce("parent_mean", "overall")
    n, total = F.coalesce("n", F.lit(0.0)), F.coalesce("sum", F.lit(0.0))
    return joined.select(*parent, *child, n.alias("n"), mean.alias("parent_mean"), ((total + strength * mean) / (n + strength)).alias("estimate"))


def runs_to_end(rows: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """What is still scored in the key after each row: the key's largest score less the current one, never below 0."""
    w = Window.partitionBy(*keys)
    best = F.greatest(*[F.max(s).over(w) for s in scores]) if len(scores) > 1 else F.max(scores[0]).over(w)
    return rows.withColumn("runs_to_end", F.greatest(F.lit(0.0), best - F.col(scores[0])))


def leave_one_group_out(rows: DataFrame, bucket: list[str], group: str, values: list[str]) -> DataFrame:
    """Mean of each value over the row's bucket without the row's own group (expected_*).

    Sums by (bucket, group) are joined back, so no bucket is ordered or gathered in one place.
    """
    own = rows.groupBy(*bucket, group).agg(*[F.sum(v).alias(f"own_{v}") for v in values], F.count("*").alias("own_n"))
    total = own.groupBy(*bucket).agg(*[F.sum(f"own_{v}").alias(f"all_{v}") for v in values], F.sum("own_n").alias("all_n"))
    table = own.join(total, bucket)
    rest = F.greatest(F.col("all_n") - F.col("own_n"), F.lit(1))
    table = table.select(*bucket, group, *[((F.col(f"all_{v}") - F.col(f"own_{v}")) / rest).alias(f"expected_{v}") for v in values])
    return rows.join(table, [*bucket, group])


def shrunken_rate_without_own(rows: DataFrame, bucket: list[str], group: str, event: Column, eligible: Column, prior: float = 30.0) -> DataFrame:
    """(attempts elsewhere + prior * overall rate) / (chances elsewhere + prior), over ``eligible`` rows, as ``rate``."""
    marked = rows.withColumns({"__e": F.when(eligible, event.cast("int")), "__n": eligible.cast("int")})
    own = marked.groupBy(*bucket, group).agg(F.coalesce(F.sum("__e"), F.lit(0)).alias("own_e"), F.sum("__n").alias("own_n"))
    total = own.groupBy(*bucket).agg(F.sum("own_e").alias("all_e"), F.sum("own_n").alias("all_n"))
    overall = own.agg((F.sum("own_e") / F.sum("own_n")).alias("overall"))
    table = own.join(total, bucket).crossJoin(F.broadcast(overall))
    rate = (F.col("all_e") - F.col("own_e") + prior * F.col("overall")) / (F.col("all_n") - F.col("own_n") + prior)
    return rows.join(table.select(*bucket, group, rate.alias("rate")), [*bucket, group])


def holdout_fit(rows: DataFrame, is_train: Column, cell: list[str], value: str) -> DataFrame:
    """One row: n, rmse, mae, bias and correlation on held-out rows of means learnt by cell from the others."""
    train, test = rows.filter(is_train), rows.filter(~is_train)
    means = train.groupBy(*cell).agg(F.avg(value).alias("fit"))
    overall = train.agg(F.avg(value).alias("overall"))
    error = F.coalesce("fit", "overall") - F.col(value)
    scored = test.join(means, cell, "left").crossJoin(F.broadcast(overall)).withColumn("e", error).withColumn("f", F.coalesce("fit", "overall"))
    return scored.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), F.corr("f", value).alias("correlation"))


def median_imputed(rows: DataFrame, value: str, family: str) -> DataFrame:
    """Null values take their family's median, else the overall one; ``missing`` marks them."""
    medians = rows.groupBy(family).agg(F.percentile(value, 0.5).alias("__m"))
    overall = rows.agg(F.percentile(value, 0.5).alias("__o"))
    joined = rows.join(medians, family, "left").crossJoin(F.broadcast(overall))
    return joined.withColumns({"missing": F.col(value).isNull(), value: F.coalesce(value, "__m", "__o")}).drop("__m", "__o")
