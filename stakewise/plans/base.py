"""Registry of the queries, and the stand-in timeline that both engines build from ``events``.

A day of events stands for a game, sixteen users for a team, the order in time for the order of pitches, and twelve
equal parts of it for innings. Teams grow in number with the users, not in length: a timeline has a few dozen rows. Purchases are upheld challenges, signups overturned ones; ``value`` is the stake.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS, ORDER = ["game", "team"], ["pitch_order"]


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, team, pitch_order, inning, event_id, user_id, event_type, stake, role, outcome, success, p, margin."""
    e = table(spark, sf_dir, "events").withColumns({"game": F.to_date("ts").cast("string"), "team": F.floor(F.col("user_id") / 64) * 4 + F.col("user_id") % 4})
    whole = Window.partitionBy(*KEYS)
    e = e.withColumns({"pitch_order": F.row_number().over(whole.orderBy("ts", "event_id")), "n": F.count("*").over(whole)})
    return e.select(
        *KEYS, "pitch_order", (F.floor((F.col("pitch_order") - 1) * 12 / F.col("n")) + 1).cast("int").alias("inning"), "event_id", "user_id", "event_type", F.col("value").alias("stake"),
        F.when(F.col("user_id") % 2 == 0, "offense").otherwise("defense").alias("role"),
        F.when(F.col("event_type") == "purchase", "upheld").when(F.col("event_type") == "signup", "overturned").alias("outcome"),
        (F.col("event_type") == "signup").alias("success"), ((F.col("event_id") % 100) / 100).alias("p"), ((F.col("event_id") % 61 - 30) / 10).alias("margin"),
    )


#: The same timeline for the SQL engine, as the common table expression ``t``.
T = """b AS (
    SELECT *, cast(cast(ts AS date) AS varchar) AS game, (user_id // 64) * 4 + user_id % 4 AS team,
        row_number() OVER (PARTITION BY cast(ts AS date), user_id // 64, user_id % 4 ORDER BY ts, event_id) AS pitch_order,
        count(*) OVER (PARTITION BY cast(ts AS date), user_id // 64, user_id % 4) AS n
    FROM events
), t AS (
    SELECT game, team, pitch_order, 1 + ((pitch_order - 1) * 12) // n AS inning, event_id, user_id, event_type, value AS stake,
        CASE WHEN user_id % 2 = 0 THEN 'offense' ELSE 'defense' END AS role,
        CASE event_type WHEN 'purchase' THEN 'upheld' WHEN 'signup' THEN 'overturned' END AS outcome,
        event_type = 'signup' AS success, cast(event_id % 100 AS double) / 100 AS p, cast(event_id % 61 - 30 AS double) / 10 AS margin
    FROM b
)"""


def nearest(value, places: int):
    """A double rounded as a double, halves away from zero, not by its decimal digits: short decimals often lie right
    between two."""
    return F.signum(value) * F.floor(F.abs(value) * 10.0**places + 0.5) / 10.0**places


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, integers as longs: what both engines agree on bit by bit."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append(F.round(c, places).alias(name) if kind == "double" else c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else c)
    return df.select(*out)
