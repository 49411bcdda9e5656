"""Checks that fail closed: columns, keys, coverage, totals, hashes, frozen policies."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A table or a policy broke a rule."""


def require_columns(df: DataFrame, required: list[str], label: str) -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise CheckFailed(f"{label} lacks {', '.join(missing)}")
    return df


def guard_columns(df: DataFrame, label: str, allowed: list[str] | None = None, denied: list[str] = ()) -> DataFrame:
    """``df`` if it has no denied column and none outside the allowed ones: truth can't leak into a decision rule."""
    bad = sorted(set(df.columns) & set(denied) | (set(df.columns) - set(allowed) if allowed is not None else set()))
    if bad:
        raise CheckFailed(f"{label} may not read {', '.join(bad)}")
    return df


def require_none(bad: DataFrame, rule: str) -> None:
    """Raise if ``bad`` has a row; an example is enough, nothing is collected."""
    if example := bad.limit(1).collect():
        raise CheckFailed(f"{rule}: {example[0].asDict()}")


def fetched(df: DataFrame, most: int, label: str):
    """``df`` as a pandas frame, counted first: more than ``most`` rows raise instead of filling the driver."""
    held = df.cache()
    try:
        if (n := held.count()) > most:
            raise CheckFailed(f"{n} {label} are more than {most}")
        return held.toPandas()
    finally:
        held.unpersist()


def require_unique(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    require_none(df.groupBy(*keys).count().filter("count > 1"), f"{label} repeats a key")
    return df


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are in one table only, with ``side``; empty if they agree."""
    left, right = (x.select(*keys).distinct().withColumn(f"__{n}", F.lit(True)) for n, x in (("a", a), ("b", b)))
    both = left.join(right, keys, "full")
    return both.filter("__a IS NULL OR __b IS NULL").select(*keys, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("side"))


def coverage(df: DataFrame, ok: Column, by: str) -> DataFrame:
    """Share of rows for which ``ok`` holds, by group and overall ("league")."""
    from stakewise.operators.stats import with_total

    n_ok = F.sum(F.coalesce(ok, F.lit(False)).cast("int"))
    return with_total(df.withColumn(by, F.col(by).cast("string")), by, [F.count("*").alias("rows"), (n_ok / F.count("*")).alias("coverage")], "league")


def require_coverage(table: DataFrame, by: str, league: float = 0.995, group: float = 0.99) -> None:
    least = F.when(F.col(by) == "league", league).otherwise(group)
    require_none(table.filter(F.col("coverage") < least), "coverage is too low")


def reconciled(detail: DataFrame, totals: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Keys whose counted detail differs from the stated totals."""
    named = totals.select(*keys, *[F.col(c).alias(f"stated_{c}") for c in counts])
    joined = named.join(detail, keys, "left")
    wrong = [F.coalesce(F.col(c), F.lit(0)) != F.col(f"stated_{c}") for c in counts]
    bad = wrong[0]
    for w in wrong[1:]:
        bad = bad | w
    return joined.filter(bad)


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical JSON, its columns in sorted order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> str:
    """Hash of a table that no order of rows changes: row hashes are summed in four parts, with their number."""
    columns = columns or df.columns
    h = df.select(row_hash(columns).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    r = h.agg(F.count("*").cast("string"), *parts).first()
    return hashlib.sha256("|".join([*sorted(columns), *(x or "0" for x in r)]).encode()).hexdigest()


def frozen(policy: dict) -> dict:
    """A policy with the hash of its content."""
    body = json.dumps(policy, sort_keys=True, separators=(",", ":"))
    return {"policy": policy, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def require_frozen(record: dict) -> dict:
    if frozen(record["policy"])["sha256"] != record["sha256"]:
        raise CheckFailed("the policy changed after it was frozen")
    return record["policy"]


def require_provenance(probabilities: DataFrame, clock: DataFrame, keys: list[str], oracle: str = "oracle") -> None:
    """Only the labelled oracle may use truth, every policy covers every key once, and chances lie in [0, 1]."""
    require_none(probabilities.filter(F.col("truth_used") & (F.col("policy") != oracle)), "a policy uses truth")
    require_none(probabilities.filter(~(F.col("p1").between(0, 1) & F.col("p2").between(0, 1)) | F.col("p1").isNull() | F.col("p2").isNull()), "a chance is outside [0, 1]")
    require_unique(probabilities, ["policy", *keys], "probabilities")
    policies = probabilities.select("policy").distinct()
    wanted = clock.select(*keys).crossJoin(F.broadcast(policies))
    require_none(same_keys(wanted, probabilities, ["policy", *keys]), "probabilities do not cover the clock")


def held_out_apart(train: DataFrame, test: DataFrame, group: str) -> None:
    require_none(train.select(group).intersect(test.select(group)), "a held-out group was trained on")
