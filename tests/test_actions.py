"""Actions whose two sides weigh even, and thresholds right between two roundings, against the SQL."""

from datetime import datetime, timedelta

import duckdb

from stakewise import plans


def test_even_sides_and_halves_equal_sql(spark, tmp_path):
    start, rows = datetime(2024, 1, 1), []
    # p percent and inning with a stake in whole cents that weighs even; stakes that with the unit make a power of two
    even = [(p, i, (100 - p) * 10 * i // p) for p in range(1, 100) for i in range(1, 13) if (100 - p) * 10 * i % p == 0]
    even += [(p, i, total - 10 * i) for p in (3, 50) for i in range(1, 13) for total in (1280, 2560, 3200, 6400, 12800, 16000, 32000, 51200)]
    for g, (p, inning, cents) in enumerate(even):
        # twelve events of one user make twelve innings
        for i in range(1, 13):
            rows.append((1200 * g + 100 * (i - 1) + p, start + timedelta(minutes=i), 64 * g, "signup", cents / 100 if i == inning else 1.0, "{}"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    names = ["event_id", "advantage", "threshold", "act"]
    got = sorted(map(tuple, plans.QUERIES["m3_actions"](spark, str(tmp_path)).select(*names).collect()))
    db = duckdb.connect()
    db.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({plans.SQL['m3_actions']})").fetchall())
    assert [(a, b) for a, b in zip(got, want, strict=True) if repr(a) != repr(b)] == []
