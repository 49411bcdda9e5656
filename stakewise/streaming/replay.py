"""Replays as streams: a state per key, updated as rows arrive, equal to the batch folds.

Python is called, and state is kept, once for a bucket of keys, not once for a key. Keys are dealt to ``buckets`` by a hash; give as
many as leave some thousand rows of a batch to each, and keep the number as long as the checkpoint.

``stream_inventory`` and ``stream_mass`` take rows that arrive in order from one batch to the next. ``late_inventory`` and
``late_mass`` take them in any order within a delay: a key's rows wait in its state until the watermark has passed them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGULATION = 9
STATE = "states binary"
BUCKETS = 1024
#: Rows of a frame that goes back to Spark, some more if a key has more.
FRAME = 20_000
KEY_TYPES = (T.IntegralType, T.StringType, T.DateType, T.BooleanType, T.DecimalType, T.BinaryType)
INVENTORY_OUT = {"before": "int32", "after": "int32", "invalid": "bool"}
MASS_OUT = {c: "float64" for c in ("m0", "m1", "m2", "challenges", "captured")}
SPARK_TYPES = {"int32": T.IntegerType(), "bool": T.BooleanType(), "float64": T.DoubleType()}


def inventory_step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list[tuple]]:
    """The state (k, inning) behind ``rows`` (inning, outcome; in order), and (before, after, invalid) of each."""
    k, last = state
    made = []
    for inning, outcome in zip(rows["inning"], rows["outcome"], strict=True):
        if last is not None and inning != last and inning > REGULATION and k == 0:
            k = 1
        before = k
        challenged = isinstance(outcome, str)
        invalid = challenged and (k == 0 or outcome not in ("upheld", "overturned"))
        if outcome == "upheld" and not invalid:
            k -= 1
        made.append((before, k, invalid))
        last = int(inning)
    return (int(k), last), made


def mass_step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list[tuple]]:
    """The state (m0, m1, m2, inning) behind ``rows`` (inning, p1, p2, success, stake; in order), and (m0, m1, m2,
    challenges, captured) of each."""
    m0, m1, m2, last = state
    made = []
    for inning, p1, p2, success, stake in zip(*[rows[c] for c in ("inning", "p1", "p2", "success", "stake")], strict=True):
        if inning > REGULATION and (last is None or inning > last):
            m0, m1 = 0.0, m1 + m0
        c1, c2 = m1 * p1, m2 * p2
        made.append((m0, m1, m2, c1 + c2, (c1 + c2) * stake if success else 0.0))
        total = m0 + m1 + m2
        if not success:
            m0, m1, m2 = m0 + c1, m1 - c1 + c2, m2 - c2
        m0, m1, m2 = (max(0.0, m) / total for m in (m0, m1, m2))
        last = int(inning)
    return (float(m0), float(m1), float(m2), last), made


def written(rows: DataFrame, kept: list[str], out: dict[str, str]) -> T.StructType:
    return T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, SPARK_TYPES[t]) for c, t in out.items()]])


def placed(columns: list[Column], types: list[T.DataType]) -> list[Column]:
    """``columns`` as c0, c1, ... and, for each of whole numbers, n0, n1, ...: where it is null. A frame with nulls holds whole
    numbers as doubles, so they travel as 0."""
    whole = [isinstance(t, T.IntegralType) for t in types]
    values = [(F.coalesce(c, F.lit(0).cast(t)) if w else c).alias(f"c{i}") for i, (c, t, w) in enumerate(zip(columns, types, whole, strict=True))]
    return values + [c.isNull().alias(f"n{i}") for i, (c, w) in enumerate(zip(columns, whole, strict=True)) if w]


def listed(frames: Iterator[pd.DataFrame], wide: int) -> Iterator[tuple]:
    """The rows of ``wide`` columns that ``placed`` made, as tuples."""
    for frame in frames:
        columns = [frame[f"c{i}"].tolist() for i in range(wide)]
        for i, values in enumerate(columns):
            if f"n{i}" in frame:
                for row in np.flatnonzero(frame[f"n{i}"].to_numpy()):
                    values[row] = None
        yield from zip(*columns, strict=True)


def in_place(rows: Iterable[tuple], wide: int) -> list[tuple]:
    """``rows`` sorted by their first ``wide`` values, nulls first."""
    rows = list(rows)
    if any(None in r[:wide] for r in rows):
        return sorted(rows, key=lambda r: [(v is not None, v) for v in r[:wide]])
    return sorted(rows, key=lambda r: r[:wide])


def framed(kept: list[str], out: dict[str, str], done: list[tuple]) -> pd.DataFrame:
    """``done`` (the values of ``kept``, then those of ``out``) as a frame; whole numbers as objects, which stay whole when Spark
    joins the frame to one with nulls."""
    columns = list(zip(*done, strict=True))
    named = {c: pd.Series(v, dtype=object if isinstance(v[0], int) or None in v else None) for c, v in zip(kept, columns, strict=False)}
    return pd.DataFrame(named | {c: np.array(v, t) for (c, t), v in zip(out.items(), columns[len(kept) :], strict=True)})


def bucket(rows: DataFrame, keys: list[str], buckets: int) -> Column:
    """The bucket of a row's key, by a hash."""
    for c in keys:
        if not isinstance(rows.schema[c].dataType, KEY_TYPES):
            raise TypeError(f"key {c} is a {rows.schema[c].dataType.simpleString()}; cast it to a string or a whole number")
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")


def in_order(rows: DataFrame, keys: list[str], order: list[str], step: Callable, start: tuple, buckets: int, out: dict[str, str]) -> DataFrame:
    """Folds each key's rows as they arrive. The keys of a bucket share a call and a value of state, a dictionary."""
    names = [*order, *[c for c in rows.columns if c not in keys and c not in order]]
    of_key, of_all = len(keys), len(keys) + len(names)

    def update(_, frames, state):
        states = pickle.loads(state.get[0]) if state.exists else {}
        arrived, done = {}, []
        for row in listed(frames, of_all):
            arrived.setdefault(row[:of_key], []).append(row[of_key:])
        for key, ready in arrived.items():
            ready = in_place(ready, len(order))
            states[key], made = step(states.get(key, start), dict(zip(names, zip(*ready, strict=True), strict=True)))
            done += [key + r[: len(order)] + m for r, m in zip(ready, made, strict=True)]
            if len(done) >= FRAME:
                yield framed([*keys, *order], out, done)
                done = []
        state.update((pickle.dumps(states),))
        if done:
            yield framed([*keys, *order], out, done)

    types = [rows.schema[c].dataType for c in (*keys, *names)]
    dealt = rows.select(bucket(rows, keys, buckets), *placed([F.col(c) for c in (*keys, *names)], types))
    return dealt.groupBy("bucket").applyInPandasWithState(update, written(rows, [*keys, *order], out), STATE, "append", "NoTimeout")


def stream_inventory(rows: DataFrame, keys: list[str], order: list[str], initial: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(keys, order, before, after, invalid) of a stream of (keys, order, inning, outcome), appended as rows arrive.

    Rows of a key must arrive in order from one batch to the next; inside a batch they are sorted. Give the source a
    watermark and drop duplicates before, so that refetched rows do not count twice.
    """
    return in_order(rows, keys, order, inventory_step, (initial, None), buckets, INVENTORY_OUT)


def stream_mass(rows: DataFrame, keys: list[str], order: list[str], initial: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(keys, order, m0, m1, m2, challenges, captured) of a stream of (keys, order, inning, p1, p2, success, stake): the
    expected replay of a policy, appended as rows arrive. The order of rows is as for ``stream_inventory``."""
    return in_order(rows, keys, order, mass_step, (*[float(k == initial) for k in range(3)], None), buckets, MASS_OUT)


def in_turn(rows: DataFrame, keys: list[str], time: str, order: list[str], delay: str, step: Callable, start: tuple, buckets: int, out: dict[str, str]) -> DataFrame:
    """Folds a key's rows in the order of (time, order) however they arrive.

    Rows wait in the state, all of a bucket's keys as one value, until an event-time timeout at the earliest of them shows that the
    watermark has passed it; then all rows up to the watermark are folded and the others wait on. A row that is fetched again
    while it waits counts once, as it was fetched last; behind the watermark it is late, and dropped. What waits is bounded by
    the rows of the delay.
    """
    names = [*order, *[c for c in rows.columns if c not in keys and c not in order and c != time]]
    of_key, of_place = len(keys), len(keys) + 1 + len(order)
    of_all = len(keys) + 1 + len(names)

    def update(_, frames, state):
        kept = pickle.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for row in listed(frames, of_all):
                _, passed, waiting = kept.setdefault(row[:of_key], (start, None, {}))
                if passed is None or row[of_key] > passed:
                    waiting[row[of_key:of_place]] = row[of_place:]
        limit = state.getCurrentWatermarkMs() * 1000
        done, earliest = [], None
        for key, (folded, _, waiting) in kept.items():
            ready = in_place([at for at in waiting if at[0] <= limit], 1 + len(order))
            if ready:
                columns = zip(*[at[1:] + waiting.pop(at) for at in ready], strict=True)
                folded, made = step(folded, dict(zip(names, columns, strict=True)))
                kept[key] = (folded, limit, waiting)
                done += [key + at[1:] + m for at, m in zip(ready, made, strict=True)]
            if waiting:
                first = min(at[0] for at in waiting)
                earliest = first if earliest is None else min(earliest, first)
            if len(done) >= FRAME:
                yield framed([*keys, *order], out, done)
                done = []
        state.update((pickle.dumps(kept),))
        if earliest is not None:
            # a timeout fires when the watermark is beyond it, and a row is due when the watermark has reached it
            state.setTimeoutTimestamp(-(-earliest // 1000) - 1)
        if done:
            yield framed([*keys, *order], out, done)

    columns = [*[F.col(c) for c in keys], F.unix_micros(time), *[F.col(c) for c in names]]
    types = [*[rows.schema[c].dataType for c in keys], T.LongType(), *[rows.schema[c].dataType for c in names]]
    dealt = rows.select(bucket(rows, keys, buckets), *placed(columns, types), F.col(time).alias("time")).withWatermark("time", delay)
    return dealt.groupBy("bucket").applyInPandasWithState(update, written(rows, [*keys, *order], out), STATE, "append", "EventTimeTimeout")


def late_inventory(rows: DataFrame, keys: list[str], time: str, order: list[str], delay: str, initial: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """``stream_inventory`` of (keys, time, order, inning, outcome) whose rows may be up to ``delay`` late and repeat.

    Rows are ordered by time, then by ``order``, which together name a row of a key. A row's result is appended once the
    watermark has passed it. RocksDB as the session's state store keeps what waits out of the executors'
    heaps. Rows without a time never count.
    """
    return in_turn(rows.filter(F.col(time).isNotNull()), keys, time, order, delay, inventory_step, (initial, None), buckets, INVENTORY_OUT)


def late_mass(rows: DataFrame, keys: list[str], time: str, order: list[str], delay: str, initial: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """``stream_mass`` of (keys, time, order, inning, p1, p2, success, stake); rows may be late as for ``late_inventory``."""
    start = (*[float(k == initial) for k in range(3)], None)
    return in_turn(rows.filter(F.col(time).isNotNull()), keys, time, order, delay, mass_step, start, buckets, MASS_OUT)
