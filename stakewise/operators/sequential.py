"""Folds over a keyed, ordered timeline: inventories, probability mass, values backwards.

A fold carries what it knows of the rows before: an inventory of three values, a vector over them, or a function of
them. A timeline is cut into segments of ``SEGMENT`` rows. Where it has more than one, each segment first gives its
map, the state behind it for every state of a basis before it; the maps are combined along the key, and then all
segments run at once from their true states. So no array is longer than a segment or the number of segments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGULATION = 9
#: Rows of a key that are folded as one array.
SEGMENT = 256


def folded(rows: DataFrame, keys: list[str], order: list[str], basis: list[Column], start: Column, step: Callable[[Column, Column], tuple[Column, Column]], combine: Callable[[Column, Column], Column], backwards: bool = False, out: str = "state") -> DataFrame:
    """``rows`` with the struct column ``out`` that ``step`` emits for each.

    ``step(state, row)`` gives (next state, emitted struct); ``row`` has the columns and ``inning_before``, of the
    row before in the direction of the fold, null for the first. ``combine(state, images)`` gives the state behind a
    segment from the one before it and the images of ``basis``. ``order`` must be unique within a key.
    """
    along = Window.partitionBy(*keys).orderBy(*[F.desc(c) if backwards else F.asc(c) for c in order])
    rest = [c for c in rows.columns if c not in keys and c not in order]
    placed = rows.withColumns({"inning_before": F.lag("inning").over(along), "__segment": F.floor((F.row_number().over(along) - 1) / SEGMENT)})
    items = F.sort_array(F.collect_list(F.struct(*order, *rest, "inning_before")), asc=not backwards)
    segments = placed.groupBy(*keys, "__segment").agg(items.alias("__items"))

    def through(first: Column) -> Column:
        return F.aggregate("__items", first, lambda s, row: step(s, row)[0])

    earlier = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    images = F.when(F.size("__items") == SEGMENT, F.array(*map(through, basis)))
    segments = segments.withColumn("__maps", F.collect_list(images).over(earlier))
    begun = segments.withColumn("__start", F.aggregate("__maps", start, combine)).drop("__maps")

    def onward(acc: Column, row: Column) -> Column:
        state, emitted = step(acc["state"], row)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(emitted)).alias("out"))

    probe = begun.select(F.transform("__items", lambda row: step(F.col("__start"), row)[1]).alias("out"))
    kind = probe.schema["out"].dataType.simpleString()
    zero = F.struct(F.col("__start").alias("state"), F.array().cast(kind).alias("out"))
    done = begun.select(*keys, F.col("__items"), F.aggregate("__items", zero, onward, lambda a: a["out"]).alias("__out"))
    pairs = done.select(*keys, F.explode(F.arrays_zip("__items", "__out")).alias("__p"))
    return pairs.select(*keys, *[F.col(f"__p.__items.{c}") for c in (*order, *rest)], F.col("__p.__out").alias(out))


def counted(initial: int, most: int = 2) -> dict:
    """Basis, start and combination for a state that is a number up to ``most``."""
    most = max(initial, most)
    return {"basis": [F.lit(k) for k in range(most + 1)], "start": F.lit(initial), "combine": lambda s, images: F.element_at(images, s + 1)}


def vectors(names: list[str], start: list[float], affine: bool = False) -> dict:
    """Basis, start and combination for a struct of doubles that steps map linearly, or, with a constant, affinely."""

    def unit(at: int | None) -> Column:
        return F.struct(*[F.lit(float(i == at)).alias(n) for i, n in enumerate(names)])

    def combine(s: Column, images: Column) -> Column:
        first = images[0] if affine else None
        parts = []
        for n in names:
            total = first[n] if affine else F.lit(0.0)
            for i, m in enumerate(names):
                image = images[i + affine][n]
                total = total + s[m] * (image - first[n] if affine else image)
            parts.append(total.alias(n))
        return F.struct(*parts)

    basis = [unit(None)] * affine + [unit(i) for i in range(len(names))]
    return {"basis": basis, "start": F.struct(*[F.lit(x).alias(n) for n, x in zip(names, start, strict=True)]), "combine": combine}


def inventory_replay(rows: DataFrame, keys: list[str], order: list[str], initial: int = 2) -> DataFrame:
    """Challenges left before and after each row of (keys, order, inning, outcome).

    "upheld" costs one, "overturned" none, null is no challenge. Entering each extra inning lifts zero to one. A
    challenge with none left, or of another outcome, changes nothing and is flagged ``invalid``.
    """

    def step(k: Column, row: Column) -> tuple[Column, Column]:
        grant = (row["inning_before"] != row["inning"]) & (row["inning"] > REGULATION) & (k == 0)
        before = F.when(grant, 1).otherwise(k)
        bad = row["outcome"].isNotNull() & ((before == 0) | ~row["outcome"].isin("upheld", "overturned"))
        bad = F.coalesce(bad, F.lit(False))
        after = F.when((row["outcome"] == "upheld") & ~bad, before - 1).otherwise(before)
        return after, F.struct(before.alias("before"), after.alias("after"), bad.alias("invalid"))

    return folded(rows, keys, order, step=step, **counted(initial))


def require_valid(replayed: DataFrame) -> DataFrame:
    """The strict form: an invalid challenge raises when its row is read."""
    return replayed.withColumn("state", F.when(~F.col("state.invalid"), F.col("state")).otherwise(F.raise_error(F.lit("challenge without inventory or resolution")).cast(replayed.schema["state"].dataType)))


def mass_replay(rows: DataFrame, keys: list[str], order: list[str], initial: int = 2) -> DataFrame:
    """Expected replay of a policy: mass at 0, 1 and 2 challenges before each row, and what is expected to happen.

    Rows have inning, p1 and p2 (chance to challenge with one or two left), success and stake. A failure moves mass
    one down, a success and a pass keep it; entering an extra inning, also as the first row, moves mass from 0 to 1.
    """

    def step(s: Column, row: Column) -> tuple[Column, Column]:
        enters = (row["inning"] > REGULATION) & (row["inning_before"].isNull() | (row["inning"] > row["inning_before"]))
        m0, m1, m2 = F.when(enters, 0.0).otherwise(s["m0"]), s["m1"] + F.when(enters, s["m0"]).otherwise(0.0), s["m2"]
        c1, c2 = m1 * row["p1"], m2 * row["p2"]
        fails = (~row["success"]).cast("double")
        a0, a1, a2 = m0 + c1 * fails, m1 - c1 * fails + c2 * fails, m2 - c2 * fails
        total = m0 + m1 + m2
        after = [F.greatest(F.lit(0.0), a) / total for a in (a0, a1, a2)]
        won = (c1 + c2) * row["success"].cast("double")
        out = F.struct(
            m0.alias("m0"), m1.alias("m1"), m2.alias("m2"), enters.alias("granted"), (c1 + c2).alias("challenges"), won.alias("successes"),
            ((c1 + c2) * fails).alias("failures"), (won * row["stake"]).alias("captured"),
        )
        return F.struct(*[a.alias(f"m{k}") for k, a in enumerate(after)]), out

    return folded(rows, keys, order, step=step, **vectors(["m0", "m1", "m2"], [float(k == initial) for k in range(3)]))


def policy_replay(rows: DataFrame, keys: list[str], order: list[str], initial: int = 2) -> DataFrame:
    """Deterministic replay: rows have inning, act1 and act2 (challenge with one or two left), success and stake."""

    def step(k: Column, row: Column) -> tuple[Column, Column]:
        grant = F.coalesce((row["inning"] > row["inning_before"]) & (row["inning"] > REGULATION) & (k == 0), F.lit(False))
        before = F.when(grant, 1).otherwise(k)
        act = F.coalesce(F.when(before == 1, row["act1"]).when(before >= 2, row["act2"]), F.lit(False))
        after = before - (act & ~row["success"]).cast("int")
        captured = F.when(act & row["success"], row["stake"]).otherwise(0.0)
        out = F.struct(before.alias("before"), after.alias("after"), act.alias("challenged"), captured.alias("captured"))
        return after, out

    return folded(rows, keys, order, step=step, **counted(initial))


def reachable_value(rows: DataFrame, keys: list[str], order: list[str], metrics: list[str]) -> DataFrame:
    """Backward values c0, c1, c2 of each metric for the row and all after it.

    Rows have inning, p (chance to challenge), adverse, correct and the metrics' gains. A correct challenge adds
    p * gain; a wrong one leads to one challenge less with chance p; before an extra inning, none is worth as much as one.
    """
    names = [f"{m}_c{k}" for m in metrics for k in range(3)]

    def step(s: Column, row: Column) -> tuple[Column, Column]:
        crossed = F.coalesce((row["inning_before"] > REGULATION) & (row["inning_before"] != row["inning"]), F.lit(False))
        p = F.coalesce(row["p"], F.lit(0.0))
        adverse, correct = (F.coalesce(row[c], F.lit(False)) for c in ("adverse", "correct"))
        out = {}
        for m in metrics:
            gain = F.coalesce(row[m], F.lit(0.0))
            old = [F.when(crossed, s[f"{m}_c1"]).otherwise(s[f"{m}_c0"]), s[f"{m}_c1"], s[f"{m}_c2"]]
            out[f"{m}_c0"] = old[0]
            for k in (1, 2):
                out[f"{m}_c{k}"] = F.when(~adverse, old[k]).when(correct, old[k] + p * gain).otherwise((1 - p) * old[k] + p * old[k - 1])
        named = F.struct(*[c.alias(n) for n, c in out.items()])
        return named, named

    return folded(rows, keys, order, step=step, backwards=True, **vectors(names, [0.0] * len(names), affine=True))


def transitions(rows: DataFrame, keys: list[str], order: list[str], carried: list[str]) -> DataFrame:
    """Each row with its successor's ``carried`` columns (next_*), a terminal flag, and whether the step grants one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    granted = F.coalesce((F.lead("inning").over(w) > REGULATION) & (F.lead("inning").over(w) > F.col("inning")), F.lit(False))
    return out.withColumns({"terminal": F.lead("inning").over(w).isNull(), "extra_grant": granted})


def future_totals(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Totals of ``values`` over all later rows of the key (future_*), zero for the last one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumns({f"future_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
