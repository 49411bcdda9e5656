"""Balanced label propagation: documents to shards, linked documents together, sizes even.

Documents are linked by a shared group (for the query: equal texts). Every document starts with a label, a shard by
hash. In each round a group's members take the label that is strongest among them, as long as that shard has room for
all of them; if none of their labels has, they take another shard's that has. A shard accepts its movers, large groups
first, until its quota of rows is full; those beyond it move in a later round. Members that wait hold no room, so no
shard has to empty before another can fill, and a round ends with a group settled or with none that fits.

Cuts are few by construction. Groups of a whole quota or more, fewer than shards, fill whole shards first. When no
waiting group fits anywhere, fewer groups than shards are left (each is larger than the mean room), and only these are
split over what room is left. So beyond the cuts that quotas force, at most one group per shard is cut. Documents
without links then fill every shard to its quota exactly.

A group's members never meet in one task: they have ranks, a shard takes a range of ranks, and rows find their range by
blocks of ``BLOCK`` ranks. Order is by id and content hashes, so another split of the files gives the same shards.

Null texts count as empty. Repeated rows are separate documents; rows of a null group are linked with nothing. Ids may
be of any type and null. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakewise.llm.common import buckets_for, fingerprint, ranked, small_or_shuffled, stored

SHARDS = 24
#: Ranks of a group that meet in one join key.
BLOCK = 10_000
RANGE = "g1 long, g2 long, first long, behind long, shard int"


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: sizes at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def cut_links(placed: DataFrame) -> int:
    """Cut of a placement (g1, g2, shard): for each group, the shards beyond the first that hold members."""
    per_group = placed.select("g1", "g2", "shard").distinct().groupBy("g1", "g2").agg((F.count("*") - 1).alias("cut"))
    return per_group.agg(F.sum("cut")).first()[0] or 0


def split_over(groups: list, room: list[int], whole: bool) -> list[tuple]:
    """Ranges (g1, g2, first, behind, shard) of fewer ``groups`` (g1, g2, first, left) than shards; ``room`` shrinks.

    With ``whole``, only shards that a group fills are taken, so its rest stays; otherwise it takes the largest rooms.
    """
    ranges = []
    for g1, g2, first, left in groups:
        for s in sorted(range(len(room)), key=lambda s: (-room[s], s)):
            take = min(left, room[s])
            if take and not (whole and take < room[s]):
                ranges.append((g1, g2, first, first + take, s))
                first, left, room[s] = first + take, left - take, room[s] - take
    return ranges


def settled(waiting: DataFrame, room: list[int], round_: int, n: int) -> DataFrame:
    """``waiting`` (g1, g2, first, left, labels) with ``shard`` where a shard takes the whole group in this round.

    Movers of a shard are accepted in order of size classes and hashes while their sums fit. The sums are exact without
    a single task for a shard: they add up inside hash buckets, and buckets start where earlier ones end.
    """
    fits = F.filter("labels", lambda s: _at(room, s) >= F.col("left"))
    others = [s for s in range(len(room)) if room[s] > 0]
    names = F.array(*[F.lit(s) for s in others])
    possible = F.filter(names, lambda s: _at(room, s) >= F.col("left"))
    any_of = F.get(possible, F.pmod(F.xxhash64("g1", F.lit(round_)), F.greatest(F.size(possible), F.lit(1))).cast("int"))
    movers = waiting.withColumn("target", F.coalesce(F.get(fits, 0), any_of))
    order = (F.lit(64) - F.floor(F.log2(F.col("left").cast("double")))).cast("int")
    movers = movers.withColumns({"class": order, "bucket": F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets_for(n))).cast("int")})
    sums = movers.filter("target IS NOT NULL").groupBy("target", "class", "bucket").agg(F.sum("left").alias("s"))
    before = Window.partitionBy("target").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("from", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    within = Window.partitionBy("target", "class", "bucket").orderBy(F.desc("left"), "g1", "g2")
    movers = movers.withColumn("own", F.sum("left").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = movers.join(starts, ["target", "class", "bucket"], "left")
    fit = F.col("from") + F.col("own") <= _at(room, F.col("target"))
    return joined.select("g1", "g2", "first", "left", "labels", F.when(fit, F.col("target")).alias("shard"))


def propagate(groups: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """Ranges of ranks (g1, g2, first, behind, shard) for ``groups`` (g1, g2, c, labels), and the room that is left."""
    spark, room = groups.sparkSession, list(quota)
    large = groups.filter(F.col("c") >= F.lit(max(1, max(quota)))).orderBy(F.desc("c"), "g1", "g2").select("g1", "g2", F.lit(0), "c").collect()
    ranges = split_over([tuple(r) for r in large], room, whole=True)
    taken: dict[tuple, int] = {}
    for g1, g2, _, behind, _ in ranges:
        taken[g1, g2] = behind
    start = spark.createDataFrame([(*g, n) for g, n in taken.items()], "g1 long, g2 long, first long")
    waiting = groups.join(F.broadcast(start), ["g1", "g2"], "left").withColumn("first", F.coalesce("first", F.lit(0).cast("long")))
    waiting = waiting.select("g1", "g2", "first", (F.col("c") - F.col("first")).alias("left"), "labels").filter("left > 0")
    parts, round_ = [], 0
    while True:
        waiting = stored(waiting, "waiting")
        n = waiting.count()
        if not n:
            break
        moved = stored(settled(waiting, room, round_, n), "moved")
        won = {r["shard"]: r["s"] for r in moved.filter("shard IS NOT NULL").groupBy("shard").agg(F.sum("left").alias("s")).collect()}
        if not won:
            rest = moved.orderBy(F.desc("left"), "g1", "g2").select("g1", "g2", "first", "left").collect()
            ranges += split_over([tuple(r) for r in rest], room, whole=False)
            break
        room = [r - won.get(s, 0) for s, r in enumerate(room)]
        parts.append(moved.filter("shard IS NOT NULL").select("g1", "g2", "first", (F.col("first") + F.col("left")).alias("behind"), "shard"))
        waiting, round_ = moved.filter("shard IS NULL").drop("shard"), round_ + 1
    out = spark.createDataFrame(ranges, RANGE)
    for part in parts:
        out = out.union(part)
    return out, room


def balanced_shards(docs: DataFrame, group: list[Column] | None = None, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, g1, g2 (the group), shard and slot.

    ``group`` gives two long columns that are equal for linked documents (default: those of equal texts). Shards
    hold equal numbers of rows, at most one apart; slots count from 0 in each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    g1, g2 = group or fingerprint(text)
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), g1.alias("g1"), g2.alias("g2"))
    base = stored(base, "base")
    n = base.count()
    quota = quotas(n, shards)
    key = [F.col(c) for c in ("doc_id", "size", "text_crc32", "g1", "g2")]
    label = F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int")
    votes = base.filter("g1 IS NOT NULL AND g2 IS NOT NULL").groupBy("g1", "g2", label.alias("label")).agg(F.count("*").alias("v"))
    strongest = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("v"), "label"))), lambda x: x["label"])
    groups = stored(votes.groupBy("g1", "g2").agg(F.sum("v").alias("c"), strongest.alias("labels")).filter("c > 1"), "groups")
    ranges, room = propagate(groups, quota)
    ranges = stored(ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("behind") - 1) / BLOCK)))), "ranges")
    in_group = base.join(small_or_shuffled(groups.select("g1", "g2")), ["g1", "g2"])
    members = ranked(in_group, ["g1", "g2"], key[:3], "rank", n).withColumn("block", F.floor(F.col("rank") / BLOCK))
    linked = members.join(small_or_shuffled(ranges), ["g1", "g2", "block"]).filter("rank >= first AND rank < behind").select(*key, "shard")
    ends = F.array(*[F.lit(sum(room[: s + 1])).cast("long") for s in range(shards)])
    lone = base.join(small_or_shuffled(groups.select("g1", "g2")), ["g1", "g2"], "left_anti")
    single = ranked(lone, [], key, "turn", n).select(*key, F.size(F.filter(ends, lambda e: e <= F.col("turn"))).cast("int").alias("shard"))
    return ranked(stored(linked.union(single), "placed"), ["shard"], key, "slot", n).select(*key, "shard", "slot")
