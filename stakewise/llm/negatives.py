"""Hard negatives by ball trees: for anchors and their best rows of the same label, the best rows of other labels within a
window of scores. A score is the inner product of integer vectors.

Rows go to cells by their nearest pivot (a sample of rows, at most ``PIVOTS``), and a cell's rows to blocks of bounded
size, by hash. A task builds a ball tree over one block and walks it with many anchors at once: a ball's centre and radius
bound the scores of its rows from above and below, and a node is left out for an anchor if all of it lies outside the
anchor's window or strictly beneath its current last rank. Each search has two rounds: in its own block an anchor finds a
first last rank, then it visits the blocks of those cells whose bounds pass. Both sides of a visit are bounded, as anchors
are dealt in chunks; blocks are repeated once a chunk.

Ids and labels are whole numbers. Rows with a null id, label or vector, or with a null or non-finite component take no
part. Rows are told apart by themselves, so repeated rows are listed each; a row isn't its own positive, and neither is one
that shares its id. Rows of equal score come by id. Vectors of different lengths aren't compared. An empty table gives an
empty result; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakewise.llm.common import stored

#: Cells at most; their centres and radii travel with the tasks.
PIVOTS = 1024
#: Rows of a block and anchors of a chunk at most (blocks by expectation, as rows are dealt by hash).
BLOCK_ROWS = 32_768
CHUNK_ROWS = 16_384
#: Rows of a leaf, and candidates held before they are cut to the best.
LEAF = 128
HELD = 100_000
#: Stands for no bound.
FAR = 1 << 62
FOUND = "anchor long, place int, row long, id long, score long"


def usable(rows: DataFrame, id_col: Column, label: Column, vector: Column) -> DataFrame:
    """(row, id, label, v): the rows that take part, numbered; v as doubles."""
    v = F.transform(vector, lambda x: x.cast("double"))
    named = rows.select(id_col.cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine).withColumn("row", F.monotonically_increasing_id())


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A column of lists of ``size`` doubles as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


class Cells:
    """Pivots of one vector length, and the rows' nearest ones, written once as ``table`` (row, id, label, v, cell, block)."""

    def __init__(self, rows: DataFrame, size: int, n: int, block_rows: int | None = None):
        spark = rows.sparkSession
        self.size, self.block_rows = size, block_rows or int(min(BLOCK_ROWS, max(256, 16 * n**0.5)))
        most = min(PIVOTS, -(-n // self.block_rows))
        sample = rows.orderBy(F.xxhash64("row"), "row").limit(most).select("v").collect()
        self.pivots = pivots = np.array([r["v"] for r in sample], float).reshape(len(sample), size)
        half = (pivots**2).sum(1) / 2

        def nearest(batches):
            for batch in batches:
                x = matrix(batch["v"], size)
                cell = (x @ pivots.T - half).argmax(1)
                away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "id", "label", "v")), pa.array(cell.astype(np.int32)), pa.array(away)], names=["row", "id", "label", "v", "cell", "away"])

        dealt = stored(rows.select("row", "id", "label", "v").mapInArrow(nearest, "row long, id long, label long, v array<double>, cell int, away double"), "cells")
        found = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toPandas().set_index("cell").reindex(range(len(pivots)), fill_value=0)
        self.radius = found["radius"].to_numpy(float)
        self.blocks = np.maximum(-(-found["n"].to_numpy(np.int64) // self.block_rows), 0)
        self.first = np.cumsum(self.blocks) - self.blocks
        table = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(self.first, self.blocks, strict=True)) if b], "cell int, first long, blocks long")
        # at most PIVOTS rows
        self.table = dealt.join(F.broadcast(table), "cell").select("row", "id", "label", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).alias("block"))

    def visits(self, anchors: DataFrame) -> DataFrame:
        """``anchors`` (row, id, label, v, block, windows, last) once for each other block that may matter to them."""
        pivots, radius, blocks, first, size = self.pivots, self.radius, self.blocks, self.first, self.size

        def passing(batches):
            for batch in batches:
                q = matrix(batch["v"], size)
                need, most = bounds(batch)
                up, down = reach(q @ pivots.T, np.sqrt((q**2).sum(1))[:, None], radius, np.sqrt((pivots**2).sum(1)))
                near = (blocks > 0) & (up >= need.min(1)[:, None]) & (down <= most.max(1)[:, None])
                own = np.asarray(batch["block"])
                lists = [[int(b) for c in np.flatnonzero(row) for b in range(first[c], first[c] + blocks[c]) if b != o] for row, o in zip(near, own, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ANCHOR), pa.array(lists, pa.list_(pa.int64()))], names=[*ANCHOR, "blocks"])

        kinds = "row long, id long, label long, v array<double>, windows array<struct<low: long, high: long>>, last array<long>, blocks array<long>"
        routed = anchors.select(*ANCHOR, "block").mapInArrow(passing, kinds)
        return routed.select(*ANCHOR, F.explode("blocks").alias("block"))


ANCHOR = ["row", "id", "label", "v", "windows", "last"]


def bounds(batch) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and window: the least and the greatest score that can still count. Windows beyond an anchor's own
    number count nothing."""
    windows, last = batch["windows"].to_pylist(), batch["last"].to_pylist()
    width = max(map(len, windows), default=0) or 1
    need, most = np.full((len(windows), width), FAR), np.full((len(windows), width), -FAR)
    for i, (w, t) in enumerate(zip(windows, last, strict=True)):
        for j, x in enumerate(w):
            need[i, j], most[i, j] = max(x["low"], t[j] if t else -FAR), x["high"]
    return need, most


def reach(score: np.ndarray, norm: np.ndarray, radius: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores inside balls, from those of their centres; widened by far more than sums are rounded."""
    slack = norm * radius * (1 + 1e-9) + norm * length * 1e-9 + 1e-6
    return score + slack, score - slack


class BallTree:
    """Balls over the rows of a matrix; a node is halved at the median between two rows far apart."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.span, self.children, centres, radii, first, last = [], [], [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            low, high, parent, side = todo.pop()
            node = len(self.span)
            if parent >= 0:
                self.children[parent][side] = node
            own = self.order[low:high]
            part = x[own]
            centre = part.mean(0)
            away = ((part - centre) ** 2).sum(1)
            self.span.append((low, high))
            self.children.append([-1, -1])
            centres.append(centre)
            radii.append(away.max() ** 0.5)
            first.append(labels[own].min())
            last.append(labels[own].max())
            if high - low > leaf and radii[-1] > 0:
                one = part[away.argmax()]
                line = one - part[((part - one) ** 2).sum(1).argmax()]
                half = (high - low) // 2
                self.order[low:high] = own[np.argpartition(part @ line, half)]
                todo += [(low, low + half, node, 0), (low + half, high, node, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.lengths = np.sqrt((self.centres**2).sum(1))
        self.first, self.last = np.array(first), np.array(last)
        self.x = x[self.order]


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as longs: as doubles while no sum passes 53 bits."""
    most = float(np.sqrt((q**2).sum(1).max(initial=0)) * np.sqrt((x**2).sum(1).max(initial=0)))
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most >= 2.0**62:
        raise OverflowError("a score passes 62 bits")
    return q.astype(np.int64) @ x.astype(np.int64).T


def best(found: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (slot, score, id, row) cut to the first ``k`` of each slot; the slots that are full, with their last score."""
    a = np.concatenate(found, 1)
    a = a[:, np.lexsort((a[3], a[2], -a[1], a[0]))]
    starts = np.flatnonzero(np.append(True, a[0, 1:] != a[0, :-1])) if a.shape[1] else np.array([], int)
    rank = np.arange(a.shape[1]) - np.repeat(starts, np.diff(np.append(starts, a.shape[1])))
    full = rank == k - 1
    return a[:, rank < k], a[0, full], a[1, full]


def searched(tree: BallTree, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, q: np.ndarray, own: np.ndarray, wanted: np.ndarray, need: np.ndarray, most: np.ndarray, same: bool, k: int) -> np.ndarray:
    """Candidates (slot, score, id, row) of all anchors in one tree; a slot is an anchor's window. ``need`` rises as ranks
    fill."""
    norm, width = np.sqrt((q**2).sum(1)), need.shape[1]
    need, held, size = need.copy(), [], 0
    ids, rows, labels = ids[tree.order], rows[tree.order], labels[tree.order]
    todo = [(0, np.arange(len(q)))]
    while todo:
        node, active = todo.pop()
        up, down = reach(q[active] @ tree.centres[node], norm[active], tree.radii[node], tree.lengths[node])
        passes = ((up[:, None] >= need[active]) & (down[:, None] <= most[active])).any(1)
        low, high = tree.first[node], tree.last[node]
        passes &= (wanted[active] >= low) & (wanted[active] <= high) if same else (wanted[active] != low) | (low != high)
        active, up = active[passes], up[passes]
        if not len(active):
            continue
        one, two = tree.children[node]
        if one >= 0:
            # the half whose centre is nearer to most anchors is walked first
            nearer = (q[active] @ (tree.centres[one] - tree.centres[two]) > 0).mean() > 0.5
            todo += [(two, active), (one, active)] if nearer else [(one, active), (two, active)]
            continue
        a, b = tree.span[node]
        for at in range(0, len(active), 4096):
            part = active[at : at + 4096]
            score = inner(q[part], tree.x[a:b])
            fits = ((wanted[part][:, None] == labels[a:b]) == same) & (own[part][:, None] != ids[a:b])
            for w in range(width):
                i, j = np.nonzero(fits & (score >= need[part, w][:, None]) & (score <= most[part, w][:, None]))
                if len(i):
                    held.append(np.stack([part[i] * width + w, score[i, j], ids[a + j], rows[a + j]]))
                    size += len(i)
        if size > HELD + 2 * len(q) * width * k:
            kept, slots, floor = best(held, k)
            need.ravel()[slots] = np.maximum(need.ravel()[slots], floor)
            held, size = [kept], kept.shape[1]
    return best(held, k)[0] if held else np.zeros((4, 0), np.int64)


def visited(blocks: DataFrame, anchors: DataFrame, keys: list[str], size: int, same: bool, k: int) -> DataFrame:
    """The best of each block for each anchor that visits it."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros((4, 0), np.int64)
        if len(left) and len(right):
            x, labels = matrix(left["v"], size), np.asarray(left["label"])
            need, most = bounds(right)
            out = searched(BallTree(x, labels), np.asarray(left["id"]), np.asarray(left["row"]), labels, matrix(right["v"], size), np.asarray(right["id"]), np.asarray(right["label"]), need, most, same, k)
            anchor, place = np.asarray(right["row"])[out[0] // need.shape[1]], out[0] % need.shape[1]
        else:
            anchor = place = out[0]
        return pa.table({"anchor": anchor.astype(np.int64), "place": place.astype(np.int32), "row": out[3], "id": out[2], "score": out[1]})

    return blocks.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(meet, FOUND)


def first_ranks(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_rows(cells: Cells, anchors: DataFrame, same: bool, k: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(anchor, place, row, id, score, rank): for each of an anchor's windows the first ``k`` rows of the ``same`` label, or of
    others. ``anchors`` has row, id, label, v, block and windows, an array of (low, high)."""
    blocks = cells.table.select("row", "id", "label", "v", "block")
    kept = ["row", "id", "label", "v", "windows", "block"]
    started = anchors.select(*[F.col(c).alias(c) for c in kept], F.array().cast("array<long>").alias("last"))  # columns of its own beside those of the blocks
    home = stored(first_ranks(visited(blocks, started, ["block"], cells.size, same, k), k), "home")
    full = home.filter(F.col("rank") == k).select("anchor", "place", "score")
    lasts = full.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("lasts"))
    known = anchors.select(*kept).join(lasts, "row", "left")
    last = F.transform(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: F.coalesce(F.try_element_at("lasts", i), F.lit(-FAR)))
    known = stored(known.filter(F.size("windows") > 0).withColumn("last", F.when(F.col("lasts").isNull(), F.array().cast("array<long>")).otherwise(last)).drop("lasts"), "anchors")
    chunks = max(1, -(-known.count() // chunk_rows))
    visits = cells.visits(known).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    repeated = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    rest = visited(repeated, visits, ["block", "chunk"], cells.size, same, k)
    return first_ranks(home.drop("rank").union(rest), k)


def hard_negatives(rows: DataFrame, anchors_if: Column, id_col: str = "id", label: str | Column = "label", vector: str | Column = "v", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 100, block_rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (``anchors_if``, a
    condition on the column ``id``) and each of its first ``positives`` rows of the same label, the first ``negatives`` rows
    of other labels with low * positive_score <= scale * negative_score <= high * positive_score. ``vector`` has whole
    numbers."""
    label, vector = (F.col(c) if isinstance(c, str) else c for c in (label, vector))
    base = stored(usable(rows, F.col(id_col), label, vector), "vectors")
    out = base.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))])
    for size, n in sorted(tuple(r) for r in base.groupBy(F.size("v")).count().collect()):
        cells = Cells(base.filter(F.size("v") == size), size, n, block_rows)
        out = out.union(_of_one_length(cells, anchors_if, positives, negatives, low, high, scale, chunk_rows))
    return out


def _of_one_length(cells: Cells, anchors_if: Column, positives: int, negatives: int, low: int, high: int, scale: int, chunk_rows: int) -> DataFrame:
    anchors = cells.table.filter(anchors_if)
    whole = anchors.withColumn("windows", F.array(F.struct(F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))))
    found = best_rows(cells, whole, True, positives, chunk_rows)

    def down(x: Column) -> Column:
        """x / scale rounded down."""
        return F.call_function("div", x - F.pmod(x, F.lit(scale)), F.lit(scale))

    score = F.col("score")
    window = F.struct(F.col("rank").alias("rank"), F.col("id").alias("id"), score.alias("score"), (-down(-low * score)).alias("low"), down(high * score).alias("high"))
    lists = stored(found.groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("taken")), "positives")
    wanted = anchors.join(lists.withColumnRenamed("anchor", "row"), "row")
    wanted = wanted.withColumn("windows", F.transform("taken", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))))
    mined = best_rows(cells, wanted.drop("taken"), False, negatives, chunk_rows).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    named = mined.join(lists, "anchor").join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    positive = F.col("taken")[F.col("place")]
    return named.select("anchor_id", positive["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", positive["score"].alias("positive_score"), "negative_score")
