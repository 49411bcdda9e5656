"""Hard negatives against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stakewise.llm.negatives import BallTree, best, hard_negatives, inner, searched

SCHEMA = "id long, label long, v array<double>, row string, cell int, block string"


def mined(rows, every, positives, negatives):
    rows = [r for r in rows if None not in r[:3] and all(x is not None and np.isfinite(x) for x in r[2])]
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        score = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in score if x[2] == label)[:positives]:
            fits = sorted((s, k) for s, k, m in score if m != label and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def vectors(n, size, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(-9, 10, (n // 2, size))
    v = np.concatenate([base, base[rng.integers(0, n // 2, n - n // 2)] + rng.integers(-1, 2, (n - n // 2, size))])
    return [(i, int(rng.integers(0, 3)), [float(x) for x in r]) for i, r in enumerate(v)]


@pytest.mark.parametrize(("size", "block_rows", "chunk_rows"), [(4, None, 16384), (6, 16, 5), (2, 30, 3)])
def test_equals_brute_force(spark, size, block_rows, chunk_rows):
    rows = vectors(240, size, size)
    rows += [(1000, None, [1.0] * size), (1010, 1, None), (None, 1, [1.0] * size), (1020, 1, [float("nan")] * size), (1030, 1, [None] * size), (1040, 1, [float("inf")] * size), (1050, 2, [1.0] * (size + 1)), (1060, 2, [2.0] * (size + 1)), (1070, 1, [2.0] * (size + 1)), (1080, 0, []), (1090, 1, [])]
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = hard_negatives(table, F.col("id") % 10 == 0, positives=4, negatives=6, block_rows=block_rows, chunk_rows=chunk_rows)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 10, 4, 6)


def test_one_large_group_of_equal_rows(spark):
    rows = [(i, i % 2, [3.0, 4.0]) for i in range(300)] + [(i, 2, [2.0, 2.0]) for i in range(300, 310)]
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = hard_negatives(table, F.col("id") % 100 == 0, positives=2, negatives=3, block_rows=20)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 100, 2, 3)


def test_empty_table(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).count() == 0


def test_repeated_rows_are_listed_each(spark):
    rows = [(0, 1, [10.0]), (5, 1, [10.0]), (5, 1, [10.0]), (7, 2, [5.0]), (7, 2, [5.0])]
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = hard_negatives(table, F.col("id") == 0, positives=5, negatives=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted([(0, 5, k, 7, 100, 50) for k in (1, 2)] * 2)


def test_tree_leaves_out_nodes_and_loses_none():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3, 4, (400, 3)) + c for c in ((200, 0, 0), (0, 200, 0), (-200, 0, 0), (0, -200, 5))]).astype(float)
    labels, ids = rng.integers(0, 2, len(x)), np.arange(len(x))
    q = x[::100]
    need, most = np.full((len(q), 1), 3000), np.full((len(q), 1), 41_000)
    tree = BallTree(x, labels, 16)
    got = searched(tree, ids, ids, labels, q, ids[::100], labels[::100], need, most, False, 7)
    score = inner(q, x)
    for a in range(len(q)):
        fits = [(-score[a, i], i) for i in ids if labels[i] != labels[::100][a] and i != 100 * a and 3000 <= score[a, i] <= 41_000]
        assert [(-s, i) for s, i in zip(got[1, got[0] == a], got[2, got[0] == a], strict=True)] == sorted(fits)[:7]
    away = np.sqrt(((x[tree.order[slice(*tree.span[5])]] - tree.centres[5]) ** 2).sum(1))
    assert away.max() <= tree.radii[5] * (1 + 1e-9)


def test_large_scores_are_exact():
    a, b = np.array([[2.0**30, 3.0]]), np.array([[2.0**29, 5.0]])
    assert inner(a, b)[0, 0] == 2**59 + 15
    with pytest.raises(OverflowError):
        inner(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_best_keeps_ties_by_id():
    found = np.array([[0, 0, 0, 1], [5, 7, 5, 1], [9, 3, 2, 4], [0, 1, 2, 3]])
    kept, slots, floor = best([found], 2)
    assert kept[2].tolist() == [3, 2, 4]
    assert (slots.tolist(), floor.tolist()) == ([0], [5])
