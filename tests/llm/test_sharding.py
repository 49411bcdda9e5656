"""Shards are even and gapless, and keep linked documents together better than a hash does."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stakewise.llm.sharding import balanced_shards, cut_links


def shards(spark, texts, n=6):
    df = balanced_shards(spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, slot string"), shards=n)
    return df, df.collect()


def check(rows, texts, n):
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min([counts.get(s, 0) for s in range(n)]) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_groups_stay_together_within_quotas(spark):
    texts = [(i, f"text {i}") for i in range(300)] + [(1000 + i, f"copy {i % 60}") for i in range(180)] + [(2000 + i, "hot") for i in range(240)] + [(3000, None), (3001, ""), (5, "text 5")]
    df, rows = shards(spark, texts)
    check(rows, texts, 6)
    hot = len({r.shard for r in rows if 2000 <= r.doc_id < 3000})
    assert hot <= math.ceil(240 / (len(texts) // 6)) + 2
    spread = [len({r.shard for r in rows if r.doc_id >= 1000 and r.doc_id < 2000 and (r.doc_id - 1000) % 60 == g}) for g in range(60)]
    assert sum(x == 1 for x in spread) >= 50
    assert cut_links(df) == sum(x - 1 for x in spread) + hot - 1 + len({r.shard for r in rows if r.doc_id in (3000, 3001)}) - 1 + len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"text 5")}) - 1


def test_small_and_empty_tables(spark):
    check(shards(spark, [(1, "a"), (2, "a"), (3, None)])[1], [(1, "a"), (2, "a"), (3, None)], 6)
    assert shards(spark, [])[1] == []


def least_cut(sizes, rows, n):
    """Cuts that the quotas alone force."""
    return sum(math.ceil(c / math.ceil(rows / n)) - 1 for c in sizes)


@pytest.mark.parametrize(("groups", "each", "alone"), [(800, 3, 0), (700, 3, 300), (600, 3, 600), (400, 3, 1200), (40, 31, 0)])
def test_cuts_are_near_the_bound_whatever_share_of_rows_is_linked(spark, groups, each, alone):
    texts = [(i, f"copy {i % groups}") for i in range(groups * each)] + [(10_000 + i, f"text {i}") for i in range(alone)]
    df, rows = shards(spark, texts, 24)
    check(rows, texts, 24)
    assert cut_links(df) <= least_cut([each] * groups, len(texts), 24) + 24


def test_random_group_sizes_against_the_bound_and_other_file_splits(spark):
    rng = random.Random(5)
    sizes = [rng.choice((1, 1, 2, 3, 5, 8, 40, 300)) for _ in range(60)]
    texts = [(d, f"text {g}") for d, g in enumerate(g for g, c in enumerate(sizes) for _ in range(c))] + [(None, "text 1"), (None, None)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, slot string")
    one, two = (balanced_shards(frame.repartition(k), shards=7) for k in (1, 5))
    check(one.collect(), texts, 7)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert cut_links(one) <= least_cut(sizes, len(texts), 7) + 7


def test_own_groups_with_nulls_and_string_ids(spark):
    rows = [(f"d{i}", "t", i % 4 if i % 3 else None) for i in range(40)]
    df = balanced_shards(spark.createDataFrame(rows, "doc_id string, text string, own long"), group=[F.col("own"), F.col("own")], shards=4)
    counts = Counter(r.shard for r in df.collect())
    assert sorted(counts.values()) == [10] * 4 and df.filter("doc_id = 'd7'").count() == 1
