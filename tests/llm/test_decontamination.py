"""Containment of benchmark windows against brute force, in one block and in many."""

import random
import re

import pytest

from stakewise.llm.decontamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + window]), set()).add(str(item))
    out = []
    for d, text in docs:
        own, hit, found = words(text), set(), set()
        for w, who in windows.items():
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= who
        out.append((d, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Straße", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 2, 5, 9, 10, 11, 30))))) for i in range(25)]
    items += [(100, None), (101, " ... "), (102, items[20][1]), (103, "a a a a a a a a a a a a")]
    docs = [(d, " ".join(rng.choices(vocabulary, k=60))) for d in range(30)]
    for d in range(30, 60):
        own = rng.choices(vocabulary, k=50)
        item = rng.choice(items[:25])[1].split()
        at, cut = rng.randrange(50), rng.randrange(3)
        own[at:at] = [x.upper() + rng.choice((",", ".", "", "-")) for x in item[cut:]]
        docs.append((d, " \n".join(own)))
    return [*docs, (60, None), (61, ""), (62, "A a, a " * 4000), (60, None)], items


@pytest.mark.parametrize("block_bytes", [1_000_000, 1000])
def test_hits_match_brute_force(spark, block_bytes):
    docs, items = corpus()
    found = contamination(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs, items.filter("false")).first().n_hit == 0
    assert contamination(docs.filter("false"), items).count() == 0


@pytest.mark.parametrize("block_bytes", [1_000_000, 10])
def test_items_without_id_and_ids_of_any_kind(spark, block_bytes):
    big = 2**53 + 1
    docs = spark.createDataFrame([(None, "x a b c d"), (big, "A b, c e"), (big, "e f g"), (7, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), (None, "f"), (3, "c"), (4, " ")], "item_id long, text string")
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in contamination(docs, items, block_bytes=block_bytes).collect()), key=str)
    assert rows == sorted([(None, 5, 2, 2, ["3"]), (big, 4, 2, 2, ["3"]), (big, 3, 1, 1, []), (7, 0, 0, 0, [])], key=str)
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {r.doc_id for r in contamination(named, items, block_bytes=block_bytes).collect()} == {None, f"d{big}", "d7"}


def test_very_frequent_words_and_long_runs_in_a_large_benchmark(spark):
    docs = [(1, "a " * 3000), (2, "b " + "a " * 12 + "b"), (3, "c " * 9)]
    items = [(1, "a " * 11), (2, "a b"), (3, "c " * 10)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in contamination(*frames, block_bytes=10).collect())
    assert got == brute(docs, items)
