"""Toxicity: ratios against a plain recursion, and accuracy on held-out texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stakewise.llm.toxicity import DISCOUNT, STRENGTH, hashed_table, log_ratios, logistic, toxicity, within, word_ratios, words_of


def plain_ratio(table, word, order):
    """The log-ratio of a word straight from the definition."""
    n = {c: Counter() for c in (0, 1)}
    for w, *counts in table:
        s = f"\x02{w}\x03"
        for i in range(1, len(s)):
            for c in (0, 1):
                n[c][s[max(0, i - order + 1) : i + 1]] += counts[c]
    full = {g for c in (0, 1) for g, k in n[c].items()}
    ends = {g[i:] for g in full for i in range(len(g))}
    left = Counter(g[1:] for g in ends if len(g) > 1)
    letters = sum(len(g) == 1 for g in left)

    def mixed(count, contexts, gram, low):
        total, types = sum(count[g] for g in contexts[gram[:-1]]), len(contexts[gram[:-1]])
        return (max(count[gram] - DISCOUNT, 0) + DISCOUNT * types * low) / total if total else low

    by_context = [defaultdict(list), defaultdict(list)]
    for g in left:
        by_context[0][g[:-1]].append(g)
    for g in full:
        by_context[1][g[:-1]].append(g)

    def low(gram):
        if not gram:
            return 1 / (letters + 1)
        return mixed(left, by_context[0], gram, low(gram[1:])) if left[gram] else 1 / (letters + 1)

    both = n[0] + n[1]
    total, s = 0.0, f"\x02{word}\x03"
    for i in range(1, len(s)):
        gram = s[max(0, i - order + 1) : i + 1]
        own = by_context[1][gram[:-1]]
        if not own:
            continue
        p = mixed(both, by_context[1], gram, low(gram[1:]))
        chance = []
        for c in (0, 1):
            types = sum(n[c][g] > 0 for g in own)
            chance.append((max(n[c][gram] - DISCOUNT, 0) + (STRENGTH + DISCOUNT * types) * p) / (sum(n[c][g] for g in own) + STRENGTH))
        total += math.log(chance[1] / chance[0])
    return total


@pytest.mark.parametrize("order", [3, 6])
def test_ratios_equal_a_plain_recursion(spark, order):
    table = [("the", 50, 6), ("then", 9, 1), ("idiot", 0, 12), ("idiots", 0, 3), ("ça", 4, 0), ("a", 30, 3), ("\U0001f600", 1, 1), ("there", 5, 9)]
    grams, contexts = log_ratios(spark.createDataFrame(table, "word string, n0 long, n1 long"), order)
    model = hashed_table(grams, order), hashed_table(contexts, order - 1)
    words = ["the", "idiot", "idiotic", "thx", "zzz", "ça", "\U0001f600", "a", "theidiot"]
    got = word_ratios(words, *model, order)
    assert np.allclose(got, [plain_ratio(table, w, order) for w in words], atol=1e-5)
    assert got[1] > 1 > got[0]


def planted(n, seed):
    """(doc_id, text, lang, score) and labels; a fortieth of a toxic text's words begin with a bad stem."""
    rng = np.random.default_rng(seed)
    parts = ["an", "ti", "ou", "re", "sh", "el", "ing", "ba", "do", "mu"]
    make = lambda: "".join(rng.choice(parts, rng.integers(1, 5)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [make() for _ in range(rng.integers(40, 160))]
        if toxic:
            for at in rng.integers(0, len(words), max(2, len(words) // 40)):
                words[at] = rng.choice(["scum", "vile"]) + rng.choice(["", "s", "bag", "rot"])
        docs.append((i, " ".join(words), "en", 0.5))
        labels.append((i, 1, int(toxic)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = planted(1500, 3)
    table = spark.createDataFrame(docs, DOCS)
    got = toxicity(table, spark.createDataFrame(labels, LABELS), taught_if=F.col("doc_id") % 4 > 0).toPandas()
    got["toxic"] = got["id"] % 5 == 0
    held = got[got["id"] % 4 == 0]
    assert ((held["score"] >= 0.5) == held["toxic"]).mean() > 0.97
    assert held[~held["toxic"]]["score"].max() < 0.9


def test_untaught_labels_change_nothing(spark):
    docs, labels = planted(300, 4)
    table, rule = spark.createDataFrame(docs, DOCS), F.col("doc_id") % 4 > 0
    other = [(i, q, 1 - t if i % 4 == 0 else t) for i, q, t in labels]
    one, two = (toxicity(table, spark.createDataFrame(x, LABELS), taught_if=rule).orderBy("id").collect() for x in (labels, other))
    assert one == two


def test_odd_rows_are_scored(spark):
    docs, labels = planted(300, 5)
    odd = [(None, "scum vile", "en", 0.1), (9000, None, "fr", 0.1), (9001, "", None, 0.1), (9002, "scum " * 30_000, "en", 0.1), (7, "repeated id", "en", 0.1)]
    odd_labels = [(9001, 1, None), (9002, 1, 0), (9002, 1, 1), (None, 1, 1), (9000, 1, 5), (7, 1, 0)]
    got = toxicity(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + odd_labels, LABELS)).toPandas()
    assert len(got) == 305
    assert got["score"].between(0, 1).all()
    empty = got[got["id"].isin([9000, 9001])]["score"]
    assert empty.nunique() == 1
    assert got[got["id"] == 9002]["score"].item() > 0.5


@pytest.mark.parametrize("toxic", [[], [0, 0, 0], [1]])
def test_without_both_classes_the_rate_is_given(spark, toxic):
    docs = spark.createDataFrame([(i, "some words", "en", 0.0) for i in range(4)], DOCS)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS)
    want = (sum(toxic) + 1) / (len(toxic) + 2)
    assert [r.score for r in toxicity(docs, labels).collect()] == pytest.approx([want] * 4)
    assert toxicity(docs.limit(0), labels).count() == 0


def test_bounds_of_the_sample():
    assert within(np.array([5, 9, 4, 1]), 10).tolist() == [True, False, True, True]
    assert words_of("The THE, idiot! ... a") == ["the", "idiot", "...", "a"]


def test_logistic_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(2, 3, (20_000, 2))
    y = rng.random(20_000) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -0.5])))
    beta, centre, scale = logistic(x, y.astype(float))
    assert np.allclose(beta[1:] / scale, [1.0, -0.5], atol=0.05)
    assert abs(beta[0] - (beta[1:] / scale) @ centre - 0.5) < 0.1
