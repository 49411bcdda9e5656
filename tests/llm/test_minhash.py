"""Near-duplicates against brute force: all pairs of shingle sets, components by union-find."""

import random

from stakewise.llm.minhash import CROWDED, near_duplicates, one_of_each


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, width, percent):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs))


def found(spark, docs, **kw):
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **kw).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(400)}"
    return " ".join(words)


def test_components_match_brute_force(spark):
    rng = random.Random(11)
    docs = []
    for g in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(60)]
        docs += [edited(rng, base, rng.randrange(6)) for _ in range(5)]
    docs += ["", None, "one", "one", "One", "two words", "a b c", "A  b\nc", " \t\n"]
    docs = list(enumerate(docs))
    for kw in ({"width": 3, "percent": 85}, {}):
        assert found(spark, docs, **kw) == brute(docs, kw.get("width", 5), kw.get("percent", 80))


def test_crowded_bucket_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, edited(rng, base, rng.randrange(12))) for i in range(6 * CROWDED)]
    assert found(spark, docs, width=3, percent=85) == brute(docs, 3, 85)


def test_empty_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "k"), (1, "a b c d e f", "k")], "doc_id long, text string, key string")
    assert [(r.component_id, r.kept) for r in near_duplicates(frame).collect()] == [(1, True)] * 2
    assert near_duplicates(frame.filter("false")).count() == 0


def test_ids_that_pandas_would_spoil_and_repeat(spark):
    big = 2**53 + 1
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(None, "q r s t u v"), (big, "q r s t u v"), (big + 2, a), (big + 2, b), (big + 1, a + " x"), (big + 3, b + " y"), (None, "x y z"), (None, "x y z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame).collect()}
    assert rows == {(None, 2, big, False), (big, 2, big, True), (big + 2, 56, big + 1, False), (big + 2, 56, big + 2, True), (big + 1, 57, big + 1, True), (big + 3, 57, big + 2, False), (None, 1, None, True)}
    left = one_of_each(frame.unionAll(frame))
    assert sorted((r.doc_id or 0, r.text[:2]) for r in left.collect()) == [(0, "x "), (big, "q "), (big + 1, "a0"), (big + 2, "b0")]


def test_string_ids_and_dotted_columns(spark):
    frame = spark.createDataFrame([("b", "one two three four five six", 1, 2), ("a", "One two three four five six", 3, 4), ("c", "", 5, 6), ("c", "", 5, 6)], "doc_id string, text string, `a.b` long, r1 long")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame).collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True), ("c", "c", True)]
    assert sorted(map(tuple, one_of_each(frame).collect())) == [("a", "One two three four five six", 3, 4), ("c", "", 5, 6), ("c", "", 5, 6)]
