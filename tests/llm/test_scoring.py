"""Scores against brute-force counts, normalisation, and held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from stakewise.llm import scoring
from stakewise.llm.scoring import SHARED, Model, Vocabulary, joined_paths, own_words, score_documents, suffix, trained


def words(text):
    return (text or "").encode().lower().split()


def base(docs):
    taught = [zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in docs]
    counts = Counter()
    for (_, t), yes in zip(docs, taught, strict=True):
        if yes:
            counts.update([*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for (d, t), yes in zip(docs, taught, strict=True):
        own = [*words(t), b""]
        out[d] = (not yes, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    return out


def texts(rng, n):
    languages = [[f"{c}{i}{c}" for i in range(60)] for c in "abc"]
    docs = [(d, " ".join(rng.choice(languages[d % 3]) for _ in range(rng.randrange(5, 60)))) for d in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "NEVER seen\tbefore never"), (n + 3, "A0A " * 400)]


def scored(spark, docs):
    rows = score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_base_matches_brute_force_and_held_out_texts_gain(spark, monkeypatch):
    docs = texts(random.Random(3), 300)
    want = base(docs)
    for lexicon in (50, 200_000):
        monkeypatch.setattr(scoring, "LEXICON", lexicon)
        got = scored(spark, docs)
        assert len(got) == len(docs)
        for d, (held, n, known, total, score) in want.items():
            r = got[d]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert abs(r.base_score - score) < 1e-6 and r.score < 0
        held = [r for r in got.values() if r.held_out and r.n_tokens > 3]
        if lexicon > 50:
            assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)


def vocabulary(docs):
    counts = Counter()
    for _, t in docs:
        counts.update([*words(t), b""])
    shared = np.zeros((SHARED, 2))
    for w, n in counts.items():
        if w:
            shared[suffix(w)] += n, 1
    return counts, Vocabulary(list(counts), list(counts.values()), shared, sum(counts.values()))


def test_units_of_words_and_masses_of_shared_units(spark):
    docs = [(1, "common common common rare"), (2, "common odd")]
    counts, v = vocabulary(docs)
    at, own = v.found([b"rare", b"common", b"new", b""])
    assert at[2] == -1 and own[2] == v.of_suffix[suffix(b"new")] and own[0] == v.of_suffix[suffix(b"rare")]
    assert own[3] == v.end and not v.is_shared[own[1]] and len({*own.tolist()}) == 4
    for s in range(SHARED):
        alike = [n for w, n in counts.items() if w and w != b"common" and suffix(w) == s]
        assert abs(10 ** v.share[v.of_suffix[s]] - sum(n + 1 for n in alike) - 1) < 1e-9
    assert v.frequency.tolist() == sorted(v.frequency, reverse=True)


def test_probabilities_are_normalised_and_equal_plain_loops(spark):
    rng = np.random.default_rng(2)
    model = Model(np.sort(rng.integers(1, 500, 23))[::-1].astype(float), 3, rank=5)
    for table in model.tables:
        values = getattr(model, table)
        values += rng.normal(0, 0.5, values.shape).astype(np.float32)
    path = rng.integers(0, 23, 40)
    units, places = joined_paths([path, path[:0]], 7, 3)
    assert [*units] == [7, 7, 7, *path, 7, 7, 7, 7, 7] and [*places] == [*range(3, 44), 47]
    got = model.log_probabilities(units, places)
    for place, value in zip(places, got, strict=True):
        h = sum(model.context[units[place - k]].astype(float) * model.weight[k - 1] for k in (1, 2, 3))
        kinds = np.exp(model.kind[:, :-1].astype(float) @ h + model.kind[:, -1])
        every = []
        for k in range(len(kinds)):
            rows = model.unit[model.rows_of(k)].astype(float)
            inside = np.exp(rows[:, :-1] @ h + rows[:, -1])
            every += (kinds[k] / kinds.sum() * inside / inside.sum()).tolist()
        assert abs(sum(every) - 1) < 1e-9 and len(every) == 23
        assert abs(math.log(every[units[place]]) - value) < 1e-4


def test_scores_equal_a_plain_sum_over_words(spark):
    docs = texts(random.Random(8), 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    taught = [x for x in docs if zlib.crc32(str(x[0]).encode()) % 7 != 2]
    counts, v = vocabulary(taught)
    kept = [x[0] for x in taught]
    model = trained(frame.filter(frame.doc_id.isin(kept)), v, sum(counts.values()))
    for d, r in scored(spark, docs).items():
        own = words(dict(docs)[d])
        units, places = joined_paths([v.found(own)[1]], v.end, len(model.weight))
        want = model.log_probabilities(units, places).sum() / math.log(10)
        for w in own:
            u = v.found([w])[1][0]
            want += (math.log10(counts[w] + 1) - v.share[u]) if v.is_shared[u] else 0
        assert abs(want - r.score) < 0.02 * abs(want) + 0.5


def test_what_is_learned_grows_with_the_corpus(spark):
    assert [own_words(n) for n in (0, 10**6, 10**8, 10**10)] == [0, 1004, 6339, 40000]


def test_ids_of_any_kind_and_repeats(spark):
    big = 2**53 + 1
    frame = spark.createDataFrame([(None, "a b"), (big, "a b"), (big, "c"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in score_documents(frame).collect()) == sorted([("None", 3), (str(big), 3), (str(big), 2), ("None", 1)])
    assert {r.doc_id for r in score_documents(frame.selectExpr("concat('d', doc_id) AS doc_id", "text")).collect()} == {None, f"d{big}"}


def test_nothing_to_learn_from(spark):
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    got = scored(spark, [(d, "a b c") for d in held])
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got.values())
    assert scored(spark, []) == {}


def test_texts_are_looked_up_once_and_learned_in_their_order(spark, monkeypatch):
    docs = texts(random.Random(5), 40)
    counts, v = vocabulary(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(scoring, "LEXICON", 50)
    rows = scoring.encoded(frame.select("doc_id", "text"), v).collect()
    for (d, t), r in zip(docs, rows, strict=True):
        assert r.doc_id == d and np.frombuffer(r.units, v.kind).tolist() == v.found(words(t))[1].tolist()
    monkeypatch.setattr(scoring, "byte_words", None)
    written = spark.createDataFrame([(r.uid, r.units, r.uid % 2) for r in rows], "uid long, units binary, part int")
    one, two = (scoring.learned(x.coalesce(1), v, sum(counts.values())) for x in (written, written.orderBy("units")))
    assert all(np.array_equal(getattr(one, t), getattr(two, t)) for t in one.tables)


def test_sums_of_runs_in_single_precision():
    rng = np.random.default_rng(6)
    values = np.sort(rng.integers(0, 40, 300))
    for width in (5, 6):
        rows = rng.normal(size=(300, width)).astype(np.float32)
        index, sums = scoring.run_sums(values, rows)
        assert index.tolist() == sorted(set(values.tolist())) and sums.dtype == np.float32
        assert np.allclose(sums, [rows[values == i].sum(0) for i in index], atol=1e-5)
