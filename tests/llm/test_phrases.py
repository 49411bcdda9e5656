"""Phrases against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from stakewise.llm.phrases import Bitmap, collocations, grown, slabs, tokens

SCHEMA = "doc_id long, text string, lang string, n long, `group` string"


def counted(rows, least, top):
    """The contract, word for word."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang or "und", text or ""
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for size in range(1, 6):
                    if i + size <= len(words):
                        f[lang, tuple(words[i : i + size])] += 1
    frequent = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    out = []
    for (lang, phrase), a in frequent.items():
        inside = lambda big: any(big[i : i + len(phrase)] == phrase for i in range(len(big) - len(phrase) + 1))
        if any(g == lang and len(big) > len(phrase) and c >= a and inside(big) for (g, big), c in frequent.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(phrase).encode(), f[lang, phrase[:k]], f[lang, phrase[k:]], n[lang]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r, total in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, total, -score))
    return ranked


def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["of", "the", "New", "YORK", "city", "é", "red", "car", "x2", " z"]
    rows = []
    for i in range(120):
        words = list(rng.choice(vocabulary, rng.integers(0, 40), p=[0.2, 0.2, 0.1, 0.1, 0.05, 0.1, 0.1, 0.05, 0.05, 0.05]))
        if i % 3 == 0:
            words += ["new", "york", "city", "hall", "steps"]
        stops = rng.choice([" ", " ", " ", ", ", ". ", "\n", "\t", "; "], len(words))
        rows.append(("".join(w + s for w, s in zip(words, stops, strict=True)), ["en", "fr", None][i % 3 if i % 2 else 0]))
    rows += [(None, "en"), ("", "en"), ("...", None), ("of the of the of the of the of the " * 30, "en")] + [("a b c d e f", "en")] * 12
    return rows


@pytest.mark.parametrize(("least", "top", "prefix_rows"), [(8, 2000, 500_000), (3, 25, 3), (2, 2000, 1)])
def test_phrases_equal_plain_counts(spark, least, top, prefix_rows):
    rows = texts()
    docs = spark.createDataFrame([(i, t, g, 7, "x") for i, (t, g) in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in collocations(docs, least=least, top=top, prefix_rows=prefix_rows).collect()]
    assert sorted(got) == sorted(counted(rows, least, top))


def test_no_texts_and_no_frequent_words(spark):
    docs = spark.createDataFrame([Row(1, "a b c", "en", 1, "x")], SCHEMA)
    assert collocations(docs).count() == 0
    assert collocations(docs.filter("doc_id > 5")).count() == 0


def test_long_texts_are_cut_at_stops_only(monkeypatch):
    import stakewise.llm.phrases as module

    monkeypatch.setattr(module, "SLAB", 40)
    text = ("one two three. four five! six seven eight nine ten eleven\n" * 20).encode()
    parts = slabs([text, None, b"Ab c", text])
    assert len(parts) > 5
    words = [w for p in parts for w in [*tokens(p), b"."]]
    plain = tokens(text.translate(module.CLEAN)) + [b"."] + [b"ab", b"c", b"."] + tokens(text.translate(module.CLEAN))
    assert Counter(w for w in words if w != b".") == Counter(w for w in plain if w != b".")

    def runs(found):
        return Counter(piece.strip() for piece in b" ".join(found).split(b".") if piece.strip())

    assert runs(words) == runs(plain)


def test_bitmap_holds_its_hashes(spark):
    from pyspark.sql import functions as F

    table = spark.range(5000).select(F.xxhash64("id").alias("h"))
    held = Bitmap(table, F.col("h"))
    h = np.array([r.h for r in table.collect()], np.int64).view(np.uint64)
    assert held.has(h).all()
    other = np.array([r.h for r in spark.range(5000, 10000).select(F.xxhash64("id").alias("h")).collect()], np.int64).view(np.uint64)
    assert held.has(other).mean() < 0.1


def test_growth_is_depth_first():
    rows = np.array([[1, 1, 2, 2, 3], [1, 1, 2, 2, 4], [1, 1, 2, 5, 0], [1, 1, 6, 0, 0]], np.int64)
    out = []
    grown(list(rows.T), np.array([2, 3, 4, 1]), 0, 4, 2, 3, out)
    assert out == [(0, 3, 9), (0, 4, 5), (1, 5, 3), (2, 4, 4)]
