"""Packings are whole, gapless, within capacity and nearly as short as the tokens allow."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stakewise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, docs, capacity):
    pieces = packing.pack_documents(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, bin long").repartition(3), PATH, capacity).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, i, at, len(p := ids[at : at + capacity]), zlib.crc32(p.tobytes())) for i, at in enumerate(range(0, len(ids), capacity))]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, pieces[columns].to_numpy().tolist())) == sorted(want)
    for _, bin_ in pieces.sort_values("offset").groupby("sequence_id"):
        ends = bin_["offset"].to_numpy() + bin_["length"].to_numpy()
        assert bin_["offset"].iloc[0] == 0 and ends[-1] <= capacity and (bin_["offset"].to_numpy()[1:] == ends[:-1]).all()
    return pieces["sequence_id"].nunique(), -(-int(pieces["length"].sum()) // capacity) if len(pieces) else 0


def texts(n):
    rng = random.Random(2)
    out = [(d, " ".join(rng.choice(("the", "Straße", "don't", "x9,", "été.")) for _ in range(rng.choice((1, 3, 10, 40, 90))))) for d in range(n)]
    return [*out, (n, None), (n + 1, ""), (n + 2, "word " * 1000), (n + 3, "a" * 3000), (n + 4, "\n\t tab\r\n'")]


def test_packing_is_whole_and_tight(spark):
    made, least = check(spark, texts(400), 128)
    assert made <= least * 1.03 + 1


def test_rounds_merge_across_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 5)
    made, least = check(spark, texts(150), 64)
    assert made <= least * 1.15 + 1


def test_best_fit_and_empty_table(spark):
    lengths = np.array([5, 5, 4, 3, 3])
    bins, places, fill = packing.best_fit(lengths, 10)
    assert sorted(fill) == [10, 10] and pd.Series(lengths).groupby(bins).sum().max() == 10 and places.min() == 0
    assert check(spark, [], 64) == (0, 0)


def test_ids_of_any_kind(spark):
    big = 2**53 + 1
    frame = spark.createDataFrame([(None, "one"), (big, "two"), (big, "three three"), (big + 1, None)], "doc_id long, text string").coalesce(1)
    assert sorted(str(r.doc_id) for r in packing.pack_documents(frame, PATH, 8).collect()) == sorted([str(big)] * 2 + [str(big + 1), "None"])
    named = packing.pack_documents(frame.select(F.concat(F.lit("d"), F.coalesce("doc_id", F.lit(0))).alias("doc_id"), "text"), PATH, 8)
    assert named.count() == 4 and named.filter(f"doc_id = 'd{big}'").count() == 2
