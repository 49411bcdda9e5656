"""Toxicity of texts by two Kneser-Ney models, one of toxic and one of ordinary documents.

The models spell words: the chance of a letter follows from up to ``ORDER`` - 1 letters before it in the word, so stems
with any ending are recognised. A class discounts its own counts and hands what it saves, and ``STRENGTH`` more, to the
Kneser-Ney model of both classes together. So an expression that a class hardly knows is scored alike by both.

A text's words (once each, so repeated lines weigh nothing) have log-likelihoods under both models. Their differences
are compared by length: the mean over the words, and the means of what passes 1, 3 and 5 nats. Logistic weights for these
means are learnt on labelled documents that the models haven't seen.

Counts come from a sample of labelled texts bounded in bytes a class (``SAMPLE_BYTES``) and in rows for the weights
(``WEIGHT_ROWS``); every text is scored whole. Model tables are built on Spark and are bounded by the sample.

A null text is scored as an empty one, by the intercept. Rows that repeat an id are scored each; an id labelled both
ways teaches nothing, one that repeats its label counts once for each of its texts. Null labels and labels other than 0
and 1 are left out. Without labelled documents of both classes every score is (toxic + 1) / (labelled + 2).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakewise.llm.common import bounded_batches, stored
from stakewise.llm.words import mixed

#: Letters of a gram, the predicted one included.
ORDER = 6
DISCOUNT = 0.75
#: What a class adds to the weight of the shared model, in observations.
STRENGTH = 20.0
#: Nats a word's log-ratio has to pass to count in one of the means.
PASSED = (1.0, 3.0, 5.0)
#: Bytes of labelled texts that each class's counts are taken from at most.
SAMPLE_BYTES = 64_000_000
#: Labelled documents that the logistic weights are learnt from at most.
WEIGHT_ROWS = 50_000
#: Parts of the labelled texts, by hash; one in four serves the weights.
BUCKETS = 4096
#: Words whose log-ratio a worker remembers; the memory is emptied when full.
CACHED_WORDS = 400_000
#: Words spelled together.
SPELLED = 50_000
STOPS = ".,;:!?\"'()[]"


def words_of(text: str | None) -> list[str]:
    """The distinct words of a text in their order, lower-cased and without the stops around them."""
    return list(dict.fromkeys(w.strip(STOPS) or w for w in (text or "").lower().split()))


def taught(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """(text, toxic, bucket) of the labelled documents; equal texts share a bucket."""
    clear = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("toxic"), F.max(label).alias("most")).filter("toxic = most")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.join(clear.drop("most"), "id").select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def chosen_buckets(rows: DataFrame, sample_bytes: int, weight_rows: int) -> tuple[dict[int, list[int]], list[int]]:
    """Buckets whose texts are counted, by class, and buckets whose rows teach the weights, within the bounds."""
    sizes = rows.groupBy("toxic", "bucket").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).toPandas().sort_values("bucket")
    fits = sizes[sizes["bucket"] % 4 > 0]
    counted = {}
    for c in (0, 1):
        own = fits[fits["toxic"] == c]
        counted[c] = own["bucket"][within(own["bytes"].to_numpy(), sample_bytes)].tolist()
    weights = sizes[sizes["bucket"] % 4 == 0].groupby("bucket")["n"].sum()
    return counted, weights.index[within(weights.to_numpy(), weight_rows)].tolist()


def within(sizes: np.ndarray, most: int) -> np.ndarray:
    """Which of ``sizes`` are taken in order: each that still fits beside those taken before it."""
    taken, held = np.zeros(len(sizes), bool), 0
    for i, size in enumerate(sizes):
        if held + size <= most:
            taken[i], held = True, held + size
    return taken


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n0, n1): in how many ordinary and toxic texts a word occurs; texts are reduced batch by batch."""

    def counted(batches):
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                seen[toxic].update(words_of(text))
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"word": words, "n0": [seen[0][w] for w in words], "n1": [seen[1][w] for w in words]}, pa.schema({"word": pa.string(), "n0": pa.int64(), "n1": pa.int64()}))

    found = rows.select("text", "toxic").mapInArrow(counted, "word string, n0 long, n1 long")
    return found.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def before(gram: str = "gram") -> Column:
    """A gram without its last letter."""
    return F.expr(f"left({gram}, char_length({gram}) - 1)")


def behind(gram: str = "gram") -> Column:
    """A gram without its first letter."""
    return F.expr(f"substring({gram}, 2)")


def shared_chances(full: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(gram, p) of the Kneser-Ney model of both classes for the grams of ``full`` (gram, f).

    A shorter gram counts in how many grams of one letter more it ends. Nothing comes before a word's start, so short
    grams there have their plain counts, which back off like those of whole grams.
    """
    ends = full.select(F.explode(F.expr("transform(sequence(1, char_length(gram)), i -> substring(gram, i))")).alias("gram")).distinct()
    kinds = stored(ends.filter(F.char_length("gram") > 1).groupBy(behind().alias("gram")).agg(F.count("*").alias("c")), "grams")
    letters = kinds.filter(F.char_length("gram") == 1).count()
    low = lower = None
    for length in range(1, order):
        low = stored(smoothed(kinds.filter(F.char_length("gram") == length), "c", low, letters, discount), "chances")
        lower = low if lower is None else lower.union(low)
    return smoothed(full, "f", lower, letters, discount)


def smoothed(table: DataFrame, count: str, low: DataFrame | None, letters: int, discount: float) -> DataFrame:
    """(gram, p): discounted counts of a gram after its context, and what is saved given out by ``low``, the chances of
    grams one letter shorter; without it, evenly."""
    context = table.groupBy(before().alias("context")).agg(F.sum(count).alias("total"), F.count("*").alias("types"))
    met = table.withColumn("context", before()).join(context, "context")
    even = F.lit(1.0 / (letters + 1))
    if low is None:
        met = met.withColumn("q", even)
    else:
        met = met.join(low.select(F.col("gram").alias("end"), F.col("p").alias("q")), behind() == F.col("end"), "left").withColumn("q", F.coalesce("q", even))
    return met.select("gram", ((F.greatest(F.col(count) - discount, F.lit(0.0)) + discount * F.col("types") * F.col("q")) / F.col("total")).alias("p"))


def log_ratios(counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT, strength: float = STRENGTH) -> tuple[DataFrame, DataFrame]:
    """From (word, n0, n1): (gram, ratio), the log of its last letter's chance in toxic over that in ordinary words; and
    (gram, ratio) of contexts, for letters that never followed them. What neither has is a ratio of 0."""
    spelt = counts.select(F.concat(F.lit("\x02"), "word", F.lit("\x03")).alias("s"), "n0", "n1")
    places = spelt.select("n0", "n1", F.explode(F.expr(f"transform(sequence(2, char_length(s)), i -> substring(s, greatest(1, i - {order - 1}), least(i, {order})))")).alias("gram"))
    full = stored(places.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).withColumn("f", F.col("n0") + F.col("n1")), "full")
    shared = shared_chances(full.select("gram", "f"), order, discount)
    types = [F.count(F.when(F.col(n) > 0, 1)).alias(f"types{n}") for n in ("n0", "n1")]
    contexts = full.groupBy(before().alias("context")).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), *types)

    def saved(c: str) -> Column:
        return strength + discount * F.col(f"typesn{c}")

    def chance(c: str) -> Column:
        return (F.greatest(F.col(f"n{c}") - discount, F.lit(0.0)) + saved(c) * F.col("p")) / (F.col(f"t{c}") + strength)

    met = full.withColumn("context", before()).join(contexts, "context").join(shared, "gram")
    unseen = contexts.select(F.col("context").alias("gram"), (F.log(saved("1") / (F.col("t1") + strength)) - F.log(saved("0") / (F.col("t0") + strength))).alias("ratio"))
    return met.select("gram", (F.log(chance("1")) - F.log(chance("0"))).alias("ratio")), unseen


def gram_hashes(codes: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """A hash of the last ``width`` letters at each place, or of all since the word's start at place 0."""
    out = mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(1, width):
        longer = place >= k
        out[longer] = mixed(out[longer] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[np.flatnonzero(longer) - k].astype(np.uint64))
    return out


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of words one after the other, their places in their words, and each word's first place."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes), starts


def hashed_table(table: DataFrame, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the grams of a table and their ratios: 12 bytes a gram, bounded by the sample."""

    def hashes(batches):
        for batch in batches:
            grams = batch["gram"].to_pylist()
            full = [g for g in grams if g]
            codes, place, starts = spelled(full)
            ends = np.append(starts[1:], len(codes)) - 1 if full else starts
            found = gram_hashes(codes, place, order)[ends].view(np.int64)
            keep = [bool(g) for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(found), batch["ratio"].filter(pa.array(keep, pa.bool_())).cast(pa.float32())], names=["h", "ratio"])

    got = table.mapInArrow(hashes, "h long, ratio float").toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(h)
    return h[at], got["ratio"].to_numpy(np.float32)[at]


def looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``keys`` in a sorted table, and which were found."""
    hashes, values = table
    if not len(hashes):
        return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return values[at], hashes[at] == keys


def word_ratios(words: list[str], grams, contexts, order: int = ORDER) -> np.ndarray:
    """Log-ratio of each word, its letters' and its end's summed."""
    codes, place, starts = spelled([f"\x02{w}\x03" for w in words])
    here, known = looked_up(gram_hashes(codes, place, order), grams)
    back, met = looked_up(np.roll(gram_hashes(codes, place, order - 1), 1), contexts)
    value = np.where(known, here, np.where(met, back, 0)).astype(float)
    value[place == 0] = 0
    return np.add.reduceat(value, starts)


def text_means(rows: DataFrame, model, text: str = "text") -> DataFrame:
    """``rows`` with ``means``: of the log-ratios of a text's words and of what of them passes each of ``PASSED``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def means(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, contexts = sent.value
        known: dict[str, float] = {}
        for texts in parts:
            sets = [words_of(t) for t in texts]
            if len(known) > CACHED_WORDS:
                known.clear()
            new = list({w for words in sets for w in words if w not in known})
            for at in range(0, len(new), SPELLED):
                known.update(zip(new[at : at + SPELLED], word_ratios(new[at : at + SPELLED], grams, contexts).tolist(), strict=True))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            values = np.fromiter(map(known.__getitem__, chain.from_iterable(sets)), float, sizes.sum())
            out, some = np.zeros((len(sets), 1 + len(PASSED))), sizes > 0
            if some.any():
                starts = (np.cumsum(sizes) - sizes)[some]
                for i, part in enumerate([values, *[np.maximum(values - t, 0) for t in PASSED]]):
                    out[some, i] = np.add.reduceat(part, starts) / sizes[some]
            yield pd.Series(list(out))

    return rows.withColumn("means", means(F.col(text)))


def terms(means: np.ndarray) -> np.ndarray:
    """Means as inputs of the logistic function: passed ratios by their roots."""
    return np.concatenate([np.clip(means[:, :1], -5, 5), np.sqrt(means[:, 1:])], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercept and weights for standardised inputs, with their centres and scales, by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - centre) / scale], 1)
    penalty = ridge * np.diag([1e-6] + [1.0] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-10:
            break
    return beta, centre, scale


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", taught_if: Column | None = None, sample_bytes: int = SAMPLE_BYTES, weight_rows: int = WEIGHT_ROWS) -> DataFrame:
    """(id, score) of every row of ``docs``: the chance that ``label`` is 1. Only rows that meet ``taught_if``, a condition
    on the id, are learnt from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs if taught_if is None else docs.filter(taught_if)
    rows = stored(taught(known, labels, id_col, text, label), "taught")
    counted, weighted = chosen_buckets(rows, sample_bytes, weight_rows)
    n = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in n}
    rate = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    if not (counted[0] and counted[1] and weighted):
        return named.select("id", F.lit(float(rate)).alias("score"))
    sample = rows.filter((F.col("toxic") == 0) & F.col("bucket").isin(counted[0]) | (F.col("toxic") == 1) & F.col("bucket").isin(counted[1]))
    grams, contexts = log_ratios(word_counts(sample))
    model = hashed_table(grams), hashed_table(contexts, ORDER - 1)
    held = text_means(rows.filter(F.col("bucket").isin(weighted)), model).select("means", "toxic").toPandas()
    if held["toxic"].nunique() < 2:
        return named.select("id", F.lit(float(rate)).alias("score"))
    beta, centre, scale = logistic(terms(np.stack(held["means"].to_numpy())), held["toxic"].to_numpy(float))
    weight = beta[1:] / scale
    m = F.col("means")
    inputs = [F.greatest(F.least(m[0], F.lit(5.0)), F.lit(-5.0)), *[F.sqrt(m[i + 1]) for i in range(len(PASSED))]]
    linear = F.lit(float(beta[0] - weight @ centre))
    for x, w in zip(inputs, weight, strict=True):
        linear = linear + x * float(w)
    return text_means(named, model).select("id", (1 / (1 + F.exp(-linear))).alias("score"))
