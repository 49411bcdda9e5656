"""Phrases of words that keep company, by contiguous pattern growth.

A text is cut into pieces at stops and line ends and pieces into words. For each group of texts (a language), runs of 2 to
``LONGEST`` words that occur ``least`` times and more are candidates, found as in PrefixSpan: the occurrences of a frequent
pair are its projected table, rows of pointers to the words behind it; a task takes one prefix after the other, and grows
each to the right, depth first, by narrowing its range of sorted rows.

Three passes over the texts, each handing on sums only. The first counts words; the second counts pairs of frequent words
by 32 bits of their hash, which leaves most infrequent pairs out; the third counts the pairs left, and gives where such
pairs follow one another the run of up to ``LONGEST`` words, adding equal runs up. Frequent words and pairs reach the tasks
as a bitmap of at most ``MOST_BITS`` bits; where it or the 32 bits err, they let an infrequent pair pass, whose own count
decides later. A prefix with more than ``PREFIX_ROWS`` different runs is dealt by its
third word, then by its fourth, so a task's rows are bounded, and a full run is one row.

Words go by 64-bit hashes of group and word; the chance that any two of 10 million frequent words share one is 3 in a
million. Counts are exact.

A null text is empty, a null group has the name ``NO_GROUP``. Rows that repeat count each. Ties go by phrase in the order
of its UTF-8 bytes. Without texts, or without frequent words, there are no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakewise.llm.common import bounded_batches, stored
from stakewise.llm.words import mixed, word_hashes

LONGEST = 5
LEAST = 100
TOP = 2000
NO_GROUP = "und"
#: Bits of a bitmap at most (16 MB), and bits for each hash that it holds.
MOST_BITS = 1 << 27
BITS_EACH = 32
#: Different runs of one prefix that a task takes.
PREFIX_ROWS = 500_000
#: Bytes of text handled at once, where they have a stop to be cut at.
SLAB = 2_000_000
RUN = [f"w{i}" for i in range(1, LONGEST + 1)]

#: Bytes that end a piece, and what separates words, as the byte values of ".,;:!?", of line feed to carriage return, and of space and tab.
STOPS = b".,;:!?\n\x0b\x0c\r"
CLEAN = bytes.maketrans(STOPS + b"\t", b"." * len(STOPS) + b" ")


def slabs(texts: list[bytes | None]) -> list[bytes]:
    """Texts lower-cased (A-Z), with every stop a full stop, joined or cut at stops to pieces of some ``SLAB`` bytes."""
    out, held, size = [], [], 0
    for text in texts:
        data = (text or b"").lower().translate(CLEAN)
        at = 0
        while len(data) - at > SLAB and (end := data.find(b".", at + SLAB)) >= 0:
            out.append(data[at:end])
            at = end
        held.append(data[at:])
        size += len(data) - at
        if size > SLAB:
            out.append(b".".join(held))
            held, size = [], 0
    return [*out, b".".join(held)]


def tokens(slab: bytes) -> list[bytes]:
    """The words of a slab in order, with b"." between pieces."""
    return slab.replace(b".", b" . ").split()


def by_group(batch: pa.RecordBatch):
    """(group, tokens) of the slabs of a batch of (group, text)."""
    rows = sorted(zip(batch["group"].to_pylist(), batch["text"].to_pylist(), strict=True), key=lambda r: r[0])
    for group, part in groupby(rows, key=lambda r: r[0]):
        for slab in slabs([t for _, t in part]):
            yield group, tokens(slab)


def keyed(group: str, hashes: np.ndarray) -> np.ndarray:
    """Hashes of words within a group; never 0, which stands for no word."""
    out = mixed(hashes ^ word_hashes([b"\x00" + group.encode("utf-8", "surrogatepass")])[0])
    return np.where(out == 0, np.uint64(1), out)


def word_keys(group: str, words: list[bytes]) -> np.ndarray:
    """Keys of tokens in order, 0 at stops."""
    out = keyed(group, word_hashes(words))
    if words:
        out[np.array([w == b"." for w in words])] = 0
    return out


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a) * np.uint64(0x9E3779B97F4A7C15) + b)


def word_counts(rows: DataFrame) -> DataFrame:
    """(group, word, h, n) of all words, summed by batch before they are shuffled."""

    def counted(batches):
        for batch in batches:
            sums: dict[str, Counter] = {}
            for group, words in by_group(batch):
                sums.setdefault(group, Counter()).update(words)
            for group, found in sums.items():
                found.pop(b".", None)
                words = list(found)
                h = keyed(group, word_hashes(words)).view(np.int64)
                text = pa.array(words, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(words), pa.string()), text, pa.array(h), pa.array(list(found.values()), pa.int64())], names=["group", "word", "h", "n"])

    found = rows.mapInArrow(counted, "group string, word string, h long, n long")
    return found.groupBy("group", "word", "h").agg(F.sum("n").alias("n"))


class Bitmap:
    """Which hashes may be among those of a table; built on Spark as words of 64 bits, of which at most 2^21 come here."""

    def __init__(self, table: DataFrame, h: Column):
        n = table.count()
        self.bits = min(MOST_BITS, max(1 << 12, 1 << int(np.ceil(np.log2(max(1, n) * BITS_EACH)))))
        place = h.bitwiseAND(F.lit(self.bits - 1))
        at = F.shiftright(place, 6)
        words = table.groupBy(at.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("word"))
        got = words.toPandas()
        self.words = np.zeros(self.bits >> 6, np.uint64)
        self.words[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64).view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(self.bits - 1)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def summed(keys: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Rows with equal ``keys`` as one, with their number n."""
    _, at, n = np.unique(keys, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([*(pa.array(c[at].view(np.int64)) for c in columns), pa.array(n.astype(np.int64))], names=[*names, "n"])


def pair_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of words by 32 bits of their hash: enough to leave most infrequent ones out."""
    return pair_hash(a, b) >> np.uint64(32)


def frequent_places(rows: DataFrame, words: Bitmap, least: int) -> DataFrame:
    """(p): the places of pairs that may be frequent, as all pairs of a place together are."""
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def counted(batches):
        for batch in batches:
            for group, found in by_group(batch):
                h = word_keys(group, found)
                fine = (h != 0) & sent.value.has(h)
                at = np.flatnonzero(fine[:-1] & fine[1:])
                p, n = np.unique(pair_places(h[at], h[at + 1]).astype(np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int32)), pa.array(n.astype(np.int64))], names=["p", "n"])

    found = rows.mapInArrow(counted, "p int, n long")
    return found.groupBy("p").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("p")


def runs(rows: DataFrame, places: Bitmap) -> DataFrame:
    """(w1 .. w5, n): pairs that may be frequent, with w3 = 0, and apart from them what follows each at which another one
    follows; 0 where a run has ended. Equal rows are one, so the pairs' numbers are their exact counts."""
    sent = rows.sparkSession.sparkContext.broadcast(places)

    def found(batches):
        for batch in batches:
            for group, words in by_group(batch):
                h = word_keys(group, words)
                if len(h) < 2:
                    continue
                good = np.zeros(len(h) + LONGEST, bool)
                good[: len(h) - 1] = (h[:-1] != 0) & (h[1:] != 0) & sent.value.has(pair_places(h[:-1], h[1:]))
                at = np.flatnonzero(good)
                a, b = h[at], h[at + 1]
                none = np.zeros(len(at), np.uint64)
                yield summed(pair_hash(a, b), [a, b, none, none, none], RUN)
                at = np.flatnonzero(good[:-1] & good[1:])
                h = np.append(h, np.zeros(LONGEST, np.uint64))
                columns, alive = [h[at], h[at + 1]], np.ones(len(at), bool)
                for k in range(2, LONGEST):
                    alive = alive & good[at + k - 1]
                    columns.append(np.where(alive, h[at + k], np.uint64(0)))
                key = columns[0]
                for c in columns[1:]:
                    key = pair_hash(key, c)
                yield summed(key, columns, RUN)

    made = rows.mapInArrow(found, ", ".join(f"{c} long" for c in RUN) + ", n long")
    return made.groupBy(*RUN).agg(F.sum("n").alias("n"))


def dealt(table: DataFrame, prefix_rows: int) -> DataFrame:
    """``table`` with ``unit``, the hash of the prefix by which rows are dealt: the pair, or as many words more as it takes
    for a unit to have at most ``prefix_rows`` rows; ``depth`` is their number."""
    out = table.withColumn("unit", F.xxhash64("w1", "w2")).withColumn("depth", F.lit(2))
    for depth in range(3, LONGEST):
        large = out.groupBy("unit").count().filter(F.col("count") > prefix_rows).select("unit", F.lit(True).alias("large"))
        if not large.limit(1).count():
            break
        more = F.coalesce("large", F.lit(False))
        out = out.join(large, "unit", "left").withColumns({"unit": F.when(more, F.xxhash64(*RUN[:depth])).otherwise(F.col("unit")), "depth": F.when(more, depth).otherwise(F.col("depth"))}).drop("large")
    return out


def grown(columns: list[np.ndarray], n: np.ndarray, low: int, high: int, depth: int, least: int, out: list[tuple[int, int, int]]) -> None:
    """Depth-first growth of the prefix of ``depth`` words that the sorted rows ``low`` to ``high`` share: each next word whose
    rows count ``least`` and more gives a phrase (first row, words, count), which grows on."""
    if depth == len(columns):
        return
    column = columns[depth][low:high]
    cuts = low + np.append(0, np.flatnonzero(column[1:] != column[:-1]) + 1)
    sums = np.add.reduceat(n[low:high], cuts - low)
    ends = np.append(cuts[1:], high)
    for i in np.flatnonzero((sums >= least) & (columns[depth][cuts] != 0)):
        out.append((int(cuts[i]), depth + 1, int(sums[i])))
        grown(columns, n, int(cuts[i]), int(ends[i]), depth + 1, least, out)


def longer_phrases(table: DataFrame, least: int, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(words array<long>, a): phrases of three words and more that occur ``least`` times, from summed runs."""

    def grow(batches):
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not len(held):
                continue
            unit = held["unit"].to_numpy()
            # the last unit may go on in the next batch
            ready = len(held) if batch is None else int(np.searchsorted(unit, unit[-1], "left"))
            part, held = held.slice(0, ready), held.slice(ready)
            if len(part):
                yield _grown_units(part, least)

    rows = dealt(table, prefix_rows)
    found = rows.repartition(F.col("unit")).sortWithinPartitions("unit", *RUN).mapInArrow(grow, "words array<long>, a long")
    for depth in range(4, LONGEST):
        # no task sees all of a prefix whose rows were dealt by the word behind it
        shared = rows.filter(F.col("depth") >= depth).groupBy(*RUN[: depth - 1]).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        found = found.union(shared.select(F.array(*RUN[: depth - 1]).alias("words"), "a"))
    return found


def _grown_units(part: pa.Table, least: int) -> pa.RecordBatch:
    columns = [part[c].to_numpy() for c in RUN]
    n, unit, depths = part["n"].to_numpy(), part["unit"].to_numpy(), part["depth"].to_numpy()
    change = unit[1:] != unit[:-1]
    for k, c in enumerate(columns[:-1]):
        change |= (c[1:] != c[:-1]) & (depths[1:] > k)
    starts = np.append(0, np.flatnonzero(change) + 1)
    sums, ends = np.add.reduceat(n, starts), np.append(starts[1:], len(unit))
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(sums >= least):
        low, high, depth = int(starts[i]), int(ends[i]), int(depths[starts[i]])
        if depth > 2 and columns[depth - 1][low] != 0:
            out.append((low, depth, int(sums[i])))
        grown(columns, n, low, high, depth, least, out)
    words = [[int(columns[k][row]) for k in range(size)] for row, size, _ in out]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int64())), pa.array([a for *_, a in out], pa.int64())], names=["words", "a"])


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, top: int = TOP, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): the ``top`` phrases of each group.

    a is the phrase's count, n the group's number of words. A cut after k words gives l and r, the counts of both parts, and
    the score floor(1000 * a * n / (l * r)); the lowest-scoring cut counts, the first of equal ones. A candidate that lies
    in a longer one of the same count goes. Products are decimals of 38 digits: exact up to some 10^17 words.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(NO_GROUP)).alias("group"), F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL")
    words = stored(word_counts(rows), "words")
    sizes = words.groupBy("group").agg(F.sum("n").alias("total"))
    frequent = stored(words.filter(F.col("n") >= least), "frequent")
    places = stored(frequent_places(rows, Bitmap(frequent, F.col("h")), least), "pairs")
    whole = stored(runs(rows, Bitmap(places, F.col("p").cast("long"))), "runs")
    longer = longer_phrases(whole.filter("w3 <> 0"), least, prefix_rows)
    pairs = whole.filter((F.col("w3") == 0) & (F.col("n") >= least))
    phrases = stored(pairs.select(F.array("w1", "w2").alias("words"), F.col("n").alias("a")).union(longer), "phrases")
    counts = frequent.select(F.array("h").alias("words"), F.col("n").alias("a")).union(phrases)
    # a candidate within one of a word more, of the same count, lies in it wherever it occurs
    inner = phrases.filter(F.size("words") > 2)
    size = F.size("words")
    covered = inner.select(F.slice("words", 1, size - 1).alias("words"), "a").union(inner.select(F.slice("words", 2, size - 1).alias("words"), "a")).distinct()
    left = phrases.join(covered, ["words", "a"], "left_anti")
    named = left.join(frequent.select("group", F.col("h").alias("first")), F.col("words")[0] == F.col("first")).drop("first").join(sizes, "group")
    return ranked_phrases(scored(named, counts), frequent, top)


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(group, words, a, total) with l, r and score of the lowest-scoring cut."""
    size = F.size("words")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select(F.col("words").alias(part), F.col("a").alias(name)), part)
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "total", "l", "r")}
    score = F.call_function("div", (exact["a"] * exact["total"]).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), exact["l"] * exact["r"])
    lowest = cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("group", "words", "a", "total").agg(F.min("cut").alias("cut"))
    return lowest.select("group", "words", "a", "total", "cut.score", "cut.l", "cut.r")


def ranked_phrases(table: DataFrame, frequent: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each group, with the phrase in words."""
    placed = table.withColumn("row", F.struct("group", "words")).select("row", "a", "total", "score", "l", "r", F.posexplode("words").alias("at", "h"))
    spelt = placed.join(frequent.select("h", "word"), "h").groupBy("row", "a", "total", "score", "l", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = spelt.withColumn("group", F.col("row.group")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.select("group", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
