"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows of ``window`` consecutive words, and a window is the list of its word
shingles. A document contains a window only if it contains every shingle of it, so for containment the necessary
prefix of a window, with shingles ordered by rarity, is its rarest shingle alone. One pass over the documents
counts the benchmark's shingles; a second one joins documents with the prefixes. A shared shingle fixes where the
window would have to start: starts before the document or ends behind it are dropped, and the words themselves
confirm the rest.

A benchmark of at most ``block_bytes`` of text, measured before it is fetched, is a table of windows that travels with
the tasks. A larger one stays on Spark: shingle counts, prefixes and candidates are joined there, with two passes over
the documents whatever its size. What travels then is a bitmap of the shingles, which drops most others before the
shuffle. A candidate brings the words around it, so windows are confirmed in the join.

Null texts have no words. Items without words match nothing. Items without an id count as one item without a name:
their windows hit, and add one to n_items, but no name. Document ids may be of any type, null or repeated: each row has
its own result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stakewise.llm.common import bounded_batches, stored
from stakewise.llm.words import shingles, word_hashes

WINDOW = 10
SHINGLE = 3
#: Bytes of item text in a block; windows and hashes take about a hundred times as much.
BLOCK_BYTES = 1_000_000
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _SEPARATORS else c for c in range(256))
#: Bits of a bitmap of shingles: 2^22, or for larger benchmarks 32 a shingle, 2^31 (256 MB) at most.
_BITS, _MOST_BITS = 22, 31

FOUND = "n_words long, ranges array<struct<a: long, b: long>>, items array<string>, nameless boolean"
CONTEXT = "row_id long, start long, hash long, before array<binary>, words array<binary>"


def item_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and anything beyond ASCII; A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO).split()


class Windows:
    """The windows of a block of items, found by any chosen shingle of theirs."""

    def __init__(self, items: list[tuple], window: int, width: int):
        self.words: list[list[bytes]] = []
        self.items: list[set] = []
        known: dict[tuple, int] = {}
        for item, text in items:
            words = item_words(text)
            for at in range(max(1, len(words) - window + 1)) if words else ():
                run = words[at : at + window]
                if (i := known.setdefault(tuple(run), len(known))) == len(self.words):
                    self.words.append(run)
                    self.items.append(set())
                self.items[i].add(item)
        self.width = width
        self.shingles = [shingles(word_hashes(w), width) for w in self.words]
        self.all = np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, np.uint64)

    def widths(self) -> list[int]:
        """Shingle widths that occur: shorter windows are one shingle of their own."""
        return sorted({min(self.width, len(w)) for w in self.words})

    def prefixes(self, counts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Each window under its rarest shingle (ties: the first): hash to (window, place of the shingle in it)."""
        found: dict[int, list[tuple[int, int]]] = {}
        for i, values in enumerate(self.shingles):
            at = int(np.argmin(counts[np.searchsorted(self.all, values)]))
            found.setdefault(int(values[at]), []).append((i, at))
        return found


def bitmap(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, bool)
    bits[values >> np.uint64(64 - _BITS)] = True
    return bits


class Sieve:
    """A packed bitmap of shingles by their top bits; it lets false ones through, never drops a true one."""

    def __init__(self, shingles: DataFrame):
        """Of the distinct ``hash`` column; tasks send the numbers of set bytes, the driver holds 256 MB at most."""
        n = shingles.count()
        self.bits = min(_MOST_BITS, max(_BITS, (32 * n).bit_length()))
        place = F.shiftrightunsigned("hash", 64 - self.bits)
        packed = shingles.groupBy(F.shiftright(place, 3).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), place % 8).cast("int")).alias("mask"))
        rows = packed.toPandas()
        self.bytes = np.zeros(1 << (self.bits - 3), np.uint8)
        self.bytes[rows["byte"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def document_shingles(words: list[bytes], widths: list[int]):
    hashes = word_hashes(words)
    for w in widths:
        if len(words) >= w:
            yield shingles(hashes, w)


def shingle_counts(docs: DataFrame, windows: Windows) -> np.ndarray:
    """How often each shingle of the block occurs in all documents; summed on Spark, as long as the block."""
    values, widths = windows.all, windows.widths()

    def count(frames):
        bits, total = bitmap(values), np.zeros(len(values), np.int64)
        for frame in frames:
            for text in frame["text"]:
                for found in document_shingles(item_words(text), widths):
                    found = found[bits[found >> np.uint64(64 - _BITS)]]
                    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                    total += np.bincount(at[values[at] == found], minlength=len(values))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"i": seen, "n": total[seen]})

    rows = docs.select("text").mapInPandas(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(values), np.int64)
    counts[rows["i"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def merged(places: set[tuple[int, int]]) -> list[dict]:
    """Ranges (a, behind) as disjoint ones in order."""
    ranges: list[dict] = []
    for a, b in sorted(places):
        if ranges and a <= ranges[-1]["b"]:
            ranges[-1]["b"] = max(b, ranges[-1]["b"])
        else:
            ranges.append({"a": a, "b": b})
    return ranges


def block_hits(docs: DataFrame, windows: Windows, counts: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, ``FOUND``): hit ranges of words (from, behind), and the items with occurring windows."""
    prefixes, widths = windows.prefixes(counts), windows.widths()
    values = np.array(sorted(prefixes), np.uint64)
    runs, items = windows.words, [sorted(str(x) for x in own if x is not None) for own in windows.items]
    nameless = [None in own for own in windows.items]

    def probe(batches):
        import pyarrow as pa

        bits = bitmap(values)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words, starts, seen, none = item_words(text), set(), set(), False
                for found in document_shingles(words, widths):
                    for pos in np.flatnonzero(bits[found >> np.uint64(64 - _BITS)]):
                        for i, at in prefixes.get(int(found[pos]), ()):
                            run, start = runs[i], int(pos) - at
                            if start >= 0 and start + len(run) <= len(words) and words[start : start + len(run)] == run:
                                starts.add((start, start + len(run)))
                                seen.update(items[i])
                                none = none or nameless[i]
                rows.append((len(words), merged(starts), sorted(seen), none))
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), span, pa.list_(pa.string()), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_words", "ranges", "items", "nameless"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(FOUND).fields])
    return docs.mapInArrow(probe, schema)


def window_table(bench: DataFrame, window: int, width: int) -> DataFrame:
    """(wid, run, items, nameless, hashes) of each distinct window of ``bench`` (item, text); hashes are its shingles."""

    def cut(frames):
        for frame in frames:
            for item, text in zip(frame["item"], frame["text"], strict=True):
                words = item_words(text)
                runs = [words[at : at + window] for at in range(max(1, len(words) - window + 1))] if words else []
                for i in range(0, len(runs), 10_000):
                    part = runs[i : i + 10_000]
                    yield pd.DataFrame({"item": item, "run": [b" ".join(r) for r in part], "hashes": [shingles(word_hashes(r), width).view(np.int64) for r in part]})

    rows = bench.select(F.col("item").cast("string").alias("item"), "text").mapInPandas(cut, "item string, run binary, hashes array<long>")
    distinct = rows.groupBy("run").agg(F.sort_array(F.collect_set("item")).alias("items"), F.bool_or(F.col("item").isNull()).alias("nameless"), F.first("hashes").alias("hashes"))
    return stored(distinct.withColumn("wid", F.monotonically_increasing_id()), "windows")


def sieved_counts(docs: DataFrame, sieve: Sieve, widths: list[int]) -> DataFrame:
    """(hash, n): how often each shingle that passes ``sieve`` occurs in all documents."""

    def count(frames):
        for frame in frames:
            batch = [np.zeros(0, np.uint64)]
            for text in frame["text"]:
                batch += [found[sieve.passes(found)] for found in document_shingles(item_words(text), widths)]
            values, n = np.unique(np.concatenate(batch), return_counts=True)
            if len(values):
                yield pd.DataFrame({"hash": values.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def joined_hits(docs: DataFrame, bench: DataFrame, window: int, width: int) -> DataFrame:
    """``block_hits`` for a benchmark of any size, as joins of Spark; ``docs`` is scanned twice."""
    windows = window_table(bench, window, width)
    lengths = F.size(F.split(F.col("run").cast("string"), " "))
    shapes = [r["w"] for r in windows.select(F.least(F.lit(width), lengths).alias("w")).distinct().collect()]
    widths = sorted(shapes)
    placed = windows.select("wid", F.posexplode("hashes").alias("at", "hash"))
    counts = sieved_counts(docs, Sieve(placed.select("hash").distinct()), widths)
    rarity = placed.join(counts, "hash", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "hash")).alias("p"))
    prefixes = stored(rarity.select("wid", "p.at", "p.hash").join(windows.select("wid", "run"), "wid"), "prefixes")
    sieve = Sieve(prefixes.select("hash").distinct())

    def probe(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        for batch in batches:
            owners, heads, rows = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = item_words(text)
                owners.append(k)
                heads.append(len(words))
                rows.append((uid, None, None, None, None))
                for found in document_shingles(words, widths):
                    for pos in np.flatnonzero(sieve.passes(found)).tolist():
                        owners.append(None)
                        heads.append(None)
                        rows.append((uid, pos, int(found[pos : pos + 1].view(np.int64)[0]), words[max(0, pos - window) : pos], words[pos : pos + window]))
                uid += 1
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owners, pa.int64())), pa.array(heads, pa.int64()), *made], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), *T._parse_datatype_string(CONTEXT).fields])
    rows = stored(docs.mapInArrow(probe, schema), "contexts")
    met = rows.filter("start IS NOT NULL").select("row_id", "start", "hash", "before", "words").join(prefixes, "hash")
    size = F.size(F.split(F.col("run").cast("string"), " "))
    first, behind = F.size("before") - F.col("at"), size - F.col("at")
    inside = (first >= 0) & (behind <= F.size("words"))
    around = F.concat(F.slice("before", F.greatest(first, F.lit(0)) + 1, F.col("at")), F.slice("words", 1, F.greatest(behind, F.lit(0))))
    spaced = F.aggregate(around, F.lit(b""), lambda a, w: F.concat(a, F.when(F.length(a) > 0, F.lit(b" ")).otherwise(F.lit(b"")), w))
    sure = met.filter(inside).filter(spaced == F.col("run")).select("row_id", "wid", (F.col("start") - F.col("at")).alias("a"), (F.col("start") - F.col("at") + size).cast("long").alias("b"))
    spans = sure.groupBy("row_id").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["b"] >= r["a"]), joined).otherwise(F.concat(done, F.array(r)))

    none = F.array().cast("array<struct<a: long, b: long>>")
    ranges = spans.select("row_id", F.aggregate("spans", none, add).alias("ranges"))
    named = sure.select("row_id", "wid").distinct().join(windows.select("wid", "items", "nameless"), "wid")
    items = named.groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.bool_or("nameless").alias("nameless"))
    hits = rows.filter("start IS NULL").select("doc_id", "n_words", "row_id").join(ranges, "row_id", "left").join(items, "row_id", "left")
    return hits.select("doc_id", "n_words", F.coalesce("ranges", none).alias("ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("nameless", F.lit(False)).alias("nameless"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = SHINGLE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted strings), ranges."""
    bounded_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    if (bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) <= block_bytes:
        windows = Windows([(r["item"], r["text"]) for r in bench.collect()], window, width)
        hits = block_hits(named, windows, shingle_counts(named, windows))
    else:
        hits = joined_hits(named, bench, window, width)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    n_items = F.size("items").cast("long") + F.col("nameless").cast("long")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sort_array("items").alias("items"), "ranges")
