"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

1. One narrow pass makes a sketch per document: the number of distinct word shingles, a 128-bit fingerprint of the
   set and its minima under ``bands * rows`` multiply-shift hashes. Documents with equal sets become one class with
   its least doc_id as representative, so thousands of copies cost one row from here on.
2. Representatives meet in buckets of equal bands. A link at the threshold is missed with probability
   (1 - t^rows)^bands: 1e-8 at 0.85 and 2e-6 at 0.8.
3. Only documents of shared buckets have their full sets built. In crowded buckets, shingles that no other
   document of any crowded bucket holds bound what a pair can share, and pairs below the threshold by that bound
   are never formed. This is exact, as such a shingle cannot be in an intersection.
4. Each bucket first links its members to one centre, the member with the fewest shingles of its own. After the
   components of those links, only pairs of a bucket that are still in different components remain. In crowded
   buckets each member has a bitmap of the centre's shingles that it holds; two bitmaps give what a pair shares of
   the centre, and own shingles bound the rest, so hardly a pair below the threshold is formed.
5. A pair counts if its signatures agree to within 4.5 deviations of the threshold and the full sets confirm it.

A null text, or one without words, has an empty set and is linked with nothing. Texts with fewer words than a
shingle are one shingle. Ids may be of any ordered type. Links are between rows, so an id that repeats with other
texts stands for several documents; rows equal in id and text get the same result. Rows without an id get the least
id of their component, or null if it has none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stakewise.llm.common import bounded_batches, byte_words, fingerprint, small_or_shuffled, stored
from stakewise.llm.components import connected_components
from stakewise.llm.words import shingles, word_hashes

WIDTH = 5
PERCENT = 80
BANDS = 25
ROWS = 4
#: Members from which a bucket is crowded.
CROWDED = 16


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(byte_words(text or "")), width))


def hash_family(count: int, seed: int = 20_240_601) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of multiply-shift hashing, a 2-universal family on 64-bit words."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least top half of a * x + b over the set, for each hash."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(least, (values[i : i + 1024] * a[:, None] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def sketches(rows: DataFrame, width: int, count: int) -> DataFrame:
    """``rows`` (doc_id, r1, r2, text) without texts, with uid, n_shingles, fp1, fp2 and minima (null without a set)."""

    def sketch(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        a, b = hash_family(count)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            sizes, prints, least = [], [], []
            for text in batch.column("text").to_pylist():
                values = shingle_set(text, width)
                sizes.append(len(values))
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), "<i8").tolist() if len(values) else (None, None))
                least.append(minima(values, a, b).tobytes() if len(values) else None)
            made = [pa.array(range(uid, uid + len(sizes)), pa.int64()), pa.array(sizes, pa.int64()), *[pa.array([x[i] for x in prints], pa.int64()) for i in (0, 1)], pa.array(least, pa.binary())]
            uid += len(sizes)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "r1", "r2")], *made], names=schema.names)

    schema = T.StructType([*rows.schema.fields[:3], *[T.StructField(c, T.LongType()) for c in ("uid", "n_shingles", "fp1", "fp2")], T.StructField("minima", T.BinaryType())])
    return rows.mapInArrow(sketch, schema)


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    def build(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "values": [shingle_set(t, width).tobytes() for t in frame["text"]]})

    return texts.mapInPandas(build, "doc_id long, values binary")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(doc_id, own): how many shingles of a document no other document of ``sets`` holds."""

    def each(frames):
        for frame in frames:
            for doc_id, data in zip(frame["doc_id"], frame["values"], strict=True):
                values = np.frombuffer(data, "<i8")
                yield pd.DataFrame({"doc_id": np.full(len(values), doc_id), "value": values})

    held = sets.mapInPandas(each, "doc_id long, value long")
    lone = held.groupBy("value").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).filter("c = 1")
    return lone.groupBy("doc_id").agg(F.count("*").alias("own"))


def may_link(a: str, b: str, percent: int):
    """Whether sizes and shingles of their own let two documents reach the threshold."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    most = F.least(na - F.col(f"{a}.own"), nb - F.col(f"{b}.own"))
    return (most * 100) >= (na + nb - most) * percent


def shared_with_centre(a: str, b: str, percent: int):
    """``may_link`` by the bitmaps of two members of a crowded bucket, where both have one."""
    both = F.aggregate(F.zip_with(f"{a}.inside", f"{b}.inside", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0).cast("long"), lambda n, x: n + x)
    rest = F.greatest(F.lit(0), F.least(F.col(f"{a}.outside") - F.col(f"{a}.own"), F.col(f"{b}.outside") - F.col(f"{b}.own")))
    most = both + rest
    return F.coalesce(most * 100 >= (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles") - most) * percent, F.lit(True))


COMPARED = "u long, v long, linked boolean, inside array<long>, outside long"


def compared(pairs: DataFrame, sets: DataFrame, percent: int, count: int) -> DataFrame:
    """``pairs`` (u, v, bits) with ``linked``: whether signatures, then full sets, reach the threshold. Where ``bits``
    is set, also a bitmap of the shingles of u that v holds, and how many others v has."""
    t = percent / 100
    least = count * (t - 4.5 * math.sqrt(t * (1 - t) / count))

    def bitmap(held: np.ndarray) -> np.ndarray:
        packed = np.packbits(held)
        return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<i8")

    def test(frames):
        for frame in frames:
            rows = []
            for u, v, bits, m1, m2, d1, d2 in zip(*[frame[c] for c in ("u", "v", "bits", "m1", "m2", "s1", "s2")], strict=True):
                alike = np.count_nonzero(np.frombuffer(m1, "<u4") == np.frombuffer(m2, "<u4")) >= least
                if not alike and not bits:
                    continue
                x, y = np.frombuffer(d1, "<u8"), np.frombuffer(d2, "<u8")
                held = np.isin(x, y, assume_unique=True)
                both = int(np.count_nonzero(held))
                linked = alike and 100 * both >= percent * (len(x) + len(y) - both)
                if linked or bits:
                    rows.append((u, v, linked, bitmap(held) if bits else None, len(y) - both))
            yield pd.DataFrame(rows, columns=["u", "v", "linked", "inside", "outside"])

    one = sets.select(F.col("doc_id").alias("u"), F.col("minima").alias("m1"), F.col("values").alias("s1"))
    two = sets.select(F.col("doc_id").alias("v"), F.col("minima").alias("m2"), F.col("values").alias("s2"))
    return pairs.join(two, "v").join(one, "u").select("u", "v", "bits", "m1", "m2", "s1", "s2").mapInPandas(test, COMPARED)


def classes_and_links(named: DataFrame, sketch: DataFrame, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(fp1, fp2, cid, first, copies) of each class of equal sets, and (node, component) of the linked classes.

    Inside, a class goes by the row number of its first row as ``doc_id``, so ids of any type, nulls and repeats of
    an id with other texts are no matter. ``first`` is the struct of the row that stays for the class.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r1", "r2")
    classes = sketch.filter("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("uid").alias("cid"), F.min(order).alias("first"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    reps = sketch.drop("doc_id").join(classes.select(F.col("cid").alias("uid")), "uid", "left_semi")
    reps = stored(reps.select(F.col("uid").alias("doc_id"), "n_shingles", "minima", "r1", "r2"), "reps")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("minima", 4 * rows * i + 1, 4 * rows)) for i in range(bands)])
    banded = reps.select("doc_id", F.explode(keys).alias("key"))
    shared = stored(banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    members = stored(banded.join(small_or_shuffled(shared), "key"), "members")
    wanted = members.groupBy("doc_id").agg((F.max("members") >= CROWDED).alias("crowded"))
    wanted = stored(wanted.join(reps.select("doc_id", "r1", "r2"), "doc_id"), "wanted")
    texts = named.select("r1", "r2", "text").join(small_or_shuffled(wanted.select("doc_id", "r1", "r2")), ["r1", "r2"])
    sets = stored(full_sets(texts.select("doc_id", "text"), width).dropDuplicates(["doc_id"]).join(reps.drop("r1", "r2"), "doc_id"), "sets")
    own = own_shingles(sets.select("doc_id", "values").join(wanted.filter("crowded").select("doc_id"), "doc_id"))
    sized = members.join(sets.select("doc_id", "n_shingles"), "doc_id").join(own, "doc_id", "left")
    sized = sized.withColumn("own", F.when(F.col("members") >= CROWDED, F.coalesce("own", F.lit(0))).otherwise(0))
    sized = stored(sized.filter((F.col("n_shingles") - F.col("own")) * 100 >= F.col("n_shingles") * percent).withColumn("crowd", F.col("members") >= CROWDED).drop("members"), "sized")
    centre = sized.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n_shingles")).alias("share"), "doc_id", "n_shingles", "own")).alias("c"))
    centre = centre.select("key", "c.doc_id", "c.n_shingles", "c.own")
    count = bands * rows
    a, b = centre.alias("a"), sized.alias("b")
    bits = F.col("b.crowd")
    pairs = a.join(b, F.expr("a.key = b.key AND a.doc_id <> b.doc_id") & (bits | may_link("a", "b", percent)))
    pairs = stored(pairs.groupBy(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).agg(F.bool_or("b.crowd").alias("bits")), "pairs")
    tested = stored(compared(pairs, sets, percent, count), "tested")
    labels = connected_components(tested.filter("linked").select("u", "v"))
    placed = sized.join(labels, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    placed = placed.join(open_keys, "key", "left_semi").join(centre.select("key", F.col("doc_id").alias("u")), "key")
    maps = tested.filter("inside IS NOT NULL").select("u", F.col("v").alias("doc_id"), "inside", "outside")
    placed = stored(placed.join(maps, ["u", "doc_id"], "left").withColumn("inside", F.when(F.col("crowd"), F.col("inside"))), "placed")
    a, b = placed.alias("a"), placed.alias("b")
    rest = a.join(b, F.expr("a.key = b.key AND a.component < b.component AND a.doc_id <> a.u AND b.doc_id <> b.u") & may_link("a", "b", percent) & shared_with_centre("a", "b", percent))
    rest = rest.select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).distinct().withColumn("bits", F.lit(False))
    late = stored(compared(stored(rest, "rest"), sets, percent, count).filter("linked").select("u", "v"), "late")
    stars = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return classes, labels if late.isEmpty() else connected_components(stars.union(late))


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, r1, r2 (fingerprint of id and text), n_shingles, component_id, home (the
    fingerprint of the one row that stays for the component; null without a set) and copies (rows of an equal set)."""
    bounded_batches(docs.sparkSession)
    r1, r2 = fingerprint(F.col(id_col), F.col(text_col))
    named = docs.select(F.col(id_col).alias("doc_id"), r1.alias("r1"), r2.alias("r2"), F.col(text_col).alias("text"))
    sketch = stored(sketches(named, width, bands * rows), "sketch")
    classes, labels = classes_and_links(named, sketch, width, percent, bands, rows)
    linked = labels.join(classes.select(F.col("cid").alias("node"), "first"), "node")
    homes = linked.groupBy("component").agg(F.min("first").alias("home"))
    linked = stored(linked.select("node", "component").join(homes, "component").select(F.col("node").alias("cid"), "home"), "linked")
    named_classes = classes.join(linked, "cid", "left").select("fp1", "fp2", F.coalesce("home", "first").alias("home"), "copies")
    out = sketch.drop("minima", "uid").join(named_classes, ["fp1", "fp2"], "left")
    component = F.when(F.col("home").isNull(), F.col("doc_id")).otherwise(F.col("home.doc_id"))
    return out.select("doc_id", "r1", "r2", "n_shingles", component.alias("component_id"), F.col("home").dropFields("no_id", "doc_id").alias("home"), "copies")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept; ``options`` as for ``components``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their distinct shingle sets.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return components(docs, **options).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the least id, or of rows without ids or of equal ids the least hash.

    A row that repeats in id and text is there once. Rows without a set are linked with nothing and all stay.
    """
    found = components(docs, id_col=id_col, text_col=text_col, **options).filter("home IS NOT NULL")
    found = stored(found.select("r1", "r2", (F.struct("r1", "r2") == F.col("home")).alias("stays"), "copies"), "stays")
    gone = stored(found.filter("NOT stays").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).distinct(), "gone")
    twice = found.filter("stays AND copies > 1").groupBy(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).count().filter("count > 1").select("__r1", "__r2")
    twice = stored(twice, "twice")
    r1, r2 = fingerprint(F.col(id_col), F.col(text_col))
    left = docs.withColumns({"__r1": r1, "__r2": r2}).join(small_or_shuffled(gone), ["__r1", "__r2"], "left_anti")
    if not twice.isEmpty():
        few = small_or_shuffled(twice)
        left = left.join(few, ["__r1", "__r2"], "left_anti").union(left.join(few, ["__r1", "__r2"], "left_semi").dropDuplicates(["__r1", "__r2"]))
    return left.drop("__r1", "__r2")
