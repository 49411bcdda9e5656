"""Near-duplicate lines by a segment-partition edit join.

Lines within one edit of each other are linked. A line of n characters has two segments (the threshold plus one); two
lines within one edit share, at its place, the first segment or the second, with places and lengths taken from the
shorter of the two. So each distinct line enters an index under both segments for its own length, and probes the
index for lengths one below. What meets is verified with a banded bit-parallel edit distance.

A segment that many lines share is split further instead of comparing all of them: its pairs differ within a known
window, and halving that window gives keys that are more and more of the line, until few lines share one, or the
window is empty and all that meet are linked to one of them. No group is ever compared pair by pair beyond
``CROWDED`` members.

Linked lines form classes (connected components). The first line of a class, by document id, stays; the others are
removed from their documents. Lines shorter than ``MIN_CHARS`` are left alone, or, with ``short_copies``, linked to
their exact copies if they have a word: one grouping, without segments.

A null text has no lines and stays null; an empty one has one empty line. Rows that agree in id and text are one
document to this operator and get the same result. Ids may be of any ordered type; null comes first. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakewise.llm.common import fingerprint, own_columns, small_or_shuffled, stored
from stakewise.llm.components import connected_components

#: Shorter lines are near one another by chance.
MIN_CHARS = 20
#: Members from which a shared segment is split further.
CROWDED = 16
PLACE = ["doc_id", "r1", "r2", "line_no"]


def edit_distance(one: Column, two: Column, most: int = 1) -> Column:
    """Banded bit-parallel edit distance: exact up to ``most``, and larger than ``most`` beyond it.

    Bit b of a column's words stands for the row ``b - most`` below the diagonal, so the band slides with the column
    and takes 2 * most + 1 bits. For strings of at least ``most`` + 1 characters.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    swap = F.char_length(one) < F.char_length(two)
    long, short = F.split(F.when(swap, two).otherwise(one), ""), F.split(F.when(swap, one).otherwise(two), "")
    pair = F.transform(F.array(F.struct(long.alias("y"), short.alias("x"))), lambda p: _folded(p["y"], p["x"], most, width, full))
    far = F.abs(F.char_length(one) - F.char_length(two)) > most
    return F.when(far, F.lit(most + 1)).otherwise(pair[0])


def _folded(y: Column, x: Column, most: int, width: int, full: int) -> Column:
    rows = F.size(y)

    def bit(word: Column, place: Column) -> Column:
        return F.call_function("shiftright", word, place).bitwiseAND(F.lit(1))

    def invert(word: Column) -> Column:
        return word.bitwiseXOR(F.lit(full))

    def step(s: Column, j: Column) -> Column:
        c = F.get(x, j)
        match = F.lit(0)
        for b in range(width):
            match = match + F.when(F.get(y, j + (b - most)) == c, F.lit(1 << b)).otherwise(0)
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), match.alias("m"))

    def column(s: Column, j: Column) -> Column:
        t = step(s, j)
        vp, vn, m = t["vp"], t["vn"], t["m"]
        d0 = ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(full))
        inner = F.struct(vp.alias("vp"), vn.alias("vn"), t["d"].alias("d"), d0.alias("d0"))
        return F.transform(F.array(inner), lambda u: _next(u, j))[0]

    def _next(u: Column, j: Column) -> Column:
        d0, vp, vn = u["d0"], u["vp"], u["vn"]
        hp, hn = vn.bitwiseOR(invert(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
        down = F.call_function("shiftright", d0, F.lit(1))
        place = F.greatest(F.lit(0), F.lit(width - 2) - (j - (rows - most)))
        diagonal = F.lit(1) - bit(d0, F.lit(width - 1))
        flat = bit(hp, place) - bit(hn, place)
        d = u["d"] + F.when(j < rows - most, diagonal).otherwise(flat)
        return F.struct(hn.bitwiseOR(invert(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), d.alias("d"))

    start = F.struct(F.lit(((1 << (most + 1)) - 1) << most).alias("vp"), F.lit(0).alias("vn"), F.lit(most).alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, column, lambda s: s["d"])


def differ_in_one_window(one: Column, two: Column, windows: int = 8) -> Column:
    """Whether two strings agree outside one of ``windows`` equal windows, as any pair within one edit does."""
    n = F.least(F.char_length(one), F.char_length(two))

    def agree(i: int) -> Column:
        before = F.floor(n * i / windows).cast("int")
        behind = n - F.floor(n * (i + 1) / windows).cast("int")
        return (F.left(one, before) == F.left(two, before)) & (F.right(one, behind) == F.right(two, behind))

    return reduce(Column.__or__, [agree(i) for i in range(windows)])


def segment_key(side: int, length: Column, segment: Column) -> Column:
    return F.xxhash64(F.lit(side), length, segment)


def line_keys(line: Column, n: Column) -> Column:
    """Both segments of a line for its own length, and those of lines one shorter."""

    def keys(length: Column, probe: bool) -> list[Column]:
        half = F.floor(length / 2).cast("int")
        first, second = F.left(line, half), F.right(line, length - half)
        return [F.struct(segment_key(i, length, s).alias("key"), F.lit(i).alias("side"), F.lit(probe).alias("probe")) for i, s in enumerate((first, second))]

    return F.array(*keys(n, False), *keys(n - 1, True))


def is_long(min_chars: int) -> Column:
    return F.col("n") >= max(4, min_chars)


def document_lines(docs: DataFrame, wanted: Column) -> DataFrame:
    lines = docs.select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("n", F.char_length("line")).filter(wanted)


def small_pairs(rows: DataFrame) -> DataFrame:
    """(u, v) within the keys of at most ``CROWDED`` members: indexed lines with each other and with probes."""
    rows = rows.filter(F.col("m") <= CROWDED)
    a, b = rows.filter("NOT probe").alias("a"), rows.alias("b")
    pairs = a.join(b, F.expr("a.key = b.key AND a.lid <> b.lid AND (b.probe OR a.lid < b.lid)"))
    return pairs.select(F.least("a.lid", "b.lid").alias("u"), F.greatest("a.lid", "b.lid").alias("v"))


def stars(rows: DataFrame) -> DataFrame:
    """(u, v, others): each key's first indexed line with the others, and for each member their number."""
    centre = rows.filter("NOT probe").groupBy("key").agg(F.min("lid").alias("c"), (F.count("*") - 1).alias("others"))
    return rows.join(centre, "key").select(F.col("lid").alias("u"), F.col("c").alias("v"), "others")


def meeting(rows: DataFrame) -> DataFrame:
    """``rows`` (key, lid, probe, ...) whose key an indexed line shares with another one, with the members ``m``."""
    shared = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("probe").alias("only_probes")).filter("m > 1 AND NOT only_probes").select("key", "m")
    shared = stored(shared, "shared")
    return stored(rows.join(small_or_shuffled(shared), "key"), "meeting")


def halves(a: str, b: str) -> Column:
    """The two halves of the window [a, b); of a window of one character, the empty ones on either side of it."""

    def window(start: Column, end: Column) -> Column:
        return F.struct(start.alias("a"), end.alias("b"))

    start, end = F.col(a), F.col(b)
    middle = F.floor((start + end) / 2).cast("int")
    return F.when(end - start == 1, F.array(window(start, start), window(end, end))).otherwise(F.array(window(start, middle), window(middle, end)))


def split_windows(rows: DataFrame, texts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pairs of crowded keys: halve the window in which their lines differ until few lines agree outside it.

    The second list has stars of lines that differ in one character at one place, so each is linked to all others;
    two lines meet in one such place at most, and in no pair of the first list.
    """
    n = F.col("n") - F.col("probe").cast("int")
    half = F.floor(n / 2).cast("int")
    rows = rows.join(texts.select("lid", "n"), "lid").select("key", "lid", "probe", F.when(F.col("side") == 0, half).otherwise(0).alias("a"), F.when(F.col("side") == 0, n).otherwise(half).alias("b"))
    found, alike = [], []
    while True:
        rows = stored(rows, "windows")
        if rows.isEmpty():
            return found, alike
        alike.append(stored(stars(rows.filter("b - a <= 1 AND NOT probe")), "alike"))
        kids = rows.withColumnsRenamed({"a": "from", "b": "to"}).join(texts.select("lid", "line"), "lid")
        kids = kids.withColumn("w", F.explode(halves("from", "to")))
        shift = F.col("probe").cast("int")
        left = F.substr("line", F.col("from") + 1, F.col("w.a") - F.col("from"))
        right = F.substr("line", F.col("w.b") + shift + 1, F.col("to") - F.col("w.b"))
        kids = kids.select(F.xxhash64("key", "w.a", "w.b", left, right).alias("key"), "lid", "probe", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
        kids = meeting(kids)
        found.append(small_pairs(kids))
        crowded = kids.filter(F.col("m") > CROWDED).drop("m")
        found.append(stars(crowded.filter("a = b")).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
        rows = crowded.filter("a < b")


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def line_links(distinct: DataFrame, docs: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) that connect all distinct lines within one edit, and (lid, degree) of each linked line."""
    rows = distinct.select("lid", F.explode("keys").alias("k")).select("k.key", "k.side", "k.probe", "lid")
    rows = meeting(rows)
    wanted = rows.select("lid").distinct().join(distinct.select("lid", *[F.col(f"first.{c}").alias(c) for c in PLACE]), "lid").drop("doc_id")
    texts = document_lines(docs, is_long(min_chars)).join(small_or_shuffled(stored(wanted, "wanted")), ["r1", "r2", "line_no"])
    texts = stored(texts.select("lid", "line", "n").dropDuplicates(["lid"]), "texts")
    found, alike = split_windows(rows.filter(F.col("m") > CROWDED), texts)
    pairs = stored(united([small_pairs(rows), *found]).distinct(), "pairs")
    one, two = texts.select(F.col("lid").alias("u"), F.col("line").alias("x")), texts.select(F.col("lid").alias("v"), F.col("line").alias("y"))
    checked = pairs.join(one, "u").join(two, "v").filter(differ_in_one_window(F.col("x"), F.col("y"))).filter(edit_distance(F.col("x"), F.col("y")) <= 1)
    links = stored(checked.select("u", "v"), "links")
    counts = united([links.select(F.explode(F.array("u", "v")).alias("lid"), F.lit(1).cast("long").alias("n")), *[a.select(F.col("u").alias("lid"), F.col("others").alias("n")) for a in alike]])
    return united([links, *[a.select("u", "v") for a in alike]]), counts.groupBy("lid").agg(F.sum("n").alias("degree"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short_copies: bool = False, id_col: str = "doc_id", text_col: str = "text", out: str = "line_dedup") -> DataFrame:
    """``docs`` with the lines of each class but its first removed from the texts, and the struct column ``out``.

    It holds n_lines, n_links (lines elsewhere, distinct and within one edit of a line here, summed over the
    lines), and removed, an array of (line, home_doc, home_line) that names the kept line of the class. With
    ``short_copies``, shorter lines than ``min_chars`` with a word form classes of exact copies.
    """
    r1, r2 = fingerprint(F.col(id_col), F.col(text_col))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), r1.alias("r1"), r2.alias("r2"))
    fp1, fp2 = fingerprint(F.col("line"))
    wanted, keys = is_long(min_chars), line_keys(F.col("line"), F.col("n"))
    if short_copies:
        wanted, keys = wanted | F.rlike("line", F.lit(r"[^\x20\x09-\x0D]")), F.when(wanted, keys).otherwise(F.slice(keys, 1, 0))
    lines = document_lines(named, wanted).select(*PLACE, fp1.alias("fp1"), fp2.alias("fp2"), keys.alias("keys"))
    lines = stored(lines, "lines")
    distinct = lines.groupBy("fp1", "fp2").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    distinct = stored(distinct.withColumn("lid", F.monotonically_increasing_id()), "distinct")
    links, degrees = line_links(distinct, named, min_chars)
    linked = connected_components(links).join(degrees, F.col("node") == F.col("lid")).select("lid", "component", "degree")
    classes = distinct.select("fp1", "fp2", "first", "copies", "lid").join(linked, "lid", "left").filter("copies > 1 OR component IS NOT NULL")
    classes = stored(classes.withColumn("component", F.coalesce("component", "lid")), "classes")
    home = classes.groupBy("component").agg(F.min("first").alias("home"))
    affected = stored(classes.join(home, "component").select("fp1", "fp2", "home", F.coalesce("degree", F.lit(0)).alias("degree")), "affected")
    at = lines.select(*PLACE, "fp1", "fp2").join(affected, ["fp1", "fp2"])
    away = F.struct(*PLACE) != F.col("home")
    hit = F.struct(F.col("line_no").alias("line"), F.col("home.doc_id").alias("home_doc"), F.col("home.line_no").alias("home_line"), away.alias("away"), "degree")
    by_doc = at.groupBy("r1", "r2").agg(F.sort_array(F.collect_set(hit)).alias("hits"))
    gone = F.transform(F.filter("hits", lambda h: h["away"]), lambda h: F.struct(*[h[c].alias(c) for c in ("line", "home_doc", "home_line")]))
    degree = F.aggregate("hits", F.lit(0).cast("long"), lambda d, h: d + h["degree"])
    by_doc = stored(by_doc.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), gone.alias("__gone"), degree.alias("__degree")), "removed")
    joined = docs.withColumns({"__r1": r1, "__r2": r2}).join(by_doc, ["__r1", "__r2"], "left")
    text = F.col(text_col)
    #: what stands in a lambda is computed for every element, so the lines and the bounds of what stays are made before
    ends = F.concat(F.array(F.lit(-1)), F.transform("__gone", lambda g: g["line"]), F.array(F.lit(1 << 30)))
    parts = F.array(F.struct(F.split(text, "\n").alias("lines"), ends.alias("ends")))
    runs = F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p["ends"]) - 2), lambda k: F.slice(p["lines"], p["ends"][k] + 2, p["ends"][k + 1] - p["ends"][k] - 1)))
    kept = F.when(F.size("__gone") > 0, F.array_join(F.flatten(runs[0]), "\n")).otherwise(text)
    removed = F.coalesce("__gone", F.array().cast(f"array<struct<line: int, home_doc: {named.schema['doc_id'].dataType.simpleString()}, home_line: int>>"))
    found = F.struct(F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce("__degree", F.lit(0).cast("long")).alias("n_links"), removed.alias("removed"))
    return joined.select(*own_columns(docs, {text_col: kept}), found.alias(out))
