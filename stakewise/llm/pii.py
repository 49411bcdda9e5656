"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in DataFrame functions.

Found values are checked first (card numbers by their check digit, dates by the calendar, addresses by their ranges)
and then permuted within their format: a card number becomes another valid one of its length and first digit, a date
another date in the same notation, a host another host. A network of ``ROUNDS`` rounds over two halves adds to one half
a keyed SHA-256 of the other, modulo the half's size, so the map is one-to-one and equal values stay equal in all
documents. The sizes are chosen so that two halves give exactly the valid values; nothing is walked or retried. Letters
and digits of mailbox names and hexadecimal secrets are shifted place by place in the same way, and all else in a text
stays where it was. Whoever knows the key can undo it; keep the key out of the code.

Values that fail their check are left alone. A null text stays null with zero counts.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewise.llm.common import own_columns, plain_columns

ROUNDS = 8
KINDS = ("email", "phone", "date", "national_id", "host", "card", "secret")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+[.])*+[A-Za-z]{2,}+",
    "phone": r"(?<![\d+])(?:\+\d{1,3} ?\(\d{3}\) ?|\(\d{3}\) |\+\d{1,3}[ .-]\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "date": r"(?<![\d.-])(?:\d{4}-\d\d-\d\d|\d\d[.]\d\d[.]\d{4}|\d\d/\d\d/\d{4})(?![\d-])",
    "national_id": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "host": rf"(?<![\d.])(?:{_OCTET}[.]){{3}}{_OCTET}(?!\d|[.]\d)",
    "card": r"(?<!\d)(?:\d{13,19}|(?:\d{4} ){3}\d{4}|(?:\d{4}-){3}\d{4})(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
}
#: 400 years, the calendar's period, are 189 * 773 days.
FIRST_DAY, DAY_HALVES = "1800-01-01", (189, 773)
#: Areas of national ids are 001 to 899 without 666; times groups 01 to 99, and serials 0001 to 9999.
ID_HALVES = (898 * 99, 9999)


def session_key(spark: SparkSession) -> str:
    """The key in the session's ``spark.stakewise.pseudonyms.secret``; if it has none, a random one is put there, so
    values stay linked within the session and no longer."""
    name = "spark.stakewise.pseudonyms.secret"
    if not spark.conf.get(name, ""):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def keyed(key: str, *parts: Column) -> Column:
    """60 bits of a keyed SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts, F.lit(key)).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permuted(a: Column, b: Column, sizes: tuple[Column, Column], key: str, kind: Column) -> Column:
    """(a, b) of Z_m x Z_n mapped one-to-one to another such pair."""
    m, n = (x.cast("long") for x in sizes)

    def round_(s: Column, i: Column) -> Column:
        def add(x: Column, other: Column, size: Column) -> Column:
            return F.pmod(x + F.pmod(keyed(key, kind, i.cast("string"), other.cast("string")), size), size)

        even = i % 2 == 0
        return F.struct(F.when(even, add(s["a"], s["b"], m)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(add(s["b"], s["a"], n)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), round_)


def shifted(text: Column, alphabets: list[str], key: str, kind: Column) -> Column:
    """A string with each character of one of ``alphabets`` moved within it, keyed by the other half and its place."""

    def half(part: Column, other: Column, i: Column) -> Column:
        def move(c: Column, at: Column) -> Column:
            step = keyed(key, kind, i.cast("string"), at.cast("string"), other)
            moved = c
            for alphabet in alphabets:
                place = F.call_function("instr", F.lit(alphabet), c)
                moved = F.when(place > 0, F.substr(F.lit(alphabet), F.pmod(place - 1 + step, F.lit(len(alphabet))).cast("int") + 1, F.lit(1))).otherwise(moved)
            return moved

        return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), move), "")

    def round_(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, half(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(half(s["b"], s["a"], i)).alias("b"))

    cut = F.floor(F.char_length(text) / 2).cast("int")
    start = F.struct(F.left(text, cut).alias("a"), F.right(text, F.char_length(text) - cut).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda s: F.concat(s["a"], s["b"]))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits, those at places with remainder ``doubled`` (of 2, from the right) doubled, crosswise."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        two = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.char_length(digits) - i) % 2 == doubled, two).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add)


def refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits, in order, taken from ``digits``."""

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: s["out"])


def padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def digit_pair(digits: Column, key: str, kind: Column) -> Column:
    """A digit string permuted among those of its length (36 at most)."""
    n = F.char_length(digits)
    cut = F.floor(n / 2).cast("int")
    sizes = (F.pow(F.lit(10), cut), F.pow(F.lit(10), n - cut))
    pair = permuted(F.coalesce(F.left(digits, cut).try_cast("long"), F.lit(0).cast("long")), F.right(digits, n - cut), sizes, key, kind)
    return bound(pair, lambda p: F.concat(F.when(cut > 0, padded(p["a"], cut)).otherwise(""), padded(p["b"], n - cut)))


def card(value: Column, digits: Column, key: str) -> Column:
    n = F.char_length(digits)
    body = F.concat(F.left(digits, F.lit(1)), digit_pair(F.substr(digits, F.lit(2), n - 2), key, F.lit("card")))
    return bound(body, lambda b: refilled(value, F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string"))))


def phone(value: Column, digits: Column, key: str) -> Column:
    return refilled(value, F.concat(F.left(digits, F.char_length(digits) - 10), digit_pair(F.right(digits, F.lit(10)), key, F.lit("phone"))))


def host(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, "[.]"), lambda x: x.cast("long"))
    pair = bound(octets, lambda o: permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], (F.lit(65536), F.lit(65536)), key, F.lit("host")))
    return bound(pair, lambda p: F.concat_ws(".", *[x.cast("string") for h in "ab" for x in (F.floor(p[h] / 256), p[h] % 256)]))


def national_id(value: Column, key: str) -> Column:
    area, group, serial = (F.substr(value, F.lit(at), F.lit(size)).cast("long") for at, size in ((1, 3), (5, 2), (8, 4)))
    first = (area - 1 - (area > 666).cast("long")) * 99 + group - 1
    pair = permuted(first, serial - 1, (F.lit(ID_HALVES[0]), F.lit(ID_HALVES[1])), key, F.lit("national_id"))

    def written(p: Column) -> Column:
        area = F.floor(p["a"] / 99) + 1
        return F.concat_ws("-", padded(area + (area >= 666).cast("long"), 3), padded(p["a"] % 99 + 1, 2), padded(p["b"] + 1, 4))

    return bound(pair, written)


def parsed_date(value: Column) -> Column:
    """The date that a match denotes, or null: y-m-d, d.m.y or m/d/y."""
    iso = F.when(F.contains(value, F.lit("-")), value).when(F.contains(value, F.lit("/")), F.regexp_replace(value, r"^(\d\d)/(\d\d)/(\d{4})$", "$3-$1-$2")).otherwise(F.regexp_replace(value, r"^(\d\d)[.](\d\d)[.](\d{4})$", "$3-$2-$1"))
    return iso.try_cast("date")


def day_number(value: Column) -> Column:
    return F.datediff(parsed_date(value), F.lit(FIRST_DAY).cast("date"))


def date(value: Column, key: str) -> Column:
    n = DAY_HALVES[1]
    pair = bound(day_number(value), lambda d: permuted(F.floor(d / n), d % n, (F.lit(DAY_HALVES[0]), F.lit(n)), key, F.lit("date")))
    day = bound(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * n + p["b"]).cast("int")))

    def written(d: Column) -> Column:
        y, m, dd = padded(F.year(d), 4), padded(F.month(d), 2), padded(F.day(d), 2)
        return F.when(F.contains(value, F.lit("-")), F.concat_ws("-", y, m, dd)).when(F.contains(value, F.lit("/")), F.concat_ws("/", m, dd, y)).otherwise(F.concat_ws(".", dd, m, y))

    return bound(day, written)


def kind_of(value: Column, digits: Column) -> Column:
    """Which of ``KINDS`` a match is, or null if its check fails."""
    days = DAY_HALVES[0] * DAY_HALVES[1]
    area_fine = ~F.rlike(value, F.lit("^(000|666|9)|-00-|-0000$"))
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(F.rlike(value, F.lit("^[+(]")), "phone")
        .when(F.rlike(value, F.lit(r"^(\d{4}-\d\d-\d\d|\d\d[.]\d\d[.]\d{4}|\d\d/\d\d/\d{4})$")), F.when(day_number(value).between(0, days - 1), "date"))
        .when(F.rlike(value, F.lit(r"^\d{3}-\d\d-\d{4}$")), F.when(area_fine, "national_id"))
        .when(F.contains(value, F.lit(".")), "host")
        .when(F.char_length(value) >= 32, "secret")
        .otherwise(F.when(luhn_sum(digits, 1) % 10 == 0, "card"))
    )


def pseudonym(value: Column, kind: Column, digits: Column, key: str) -> Column:
    mailbox = F.substring_index(value, "@", 1)
    name = shifted(mailbox, ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"], key, F.lit("email"))
    made = {
        "email": lambda: F.concat(name, F.right(value, F.char_length(value) - F.char_length(mailbox))),
        "phone": lambda: phone(value, digits, key),
        "date": lambda: date(value, key),
        "national_id": lambda: national_id(value, key),
        "host": lambda: host(value, key),
        "card": lambda: card(value, digits, key),
        "secret": lambda: shifted(value, ["0123456789abcdef"], key, F.lit("secret")),
    }
    out = value
    for k in KINDS:
        out = F.when(kind == k, made[k]()).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with personal data in the text replaced, and the struct column ``out``: how many of each kind. Other columns are
    kept as they are, whatever their names."""
    docs, named = plain_columns(docs, [text_col])
    text = F.col(text_col)
    pattern = "|".join(PATTERNS.values())
    some = F.rlike(text, F.lit("[0-9@]"))
    values = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def checked(value: Column) -> Column:
        digits = F.regexp_replace(value, r"\D", "")
        return bound(digits, lambda d: F.struct(value.alias("value"), kind_of(value, d).alias("kind"), d.alias("digits")))

    found = docs.withColumn("__found", F.transform(values, checked))
    new = F.transform("__found", lambda f: pseudonym(f["value"], f["kind"], f["digits"], key))
    # an argument of zip_with is evaluated once a text, what stands inside a lambda once a match
    merged = F.array_join(F.flatten(F.zip_with(F.split(text, pattern), "__new", lambda x, n: F.array(x, F.coalesce(n, F.lit(""))))), "")
    found = found.withColumn("__new", new)
    text = F.when(F.size("__found") > 0, merged).otherwise(text)

    def count(kind: str) -> Column:
        n = F.size(F.filter("__found", lambda f: f["kind"] == kind))
        return F.when(F.col("__found").isNull(), 0).otherwise(n).cast("long").alias(f"n_{kind}")

    counts = F.struct(*map(count, KINDS))
    return named(found.select(*own_columns(docs, {text_col: text}), counts.alias(out)))
