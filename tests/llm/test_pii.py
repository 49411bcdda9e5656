"""Pseudonyms against a plain Python Feistel network, and the properties that they promise."""

import datetime
import hashlib
import re

from stakewise.llm.pii import DAY_HALVES, ID_HALVES, KINDS, PATTERNS, ROUNDS, pseudonymise, session_key

KEY = "test key"
SCHEMA = "doc_id long, text string, pii string"


def keyed(*parts):
    text = "|".join([KEY, *map(str, parts), KEY])
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def permuted(a, b, m, n, kind):
    for i in range(ROUNDS):
        if i % 2 == 0:
            a = (a + keyed(kind, i, b)) % m
        else:
            b = (b + keyed(kind, i, a)) % n
    return a, b


def digit_pair(d, kind):
    cut = len(d) // 2
    a, b = permuted(int(d[:cut] or 0), int(d[cut:]), 10**cut, 10 ** (len(d) - cut), kind)
    return (str(a).zfill(cut) if cut else "") + str(b).zfill(len(d) - cut)


def shifted(text, alphabets, kind):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]

    def half(part, other, i):
        out = ""
        for at, c in enumerate(part):
            for alphabet in alphabets:
                if c in alphabet:
                    c = alphabet[(alphabet.index(c) + keyed(kind, i, at, other)) % len(alphabet)]
                    break
            out += c
        return out

    for i in range(ROUNDS):
        if i % 2 == 0:
            a = half(a, b, i)
        else:
            b = half(b, a, i)
    return a + b


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10


def refilled(value, digits):
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), value)


def replaced(value):
    """(kind or None, new value)."""
    digits = re.sub(r"\D", "", value)
    if "@" in value:
        name, _, rest = value.partition("@")
        return "email", shifted(name, ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"], "email") + "@" + rest
    if value[0] in "+(":
        return "phone", refilled(value, digits[:-10] + digit_pair(digits[-10:], "phone"))
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"):
        if re.fullmatch(re.sub("%Y", r"\\d{4}", re.sub("%[md]", r"\\d\\d", form.replace(".", "[.]"))), value):
            try:
                day = datetime.datetime.strptime(value, form).date()
            except ValueError:
                return None, value
            n = (day - datetime.date(1800, 1, 1)).days
            if not 0 <= n < 146097:
                return None, value
            a, b = permuted(n // DAY_HALVES[1], n % DAY_HALVES[1], *DAY_HALVES, "date")
            new = datetime.date(1800, 1, 1) + datetime.timedelta(a * DAY_HALVES[1] + b)
            return "date", form.replace("%Y", f"{new.year:04}").replace("%m", f"{new.month:02}").replace("%d", f"{new.day:02}")
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", value):
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None, value
        a, b = permuted((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, *ID_HALVES, "national_id")
        area = a // 99 + 1
        return "national_id", f"{area + (area >= 666):03}-{a % 99 + 1:02}-{b + 1:04}"
    if "." in value:
        o = [int(x) for x in value.split(".")]
        a, b = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "host")
        return "host", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if len(value) >= 32:
        return "secret", shifted(value, ["0123456789abcdef"], "secret")
    if luhn(digits):
        return None, value
    body = digits[0] + digit_pair(digits[1:-1], "card")
    return "card", refilled(value, body + str(-luhn(body + "0") % 10))


def brute(text):
    counts = dict.fromkeys(KINDS, 0)
    if text is None:
        return None, counts

    def one(m):
        kind, new = replaced(m.group(0))
        if kind:
            counts[kind] += 1
        return new

    return re.sub("|".join(PATTERNS.values()), one, text, flags=re.ASCII), counts


VALUES = ["4539578763621486", "4539 5787 6362 1486", "4539578763621487", "30569309025904", "1990-02-28", "31.12.1999", "02/30/2001", "02/29/2000", "1600-01-01", "123-45-6789", "667-45-6789", "665-01-0001", "666-45-6789", "900-11-2222", "10.0.255.3", "256.1.1.1", "1.2.3.4.5", "+1 (743) 555-3824", "(743) 555-3824", "+49-743-555-3824", "Jane.Doe99@mail5.example.com", "x@example.org", "0f3a" * 10, "token 12", "2123465659789240", "12345678901234567890"]


def test_every_kind_matches_the_plain_network(spark):
    docs = [(i, f"é {v}, and (again) {v}. End") for i, v in enumerate(VALUES)]
    docs += [(100, " ".join(VALUES)), (101, None), (102, ""), (103, "no numbers"), (104, VALUES[0]), (105, "a" * 50_000 + "@"), (106, "1" * 50_000), (107, "\n".join(VALUES) + "$1 \\1")]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA)
    got = {r.doc_id: (r.text, r.found.asDict()) for r in pseudonymise(frame, KEY, out="found").collect()}
    for d, t in docs:
        text, counts = brute(t)
        assert got[d] == (text, {f"n_{k}": n for k, n in counts.items()}), (d, t and t[:200])
    assert sum(sum(c.values()) for _, c in got.values()) > 50


def test_pseudonyms_are_one_to_one_and_linked(spark):
    values = [f"{a:03}-{b:02}-0001" for a in (1, 665, 667, 899) for b in range(1, 100)]
    rows = [(i, v, None) for i, v in enumerate(values)]
    new = [r.text for r in pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY, out="found").orderBy("doc_id").collect()]
    assert len(set(new)) == len(values) and sum(a == b for a, b in zip(new, values, strict=True)) < 3
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new)


def test_empty_table(spark):
    assert pseudonymise(spark.createDataFrame([], SCHEMA), KEY, out="found").count() == 0


def test_time_grows_with_the_text_not_with_matches_times_length(spark):
    text = " ".join(f"plain words number {i} and so on x{i}@y.example" for i in range(20_000))
    row = pseudonymise(spark.createDataFrame([(1, text, "")], SCHEMA), KEY, out="found").first()
    assert row.found.n_email == 20_000 and row.text.count("@y.example") == 20_000 and len(row.text) == len(text)


def test_session_key_lasts_for_the_session(spark):
    assert session_key(spark) == session_key(spark) and len(session_key(spark)) == 64


def test_columns_named_like_internal_ones_are_kept(spark):
    from stakewise.llm.pii import pseudonymise

    docs = spark.createDataFrame([("mail ann@example.org", "own", "new", "x")], "text string, __found string, __new string, column_1 string")
    out = pseudonymise(docs, key="k").first()
    assert out.asDict()["__found"] == "own" and out.asDict()["__new"] == "new" and out.column_1 == "x"
    assert out.pii.n_email == 1 and "ann@" not in out.text
