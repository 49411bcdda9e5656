"""Quality counts against a plain reading of their definitions, and the compression bands."""

import base64
import random
import re

import zstandard

from stakewise.llm.quality import BANDS, CHUNK_BYTES, CHUNK_SHARE, LEVEL, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, places = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            places.update(j for i in starts for j in range(i, i + 8))
    failed = len(words) < 20 or 100 * len(places) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(places), failed


def texts():
    rng = random.Random(1)
    prose = [" ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "." for n in (25, 60, 300, 1500)]
    out = [None, "", " \t\n", "one", "a b\na b\n\n \na b\r\n", "é ü x y " * 12, "| # <>&$%* " * 5, *prose]
    out += [prose[1] + "\n" + prose[1], prose[2][:900] + " " + prose[2][:200], "word " * 400, "\x0b".join(prose), "x" * 100_000, prose[3] + " " + "spam and eggs " * 3000]
    out.append("".join(chr(rng.randrange(33, 0x2FFF)) for _ in range(9000)))
    return out


def test_counts_match_the_definitions(spark):
    docs = list(enumerate(texts()))
    rows = quality_rules(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, kept long"), out="found").collect()
    for r in rows:
        f, text = r.found, dict(docs)[r.doc_id]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed) == brute(text), text and text[:60]
        assert not (f.base_failed and f.kept)


def test_bands_keep_prose_and_reject_extremes(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    prose = [" ".join(rng.choices(vocabulary, k=n)) for n in (30, 100, 1000, 5000)]
    loops = [" ".join(f"{w} {i % 7}" for i in range(k) for w in ("buy", "cheap", "now", str(i % 13))) for k in (300, 3000)]
    noise = ["".join(chr(rng.randrange(0x100, 0x2000)) + (" " if rng.random() < 0.1 else "") for _ in range(n)) for n in (3000, 30000)]
    half = prose[3] + " " + " ".join(f"row {i % 3} of the table" for i in range(3000))
    rows = {r.doc_id: r.rules for r in quality_rules(spark.createDataFrame(list(enumerate([*prose, *loops, *noise, half])), "doc_id long, text string")).collect()}
    assert all(rows[i].kept for i in range(4))
    assert not any(rows[i].kept for i in range(4, 9))
    assert rows[3].chunks == len(prose[3].encode()) // CHUNK_BYTES


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_junk_tails_and_short_noise_are_rejected(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]

    def words(size, word):
        out = ""
        while len(out) < size:
            out += word() + " "
        return out[:size]

    sizes = (200, 400, 800, 4095, 20_000)
    prose = [words(n, lambda: rng.choice(vocabulary)) for n in sizes]
    encoded = [words(n, lambda: base64.b64encode(rng.randbytes(rng.randrange(3, 9))).decode().rstrip("=")) for n in sizes]
    digits = [words(n, lambda: rng.randbytes(rng.randrange(2, 6)).hex()) for n in sizes]
    half = words(CHUNK_BYTES, lambda: rng.choice(vocabulary))
    tails = [half + words(4000, word) for word in (lambda: base64.b64encode(rng.randbytes(6)).decode(), lambda: rng.randbytes(4).hex(), lambda: "again")]
    whole = [*prose, half + prose[3], prose[4] + " " + "a7 " * 3]
    rows = quality_rules(spark.createDataFrame(list(enumerate([*whole, *encoded, *digits, *tails])), "doc_id long, text string")).collect()
    kept = {r.doc_id for r in rows if r.rules.kept}
    assert kept == set(range(len(whole)))
    found = {r.doc_id: r.rules for r in rows}
    assert all(found[i].tail_out and found[i].chunks == 1 for i in range(len(rows) - 3, len(rows)))
    assert found[5].tail_out is False


def brute_verdict(text):
    """(ratio, whole chunks out, tail out, kept) by plain slices, one chunk after another."""
    data = (text or "").encode()
    if not data:
        return None, 0, False, False

    def out(piece):
        band = [b for b in BANDS if b[0] <= len(piece)][-1]
        ratio = len(zstandard.ZstdCompressor(level=LEVEL).compress(piece)) / len(piece)
        hexadecimal = sum(len(w) for w in re.findall(rb"[0-9A-Za-z]+", piece) if re.fullmatch(rb"[0-9A-Fa-f]+", w) and re.search(rb"[0-9]", w) and re.search(rb"[A-Fa-f]", w))
        digits = sum(48 <= c <= 57 for c in piece)
        return not band[1] <= ratio <= band[2] or (10 * digits >= len(piece) and hexadecimal >= 0.3 * len(piece))

    pieces = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    bad = sum(len(p) for p in pieces if out(p))
    whole = [p for p in pieces if len(p) == CHUNK_BYTES]
    tail_out = len(pieces[-1]) < CHUNK_BYTES and out(pieces[-1])
    kept = not brute(text)[-1] and not out(data) and bad <= CHUNK_SHARE * len(data)
    return len(zstandard.ZstdCompressor(level=LEVEL).compress(data)) / len(data), sum(map(out, whole)), tail_out, kept


def test_verdicts_match_brute_force(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randrange(2, 10))) for _ in range(2000)]
    made = texts()
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            n, kind = rng.randrange(10, 700), rng.randrange(5)
            parts.append(" ".join({0: lambda: rng.choice(vocabulary), 1: lambda: rng.choice(vocabulary), 2: lambda: rng.randbytes(3).hex(), 3: lambda: base64.b64encode(rng.randbytes(6)).decode(), 4: lambda: "spam"}[kind]() for _ in range(n)))
        made.append("\n".join(parts))
    docs = dict(enumerate(made))
    rows = quality_rules(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.rules.ratio, r.rules.chunks_out, bool(r.rules.tail_out), r.rules.kept) for r in rows}
    assert got == {d: brute_verdict(t) for d, t in docs.items()}
    assert 5 < sum(x[-1] for x in got.values()) < len(docs) - 5
