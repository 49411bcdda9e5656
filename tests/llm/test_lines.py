"""Line dedup against brute force: every pair of lines compared, classes by union-find."""

import random

from pyspark.sql import functions as F

from stakewise.llm.lines import CROWDED, dedup_lines, edit_distance

SCHEMA = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, min_chars=20):
    places = [(d, i, x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n")) if len(x) >= min_chars]
    lines = sorted({x for *_, x in places})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = dict.fromkeys(lines, 0)
    for i, x in enumerate(lines):
        for y in lines[i + 1 :]:
            if abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1:
                degree[x] += 1
                degree[y] += 1
                root[find(x)] = find(y)
    home = {}
    for d, i, x in sorted(places):
        home.setdefault(find(x), (d, i))
    out = {}
    for d, t in docs:
        if t is None:
            out[d] = (None, 0, 0, [])
            continue
        own = t.split("\n")
        removed = [(i, *home[find(x)]) for i, x in enumerate(own) if len(x) >= min_chars and home[find(x)] != (d, i)]
        gone = {i for i, *_ in removed}
        out[d] = ("\n".join(x for i, x in enumerate(own) if i not in gone), len(own), sum(degree.get(x, 0) for x in own), removed)
    return out


def run(spark, docs):
    rows = dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.text, r.line_dedup.n_lines, r.line_dedup.n_links, [tuple(x) for x in r.line_dedup.removed]) for r in rows}


def variant(rng, line):
    at, kind = rng.randrange(len(line)), rng.randrange(4)
    if kind == 0:
        return line[:at] + rng.choice("abé") + line[at + 1 :]
    if kind == 1:
        return line[:at] + line[at + 1 :]
    if kind == 2:
        return line[:at] + rng.choice("abz") + line[at:]
    return line[:at] + "XY" + line[at + 2 :]


def test_edit_distance_is_exact_up_to_the_threshold(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(4, 12)))
        b = a
        for _ in range(rng.randrange(4)):
            b = variant(rng, b) if len(b) > 4 else b
        pairs.append((a, b))
    frame = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 3):
        for r in frame.select("a", "b", edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect():
            want = distance(r.a, r.b)
            assert r.d == want if want <= most else r.d > most, (r, want, most)


def test_random_lines_match_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefg é") for _ in range(rng.randrange(20, 45))) for _ in range(12)]
    pool = base + [variant(rng, x) for x in base for _ in range(4)] + ["short", ""]
    docs = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7)))) for d in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 5000), (104, "x" * 5001)]
    assert run(spark, docs) == brute(docs)


def test_crowded_segments_are_split_not_paired(spark):
    rng = random.Random(3)
    line = "the same beginning of a boilerplate line, number "
    many = [line + str(rng.randrange(10**6)).zfill(6) for _ in range(12 * CROWDED)] + [line + "12345" + c for c in "abcdefghijklmnopqrstuvwxyz"] + [line + "12345"]
    many += [line[:9] + c + line[9:] for c in "abcdefghijklmnopqrstuvwxyz"] + [line]
    docs = [(i, x) for i, x in enumerate(many)]
    assert run(spark, docs) == brute(docs)


def test_extra_columns_repeats_and_empty_tables(spark):
    rows = [(1, "a line that is long enough", "x"), (1, "a line that is long enough", "x"), (None, "a line that is long enougH", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = dedup_lines(frame).collect()
    assert sorted((r.doc_id or 0, r.text, r.key) for r in out) == [(0, "a line that is long enougH", "y"), (1, "", "x"), (1, "", "x")]
    assert dedup_lines(frame.filter("false")).count() == 0


def test_exact_copies_of_short_lines_are_removed(spark):
    line = "a line that is long enough"
    docs = [(1, f"And ornd.\n\n{line}\n}}"), (2, f"And ornd.\n\n{line}s\nAnd ornD."), (3, "}\n \n\nAnd ornd.\n \n}"), (4, None), (5, "")]
    found = {r.doc_id: (r.text, r.line_dedup.n_links, [tuple(x) for x in r.line_dedup.removed]) for r in dedup_lines(spark.createDataFrame(docs, SCHEMA), short_copies=True).collect()}
    assert found == {
        1: (docs[0][1], 1, []), 2: ("\nAnd ornD.", 1, [(0, 1, 0), (2, 1, 2)]), 3: (" \n\n ", 0, [(0, 1, 3), (3, 1, 0), (5, 1, 3)]), 4: (None, 0, []), 5: ("", 0, []),
    }


def test_the_query_and_the_pipeline_leave_no_copies_of_short_lines(spark, tmp_path):
    import corpus_pipeline
    from stakewise.llm.queries import QUERIES

    docs = [(i, f"And ornd.\nthe text number {i} {'abcdefgh'[i] * 20}", 50) for i in range(8)]
    frame = spark.createDataFrame(docs, SCHEMA + ", n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (QUERIES["op10_lines"](spark, str(tmp_path)), corpus_pipeline.lines(spark, frame, str(tmp_path))):
        assert sum(r.text.startswith("And ornd.") for r in out.collect()) == 1


def test_string_ids(spark):
    frame = spark.createDataFrame([("b", "a line of twenty and more\nother"), ("a", "a line of twenty and more"), (None, "third")], "doc_id string, text string")
    rows = {r.doc_id: r for r in dedup_lines(frame, short_copies=True).collect()}
    assert rows["b"].text == "other" and [tuple(x) for x in rows["b"].line_dedup.removed] == [(0, "a", 0)] and rows["a"].text and rows[None].text == "third"
