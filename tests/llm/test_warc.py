"""Archives: exact round trips, also over tiny byte ranges, with magic and blank lines inside payloads."""

import hashlib
import re
from base64 import b32encode

import pytest

from stakewise.llm.common import new_folder
from stakewise.llm.warc import read_warc, round_trip, write_warc

SCHEMA = "page_id long, url string, html string, file string"
RECORD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nHTTP/\r\n\r\n"
PAYLOADS = ["", "plain", "\r\n", "\r\n\r\n", "end\r\n", "\r\n\r\n\r\nx", "a\r\n\r\n" + RECORD * 3 + "b", "\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\n", "é\x00ü" * 300, RECORD, "x" * 5000 + "\r\n\r\n" + RECORD + "\r", "\r", "\n", None]


def expected(rows):
    best = {}
    for i, _, html, _ in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = best.get(html or "")
        refers = first if i is not None and i < first else None
        out.append((i, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def pages():
    rows = [(i, f"http://x/{i} \r\ny", PAYLOADS[i % len(PAYLOADS)], "f") for i in range(3 * len(PAYLOADS))]
    return rows + [(1000 + i, None, f"page {i} {RECORD} {PAYLOADS[i % len(PAYLOADS)]}", None) for i in range(60)] + [(None, "u", "plain", "f"), (5, "http://x", PAYLOADS[5], "f")]


@pytest.mark.parametrize("size", ["128m", "2000", "61"])
def test_round_trip(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    rows = pages() if size != "61" else pages()[:14]
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
        assert found(round_trip(spark, df)) == expected(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_payloads_come_back_and_broken_tails_do_not(spark):
    rows = [(i, "u", f"<p>{i}</p>\r\n\r\n{RECORD}", None) for i in range(5)]
    path = new_folder(spark, "warc")
    write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    assert {r.page_id: r.payload.decode() for r in read_warc(spark, path).collect()} == {r[0]: r[2] for r in rows}
    text = "".join(spark.read.text(path, wholetext=True).toPandas().value)
    cut_path = new_folder(spark, "warc")
    heads = [m for m in re.finditer(r"WARC-Record-ID: <urn:page:(\d)>", text)]
    broken = text[: heads[2].start()] + "X" + text[heads[2].end() :].replace("Content-Length", "Length")
    spark.createDataFrame([(broken,)], "value string").coalesce(1).write.option("lineSep", "|").text(cut_path)
    assert sorted(r.page_id for r in read_warc(spark, cut_path).collect()) == sorted(int(m[1]) for m in heads[:2])


def test_empty_table(spark):
    assert found(round_trip(spark, spark.createDataFrame([], SCHEMA))) == []
