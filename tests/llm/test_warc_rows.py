"""Operator 6 against brute force: repeated rows and ids, both ways of its join, odd tables."""

import base64
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meshloom.llm import warc
from meshloom.llm.queries import QUERIES

COLS = "page_id long, url string, html string"


def brute(rows):
    least = defaultdict(list)
    for i, _, h in rows:
        least[h or ""].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in least[h or ""] if x is not None]
        first = min(ids) if ids else None
        again = first is not None and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                    first if again else None))
    return sorted(out, key=str)


ROWS = [(3, "u", "a"), (5, "u", "a"), (5, "v", "b unique payload"), (3, "w", "a"), (None, None, "a"), (None, "x", "only nulls"),
        (None, "y", "only nulls"), (7, "z", None), (2, "z", ""), (9, "long", "é<p>" * 300_000), (4, "t", "a\r\n\r\nb"), (4, "t", "a\r\n\r\nb")]


@pytest.mark.parametrize("broadcast", [0, warc.BROADCAST_ROWS])
def test_every_row_keeps_its_payload(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    pages = spark.createDataFrame(ROWS, COLS).withColumns({c: F.lit(1) for c in ("id", "mark", "first", "n", "package", "payload")})
    out = warc.read_packages(warc.write_packages(pages)).collect()
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute(ROWS)
    kept = {(r.id, bytes(r.payload).decode()) for r in out if r.record_type == "response"}
    assert kept == {(i, h or "") for (i, _, h) in ROWS} - {(5, "a"), (None, "a"), (7, "")}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op6_warc"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert warc.read_packages(warc.write_packages(spark.createDataFrame([], COLS))).count() == 0
