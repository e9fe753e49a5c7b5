"""Operators 4 and 7: the query against brute force, odd tables and clashing columns."""

import hashlib

from pyspark.sql import functions as F

from meshloom.llm import pii, urlfilter
from meshloom.llm.queries import QUERIES
from test_llm import SF, brute_pii

ORDER = {k: i for i, k in enumerate(pii.KINDS)}


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (ORDER[x[0]], *x[1:])))


def test_query_against_regular_expressions(spark):
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op4_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id] or ""
        base, added = brute_pii(t), pii.find(t)[1]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert r.spans == joined(base + added) and r.n_added == len(added)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base + added) for x in pii.KINDS]


def test_personal_data_of_odd_rows(spark):
    rows = [(1, "a@b.com"), (1, "a@b.com"), (None, "bob (at) mail (dot) com"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "found", "kind")})
    got = sorted((str(r.doc_id), [(x.kind, x.start, x.end, x.added) for x in r.found]) for r in pii.personal_data(docs).collect())
    assert got == [("1", [("email", 0, 7, False)])] * 2 + [("2", []), ("3", []), ("None", [("email", 0, 23, True)])]


def test_urls_of_odd_rows(spark):
    cols = "page_id long, url string, html string"
    rows = [(1, "http://x.net/a", None), (1, "http://x.net/a", None), (None, "http://y.org/fr/", "<p>" * 200_000), (2, None, ""), (3, "plain", "x")]
    pages = spark.createDataFrame(rows, cols).withColumns({c: F.lit("1") for c in ("node", "d", "host", "rule", "alias_blocked", "src")})
    got = sorted(map(str, urlfilter.judge(pages).select("page_id", "host", "rule", "verdict").collect()))
    want = [(1, "x.net", "net/", "block")] * 2 + [(None, "y.org", "org/fr/", "allow"), (2, "", None, "allow"), (3, "", None, "allow")]
    assert got == sorted(f"Row(page_id={i!r}, host={h!r}, rule={r!r}, verdict={v!r})" for i, h, r, v in want)
    assert urlfilter.judge(spark.createDataFrame([], cols)).count() == 0


def test_rules_of_equal_length(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/", None)], "page_id long, url string, html string")
    verdict = lambda rules: urlfilter.judge(pages, rules).first()
    assert verdict((("b.c", "/", "allow"), ("b.c", "/", "block"))).verdict == "block"
    assert verdict((("a.b.c", "/", "allow"), ("b.c", "/", "block"))).verdict == "allow"
