"""Operator 3: the ledger against brute force, policies and ablations by its bits, clashing columns."""

import re

import pytest
from pyspark.sql import functions as F

from meshloom.llm import quality as Q
from test_llm import SF, odd_rows

COLS = "doc_id long, text string"


def brute(t):
    """(measures, bits) of a text."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)] if len(w) >= 8 else []
    covered = set()
    for i, x in enumerate(win):
        if win.count(x) > 1:
            covered.update(range(i, i + 8))
    n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t)
    dup, varied = len(lines) - len(set(lines)), sum(len(set(w[i:i + 1000])) for i in range(0, n, 1000))
    shouts = t.count("!")
    fails = [n < 20, 100 * len(covered) > 30 * n, 10 * symbols > n, chars < 2 * n, chars > 12 * n, 2 * dup > len(lines),
             100 * varied < 30 * n, 4 * shouts > n]
    return (n, chars, symbols, dup, len(covered), len(lines), len(set(w)), shouts), sum(1 << i for i, f in enumerate(fails) if f)


def texts(spark):
    rows = [(i, t) for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()
            if len(t or "") < 20_000]
    return rows + [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 5000] + [(900, "a!!! " * 30), (901, "x y\n" * 40), (902, "# * " * 30)]


def test_ledger_against_brute_force(spark):
    rows = texts(spark)
    got = Q.ledger(spark.createDataFrame(rows, COLS)).collect()
    want = sorted(((i, *m, b) for i, t in rows for m, b in [brute(t)]), key=str)
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("policy", ["base", "v1"])
def test_policies_and_ablations(spark, policy):
    rows = texts(spark)
    docs = spark.createDataFrame(rows, COLS)
    mask, bits = Q.POLICIES[policy], [brute(t)[1] for _, t in rows]
    want = sorted(((i, t) for (i, t), b in zip(rows, bits) if not b & mask), key=str)
    clash = docs.withColumns({c: F.lit(1) for c in ("__m", "entry", "failure_bits", "n_words", "words")})
    assert sorted(map(tuple, Q.keep_passing(clash, policy).select("doc_id", "text").collect()), key=str) == want
    assert Q.keep_passing(clash, policy).columns == clash.columns
    got = {r.rule: (r.fails, r.only_this_rule, r.kept_without) for r in Q.ablations(Q.ledger(docs), policy).collect()}
    assert got == {n: (sum(bool(b & x) for b in bits), sum(b & mask == x for b in bits), sum(not b & mask & ~x for b in bits))
                   for n, x in Q.BITS.items() if x & mask}
