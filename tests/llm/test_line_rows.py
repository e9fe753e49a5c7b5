"""Operator 5 against brute force: spread near the threshold, repeated ids, null ids, clashing columns."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import linededup

COLS = "doc_id long, text string, source string"


def brute(rows, least=linededup.MIN_SITES):
    """(id, text, n_cut) of rows (id, text, site)."""
    sites, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
                texts[x.strip(" ")].add(t)
    bad = {x for x in sites if len(sites[x]) >= least and len(texts[x]) >= least}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        n = sum(x.strip(" ") in bad for x in lines)
        out.append((i, "\n".join(x for x in lines if x.strip(" ") not in bad) if n else t, n))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.text, r.n_cut) for r in df.collect()), key=str)


def test_spread_around_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        lines = [f"line {k}" for k in range(30) if rng.random() < (k + 1) / 60] + [f"own {i}"]
        rows.append((i, "\n".join(lines), f"s{int(rng.integers(0, 4 + i % 9))}"))
    rows += [(1000 + i, f"few\nsites {i}", "hot") for i in range(300)]
    assert result(linededup.strip_boilerplate(spark.createDataFrame(rows, COLS))) == brute(rows)


def test_many_sites(spark):
    rows = [(i, f"everywhere\nown {i}\n {'pair' if i % 2 else 'other'} ", f"s{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, COLS)
    assert result(linededup.strip_boilerplate(docs)) == brute(rows)
    got = linededup.boilerplate(docs).collect()
    assert sorted(round(r.sites / 100) for r in got) == [3, 3, 6]


def test_sketches_are_merged_before_and_after_the_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb", "s")], COLS)
    seen = []

    class Shelf(linededup.Shelf):
        def put(self, name, df):
            seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return super().put(name, df)

    linededup.boilerplate(docs, shelf=Shelf(spark, "t")).collect()
    plan = dict(seen)["spread"]
    assert plan.index("hll_sketch_agg") < plan.index("Exchange") < plan.index("partial_hll_sketch_agg")
    assert "distinct" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("least", [3])
def test_repeated_ids_null_ids_and_copies(spark, least):
    rows = [(1, "keep me\nmenu\nend", "a"), (1, "menu\nonly here\nmenu", "b"), (1, "keep me\nmenu\nend", "a"), (2, "x\nmenu", "c"),
            (None, "menu\nno id", "d"), (None, "other\n menu", None), (3, None, "e"), (4, "", "f"), (5, "menu", "g")]
    docs = spark.createDataFrame(rows, COLS)
    assert result(linededup.strip_boilerplate(docs, min_sites=least)) == brute(rows, least)
    clash = docs.withColumns({c: F.lit(7) for c in ("n_cut", "id", "whole", "cut", "row", "h", "salt", "pos", "site", "own_id")})
    got = linededup.strip_boilerplate(clash, min_sites=least)
    assert result(got) == brute(rows, least) and got.columns == [*clash.columns[:3], *clash.columns[4:], "n_cut"]
