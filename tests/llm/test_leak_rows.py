"""Operator 9: recall of its masks, both ways of its join, rows of one id."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from meshloom.llm import decontaminate as D


@pytest.mark.parametrize("words", [8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20])
def test_masks_hit_what_the_check_allows(words):
    most = words - -(-words * D.NUM // D.DEN)
    spots = [sum(1 << (i + o) for o, c in enumerate(mask) if c == "1") for mask in D.MASKS for i in range(words - len(mask) + 1)]
    ways = [sum(1 << i for i in c) for c in combinations(range(words), most)]
    assert sum(any(not s & w for s in spots) for w in ways) >= 0.95 * len(ways)


def both(spark, monkeypatch, docs, bench):
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    found = []
    for rows in (D.BROADCAST_ROWS, 0):
        monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
        kept = D.drop_leaks(docs.withColumns({c: F.lit(1) for c in ("doc", "row", "id", "words", "text_hash", "h", "pos")}), bench)
        found.append((sorted(map(tuple, D.leaks(docs, bench).collect())),
                      sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)))
    assert found[0] == found[1]
    return found[0]


def test_rows_of_one_id(spark, monkeypatch):
    passage, other = (" ".join(f"{c}{i}" for i in range(25)) for c in "pq")
    clean = " ".join(f"c{i}" for i in range(60))
    docs = [(1, clean), (1, clean + " " + passage), (1, passage), (2, passage + " " + passage), (None, passage), (None, clean),
            (3, None), (4, ""), (1, clean)]
    for bench in ([(7, passage), (7, other)], [(7, other), (7, passage), (7, passage), (None, clean), (8, "short item")]):
        leaks, kept = both(spark, monkeypatch, docs, bench)
        assert leaks == [(1, 7, 25, 20, 25, 0), (2, 7, 25, 20, 25, 0)]
        assert kept == sorted([(1, clean), (1, clean), (None, clean), (3, None), (4, "")], key=str)


def test_short_items_with_substitutions(spark, monkeypatch):
    item = [f"w{i}" for i in range(10)]
    docs = []
    for i, (a, b) in enumerate(combinations(range(10), 2)):
        docs.append((i, " ".join(["x", *["sub" if j in (a, b) else w for j, w in enumerate(item)], "y"])))
    leaks, _ = both(spark, monkeypatch, docs, [(1, " ".join(item)), (2, " ".join(f"v{i}" for i in range(8)))])
    assert len(leaks) >= 0.95 * len(docs) and {r[1:4] for r in leaks} == {(1, 8, 8)}


def test_empty_tables(spark, monkeypatch):
    assert both(spark, monkeypatch, [], [(1, "a b c d e f g h i")]) == ([], [])
    assert both(spark, monkeypatch, [(1, "a b")], []) == ([], [(1, "a b")])
