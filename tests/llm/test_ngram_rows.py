"""Operator 1 on repeated ids, skew and links counted one by one."""

import numpy as np
from pyspark.sql import functions as F

from meshloom.llm import ngram_join
from meshloom.llm.queries import QUERIES

from test_llm import SF, tokens


def brute(rows, k=4, num=85, den=100):
    """(id, n_shingles, n_links, component_id) for rows (id, text), each a node of its own."""
    sets = []
    for _, t in rows:
        w = tokens(t)
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else
                    frozenset([tuple(w)]) if w else frozenset())
    links = [[] for _ in rows]
    by = {}
    for a, s in enumerate(sets):
        for b in {b for x in s for b in by.get(x, ())}:
            i = len(s & sets[b])
            if den * i >= num * (len(s) + len(sets[b]) - i):
                links[a].append(b)
                links[b].append(a)
        for x in s:
            by.setdefault(x, []).append(a)
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((i, len(sets[a]), len(links[a]), min(rows[b][0] for b in seen)))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in df.collect())


def test_repeated_ids_keep_their_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, a), (4, b)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got) == brute(rows)


def test_whole_table_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op1_ngram_jaccard_join"](spark, SF)) == brute(rows)


def skewed(n=700):
    """A passage in a third of the texts, and a family of many different near copies."""
    rng = np.random.default_rng(11)
    passage = " ".join(f"common{i}" for i in range(40))
    family = [f"kin{i}" for i in range(80)]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, passage + " " + " ".join(f"own{x}" for x in rng.integers(0, 4000, 6 + i % 9))))
        elif i % 3 == 1:
            w = list(family)
            w[int(rng.integers(80))] = f"odd{i}"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(f"x{x}" for x in rng.integers(0, 4000, 30))))
    return rows


def test_skew_keeps_every_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 8)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 16)
    monkeypatch.setattr(ngram_join, "TASK_QUERIES", 50)
    rows = skewed()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(ngram_join.jaccard_classes(docs)) == want
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "MAX_HOT", 3)
    assert result(ngram_join.jaccard_classes(docs)) == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("id", "fp", "n", "token", "group_id", "rep", "salt")})
    assert result(ngram_join.jaccard_classes(docs)) == [(1, 3, 1, 1), (2, 3, 1, 1)]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(0, a + " more", "x"), (1, a, "x"), (1, b, "y"), (1, b, "x"), (5, "", "x"), (5, "", "y"), (6, None, "z"),
            (None, a, "n"), (2, b, "z"), (7, "two words", "x"), (8, "two words", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    want = [rows[i] for i in (0, 3, 4, 5, 6, 7, 9)]
    assert sorted(map(tuple, ngram_join.keep_one(docs).collect()), key=str) == sorted(want, key=str)


def test_overlaps_by_pairs_and_by_product(monkeypatch):
    rng = np.random.default_rng(9)
    make = lambda n: [np.unique(rng.integers(0, 60, int(rng.integers(0, 40))).astype(np.uint64)) for _ in range(n)]
    one, two = make(30), make(20)
    for dense in (1, 8, 100):
        monkeypatch.setattr(ngram_join, "DENSE", dense)
        assert (ngram_join._common(one, two) == [[len(np.intersect1d(a, b)) for b in two] for a in one]).all()
        inner = np.array([[len(np.intersect1d(a, b)) for b in one] for a in one])
        up = np.triu_indices(30, 1)
        assert (ngram_join._common(one, None)[up] == inner[up]).all()
