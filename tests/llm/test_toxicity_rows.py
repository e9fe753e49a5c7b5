"""Operator 10: features against window-by-window compression, the query on held-out rows."""

import zlib

import numpy as np

from meshloom.llm import toxicity as T
from meshloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_features_are_lengths_window_by_window():
    rng = np.random.default_rng(6)
    words = [f"w{i}ord{i * 7 % 13}" for i in range(60)]
    text = lambda n: " ".join(words[int(i)] for i in rng.integers(0, 60, n))
    plain, toxic = T._squeezer(text(400).encode()), T._squeezer((text(80) + " foulterm meanword ").encode() + text(400).encode())
    texts = [b"", b"x", text(5).encode(), (text(40) + " foulterm " + text(30)).encode(), b"y" * 5000, text(3000).encode() + b" meanword"]
    got = T.features(texts, plain, toxic)
    for t, row in zip(texts, got):
        buf, spans, owner = T._windows([t])
        assert not len(spans) or (owner == 0).all() and max(n for _, n in spans) <= 2 * T.WINDOW
        covered = np.zeros(len(buf), bool)
        gains = []
        for s, n in spans.tolist():
            covered[s:s + n] = True
            w = buf[s:s + n]
            gains.append(max(0, len(plain.compress(w)) - len(toxic.compress(w))))
        assert not t or covered.all()
        want = [max(gains, default=0)] + [np.log1p(sum(g >= x for g in gains)) if gains else 0 for x in T.LEVELS]
        assert np.allclose(row, want)


def test_query_on_rows_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_training_takes_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b text"), (1, "a text"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    assert T.labelled(docs, labels, labels.doc_id.isNull() | labels.doc_id.isNotNull()) == [(1, "a text", 1)]
