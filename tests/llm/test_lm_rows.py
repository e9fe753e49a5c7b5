"""Operator 8: scores against a dictionary-made bigram model, pointers, wide counts, odd tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import lm
from meshloom.llm.queries import QUERIES
from test_llm import SF, tokens

COLS = "doc_id long, text string"


class Brute:
    """The model by dictionaries; shards of contexts are ranges of word hashes, then of
    bigrams in order of their hashes."""

    def __init__(self, texts, log):
        self.c, self.b, self.t = Counter(), Counter(), Counter()
        for x in texts:
            w = [*tokens(x), None]
            h = [None, *w[:-1]]
            self.c.update(w)
            self.b.update(zip(h, w))
            self.t.update(zip(h, w, w[1:]))
        self.n, self.v = sum(self.c.values()), len(self.c)
        hashed = {w: int(lm.END if w is None else lm._tokens([w])[0][0]) for w in self.c}
        order = sorted(self.b, key=lambda k: (hashed[k[0]], hashed[k[1]]))
        per = -(-len(order) // (1 << log))
        self.shard = [{w: x >> (64 - log) for w, x in hashed.items()}, {k: i // per for i, k in enumerate(order)}]
        self.levels = [self.level(self.b, self.shard[0], 1, self.plain, lambda h: self.c[h])]
        self.levels.append(self.level(self.t, self.shard[1], lm.KEPT, None, lambda h: self.b[h]))

    def level(self, grams, shard, least, plain, total):
        """(probabilities, log10 of backoff weights) of a level."""
        split = lambda k: (k[0], k[1]) if len(k) == 2 else (k[:2], k[2])
        seen = {}
        for k, n in grams.items():
            x = seen.setdefault(shard[split(k)[0]], [0, 0])
            x[0] += n == 1
            x[1] += n == 2
        p, left, rest = {}, Counter(), Counter()
        for k, n in grams.items():
            h, w = split(k)
            if n >= least:
                p[h, w] = min(1.0, (n - lm._discount(*seen[shard[h]])) / total(h))
                left[h] += p[h, w]
                rest[h] += 10 ** (plain(w) if plain else self.second(h[1], w))
        return p, {h: math.log10(max(1 - left[h], 1e-12) / max(1 - rest[h], 1e-12)) for h in left}

    def plain(self, w):
        return math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def second(self, h, w):
        p, back = self.levels[0]
        return math.log10(p[h, w]) if (h, w) in p else back.get(h, 0.0) + self.plain(w)

    def score(self, x):
        w = [*tokens(x), None]
        total = self.second(None, w[0])
        p, back = self.levels[1]
        for h2, h1, y in zip([None, *w[:-2]], w, w[1:]):
            h = (h2, h1)
            total += math.log10(p[h, y]) if (h, y) in p else back.get(h, 0.0) + self.second(h1, y)
        return total


def test_query_against_dictionaries(spark):
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    train = [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 10]
    brute = Brute(train, max(2, (max(1, len(train)) // lm.SHARD_TEXTS).bit_length()))
    for r in QUERIES["op8_lm_scoring"](spark, SF).collect():
        n = r.n_tokens  # a probability is stored in steps of 0.00025
        assert abs(r.score - brute.score(docs[r.doc_id])) <= 3e-4 * n + 1e-6


def test_bigrams_are_found_through_the_pointers(spark):
    texts = [(i, f"left{i % 7} right{i % 5} left{i % 3}") for i in range(100)]
    meta = lm.fit(spark.createDataFrame(texts, COLS))
    t = lm.Trie(meta)
    ids = np.arange(t.size)
    ctx, word = np.repeat(ids, t.size), np.tile(ids, t.size)
    plain = t.plain(t.counts(word))
    want = t.scores(ctx, word, plain)
    seen = want > plain + 0.3
    assert seen.any()
    for s in t.paired:  # pointers that are all the same, or moved by one context, lose the successors
        point, nxt, prob, backoff, discount = t._pairs(s)
        values = point.get(np.arange(point.n))
        for wrong in (np.full_like(values, values[-1]), np.append(values[1:], values[-1])):
            t.open[f"pairs-{s}"] = (lm.EliasFano.of(wrong, nxt.n + 1), nxt, prob, backoff, discount, 0)
            own = t.shard_of(ctx) == s
            lost = t.scores(ctx[own], word[own], plain[own])
            assert (lost[seen[own]] < want[own][seen[own]]).any()
        t.open[f"pairs-{s}"] = (point, nxt, prob, backoff, discount, 0)


def test_search_stays_in_its_range():
    e = lm.EliasFano.of(np.array([3, 3, 8, 900, 901, 5000], np.uint64), 6000)
    x = np.array([3, 3, 8, 900, 901, 5000, 5000], np.uint64)
    since, until = np.array([0, 1, 3, 0, 4, 5, 0]), np.array([1, 2, 6, 4, 5, 6, 5])
    assert e.find(x, since, until).tolist() == [0, 1, -1, 3, 4, 5, -1]


def test_counts_beyond_32_bits():
    keys, counts = np.array([4, 9, 2 ** 63], np.uint64), np.array([1, 2 ** 40 + 3, 7])
    for c in (counts, np.array([1, 2, 3])):
        got = lm._unpack(lm._pack(keys, c))
        assert (got[0] == keys).all() and (got[1] == c).all()
    assert lm._merged([lm._pack(keys, np.full(3, 2 ** 32 - 1))] * 3)[1].tolist() == [3 * (2 ** 32 - 1)] * 3


def test_shards_read_from_a_store_are_given_up(spark, monkeypatch):
    meta = lm.fit(spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(300)], COLS))
    texts = [f"a{i} b{i} x".encode() for i in range(300)]

    def scored():
        t = lm.Trie(meta)
        ids = t.ids(lm._tokens(texts)[0])
        return t, t.scores(np.append([-1], ids[:-1]), ids, t.plain(t.counts(ids))).tolist()

    _, want = scored()
    real = lm._load
    monkeypatch.setattr(lm, "_load", lambda p: (*real(p)[:2], 1000))
    monkeypatch.setattr(lm, "HELD_BYTES", 2500)
    t, got = scored()
    assert got == want and len(t.open) <= 2


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (2, "")]])
def test_nothing_to_learn_from(spark, rows):
    meta = lm.fit(spark.createDataFrame(rows, COLS))
    docs = spark.createDataFrame([(1, "new words"), (None, None), (1, "new words")], COLS).withColumns(
        {c: F.lit(1) for c in ("id", "score", "bucket", "blob")})
    out = lm.score(docs, meta).collect()
    assert len(out) == 3 and all(math.isfinite(r.score) for r in out) and lm.score(docs.limit(0), meta).count() == 0


def test_trigrams_are_found_through_the_pointers(spark):
    texts = [(i, f"a{i % 3} b{i % 2} c{i % 3}" + f" rare{i}" * (i % 5 == 0)) for i in range(120)]
    t = lm.Trie(lm.fit(spark.createDataFrame(texts, COLS)))
    word = lambda *w: t.ids(lm._tokens([x.encode() for x in w])[0][::2])
    pair, _ = t.bigrams(word("a0", "a1", "c0"), word("b0", "b1", "a0"))
    assert (pair[:2] >= 0).all() and pair[2] == -1
    last = word("c0", "c1", "c2")
    low = np.full(3, -9.0)
    for k in (0, 1):
        got = t.third(np.full(3, pair[k]), last, low)
        assert (got > -2).tolist() == [c % 3 == k for c in range(3)]
    ids, plain = np.arange(t.size), t.plain(t.counts(np.arange(t.size)))
    middle, count = t.parts(pair[:2])
    assert (middle == word("b0", "b1")).all() and count.tolist() == [20, 20]
    total = 10 ** t.third(np.full(t.size, pair[0]), ids, t.scores(np.full(t.size, middle[0]), ids, plain))
    assert 0.97 < total.sum() < 1.01
    assert sum(t._triples(s)[1].n for s in t.tripled) == sum(n >= lm.KEPT for n in Counter(
        g for _, x in texts for w in [[None, *x.split(), None]] for g in zip(w, w[1:], w[2:])).values())
