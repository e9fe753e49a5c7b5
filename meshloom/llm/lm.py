"""Operator 8 - n-gram language model in an Elias-Fano trie.

Learning. Tasks count words (64-bit hashes, per-text end included), bigrams, then
trigrams in memory-bounded batches and emit sorted, delta-coded, compressed blobs of
(key, count), each for one range or hash bucket of keys; a bucket's blobs are merged by
one task. The number of buckets follows the number of texts, so a merge stays small, and
bigrams and trigrams are dealt by a hash of the whole key, so a word that is a third of
all tokens is no hot key. Every bigram is kept, and every trigram seen KEPT times or more;
all are counted.

Trie. Level 1 holds every word of the training texts: per shard an Elias-Fano
sequence of sorted hashes (a word's rank is its id) and exact counts. Level 2 holds, per
word, the ids of its successors, level 3, per bigram (by its rank in level 2), the ids of
its successors, both with quantised log probabilities and backoff weights: monotone
pointers from contexts to ranges and the successors as one monotone sequence per shard,
both Elias-Fano. Shards are files in the shared folder that every task maps into memory;
nothing is unpacked.

Querying. A batch's distinct words are found in level 1. A context's two pointers give
the range of its successors, and a word is searched in that range only. The score backs
off: p(w|h) = (c(hw) - D) / c(h) if seen, else b(h) p(w|h'), where h' is h without its
first word, and p(w) the additive estimate of the base score; b(h) normalises what is
left. D = n1 / (n1 + 2 n2) is fitted for each shard, n1 and n2 its n-grams seen once and
twice, trigrams that aren't kept among them. Nothing reaches over the end of a text.

Measured on sf0.1 as held-out log10 a token: base -4.25, bigrams -3.54, with the trigrams
kept -3.41, with all trigrams -3.21. Those seen once are 87 % of the trigrams; with them
a second shuffle and the files hold eight times as much, which the limits do not allow.

Null and empty texts are the end token alone, texts of any length are read whole. A null
id counts as held out. Repeated rows count each, in learning and in scoring; ties need
no rule. Learning from an empty table gives a trie without words, under which every
token has the additive estimate alone; scoring one gives no rows. Other columns are
unused, so their names cannot clash. Words are known by 64-bit hashes; among N distinct
words N^2 / 2^65 pairs of equal hashes are expected.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table
from .words import U, chunks, mix, word_hashes

END = U(0x5B1D0F0E9E3779B9)
#: Bounds of the fitted discount, for shards with too few bigrams to fit it.
DISCOUNTS = 0.1, 0.9
#: Texts for each shard, and tokens that a task counts before it emits.
SHARD_TEXTS = 4096
BATCH_TOKENS = 2 << 20
#: Bytes of shards a worker holds where the shared folder cannot be mapped.
HELD_BYTES = 256 << 20
#: Quantisation: steps of a 16-bit code over log10 values down to LOWEST.
LOWEST = -16.0
#: Zeros between two hints of a select.
HINT_BITS = 7
HINT = 1 << HINT_BITS
#: Trigrams seen less often are counted, but not kept.
KEPT = 2
_STEP = -LOWEST / 65535
MIX1 = U(0x9E3779B97F4A7C15)


def quantise(logs: np.ndarray, top: float = 0.0) -> np.ndarray:
    return np.clip(np.rint((top - logs) / _STEP), 0, 65535).astype(np.uint16)


def dequantise(codes: np.ndarray, top: float = 0.0) -> np.ndarray:
    return top - codes.astype(np.float64) * _STEP


class EliasFano:
    """A non-decreasing sequence of 64-bit integers: low bits packed, high bits
    in unary with a rank directory of one count for each 64 bits."""

    FIELDS = ("low", "high", "zeros")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros
        self.words = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,))
        self.hint: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        v = values.astype(np.uint64)
        shifts = np.arange(bits, dtype=np.uint64)
        low = [np.empty(0, np.uint8)]
        for lo in range(0, n, 1 << 16):
            low.append(((v[lo:lo + (1 << 16), None] >> shifts) & U(1)).astype(np.uint8).ravel())
        low_bytes = np.packbits(np.concatenate(low), bitorder="little")
        low_bytes = np.concatenate((low_bytes, np.zeros(8, np.uint8)))
        tops = (v >> U(bits)).astype(np.int64)
        buckets = (universe >> bits) + 2
        flags = np.zeros(-(-(n + buckets) // 64) * 64, np.uint8)
        flags[tops + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        zeros = np.cumsum(64 - np.bitwise_count(high).astype(np.int64)).astype(np.uint32)
        return cls(n, bits, low_bytes, high, zeros)

    def _select_zero(self, h: np.ndarray) -> np.ndarray:
        """Position of the h-th zero of the high bits."""
        if self.hint is None:  # the word of every HINT-th zero
            self.hint = np.searchsorted(self.zeros, np.arange(0, int(self.zeros[-1]) + 1, HINT), side="right")
        w = self.hint[h >> HINT_BITS]
        for _ in range(8):
            w = w + (self.zeros[np.minimum(w, len(self.zeros) - 1)] <= h)
        late = np.flatnonzero(self.zeros[np.minimum(w, len(self.zeros) - 1)] <= h)
        if len(late):
            w[late] = np.searchsorted(self.zeros, h[late], side="right")
        before = np.where(w > 0, self.zeros[np.maximum(w, 1) - 1], 0)
        left = (h - before).astype(np.int64)
        x = ~self.high[w]
        at = w.astype(np.int64) * 64
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & U((1 << step) - 1)).astype(np.int64)
            go = left >= count
            left -= np.where(go, count, 0)
            x = np.where(go, x >> U(step), x)
            at += np.where(go, step, 0)
        return at

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks [lo, hi) of the values whose high part is h."""
        hi = self._select_zero(h) - h
        lo = np.where(h > 0, self._select_zero(np.maximum(h, 1) - 1) - h + 1, 0)
        return lo, hi

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        return (self.words[at >> 3] >> (at & 7).astype(np.uint64)) & U((1 << self.bits) - 1)

    def find(self, x: np.ndarray, since: np.ndarray | None = None, until: np.ndarray | None = None) -> np.ndarray:
        """Rank of each value, or -1; of ranks [since, until) only where given."""
        if not self.n:
            return np.full(len(x), -1)
        h = (x >> U(self.bits)).astype(np.int64)
        known = h < int(self.zeros[-1]) - 1
        lo, hi = self._bucket(np.where(known, h, 0))
        hi = np.where(known, hi, lo)
        if since is not None:
            lo = np.maximum(lo, since)
            hi = np.maximum(np.minimum(hi, until), lo)
        stop = hi.copy()
        want = x & U((1 << self.bits) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        ok = lo < stop
        ok[ok] = self._low(lo[ok]) == want[ok]
        return np.where(ok, lo, -1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at ranks i (used for pointers): the high part is the position of
        the i-th one less i, found by ones per word."""
        ones = np.arange(1, len(self.zeros) + 1, dtype=np.int64) * 64 - self.zeros
        w = np.searchsorted(ones, i, side="right")
        left = (i - np.where(w > 0, ones[np.maximum(w, 1) - 1], 0)).astype(np.int64)
        x = self.high[w].copy()
        at = w.astype(np.int64) * 64
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & U((1 << step) - 1)).astype(np.int64)
            go = left >= count
            left -= np.where(go, count, 0)
            x = np.where(go, x >> U(step), x)
            at += np.where(go, step, 0)
        return ((at - i).astype(np.uint64) << U(self.bits)) | self._low(i)


# Files: a JSON header with the place of every array, then the arrays.

def _save(path: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    places, at, blobs = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        places[name] = (at, a.dtype.str, len(a))
        blobs.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(blobs[-1])
    head = json.dumps({"meta": meta, "places": places}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    from pyspark import TaskContext

    part = f"{inner}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with fs.open_output_stream(part) as f:
        f.write(len(head).to_bytes(8, "little") + head + b"".join(blobs))
    fs.move(part, inner)


def _load(path: str) -> tuple[dict[str, np.ndarray], dict, int]:
    """Arrays, description, and the bytes held for them: none where the file is mapped."""
    fs, inner = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(inner, np.uint8, "r")
    else:  # a store that can't be mapped: the compact bytes are held instead
        with fs.open_input_file(inner) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8:8 + size].tobytes())
    base = 8 + size
    return ({k: raw[base + at:base + at + n * np.dtype(t).itemsize].view(t)
             for k, (at, t, n) in head["places"].items()}, head["meta"], 0 if isinstance(raw, np.memmap) else len(raw))


def _ef_arrays(name: str, e: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{f}": getattr(e, f) for f in EliasFano.FIELDS}


def _ef_from(arrays, meta, name: str) -> EliasFano:
    n, bits = meta[name]
    return EliasFano(n, bits, *(arrays[f"{name}.{f}"] for f in EliasFano.FIELDS))


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    d = np.diff(keys, prepend=U(0))
    wide = 8 if len(counts) and counts.max() >> 32 else 4
    raw = (bytes([wide]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()
           + np.ascontiguousarray(counts.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    wide, raw = int(raw[0]), raw[1:]
    n = len(raw) // (8 + wide)
    d = np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view("<u8").ravel()
    c = np.ascontiguousarray(raw[8 * n:].reshape(wide, n).T).view(f"<u{wide}").ravel()
    return np.cumsum(d, dtype=np.uint64), c.astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their total counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _merged(blobs) -> tuple[np.ndarray, np.ndarray]:
    got = [_unpack(b) for b in blobs]
    return _summed(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and ends, and the offsets of n texts (n + 1)."""
    words, offsets = word_hashes(texts)
    return (np.insert(words, offsets[1:], END), offsets + np.arange(len(offsets)))


def _emit(keys: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(buckets, kind="stable")
    b, keys, counts = buckets[order], keys[order], counts[order]
    names, first = np.unique(b, return_index=True)
    ends = np.append(first[1:], len(b))
    return pa.RecordBatch.from_arrays(
        [pa.array(names.astype(np.int64)),
         pa.array([_pack(keys[x:y], counts[x:y]) for x, y in zip(first, ends)], pa.binary())],
        names=["bucket", "blob"])


def _blobs(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _count_words(log: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            keys, counts = _summed(np.concatenate(held))
            return _emit(keys, counts, (keys >> U(64 - log)).astype(np.int64))

        for b in batches:
            texts = _blobs(b.column(0))
            for lo, hi in chunks(texts):
                t, _ = _tokens(texts[lo:hi])
                held.append(t)
                size += len(t)
                if size >= BATCH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _build_words(base: str, log: int):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        keys, counts = _merged(pdf["blob"])
        e = EliasFano.of(keys & U((1 << (64 - log)) - 1), 1 << (64 - log))
        kind = np.uint32 if counts.max() < 1 << 32 else np.uint64
        _save(f"{base}/words-{shard}", _ef_arrays("hash", e) | {"count": counts.astype(kind)},
              {"hash": [e.n, e.bits]})
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    return run


class Trie:
    """Mapped levels. ids are ranks of hashes over all shards."""

    def __init__(self, meta: dict):
        self.log, self.base = meta["log"], meta["base"]
        shards, _, _ = _load(f"{self.base}/{meta['shards']}")
        self.starts, self.paired = shards["starts"].astype(np.int64), set(shards["paired"].tolist())
        self.firsts, self.tripled = shards["firsts"].astype(np.int64), set(shards["tripled"].tolist())
        self.per = max(1, -(-int(self.firsts[-1]) >> self.log))  # bigrams of a shard of level 3
        self.open: OrderedDict[str, tuple] = OrderedDict()
        self.held = 0
        self.total, self.size = meta["total"], int(self.starts[-1])
        self.norm = self.total + 0.1 * (self.size + 1)

    def _level(self, name: str, make) -> tuple:
        """A shard's arrays. Mapped files stay open; of bytes that had to be read, the
        shards used last stay within HELD_BYTES."""
        if name in self.open:
            self.open.move_to_end(name)
        else:
            arrays, meta, size = _load(f"{self.base}/{name}")
            self.open[name] = (*make(arrays, meta), size)
            self.held += size
            while self.held > HELD_BYTES and len(self.open) > 1:
                self.held -= self.open.popitem(last=False)[1][-1]
        return self.open[name][:-1]

    def _words(self, s: int):
        return self._level(f"words-{s}", lambda a, m: (_ef_from(a, m, "hash"), a["count"]))

    def _pairs(self, s: int):
        return self._level(f"pairs-{s}", lambda a, m: (
            _ef_from(a, m, "point"), _ef_from(a, m, "next"), a["prob"], a["backoff"], m["discount"])) if s in self.paired else None

    def _triples(self, s: int):
        return self._level(f"triples-{s}", lambda a, m: (
            _ef_from(a, m, "point"), _ef_from(a, m, "next"), a["prob"], a["backoff"])) if s in self.tripled else None

    def _by_shard(self, shards: np.ndarray):
        order = np.argsort(shards, kind="stable")
        cuts = np.flatnonzero(np.diff(shards[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(shards[part[0]]), part

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for s, part in self._by_shard((hashes >> U(64 - self.log)).astype(np.int64)):
            if self.starts[s + 1] > self.starts[s]:
                r = self._words(s)[0].find(hashes[part] & U((1 << (64 - self.log)) - 1))
                out[part] = np.where(r >= 0, r + self.starts[s], -1)
        return out

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, ids, side="right") - 1

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        for s, part in self._by_shard(self.shard_of(ids[known])):
            at = known[part]
            out[at] = self._words(s)[1][ids[at] - self.starts[s]]
        return out

    def plain(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the additive estimate."""
        return np.log10((counts + 0.1) / self.norm)

    def _distinct(self, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different (ctx, word) in order, and for each row which of them it is. Few
        rows of a batch are new, and in order a search reads its shard from end to end."""
        if len(ctx) and (int(ctx.max()) + 1) * (self.size + 1) < 1 << 63:
            key, inverse = np.unique(ctx * (self.size + 1) + word + 1, return_inverse=True)
            return key // (self.size + 1), key % (self.size + 1) - 1, inverse
        order = np.lexsort((word, ctx))
        c, w = ctx[order], word[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1]))) if len(c) else np.empty(0, bool)
        inverse = np.empty(len(c), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return c[new], w[new], inverse

    def _successors(self, point: EliasFano, nxt: EliasFano, r: np.ndarray, word: np.ndarray):
        """For contexts r of a shard, in order: which have successors, and of these the rank
        of the word among all of the shard, or -1, searched in the context's range only."""
        new = np.concatenate(([True], r[1:] != r[:-1]))
        u, inv = r[new], np.cumsum(new) - 1
        since, until = (point.get(x).astype(np.int64) for x in (u, u + 1))
        has = np.flatnonzero((until > since)[inv])
        w, inv = word[has], inv[has]
        rank = np.full(len(has), -1)
        seen = np.flatnonzero(w >= 0)
        rank[seen] = nxt.find((r[has[seen]] * self.size + w[seen]).astype(np.uint64), since[inv[seen]], until[inv[seen]])
        return has, rank

    def _slices(self, shards: np.ndarray):
        """(shard, slice) of shards in order."""
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield int(shards[lo]), slice(lo, hi)

    def bigrams(self, ctx: np.ndarray, word: np.ndarray, plain: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Id of each bigram (-1: not seen), and log10 p(word | ctx) for ids of words (-1:
        unknown) where plain, log10 p(word), is given."""
        out, found = None if plain is None else plain.copy(), np.full(len(ctx), -1, np.int64)
        known = np.flatnonzero(ctx >= 0)
        c, w, inverse = self._distinct(ctx[known], word[known])
        ids, add, own = np.full(len(c), -1, np.int64), np.zeros(len(c)), np.zeros(len(c), bool)
        for s, part in self._slices(self.shard_of(c)):
            level = self._pairs(s)
            if level is None:
                continue
            point, nxt, prob, backoff, _ = level
            r = c[part] - self.starts[s]
            has, i = self._successors(point, nxt, r, w[part])
            hit = i >= 0
            has += part.start
            ids[has[hit]] = self.firsts[s] + i[hit]
            add[has] = dequantise(backoff[c[has] - self.starts[s]], 4.0)
            add[has[hit]], own[has[hit]] = dequantise(prob[i[hit]]), True
        found[known] = ids[inverse]
        if out is not None:
            out[known] = np.where(own[inverse], 0.0, out[known]) + add[inverse]
        return found, out

    def scores(self, ctx: np.ndarray, word: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """log10 p(word | ctx) by words and bigrams."""
        return self.bigrams(ctx, word, plain)[1]

    def third(self, pair: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 p(word | the two words before), by the id of their bigram (-1: none) and
        lower, log10 p(word | the word before)."""
        out = lower.copy()
        known = np.flatnonzero(pair >= 0)
        c, w, inverse = self._distinct(pair[known], word[known])
        add, own = np.zeros(len(c)), np.zeros(len(c), bool)
        for s, part in self._slices(c // self.per):
            level = self._triples(s)
            if level is None:
                continue
            point, nxt, prob, backoff = level
            r = c[part] - s * self.per
            has, i = self._successors(point, nxt, r, w[part])
            hit = i >= 0
            has += part.start
            add[has] = dequantise(backoff[c[has] - s * self.per], 4.0)
            add[has[hit]], own[has[hit]] = dequantise(prob[i[hit]]), True
        out[known] = np.where(own[inverse], 0.0, out[known]) + add[inverse]
        return out

    def parts(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of bigrams by id: the second word, and the count, which the probability gives back
        to one part in a thousand (exactly up to some hundreds)."""
        word, count = np.empty(len(pair), np.int64), np.empty(len(pair))
        for s, part in self._by_shard(np.searchsorted(self.firsts, pair, side="right") - 1):
            _, nxt, prob, _, discount = self._pairs(s)
            i = pair[part] - self.firsts[s]
            value = nxt.get(i).astype(np.int64)
            word[part] = value % self.size
            c1 = self.counts(value // self.size + self.starts[s])
            count[part] = np.rint(10 ** dequantise(prob[i]) * c1 + discount)
        return word, np.maximum(count, 1)


_tries: dict[str, Trie] = {}


def trie(meta: dict) -> Trie:
    key = f"{meta['base']}/{meta['shards']}"
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie(meta)
    return _tries[key]


def _count_pairs(meta: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, size = trie(meta), [], 0
        end = t.ids(np.array([END]))[0]

        def flush():
            hashes = np.concatenate(held)
            u, inv = np.unique(hashes, return_inverse=True)
            ids = t.ids(u)[inv]
            ctx = np.concatenate(([end], ids[:-1]))
            keys, counts = _summed((ctx * t.size + ids).astype(np.uint64))
            b = (mix(keys.copy()) >> U(64 - t.log)).astype(np.int64)
            return _emit(keys, counts, b)

        for b in batches:
            texts = _blobs(b.column(0))
            for lo, hi in chunks(texts):
                h, _ = _tokens(texts[lo:hi])
                held.append(h)
                size += len(h)
                if size >= BATCH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _deal(meta: dict):
    """Totals of a bucket's bigrams, dealt to the shards of their contexts."""

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        t = trie(meta)
        keys, counts = _merged(pdf["blob"])
        shards = t.shard_of((keys // U(max(1, t.size))).astype(np.int64))
        return _emit(keys, counts, shards).to_pandas()

    return run


def _discount(once: int, twice: int) -> float:
    return min(max(once / max(1, once + 2 * twice), DISCOUNTS[0]), DISCOUNTS[1])


def _build_pairs(meta: dict):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        t, shard = trie(meta), int(key[0])
        keys, counts = _merged(pdf["blob"])
        n = int(t.starts[shard + 1] - t.starts[shard])
        ctx = (keys // U(t.size)).astype(np.int64) - t.starts[shard]
        word = (keys % U(t.size)).astype(np.int64)
        u, inv = np.unique(word, return_inverse=True)
        plain = 10 ** t.plain(t.counts(u))[inv]
        c1 = t.counts(ctx + t.starts[shard])
        discount = _discount(int((counts == 1).sum()), int((counts == 2).sum()))
        p = (counts - discount) / c1
        left = 1 - np.bincount(ctx, p, n)
        rest = np.maximum(1 - np.bincount(ctx, plain, n), 1e-12)
        backoff = np.log10(np.maximum(left, 1e-12) / rest)
        point = EliasFano.of(np.concatenate(([0], np.cumsum(np.bincount(ctx, minlength=n)))).astype(np.uint64), len(keys) + 1)
        nxt = EliasFano.of((ctx * t.size + word).astype(np.uint64), n * t.size + 1)
        _save(f"{t.base}/pairs-{shard}",
              _ef_arrays("point", point) | _ef_arrays("next", nxt)
              | {"prob": quantise(np.log10(p)), "backoff": quantise(backoff, 4.0)},
              {"point": [point.n, point.bits], "next": [nxt.n, nxt.bits], "discount": discount})
        return pd.DataFrame({"shard": [shard], "kept": [len(keys)]})

    return run


def _count_triples(meta: dict, split: int):
    """Trigrams by shard of their bigram and, so that a hot bigram is no hot key, by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, starts, size = trie(meta), [], [], 0
        end = t.ids(np.array([END]))[0]

        def flush():
            hashes, first = np.concatenate(held), np.concatenate(starts)
            u, inv = np.unique(hashes, return_inverse=True)
            ids = t.ids(u)[inv]
            pair, _ = t.bigrams(np.where(first, end, np.roll(ids, 1)), ids)
            word, pair = ids[~first], np.roll(pair, 1)[~first]
            shard = pair // t.per
            key = ((pair - shard * t.per) * t.size + word).astype(np.uint64)
            bucket = shard * split + (mix(key.copy()) >> U(64 - 16)).astype(np.int64) % split
            order = np.lexsort((key, bucket))
            key, bucket = key[order], bucket[order]
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])))) if len(key) else order
            return _emit(key[new], np.diff(np.append(new, len(key))), bucket[new])

        for b in batches:
            texts = _blobs(b.column(0))
            for lo, hi in chunks(texts):
                h, offsets = _tokens(texts[lo:hi])
                first = np.zeros(len(h), bool)
                first[offsets[:-1]] = True
                held.append(h)
                starts.append(first)
                size += len(h)
                if size >= BATCH_TOKENS:
                    yield flush()
                    held, starts, size = [], [], 0
        if held:
            yield flush()

    return run


def _keep_triples(split: int):
    """Totals of a bucket: the trigrams to keep, and how many were seen once and twice."""

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(pdf["blob"])
        keep = counts >= KEPT
        return pd.DataFrame({"bucket": [int(key[0]) // split], "blob": [_pack(keys[keep], counts[keep])],
                             "once": [int((counts == 1).sum())], "twice": [int((counts == 2).sum())]})

    return run


def _build_triples(meta: dict):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        t, shard = trie(meta), int(key[0])
        keys, counts = _merged(pdf["blob"])
        discount = _discount(int(pdf["once"].sum()), int(pdf["twice"].sum()))
        n = min(t.per, int(t.firsts[-1]) - shard * t.per)
        ctx, word = (keys // U(t.size)).astype(np.int64), (keys % U(t.size)).astype(np.int64)
        u, inv = np.unique(ctx, return_inverse=True)
        middle, total = t.parts(u + shard * t.per)
        words, at = np.unique(word, return_inverse=True)
        lower = t.scores(middle[inv], word, t.plain(t.counts(words))[at])
        p = np.minimum((counts - discount) / total[inv], 1.0)
        left = 1 - np.bincount(ctx, p, n)
        rest = np.maximum(1 - np.bincount(ctx, 10 ** lower, n), 1e-12)
        point = EliasFano.of(np.concatenate(([0], np.cumsum(np.bincount(ctx, minlength=n)))).astype(np.uint64), len(keys) + 1)
        nxt = EliasFano.of((ctx * t.size + word).astype(np.uint64), n * t.size + 1)
        _save(f"{t.base}/triples-{shard}",
              _ef_arrays("point", point) | _ef_arrays("next", nxt)
              | {"prob": quantise(np.log10(p)), "backoff": quantise(np.log10(np.maximum(left, 1e-12) / rest), 4.0)},
              {"point": [point.n, point.bits], "next": [nxt.n, nxt.bits]})
        return pd.DataFrame({"shard": [shard], "kept": [len(keys)]})

    return run


def fit(texts: DataFrame, text_col: str = "text") -> dict:
    """Learn from every row of texts; returns the trie's description, four values; the
    levels and the list of their shards stay in the shared folder."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    log = max(2, (max(1, texts.count()) // SHARD_TEXTS).bit_length())
    base = new_path(spark, "trie")
    words = (texts.mapInArrow(_count_words(log), "bucket long, blob binary").groupBy("bucket")
             .applyInPandas(_build_words(base, log), "shard long, n long, total long")).toPandas()
    sizes = np.zeros((1 << log) + 1, np.int64)
    sizes[words["shard"].to_numpy(np.int64) + 1] = words["n"]
    arrays = {"starts": np.cumsum(sizes)} | {k: np.zeros(1, np.int64) for k in ("paired", "firsts", "tripled")}
    arrays["paired"] = arrays["tripled"] = np.empty(0, np.int64)
    meta = {"base": base, "log": log, "shards": "shards-1", "total": int(words["total"].sum())}
    _save(f"{base}/shards-1", arrays, {})
    pairs = (texts.mapInArrow(_count_pairs(meta), "bucket long, blob binary").groupBy("bucket")
             .applyInPandas(_deal(meta), "bucket long, blob binary").groupBy("bucket")
             .applyInPandas(_build_pairs(meta), "shard long, kept long")).toPandas()
    kept = np.zeros((1 << log) + 1, np.int64)
    kept[pairs["shard"].to_numpy(np.int64) + 1] = pairs["kept"]
    arrays |= {"paired": np.sort(pairs["shard"].to_numpy(np.int64)), "firsts": np.cumsum(kept)}
    _save(f"{base}/shards-2", arrays, {})
    meta = meta | {"shards": "shards-2"}
    split = 1 << (log // 2)
    triples = (texts.mapInArrow(_count_triples(meta, split), "bucket long, blob binary").groupBy("bucket")
               .applyInPandas(_keep_triples(split), "bucket long, blob binary, once long, twice long").groupBy("bucket")
               .applyInPandas(_build_triples(meta), "shard long, kept long")).toPandas()
    arrays["tripled"] = np.sort(triples["shard"].to_numpy(np.int64))
    _save(f"{base}/shards-3", arrays, {})
    return meta | {"shards": "shards-3"}


SCHEMA = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(meta: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(meta)
        end = t.ids(np.array([END]))[0]
        for b in batches:
            texts, out = _blobs(b.column(1)), []
            groups = list(chunks(texts))
            for g in range(0, len(groups), 8):
                lo, hi = groups[g][0], groups[min(g + 8, len(groups)) - 1][1]
                parts = [_tokens(texts[x:y]) for x, y in groups[g:g + 8]]
                shift = np.cumsum([0] + [len(h) for h, _ in parts])
                offs = np.concatenate([o[:-1] + s for (_, o), s in zip(parts, shift)])
                u, inv = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
                ids = t.ids(u)
                counts = t.counts(ids)
                plain = t.plain(counts)[inv]
                ids = ids[inv]
                first = np.zeros(len(ids), bool)
                first[offs] = True
                pair, lower = t.bigrams(np.where(first, end, np.roll(ids, 1)), ids, plain)
                scores = t.third(np.where(first, -1, np.roll(pair, 1)), ids, lower)
                out.append((np.diff(np.append(offs, shift[-1])), np.add.reduceat((counts > 0)[inv].astype(np.int64), offs),
                            np.add.reduceat(plain, offs), np.add.reduceat(scores, offs)))
                assert hi - lo == len(offs)
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0]), pa.array(cols[1]), pa.array(np.full(len(texts), t.total)),
                 pa.array(cols[2]), pa.array(cols[3])],
                names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, meta: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_score(meta), SCHEMA).withColumnRenamed("id", id_col))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    return score(docs, fit(docs.where(~held))).withColumn("held_out", held)
