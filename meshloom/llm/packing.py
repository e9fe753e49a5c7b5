"""Operator 2 - sequence packing by minimum bin slack.

Each task tokenises its texts in order and packs them in windows of WINDOW_TOKENS
ids. A text longer than the capacity gives full sequences first; what remains of
every text is an item with a length below the capacity. A window knows only how
many items of each length it holds: a bitset subset-sum marks every total that
some multiset of lengths reaches (a Python integer, one shift-or per length and
binary count part), the reachable total closest to the capacity is taken, and
the part bitsets are walked backwards to recover how many items of each length
fill it. The chosen multiset is reused while its counts last. Sequences filled
this way need no cut. Leftovers of a window pass to the next one; what a task
finally can't fill is laid end to end and cut into sequences whose lengths are
the powers of two in the binary form of its total, which need no padding.

Nothing is shuffled and a window bounds the memory, whatever the size or skew of
the input. Sequence ids are partition * 2^33 + number: the same input partition
gives the same rows when a lost task runs again.

Null and empty texts are one piece with the end id alone. Repeated rows and ids
are packed like others. Rows without an id are packed with a null id. Columns
besides id and text are unused.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, tidy
from .words import _BASE, TABLE, U, chunks, mix, power

CAPACITY = 4096
END = 2
#: Ids held at once by a task: 8 MB.
WINDOW_TOKENS = 2 << 20
#: Rows taken out of a batch, and bytes of text tokenised, at once.
ROWS, CHUNK = 256, 1 << 18
#: Pieces whose ids a worker remembers in each of two tables: 100 bytes each.
CACHE_PIECES = 400_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")


class _Table:
    """Pieces by two 64-bit hashes in open addressing, and their ids end to end."""

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.mask = (1 << max(4, (2 * limit).bit_length())) - 1
        self.key, self.check = (np.zeros(self.mask + 1, np.uint64) for _ in range(2))
        self.at = np.full(self.mask + 1, -1, np.int64)
        self.length = np.zeros(self.mask + 1, np.int32)
        self.ids, self.used = np.zeros(4 * limit + 64, np.uint32), 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slot of each piece, or -1."""
        slot = (key & np.uint64(self.mask)).astype(np.int64)
        hit = (self.key[slot] == key) & (self.check[slot] == check) & (self.at[slot] >= 0)
        out = np.where(hit, slot, -1)
        live = np.flatnonzero(~hit & (self.at[slot] >= 0))
        while len(live):
            s = slot[live] = (slot[live] + 1) & self.mask
            hit = (self.key[s] == key[live]) & (self.check[s] == check[live]) & (self.at[s] >= 0)
            out[live[hit]] = s[hit]
            live = live[~hit & (self.at[s] >= 0)]
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct pieces that find() doesn't know."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)))
        self.ids[self.used:self.used + len(ids)] = ids
        at = self.used + np.concatenate(([0], np.cumsum(lengths[:-1]))).astype(np.int64)
        self.used, self.size = self.used + len(ids), self.size + len(key)
        slot, live = (key & np.uint64(self.mask)).astype(np.int64), np.arange(len(key))
        while len(live):
            free = live[self.at[slot[live]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            done = free[one]
            s = slot[done]
            self.key[s], self.check[s], self.at[s], self.length[s] = key[done], check[done], at[done], lengths[done]
            left = np.ones(len(key), bool)
            left[done] = False
            live = live[left[live]]
            slot[live] = (slot[live] + (self.at[slot[live]] >= 0)) & self.mask

    def of(self, slots: np.ndarray) -> np.ndarray:
        """The ids of the pieces in the slots, end to end."""
        n = self.length[slots]
        ends = np.cumsum(n, dtype=np.int64)
        return self.ids[np.repeat(self.at[slots] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


#: Bytes by class: 0 white space, 1 letters, 2 digits, 3 other signs, 4 what keeps a word whole.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[[39, 60]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_OTHER = mix(np.arange(1001, 1257, dtype=np.uint64) * U(_BASE))[_FOLD]


class PieceTokenizer:
    """Ids of whole texts, by a table of ids for the pieces of their words.

    The tokenizer drops white space, never merges across it, lower-cases, and takes
    runs of letters, single digits and runs of other signs apart. So a text's ids are
    those of its pieces in order, and variants of a word share them. Words with an
    apostrophe or "<" (contractions, special tokens), control or non-ASCII characters
    are pieces as a whole. Pieces are known by two 64-bit hashes, of A-Z folded bytes.

    Two tables of at most `limit` pieces: what the younger lacks is looked up in the
    older, then learnt; a full younger one becomes the older. Pieces without an
    apostrophe or the like are learnt many in one text, whose ids part where a token ends
    a piece.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would hold memory
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.young, self.old = _Table(limit), _Table(0)

    def _learn(self, pieces: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, end to end, and how many each has."""
        plain = np.flatnonzero(~whole)
        blocks = [plain[lo:lo + 512] for lo in range(0, len(plain), 512)]
        got = self.tok.encode_batch_fast([b" ".join([pieces[i] for i in b]).decode() for b in blocks], add_special_tokens=False)
        found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(pieces)
        alone = np.flatnonzero(whole).tolist()
        for block, e in zip(blocks, got):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(block):
                for i, lo, hi in zip(block.tolist(), [0, *ends.tolist()], ends.tolist()):
                    found[i] = ids[lo:hi]
            else:
                alone += block.tolist()
        for lo in range(0, len(alone), 4096):
            some = alone[lo:lo + 4096]
            for i, e in zip(some, self.tok.encode_batch_fast([pieces[i].decode() for i in some], add_special_tokens=False)):
                found[i] = np.array(e.ids, np.uint32)
        return np.concatenate([*found, np.empty(0, np.uint32)]), np.fromiter(map(len, found), np.int32, len(found))

    def _known(self, key: np.ndarray, check: np.ndarray, piece, whole: np.ndarray) -> np.ndarray:
        """Slots in the younger table, after what it lacks was learnt; piece(i) gives bytes."""
        slots = self.young.find(key, check)
        lack = np.flatnonzero(slots < 0)
        if len(lack):
            _, one = np.unique(key[lack], return_index=True)
            new = lack[one]
            if self.young.size + len(new) > self.young.limit:
                self.old, self.young = self.young, _Table(max(self.limit, len(key)))
                return self._known(key, check, piece, whole)
            had = self.old.find(key[new], check[new])
            got = new[had >= 0]
            if len(got):
                self.young.add(key[got], check[got], self.old.of(had[had >= 0]), self.old.length[had[had >= 0]])
            new = new[had < 0]
            if len(new):
                self.young.add(key[new], check[new], *self._learn([piece(i) for i in new.tolist()], whole[new]))
            slots[lack] = self.young.find(key[lack], check[lack])
        return slots

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        up, down = power(len(buf) + 1)
        kind = _KIND[buf]
        space = kind == 0
        word = np.empty(len(buf), bool)
        word[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=word[1:])
        words = np.flatnonzero(word)  # starts and ends of words in turn
        odd = np.add.reduceat(kind == 4, words[0::2], dtype=np.int64) if len(words) else np.empty(0, np.int64)
        cut = np.empty(len(buf), bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == 2
        whole_word = odd > 0
        for lo, hi in words.reshape(-1, 2)[whole_word].tolist():
            cut[lo + 1:hi] = False
        cut[words] = True
        at = np.flatnonzero(cut)
        stop = np.append(at[1:], len(buf))
        real = kind[at] != 0
        start, end = at[real], stop[real]
        whole = whole_word[np.searchsorted(words[0::2], start, side="right") - 1] if len(words) else np.empty(0, bool)
        total, other = np.zeros(len(buf) + 1, np.uint64), np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(TABLE[buf] * up[:len(buf)], out=total[1:])
        np.cumsum(_OTHER[buf], out=other[1:])
        key, check = mix((total[end] - total[start]) * down[start]), other[end] - other[start]
        slots = self._known(key, check, lambda i: joined[start[i]:end[i]].lower(), whole)
        if (self.young.check[slots] != check).any() or (slots < 0).any():  # one hash, two pieces
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        ids = self.young.of(slots)
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        ends = np.concatenate(([0], np.cumsum(self.young.length[slots], dtype=np.int64)))
        return np.split(ids, ends[np.searchsorted(start, bounds[:-1])]) if texts else []


_tokenizers: dict[tuple[str, int], PieceTokenizer] = {}


def tokenizer(path: str, limit: int = CACHE_PIECES) -> PieceTokenizer:
    """One tokenizer and table for each Python worker."""
    if (path, limit) not in _tokenizers:
        _tokenizers[path, limit] = PieceTokenizer(path, limit)
    return _tokenizers[path, limit]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts per length, at most `counts`, whose total is the largest not above
    capacity that any choice reaches."""
    reach = 1
    mask = (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], capacity // length) if length else 0
        part = 1
        while left > 0:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen: Counter[int] = Counter()
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] += take
    return chosen


class Packer:
    def __init__(self, partition: int, capacity: int = CAPACITY):
        self.capacity = capacity
        self.next = partition << 33
        self.items: dict[int, deque] = defaultdict(deque)
        self.rows: list[tuple] = []

    def _sequence(self, pieces: list[tuple]) -> None:
        offset, size = 0, sum(len(p[3]) for p in pieces)
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, self.next, offset, size))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self._sequence([(doc, at, n, ids[at:at + self.capacity])])
            at += self.capacity
        if at < n:
            self.items[n - at].append((doc, at, n, ids[at:]))

    def pack(self) -> None:
        """Fill sequences while the best choice leaves no slack."""
        counts = {length: len(q) for length, q in self.items.items() if q}
        while counts:
            chosen = fill(counts, self.capacity)
            if sum(k * v for k, v in chosen.items()) < self.capacity:
                break
            for _ in range(min(counts[k] // v for k, v in chosen.items())):
                pieces = []
                for length, v in chosen.items():
                    pieces += [self.items[length].popleft() for _ in range(v)]
                    counts[length] -= v
                self._sequence(pieces)
            counts = {k: v for k, v in counts.items() if v}
        self.items = defaultdict(deque, {k: q for k, q in self.items.items() if q})

    def close(self) -> None:
        """Cut the rest into sequences of power-of-two lengths."""
        self.pack()
        rest = [p for length in sorted(self.items, reverse=True) for p in self.items[length]]
        self.items.clear()
        left = sum(len(p[3]) for p in rest)
        queue = deque(rest)
        while left:
            want = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= want
            pieces = []
            while want:
                doc, start, total, ids = queue.popleft()
                if len(ids) > want:
                    queue.appendleft((doc, start + want, total, ids[want:]))
                    ids = ids[:want]
                pieces.append((doc, start, total, ids))
                want -= len(ids)
            self._sequence(pieces)

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          names=[x.split()[0] for x in SCHEMA.split(", ")])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)
        del b
        tidy()


def _run(path: str, capacity: int, cache_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tidy()
        tok, packer, held = tokenizer(path, cache_pieces), Packer(TaskContext.get().partitionId(), capacity), 0
        for b in _sliced(batches):
            docs, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts, CHUNK):
                for doc, ids in zip(docs[lo:hi], tok.encode(texts[lo:hi])):
                    packer.add(doc, np.append(ids, np.uint32(END)))
                    held += len(ids) + 1
                if held >= WINDOW_TOKENS:
                    packer.pack()
                    held = sum(k * len(q) for k, q in packer.items.items())
                    if held >= WINDOW_TOKENS // 2:
                        packer.close()
                        held = 0
                    yield packer.flush()
        packer.close()
        yield packer.flush()
        tidy()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """One row per piece of a text: where it lies in its text and in its sequence,
    and the sequence's length (capacity, or a power of two)."""
    out = (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
           .mapInArrow(_run(tokenizer_path, capacity, cache_pieces), SCHEMA))
    return out.withColumnRenamed("doc_id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), default_tokenizer())
