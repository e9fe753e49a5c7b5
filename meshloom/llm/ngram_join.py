"""Operator 1 - n-gram Jaccard join by a token-group matrix.

Every text becomes the set of its distinct k-word shingles (64-bit hashes, the tokens).
Texts with equal sets are one class from the start. Between classes:

1. Order all tokens by (listed, frequency, hash), the same for every text. Listed are
   those that more than HOT texts show among their smallest hashes; the list is
   shortened to at most MAX_HOT entries by raising that count, so that it can be handed
   to every task. Any order gives the same links, a good one is faster.
2. Index each class under its first |s| - ceil(t|s|) + l tokens, l = 1 + |s|/40. Two
   sets with Jaccard >= t share at least min(l) of them, so a class with fewer tokens
   that another class has too is linked with nothing and falls away.
3. Range-partition the classes left by their first shared token, which similar ones
   have in common, and cut them into groups of at most GROUP_ROWS rows and GROUP_BYTES.
4. Store each group's token union: one row for each index token of its members, and
   the least and largest size of its members. Tokens that stand in exactly the same
   groups are one column of this matrix (known by a 128-bit signature of the groups),
   so that what a large family has in common is one row a group.
5. Bound the overlap of a query class with a group of fitting sizes by counting the
   query's tokens in the union. Under the l of 2. no member can be linked, and the group
   stays closed.
6. Open the groups that qualify: the texts of their members and queries meet in one
   task, members first; queries stream by in blocks. Every exact overlap of a block is
   counted, tokens of few sets pair by pair, others by a matrix product. Each block
   returns a spanning forest of its links (and each class's number of links);
   distributed components finish.

Skew. Copies of a text are one class before anything is shuffled by token. A token of
the list, and every token of a class that consists mostly of listed ones, is dealt over
SALTS parts of the index. A group's queries are dealt over as many tasks as they need,
each with the group's members. The join of 5. is split by adaptive execution. A family
of many thousand *different* near copies is still compared class by class, as the number
of links asks for it: its work grows with the square of the family.

Hashes stand for tokens and a set's 64-bit fingerprint for the set. A pair that is
compared is judged wrongly with a chance below 1e-9; among N different sets N^2 / 2^65
pairs of equal fingerprints are expected, 3 in a corpus of 10^10.

Null texts and texts without words have an empty set, size 0, and are linked with
nothing, not even each other: component_id is their own id. Rows without an id have a
null component and no links. Rows are what is joined, not ids: repeated rows are copies
like any other, and two texts of one id are two rows, each with its own links. Ties need
no rule, as all links count. Texts of any length are processed whole; a set larger than
GROUP_BYTES is a group of its own. An empty table gives no rows. Columns besides id and
text are unused, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import Shelf, read_table
from .words import shingle_sets

#: A token of more texts than this is listed.
HOT = 32
#: Most entries of the list: 6 MB.
MAX_HOT = 500_000
#: Parts of the index over which the classes of a listed token are dealt.
SALTS = 16
GROUP_ROWS = 1024
GROUP_BYTES = 8 << 20
#: Queries compared with a group at once, and those that one task takes.
BLOCK_ROWS, BLOCK_BYTES = 256, 2 << 20
#: A token of more sets of a comparison than this is counted by a matrix product.
DENSE = 16
TASK_QUERIES = 2048
#: Rows of (class, group) that are broadcast, 24 MB; beyond that the texts are shuffled.
BROADCAST_ROWS = 200_000
#: Tokens a task counts before it emits.
COUNTED = 2 << 20


def _need(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def _slack(n: int) -> int:
    return 1 + n // 40


def _prefix(n: int, num: int, den: int) -> int:
    return min(n, n - _need(n, num, den) + _slack(n))


def _blobs(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches, for a smaller peak of memory."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _fp(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _sketches(k: int):
    """(id, n, fp, text_hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            sizes, fps = [], []
            for s in shingle_sets(_blobs(b.column(1)), k):
                sizes.append(len(s))
                fps.append(_fp(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), b.column(2)],
                names=["id", "n", "fp", "text_hash"])

    return run


def _window(n: int, num: int, den: int) -> int:
    """Of how many of a set's smallest hashes the frequencies are counted."""
    return min(n, _prefix(n, num, den) + n // 12)


def _counted(k: int, num: int, den: int):
    """(token, n): in how many texts of the task a token is among the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

        for b in _sliced(batches):
            for s in shingle_sets(_blobs(b.column(0)), k):
                held.append(s[:_window(len(s), num, den)].copy())
                size += len(held[-1])
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _first(s: np.ndarray, p: int, listed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first p tokens of a set in the global order, and how many aren't listed."""
    if not len(listed):
        return s[:p], p
    for part in (s[:2 * p], s):
        at = np.minimum(np.searchsorted(listed, part), len(listed) - 1)
        hot = listed[at] == part
        cold = part[~hot]
        if len(cold) >= p:
            return cold[:p], p
    rest = part[hot]
    rest = rest[np.lexsort((rest, counts[at[hot]]))]
    return np.concatenate((cold, rest))[:p], len(cold)


_INDEX_SCHEMA = "token long, salt int, fp long, n int"


def _index_rows(k: int, num: int, den: int, listed: bytes, counts: bytes):
    """(token, salt, fp, n): the tokens under which a class is indexed. Salt 0 holds the
    classes of a token that is taken for rare; a salted token leaves one mark there,
    of size 0, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, freq = np.frombuffer(listed, np.uint64), np.frombuffer(counts, np.int64)
        marked: set[int] = set()
        for b in _sliced(batches):
            tokens, salts, fps, sizes, seen = [], [], [], [], set()
            for s in shingle_sets(_blobs(b.column(0)), k):
                n = len(s)
                if not n or (fp := _fp(s)) in seen:
                    continue
                seen.add(fp)
                p = _prefix(n, num, den)
                first, cold = _first(s, p, hot, freq)
                # What follows a window full of listed tokens is as frequent, but not counted.
                rare = len(hot) == 0 or int((hot[np.minimum(np.searchsorted(hot, w := s[:_window(n, num, den)]), len(hot) - 1)]
                                             != w).sum()) >= p
                salt = np.zeros(p, np.int32)
                salt[cold if rare else 0:] = 1 + fp % SALTS
                new = [t for t in first[salt > 0].tolist() if t not in marked]
                marked.update(new)
                for t, x, f, m in ((first, salt, fp, n), (np.array(new, np.uint64), np.zeros(len(new), np.int32), 0, 0)):
                    tokens.append(t)
                    salts.append(x)
                    fps.append(np.full(len(t), f, np.int64))
                    sizes.append(np.full(len(t), m, np.int32))
            if len(marked) > COUNTED:
                marked = set()

            def column(parts, kind):
                return pa.array(np.concatenate([*parts, np.empty(0, kind)]))

            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*tokens, np.empty(0, np.uint64)]).view(np.int64)), column(salts, np.int32),
                 column(fps, np.int64), column(sizes, np.int32)], names=["token", "salt", "fp", "n"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, n) with their partition, and the rows and bytes of it before each."""
    from pyspark import TaskContext

    part, row, size = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column(1).to_numpy().astype(np.int64) * 8
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.full(len(n), part)), pa.array(row + np.arange(len(n))), pa.array(size + np.cumsum(n) - n),
             pa.array(n)], names=["fp", "part", "row", "start", "bytes"])
        row, size = row + len(n), size + int(n.sum())


def _placed(members: DataFrame, shelf: Shelf) -> DataFrame:
    """(fp, group_id): members in the order of their keys, cut where the rows before reach
    a multiple of GROUP_ROWS or the bytes before one of GROUP_BYTES, so that groups are
    full whatever the number of partitions. The driver adds up one row a partition."""
    rows = shelf.put("numbered", members.repartitionByRange("key", "fp").sortWithinPartitions("key", "fp").select("fp", "n")
                     .mapInArrow(_numbered, "fp long, part long, row long, start long, bytes long"))
    parts = rows.groupBy("part").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).orderBy("part").collect()
    before, r, b = [], 0, 0
    for p in parts:
        before.append((p["part"], r, b))
        r, b = r + p["rows"], b + p["bytes"]
    offsets = members.sparkSession.createDataFrame(before, "part long, rows long, size long")
    return rows.join(F.broadcast(offsets), "part").select("fp", F.expr(
        f"(rows + row) div {GROUP_ROWS} + (size + start) div {GROUP_BYTES}").alias("group_id"))


def _common(one: list[np.ndarray], two: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of one with two (None: of one with its later ones)."""
    sets = one + (two or [])
    rows, first = len(one), len(one) if two else 0
    cols = len(sets) - first
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    t, d = tokens[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(t)))
    column = np.repeat(np.arange(len(starts)), counts)
    size = np.repeat(counts, counts)

    # Tokens of few sets: their pairs, by the distance of the two in the sorted list.
    few = (size > 1) & (size <= DENSE)
    c, x = column[few], d[few]
    keys = [np.empty(0, np.int64)]
    for lag in range(1, DENSE):
        same = c[lag:] == c[:-lag]
        if not same.any():
            break
        i, j = x[:-lag][same], x[lag:][same]
        ok = (i < rows) & (j >= first)
        keys.append(i[ok] * cols + j[ok] - first)
    both = np.bincount(np.concatenate(keys), minlength=rows * cols).reshape(rows, cols)

    # Tokens of many sets: a matrix product.
    many = size > DENSE
    c, x = np.unique(column[many], return_inverse=True)[1], d[many]
    for lo in range(0, int(c.max()) + 1 if len(c) else 0, 4096):
        part = (c >= lo) & (c < lo + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[x[part], c[part] - lo] = 1
        both += (m[:rows] @ m[first:].T).astype(np.int64)
    return both


def _links(one: list[np.ndarray], two: list[np.ndarray] | None, num: int, den: int):
    """Index pairs (i, j) of sets with Jaccard >= num/den; two=None: within one, i < j."""
    inter = _common(one, two)
    n1 = np.array([len(s) for s in one])
    n2 = np.array([len(s) for s in two]) if two else n1
    i, j = np.nonzero((inter > 0) & (den * inter >= num * (n1[:, None] + n2[None, :] - inter)))
    return (i, j) if two else (i[i < j], j[i < j])


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


_LINK = pa.struct([("a", pa.int64()), ("b", pa.int64())])
_DEG = pa.struct([("id", pa.int64()), ("links", pa.int64())])
_OPEN_SCHEMA = "forest array<struct<a:long,b:long>>, degrees array<struct<id:long,links:long>>"


def _found(ids1, ids2, w1, w2, i, j):
    """Spanning forest and per-class link counts of the pairs (i, j)."""
    pairs = list(zip(ids1[i].tolist(), ids2[j].tolist()))
    deg: dict[int, int] = {}
    for (a, b), x, y in zip(pairs, w1[i].tolist(), w2[j].tolist()):
        deg[a] = deg.get(a, 0) + y
        deg[b] = deg.get(b, 0) + x
    return ([{"a": a, "b": b} for a, b in _forest(pairs)],
            [{"id": k, "links": v} for k, v in deg.items()])


class _Block:
    """Classes of one side: fingerprints, copies and sets."""

    def __init__(self):
        self.fps, self.copies, self.sets, self.bytes, self.known = [], [], [], 0, set()

    def add(self, fp: int, copies: int, s: np.ndarray) -> None:
        if fp not in self.known:
            self.known.add(fp)
            self.fps.append(fp)
            self.copies.append(copies)
            self.sets.append(s)
            self.bytes += s.nbytes

    def full(self) -> bool:
        return len(self.fps) >= BLOCK_ROWS or self.bytes >= BLOCK_BYTES


def _opened(k: int, num: int, den: int):
    """Links within the groups and of their queries, from rows (group_id, salt, role, fp,
    copies, text) sorted by the first four."""

    def found(one: _Block, two: _Block | None):
        i, j = _links(one.sets, two.sets if two else None, num, den)
        two = two or one
        forest, degrees = _found(np.array(one.fps), np.array(two.fps), np.array(one.copies), np.array(two.copies), i, j)
        return pa.RecordBatch.from_arrays([pa.array([forest], pa.list_(_LINK)), pa.array([degrees], pa.list_(_DEG))],
                                          names=["forest", "degrees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, members, queries = None, None, _Block(), _Block()
        for b in _sliced(batches, 256):
            rows = zip(*(b.column(i).to_pylist() for i in range(5)), shingle_sets(_blobs(b.column(5)), k))
            for group, salt, role, fp, copies, s in rows:
                if (group, salt) != at:
                    if queries.fps:
                        yield found(queries, members)
                    if members.fps and at[1] == 0:
                        yield found(members, None)
                    at, last, members, queries = (group, salt), None, _Block(), _Block()
                if not len(s) or _fp(s) != fp or (role, fp) == last:
                    continue  # another text of the same id, or a repeated row
                last = role, fp
                if role:
                    queries.add(fp, copies, s.copy())
                    if queries.full():
                        yield found(queries, members)
                        queries = _Block()
                else:
                    members.add(fp, copies, s.copy())
        if queries.fps:
            yield found(queries, members)
        if members.fps and at[1] == 0:
            yield found(members, None)

    return run


def _joined(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, text_hash, n, n_links, least, component) of every row: component is the
    fingerprint that names the component, null for an empty set; least its smallest id."""
    shelf = Shelf(docs.sparkSession, "ngram-join")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = base.where("id is not null")
    sketch = shelf.put("sketch", base.select("id", "text", F.xxhash64("text")).mapInArrow(
        _sketches(k), "id long, n long, fp long, text_hash long"))
    classes = (sketch.where("fp is not null and id is not null").groupBy("fp")
               .agg(F.min("id").alias("rep"), F.count("*").alias("copies")))

    # The list: counts over all texts; its length is checked before use.
    counted = shelf.put("counts", named.select("text").mapInArrow(_counted(k, num, den), "token long, n long")
                        .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > HOT))
    least = HOT
    while counted.where(F.col("n") > least).count() > MAX_HOT:
        least *= 2
    hot = counted.where(F.col("n") > least).toArrow()
    tokens, freq = (hot.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    tokens = tokens.view(np.uint64)
    order = np.argsort(tokens)

    # Tokens that two classes or more are indexed under.
    by_token = Window.partitionBy("token", "salt")
    index = (named.select("text")
             .mapInArrow(_index_rows(k, num, den, tokens[order].tobytes(), freq[order].tobytes()), _INDEX_SCHEMA)
             .repartition("token", "salt").groupBy("token", "salt", "fp").agg(F.first("n").alias("n"))
             .withColumn("classes", F.count("*").over(by_token)).where("n > 0 and (salt > 0 or classes > 1)"))
    index = shelf.put("index", index.select("token", "fp", "n", (F.col("salt") > 0).alias("often")))
    shelf.drop("counts")

    # Groups of the classes that share enough of them: the l of the smallest set that could be linked.
    least_common = f"1 + ((n * {num} + {den - 1}) div {den}) div 40"
    members = shelf.put("members", index.groupBy("fp").agg(
        F.count("*").alias("shared"), F.first("n").alias("n"), F.min(F.struct("often", "token")).alias("key"))
        .where(f"shared >= {least_common}").select("fp", "n", "key"))
    place = shelf.put("place", _placed(members, shelf))

    # Token unions: the tokens of each group that another group has too. Tokens of exactly
    # the same groups are one signature, so that a family's common tokens count at once.
    rows = shelf.put("rows", index.join(place, "fp").select("token", "fp", "n", "group_id"))
    shelf.drop("index", "members", "numbered")
    sizes = rows.groupBy("group_id").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    union = shelf.put("union", rows.select("token", "group_id").distinct())
    mark = [F.bit_xor(F.xxhash64(F.lit(x), "group_id")).alias(f"sig{x}") for x in (1, 2)]
    signed = shelf.put("signed", union.groupBy("token").agg(F.count("*").alias("groups"), *mark)
                       .where("groups > 1").drop("groups"))
    sig = ["sig1", "sig2"]
    unions = union.join(signed, "token").select(*sig, "group_id").distinct().join(sizes, "group_id").select(
        *sig, F.col("group_id").alias("union_id"), "low", "high")

    # The bound on the overlap of a class with a group.
    weights = rows.join(signed, "token").groupBy("fp", "n", "group_id", *sig).agg(F.count("*").alias("w"))
    queries = shelf.put("queries", weights.join(unions.hint("merge"), sig)
                        .where(f"group_id < union_id and {num} * low <= {den} * n and {den} * high >= {num} * n")
                        .groupBy("fp", "union_id").agg(F.sum("w").alias("common"), F.first("n").alias("n"))
                        .where(f"common >= {least_common}")
                        .select("fp", F.col("union_id").alias("group_id")))
    shelf.drop("rows", "union", "signed")

    # Who goes where: members to every part of their group, queries to one.
    parts = (place.groupBy("group_id").agg(F.count("*").alias("m"))
             .join(queries.groupBy("group_id").agg(F.count("*").alias("q")), "group_id", "left")
             .where("m > 1 or q > 0")
             .select("group_id", (1 + F.expr(f"coalesce(q, 0) div {TASK_QUERIES}")).cast("int").alias("parts")))
    own = place.join(parts, "group_id").select(
        "fp", "group_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"))
    asked = queries.join(parts, "group_id").select(
        "fp", "group_id", F.pmod(F.hash("fp"), F.col("parts")).alias("salt"), F.lit(1).alias("role"))
    sent = shelf.put("sent", own.union(asked).join(classes, "fp")
                     .select(F.col("rep").alias("id"), "fp", "group_id", "salt", "role", "copies"))
    shelf.drop("queries")
    few = sent.count() <= BROADCAST_ROWS
    opened = shelf.put("opened", named.join(F.broadcast(sent) if few else sent, "id")
                       .repartition("group_id", "salt").sortWithinPartitions("group_id", "salt", "role", "fp")
                       .select("group_id", "salt", "role", "fp", "copies", "text")
                       .mapInArrow(_opened(k, num, den), _OPEN_SCHEMA))
    shelf.drop("sent", "place")

    edges = opened.select(F.explode("forest").alias("e")).select("e.a", "e.b")
    degrees = (opened.select(F.explode("degrees").alias("d")).groupBy(F.col("d.id").alias("fp"))
               .agg(F.sum("d.links").alias("links")))
    nodes = connected_components(edges).join(classes, F.col("node") == F.col("fp")).select("fp", "component", "rep")
    least_id = nodes.groupBy("component").agg(F.min("rep").alias("least"))
    labels = (classes.join(nodes.join(least_id, "component").select("fp", "component", "least"), "fp", "left")
              .join(degrees, "fp", "left")
              .select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("least", "rep").alias("least"),
                      (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return sketch.join(labels, "fp", "left").select(
        "id", "text_hash", "n", "component", F.coalesce("least", "id").alias("least"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                    num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, n_links (other rows with a
    Jaccard similarity of at least num/den), component_id (smallest id that links
    reach). See the module for the method and the special cases."""
    return _joined(docs, id_col, text_col, k, num, den).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), 0).otherwise(F.col("n_links")).alias("n_links"),
        F.when(F.col("id").isNotNull(), F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
             num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that with the smallest id, then the smallest
    hash of its text, then the smallest columns in their order. Rows of one id with
    different texts are told apart; rows without an id or with an empty set all stay."""
    rows = _joined(docs, id_col, text_col, k, num, den).where("id is not null")
    first = (rows.where("component is not null").groupBy("component")
             .agg(F.min(F.struct("id", "text_hash")).alias("first")).select("first.*").distinct())
    empty = rows.where("component is null").select("id", "text_hash").distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    key = ["id", "text_hash"]
    one = row.join(first, key, "left_semi").groupBy(*key).agg(F.min("row").alias("row"))
    rest = row.join(empty, key, "left_semi").unionByName(row.where("id is null"))
    return one.select("row.*").union(rest.select("row.*"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


#: DuckDB SQL of op1_ngram_jaccard_join(): all pairs that share a shingle, counted.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT x, x FROM u UNION SELECT k.x, u.y FROM reach k JOIN u ON k.y = u.x),
least_id AS (SELECT reach.x, min(doc_id) AS c FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x),
links AS (SELECT x, count(*) AS k FROM u GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(k, 0) AS n_links, coalesce(c, doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN links ON links.x = d.r LEFT JOIN least_id ON least_id.x = d.r
"""
