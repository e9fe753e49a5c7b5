"""Spatial joins: radius, k nearest, nearest compatible, overlap.

A radius join hashes one side to cells as wide as the radius, repeats the other
side for the cells around it, and joins on the cell. The optimiser doesn't see
that the repeated side is many times its input and would broadcast it, hence the
merge hint; adaptive execution splits cells that hold many points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from .tables import cut

CELL = ("cx", "cy", "cz")


def with_cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({c: F.expr(f"CAST(floor({a} / {size!r}) AS BIGINT)") for c, a in zip(CELL, "xyz")})


def _around(points: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """A row for every given neighbour cell."""
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", o)]) for o in offsets]))
    cols = [c for c in points.columns if c not in CELL]
    return points.withColumn("o", steps).select(
        *cols, *[(F.col(c) + F.col(f"o.{n}")).alias(c) for c, n in zip(CELL, "abc")])


_ALL = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def radius_join(queries: DataFrame, points: DataFrame, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, d2) with d2 <= radius^2 for (pid, x, y, z) rows; columns named in
    keep come from both sides with prefixes a_ and b_. A point meets itself if it
    is on both sides."""
    cols = tuple(dict.fromkeys(("pid", "x", "y", "z", *keep)))
    a = _around(with_cells(queries.select(*cols), radius), _ALL)
    b = with_cells(points.select(*cols), radius)
    a = a.select(*CELL, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = b.select(*CELL, *[F.col(c).alias(f"b_{c}") for c in cols])
    d2 = E.dist2(E.vec("a_"), E.vec("b_"))
    return (a.hint("merge").join(b, list(CELL)).withColumn("d2", F.expr(d2)).where(F.col("d2") <= radius * radius)
            .select(F.col("a_pid").alias("src"), F.col("b_pid").alias("dst"), "d2",
                    *[f"{s}_{k}" for k in keep for s in "ab"]))


def radius_pairs(points: DataFrame, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs (src < dst): each point visits half of its neighbour cells.
    Columns named in keep come from both ends, a_ from src and b_ from dst. Cells are
    dealt over a fixed number of tasks: adaptive execution would put many in one for the
    size of their points, of which the pairs are the square."""
    half = [o for o in _ALL if o > (0, 0, 0)]
    cols = tuple(dict.fromkeys(("pid", "x", "y", "z", *keep)))
    base = with_cells(points.select(*cols), radius)
    a = _around(base, [(0, 0, 0), *half]).select(*CELL, *[F.col(c).alias(f"a_{c}") for c in cols])
    a = a.withColumn("own", F.expr(" AND ".join(
        f"{c} = CAST(floor(a_{x} / {radius!r}) AS BIGINT)" for c, x in zip(CELL, "xyz"))))
    b = base.select(*CELL, *[F.col(c).alias(f"b_{c}") for c in cols])
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * points.sparkSession.sparkContext.defaultParallelism)
    a, b = a.repartition(tasks, *CELL), b.repartition(tasks, *CELL)
    ends = [F.expr(f"IF(a_pid < b_pid, {s}_{k}, {t}_{k})").alias(f"{s}_{k}") for s, t in ("ab", "ba") for k in keep]
    return (a.hint("merge").join(b, list(CELL)).where("NOT own OR a_pid < b_pid")
            .withColumn("d2", F.expr(E.dist2(E.vec("a_"), E.vec("b_")))).where(F.col("d2") <= radius * radius)
            .select(F.least("a_pid", "b_pid").alias("src"), F.greatest("a_pid", "b_pid").alias("dst"), "d2", *ends))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k rows of each src with the smallest (d2, dst), with their rank."""
    w = Window.partitionBy("src").orderBy("d2", "dst")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_knn(queries: DataFrame, points: DataFrame, k: int, radius: float) -> DataFrame:
    """Up to k nearest other points within the radius."""
    return top_k(radius_join(queries, points, radius).where("src <> dst"), k)


def ordered_neighbours(points: DataFrame, codes: list[str], cols: tuple[str, ...], reach: int = 2) -> DataFrame:
    """Pairs of each point with the points up to `reach` ranks after it in each of the
    orders (code, pid). All orders are sorted at once, cut into range partitions; the
    first rows of later partitions, at most `reach` for each, are copied as a halo to the
    ones before."""
    spark = points.sparkSession
    tagged = points.select("pid", *cols, F.posexplode(F.array(*map(F.expr, codes))).alias("order", "code"))
    part = cut(tagged.repartitionByRange("order", "code", "pid").withColumn("part", F.spark_partition_id()), "order")
    w = Window.partitionBy("part", "order").orderBy("code", "pid")
    heads = (part.withColumn("r", F.row_number().over(w)).where(F.col("r") <= reach).drop("r")
             .orderBy("order", "code", "pid").collect())  # reach rows for each partition and order
    halo, after, waiting = [], [], []
    for i in range(len(heads) - 1, -1, -1):  # from the end: `after` are the rows that follow the partition
        r = heads[i]
        waiting.insert(0, r)
        first = i == 0 or (heads[i - 1]["part"], heads[i - 1]["order"]) != (r["part"], r["order"])
        if first:
            halo += [h.asDict() | {"part": r["part"]} for h in after if h["order"] == r["order"]]
            after, waiting = ([*waiting, *[h for h in after if h["order"] == r["order"]]])[:reach], []
    both = part.withColumn("own", F.lit(True))
    if halo:
        ghosts = spark.createDataFrame([tuple(h[c] for c in part.columns) for h in halo], part.schema)
        both = both.union(ghosts.withColumn("own", F.lit(False)))
    row = F.struct("pid", *cols)
    ahead = both.select("own", row.alias("a"), F.array(*[F.lead(row, i).over(w) for i in range(1, reach + 1)]).alias("next"))
    pairs = ahead.select("own", "a", F.explode("next").alias("b"))
    return pairs.where("own and b is not null").select("a", "b")


def zorder_knn(points: DataFrame, k: int, radius: float, origin: float, cell: float, bits: int = 18,
               shifts: int = 4, step: int = 5) -> DataFrame:
    """Approximate neighbours: candidates are two ranks up and down in shifted
    Z-orders, those within the radius ordered by (d2, id), at most k kept."""
    codes = [E.morton(*[f"({E.grid_index(a, origin, cell)} + {s * step})" for a in "xyz"], bits) for s in range(shifts)]
    found = ordered_neighbours(points, codes, ("x", "y", "z"))
    d2 = E.dist2(("a.x", "a.y", "a.z"), ("b.x", "b.y", "b.z"))
    near = found.select(F.col("a.pid").alias("src"), F.col("b.pid").alias("dst"), F.expr(d2).alias("d2"))
    near = near.where(F.col("d2") <= radius * radius)
    both = near.union(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2")).distinct()
    return top_k(both, k)


def nearest_compatible(queries: DataFrame, points: DataFrame, max_error: float, cos: float = 0.7) -> DataFrame:
    """For each query point the nearest point within half the error whose normal
    agrees; none if there is none. Ties go to the smaller id."""
    normals = ("nx", "ny", "nz")
    pairs = radius_join(queries, points, max_error / 2, normals).where("src <> dst")
    agree = F.expr(E.dot(("a_nx", "a_ny", "a_nz"), ("b_nx", "b_ny", "b_nz"))) >= cos
    return (pairs.where(agree).groupBy("src").agg(F.min(F.struct("d2", "dst")).alias("m"))
            .select("src", F.col("m.dst").alias("dst"), F.col("m.d2").alias("d2")))


def without_overlap(scan: DataFrame, base: DataFrame, distance: float) -> DataFrame:
    """Points of the scan with no base point within the distance."""
    hit = radius_join(scan, base, distance).select(F.col("src").alias("pid")).distinct()
    return scan.join(hit, "pid", "left_anti")


def expand_set(members: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Ids of members and of all points within the radius of one."""
    grown = radius_join(members, points, radius).select(F.col("dst").alias("pid"))
    return members.select("pid").union(grown).distinct()


def outside_neighbours(members: DataFrame, adj: DataFrame) -> DataFrame:
    """(src, dst) neighbours of members (pid) that are no members themselves."""
    out = adj.select("src", "dst").join(members.select(F.col("pid").alias("src")), "src", "left_semi")
    return out.join(members.select(F.col("pid").alias("dst")), "dst", "left_anti").select("src", "dst")


def adjacent_cells(cells: DataFrame) -> DataFrame:
    """Occupied cells (cx, cy, cz) with each of their occupied 26 neighbours."""
    own = cells.select(*CELL).distinct()
    a = own.select(*CELL, *[F.col(c).alias(f"s{c}") for c in CELL])
    return (_around(a, [o for o in _ALL if o != (0, 0, 0)]).hint("merge").join(own, list(CELL))
            .select("scx", "scy", "scz", *CELL))


def adjacent_or_coarser(cells: DataFrame) -> DataFrame:
    """Occupied cells (cx, cy, cz) with, in each of the 26 directions, the occupied cell
    there (up = 0), or where there is none the occupied cell there on the next coarser
    level (up = 1); a direction without either gives nothing."""
    own = cells.select(*CELL).distinct()
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", o)]) for o in _ALL if o != (0, 0, 0)]))
    asked = own.select(*[F.col(c).alias(f"s{c}") for c in CELL], steps.alias("o"))
    half = lambda c: F.expr(f"CAST(floor({c} / 2) AS BIGINT)")
    here = asked.select("*", *[(F.col(f"s{c}") + F.col(f"o.{n}")).alias(c) for c, n in zip(CELL, "abc")])
    here = here.join(own.withColumn("found", F.lit(True)), list(CELL), "left")
    near = here.where("found").select(*[f"s{c}" for c in CELL], F.lit(0).alias("up"), *CELL)
    coarse = own.select(*[half(c).alias(c) for c in CELL]).distinct()
    above = here.where("found IS NULL").select(*[f"s{c}" for c in CELL], *[(half(f"s{c}") + F.col(f"o.{n}")).alias(c) for c, n in zip(CELL, "abc")])
    return near.union(above.join(coarse, list(CELL)).select(*[f"s{c}" for c in CELL], F.lit(1).alias("up"), *CELL))
