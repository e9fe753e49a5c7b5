"""Detail maps on mesh entities: numbering, Laplacian, least squares, tessellation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from . import kernels

#: Texels along an edge's R parts: inside an edge, a triangle, a quad.
R = 10


def counts(r: int = R) -> dict[str, int]:
    return {"vertex": 1, "edge": r - 1, "triangle": (r - 1) * (r - 2) // 2, "quad": (r - 1) ** 2}


def numbering(entities: DataFrame, r: int = R) -> DataFrame:
    """(kind, id, first): consecutive texel numbers of entities (kind, id), kinds in
    order; within a kind by rank of the id, which is dense within partitions of the
    range order, so no single task orders all."""
    size = counts(r)
    order = {"vertex": 0, "edge": 1, "triangle": 2, "quad": 3}
    n = {row["kind"]: row["count"] for row in entities.groupBy("kind").count().collect()}
    base, offset = {}, 0
    for kind in order:
        base[kind] = offset
        offset += n.get(kind, 0) * size[kind]
    from .tables import cut

    ranked = cut(entities.select("kind", "id").repartitionByRange("kind", "id").withColumn("part", F.spark_partition_id()), "texels")
    w = Window.partitionBy("part", "kind").orderBy("id")
    before: dict[tuple, int] = {}
    seen: dict[str, int] = {}
    for row in ranked.groupBy("part", "kind").count().orderBy("part").collect():  # one row for each partition and kind
        before[(row["part"], row["kind"])] = seen.get(row["kind"], 0)
        seen[row["kind"]] = seen.get(row["kind"], 0) + row["count"]
    start = ranked.sparkSession.createDataFrame(
        [(p, k, base[k] + v * size[k], size[k]) for (p, k), v in before.items()] or [(-1, "vertex", 0, 1)],
        "part int, kind string, start long, size int")
    return (ranked.withColumn("k", F.row_number().over(w) - 1).join(F.broadcast(start), ["part", "kind"])
            .select("kind", "id", (F.col("start") + F.col("k") * F.col("size")).alias("first")))


def quad_grid(quads: DataFrame, r: int = R) -> DataFrame:
    """(fid, i, j, x, y, z, nx, ny, nz, h): the (r+1)^2 samples of quads given by
    corners p0..p3 and n0..n3 with heights h0..h3 in ring order, displaced along the normal."""
    g = (quads.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(r)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(r))))
         .withColumns({"u": F.expr(f"i / double({r})"), "v": F.expr(f"j / double({r})")}))
    mix = lambda p: E.bilinear(f"{p[0]}0{p[1:]}", f"{p[0]}1{p[1:]}", f"{p[0]}2{p[1:]}", f"{p[0]}3{p[1:]}", "u", "v")
    s = g.selectExpr("fid", "i", "j", *[f"{mix(f'p{c}')} AS p{c}" for c in "xyz"], *[f"{mix(f'n{c}')} AS m{c}" for c in "xyz"],
                     f"{mix('h')} AS h")
    s = s.selectExpr("fid", "i", "j", "px", "py", "pz", "h", *[f"{t} AS n{c}" for t, c in zip(E.unit(E.vec("m")), "xyz")])
    return s.selectExpr("fid", "i", "j", *[f"p{c} + h * n{c} AS {c}" for c in "xyz"], "nx", "ny", "nz", "h")


def triangle_grid(triangles: DataFrame, r: int = R) -> DataFrame:
    """(fid, i, j, x, y, z): samples i + j <= r of triangles with corners p0..p2."""
    g = (triangles.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(r))))
         .withColumn("j", F.explode(F.expr(f"sequence(0, {r} - i)")))
         .withColumns({"u": F.expr(f"i / double({r})"), "v": F.expr(f"j / double({r})")}))
    return g.selectExpr("fid", "i", "j", *[f"{E.barycentric(f'p0{c}', f'p1{c}', f'p2{c}', 'u', 'v')} AS {c}" for c in "xyz"])


def grid_cells(samples: DataFrame, r: int = R) -> DataFrame:
    """(fid, i, j, ring): the r^2 small quads over samples of quads."""
    return samples.where(f"i < {r} AND j < {r}").selectExpr(
        "fid", "i", "j", "array(struct(i, j), struct(i + 1 AS i, j), struct(i + 1 AS i, j + 1 AS j), struct(i, j + 1 AS j)) AS ring")


def samples(faces: DataFrame, edge_first: DataFrame, face_first: DataFrame, vertex_first: DataFrame, r: int = R) -> DataFrame:
    """(fid, i, j, texel) for the grid samples of quads and triangles (fid, verts), where a
    sample on a border belongs to the edge or vertex that faces share. edge_first
    (v0, v1, first), face_first (fid, first) and vertex_first (root, first) come from
    numbering(); an edge's texels run from its smaller vertex."""
    f = faces.select("fid", F.size("verts").alias("n"), *[F.get("verts", F.lit(k)).alias(f"v{k}") for k in range(4)])
    g = (f.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(r))))
         .withColumn("i", F.explode(F.expr(f"sequence(0, CASE WHEN n = 4 THEN {r} ELSE {r} - j END)"))))
    # Where a border sample lies: from, to and how many parts of the edge from the first.
    quad = [(f"i = 0 AND j = 0", "v0", "v0", "0"), (f"i = {r} AND j = 0", "v1", "v1", "0"), (f"i = {r} AND j = {r}", "v2", "v2", "0"),
            (f"i = 0 AND j = {r}", "v3", "v3", "0"), ("j = 0", "v0", "v1", "i"), (f"i = {r}", "v1", "v2", "j"),
            (f"j = {r}", "v3", "v2", "i"), ("i = 0", "v0", "v3", "j")]
    tri = [("i = 0 AND j = 0", "v0", "v0", "0"), (f"i = {r}", "v1", "v1", "0"), (f"j = {r}", "v2", "v2", "0"),
           ("j = 0", "v0", "v1", "i"), ("i = 0", "v0", "v2", "j"), (f"i + j = {r}", "v1", "v2", "j")]

    def border(k: int) -> str:
        cases = " ".join(f"WHEN n = {n} AND {where[0]} THEN {where[k]}" for n, rows in ((4, quad), (3, tri)) for where in rows)
        return f"CASE {cases} END"

    inner = (f"CASE WHEN n = 4 THEN (j - 1) * {r - 1} + i - 1 ELSE (j - 1) * {r - 1} - (j - 1) * j DIV 2 + i - 1 END")
    g = g.selectExpr("fid", "i", "j", f"{border(1)} AS a", f"{border(2)} AS b", f"CAST({border(3)} AS BIGINT) AS at", f"CAST({inner} AS BIGINT) AS inner")
    corner = g.where("a = b").join(vertex_first, F.col("a") == F.col("root")).select("fid", "i", "j", F.col("first").alias("texel"))
    edge = (g.where("a <> b").withColumns({"v0": F.least("a", "b"), "v1": F.greatest("a", "b")}).join(edge_first, ["v0", "v1"])
            .select("fid", "i", "j", F.expr(f"first + CASE WHEN a = v0 THEN at ELSE {r} - at END - 1").alias("texel")))
    inside = g.where("a IS NULL").join(face_first, "fid").select("fid", "i", "j", F.expr("first + inner").alias("texel"))
    return corner.union(edge).union(inside)


def numbered_mesh(vertices: DataFrame, faces: DataFrame, r: int = R) -> DataFrame:
    """samples() of a mesh (root...), (fid, verts), numbered here. Edges are known by the
    order of their vertices."""
    from .extract import dense_ids, face_edges
    from .tables import cut

    edges = cut(dense_ids(face_edges(faces).select(F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1")).distinct(),
                          ("v0", "v1"), "id"), "edge-ids")
    kinds = (vertices.select(F.lit("vertex").alias("kind"), F.col("root").alias("id")).union(edges.select(F.lit("edge"), "id"))
             .union(faces.select(F.when(F.size("verts") == 4, "quad").otherwise("triangle"), "fid")))
    n = cut(numbering(kinds, r), "texel-ids")
    return samples(faces, edges.join(n.where("kind = 'edge'"), "id").select("v0", "v1", "first"),
                   n.where("kind in ('quad', 'triangle')").select(F.col("id").alias("fid"), "first"),
                   n.where("kind = 'vertex'").select(F.col("id").alias("root"), "first"), r)


def texel_neighbours(grid: DataFrame, faces: DataFrame) -> DataFrame:
    """(t, s) pairs of texels next to each other on a face's grid: along its two axes, on
    triangles along the third side too. Pairs on an edge come from both its faces once."""
    kind = faces.select("fid", (F.size("verts") == 3).alias("tri"))
    g = grid.join(kind, "fid")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(t).alias("only")) for a, b, t in (
        (1, 0, False), (0, 1, False), (1, -1, True))]))
    moved = g.withColumn("o", step).where("tri OR NOT o.only").select(
        "fid", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), F.col("texel").alias("t"))
    pairs = moved.join(grid.select("fid", "i", "j", F.col("texel").alias("s")), ["fid", "i", "j"]).where("t <> s")
    return pairs.select(F.least("t", "s").alias("t"), F.greatest("t", "s").alias("s")).distinct()


def interpolation_weights(points: DataFrame, grid: DataFrame, faces: DataFrame, r: int = R) -> DataFrame:
    """(obs, texel, w): the texels around points (obs, fid, u, v) and their weights, which
    add up to one: bilinear in a small quad, barycentric in a small triangle."""
    p = points.join(faces.select("fid", (F.size("verts") == 3).alias("tri")), "fid").selectExpr(
        "obs", "fid", "tri", f"least({r - 1}, greatest(0, CAST(floor(u * {r}) AS INT))) AS i0", f"u * {r} AS x",
        f"least({r - 1}, greatest(0, CAST(floor(v * {r}) AS INT))) AS j0", f"v * {r} AS y")
    # On the far side of a triangle's diagonal the cell is one step back.
    p = p.selectExpr("obs", "fid", "tri", "x", "y", "j0", f"CASE WHEN tri THEN greatest(0, least(i0, {r - 1} - j0)) ELSE i0 END AS i0")
    p = p.selectExpr("obs", "fid", "tri", "i0", "j0", "x - i0 AS a", "y - j0 AS b")
    def around(*corners: tuple[int, int, str]) -> str:
        return "array(" + ", ".join(f"named_struct('di', {di}, 'dj', {dj}, 'w', CAST({w} AS DOUBLE))" for di, dj, w in corners) + ")"

    square = around((0, 0, "(1 - a) * (1 - b)"), (1, 0, "a * (1 - b)"), (0, 1, "(1 - a) * b"), (1, 1, "a * b"))
    lower, upper = around((0, 0, "1 - a - b"), (1, 0, "a"), (0, 1, "b")), around((1, 1, "a + b - 1"), (0, 1, "1 - a"), (1, 0, "1 - b"))
    corner = f"CASE WHEN NOT tri THEN {square} WHEN a + b <= 1 OR i0 + j0 >= {r - 1} THEN {lower} ELSE {upper} END"
    e = p.select("obs", "fid", "i0", "j0", F.explode(F.expr(corner)).alias("c")).selectExpr(
        "obs", "fid", "i0 + c.di AS i", "j0 + c.dj AS j", "CAST(c.w AS DOUBLE) AS w")
    return e.join(grid, ["fid", "i", "j"]).groupBy("obs", "texel").agg(F.sum("w").alias("w"))


def laplacian(texels: DataFrame) -> DataFrame:
    """(row, col, val) of the uniform Laplacian over neighbour pairs (t, s)."""
    both = texels.select("t", "s").union(texels.select(F.col("s").alias("t"), F.col("t").alias("s"))).distinct()
    degree = both.groupBy("t").count()
    off = both.join(degree, "t").select(F.col("t").alias("row"), F.col("s").alias("col"), (-1.0 / F.col("count")).alias("val"))
    return off.union(degree.select(F.col("t").alias("row"), F.col("t").alias("col"), F.lit(1.0)))


def normal_equations(lap: DataFrame, data: DataFrame, values: tuple[str, ...], smoothness: float = 0.8,
                     fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, col, val) and (row, values...) of the least squares of Laplacian rows,
    weighted by smoothness, and data rows (obs, col, w, values...). Texels of fixed
    (row, values...) keep their value: they are no unknowns, and what they contribute
    stands on the right side."""
    l1 = lap.select("row", F.col("col").alias("i"), F.col("val").alias("a"))
    l2 = lap.select("row", F.col("col").alias("j"), F.col("val").alias("b"))
    smooth = l1.join(l2, "row").select("i", "j", (F.col("a") * F.col("b") * smoothness).alias("v"))
    d1 = data.select("obs", F.col("col").alias("i"), F.col("w").alias("a"), *values)
    d2 = data.select("obs", F.col("col").alias("j"), F.col("w").alias("b"))
    fit = d1.join(d2, "obs").select("i", "j", (F.col("a") * F.col("b") * (1 - smoothness)).alias("v"))
    m = smooth.union(fit).groupBy(F.col("i").alias("row"), F.col("j").alias("col")).agg(F.sum("v").alias("val"))
    rhs = d1.groupBy(F.col("i").alias("row")).agg(*[F.sum(F.col("a") * F.col(v) * (1 - smoothness)).alias(v) for v in values])
    if fixed is None:
        return m, rhs
    known = fixed.select(F.col("row").alias("known"), *[F.col(v).alias(f"f_{v}") for v in values])
    m = m.join(known.select("known"), F.col("row") == F.col("known"), "left_anti")
    moved = m.join(known, F.col("col") == F.col("known")).groupBy("row").agg(
        *[F.sum(-F.col("val") * F.col(f"f_{v}")).alias(v) for v in values])
    rhs = rhs.join(known.select("known"), F.col("row") == F.col("known"), "left_anti").unionByName(moved)
    return (m.join(known.select("known"), F.col("col") == F.col("known"), "left_anti"),
            rhs.groupBy("row").agg(*[F.sum(v).alias(v) for v in values]))


def first_guess(matrix: DataFrame, rhs: DataFrame, values: tuple[str, ...], rounds: int = 10) -> DataFrame:
    """(row, values...): a texel with data starts at its right side over its diagonal,
    others take the start of the neighbour with the largest weight, for some rounds; what
    no start reaches begins at zero."""
    from .tables import cut

    rows = matrix.select("row").distinct()
    diagonal = matrix.where("row = col").select("row", F.col("val").alias("diagonal"))
    known = rhs.join(diagonal, "row").where("diagonal <> 0").select("row", *[(F.col(v) / F.col("diagonal")).alias(v) for v in values])
    known = cut(known.join(rows, "row", "left_semi"), "starts")
    links = matrix.where("row <> col AND val <> 0")
    for _ in range(rounds):
        open_rows = rows.join(known.select("row"), "row", "left_anti")
        given = known.select(F.col("row").alias("col"), *values)
        new = cut(links.join(open_rows, "row", "left_semi").join(given, "col").groupBy("row").agg(
            F.min_by(F.struct(*values), F.struct((-F.abs("val")).alias("w"), "col")).alias("s")).select("row", "s.*"), "starts")
        if new.isEmpty():
            break
        known = cut(known.union(new), "starts")
    return rows.join(known, "row", "left").select("row", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def solve(matrix: DataFrame, rhs: DataFrame, blocks: DataFrame, values: tuple[str, ...], tolerance: float = 1e-4,
          rounds: int = 500) -> DataFrame:
    """(row, values...) that solve the symmetric positive system matrix (row, col, val),
    rhs (row, values...), to a residual of tolerance times the right side.

    Conjugate gradients over the whole system: a product is one join on the column and one
    sum. The preconditioner solves each block (row, block) alone, in one task, so few
    rounds are needed and no entry between blocks is lost. The driver sees a few sums a
    round; each round is written to the shared folder and the one before deleted. Raises
    if the rounds run out."""
    from .graph import delete_path
    from .tables import cut

    spark = matrix.sparkSession
    m = cut(matrix.join(blocks, "row").select("row", "col", "val", "block"), "matrix")
    inside = cut(m.join(blocks.select(F.col("row").alias("col"), F.col("block").alias("other")), "col").where("block = other")
                 .select("block", "row", "col", "val"), "blocks")

    def times(x: DataFrame, cols: dict[str, str]) -> DataFrame:
        """(row, new...) for columns old -> new of x."""
        return (m.join(x.select(F.col("row").alias("col"), *cols), "col").groupBy("row")
                .agg(*[F.sum(F.col("val") * F.col(o)).alias(n) for o, n in cols.items()]))

    res, pre, direction = ([f"{p}_{v}" for v in values] for p in "rzd")

    def conditioned(x: DataFrame) -> DataFrame:
        """x with z: every block's residual solved by its own matrix."""
        schema = "row long, " + ", ".join(f"{z} double" for z in pre)

        def run(entries: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            ids = np.unique(entries["row"])
            right = right.set_index("row").reindex(ids).fillna(0.0)
            place = pd.Series(np.arange(len(ids)), index=ids)
            z = kernels.conjugate_gradient(place[entries["row"]].to_numpy(), place[entries["col"]].to_numpy(),
                                           entries["val"].to_numpy(float), right[list(res)].to_numpy(float),
                                           np.zeros((len(ids), len(values))), 1e-10)
            return pd.DataFrame({"row": ids} | {c: z[:, i] for i, c in enumerate(pre)})

        own = x.join(blocks, "row").select(F.col("block").alias("own"), "row", *res)
        z = inside.groupBy("block").cogroup(own.groupBy("own")).applyInPandas(run, schema)
        return x.join(z, "row", "left").fillna(0.0, subset=list(pre))

    start = cut(first_guess(matrix, rhs, values), "start")
    goal = {v: tolerance ** 2 * max(s or 0.0, 1e-30) for v, s in rhs.agg(*[F.sum(F.col(v) * F.col(v)).alias(v) for v in values]).first().asDict().items()}
    right = rhs.select("row", *[F.col(v).alias(f"b_{v}") for v in values])
    x = start.join(right, "row", "left").join(times(start, {v: f"q_{v}" for v in values}), "row", "left").select(
        "row", *values, *[(F.coalesce(f"b_{v}", F.lit(0.0)) - F.coalesce(f"q_{v}", F.lit(0.0))).alias(f"r_{v}") for v in values])
    x = cut(conditioned(x).withColumns({d: F.col(z) for d, z in zip(direction, pre)}), "cg")

    def sums(x: DataFrame, *pairs: tuple[str, str]) -> list[dict[str, float]]:
        got = x.agg(*[F.sum(F.col(f"{a}_{v}") * F.col(f"{b}_{v}")).alias(f"{a}{b}_{v}") for a, b in pairs for v in values]).first()
        return [{v: got[f"{a}{b}_{v}"] or 0.0 for v in values} for a, b in pairs]

    rr, rz = sums(x, ("r", "r"), ("r", "z"))
    for _ in range(rounds):
        todo = [v for v in values if rr[v] > goal[v]]
        if not todo:
            return x.select("row", *values)
        both = cut(x.join(times(x, {f"d_{v}": f"q_{v}" for v in values}), "row"), "cg")
        (dq,) = sums(both, ("d", "q"))
        step = {v: rz[v] / dq[v] if v in todo and dq[v] else 0.0 for v in values}
        moved = both.select("row", *[(F.col(v) + step[v] * F.col(f"d_{v}")).alias(v) for v in values],
                            *[(F.col(f"r_{v}") - step[v] * F.col(f"q_{v}")).alias(f"r_{v}") for v in values], *direction)
        solved = cut(conditioned(moved), "cg")
        rr, new = sums(solved, ("r", "r"), ("r", "z"))
        turn = {v: new[v] / rz[v] if v in todo and rz[v] else 0.0 for v in values}
        for old in (x, both):
            delete_path(spark, old.inputFiles()[0].rsplit("/", 1)[0])
        x = solved.withColumns({f"d_{v}": F.col(f"z_{v}") + turn[v] * F.col(f"d_{v}") for v in values})
        rz = new
    raise ValueError(f"no solution to a tolerance of {tolerance} in {rounds} rounds")


def project(points_on_faces: DataFrame, scale: float) -> DataFrame:
    """(pid, fid, u, v, h): each point's best face, by |h|, of candidates (pid, x, y, z,
    fid, corners array<struct<x,y,z,nx,ny,nz>> of a quad or triangle); |h| < scale and a
    squared residual within 0.001 scale^2."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = pdf["corners"].map(len)
            for n in (3, 4):
                part = pdf[size == n]
                if not len(part):
                    continue
                c = np.array([[[k[f] for f in ("x", "y", "z", "nx", "ny", "nz")] for k in row] for row in part["corners"]], float)
                x, r = kernels.project_to_patch(part[["x", "y", "z"]].to_numpy(float), c[:, :, :3], c[:, :, 3:])
                ok = (np.abs(x[:, 2]) < scale) & (r <= 0.001 * scale * scale) & (x[:, :2] >= -1e-6).all(1)
                ok &= (x[:, :2] <= 1 + 1e-6).all(1) if n == 4 else x[:, 0] + x[:, 1] <= 1 + 1e-6
                yield pd.DataFrame({"pid": part["pid"], "fid": part["fid"], "u": x[:, 0], "v": x[:, 1], "h": x[:, 2]})[ok]

    found = points_on_faces.mapInPandas(run, "pid long, fid long, u double, v double, h double")
    return found.groupBy("pid").agg(F.min_by(F.struct("fid", "u", "v", "h"), F.struct(F.abs("h"), "fid")).alias("m")).select("pid", "m.*")


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, corners): positions and normals of faces (fid, verts) in ring order."""
    fields = F.struct("x", "y", "z", "nx", "ny", "nz")
    at = faces.select("fid", F.posexplode("verts").alias("k", "root")).join(vertices, "root").groupBy("fid").agg(
        F.array_sort(F.collect_list(F.struct("k", fields.alias("c")))).alias("c"))
    return at.join(faces.select("fid", F.size("verts").alias("n")), "fid").where("size(c) = n").select(
        "fid", F.transform("c", lambda x: x["c"]).alias("corners"))


def incident(points: DataFrame, member: DataFrame, faces: DataFrame) -> DataFrame:
    """(pid, x, y, z, fid): points with the faces at their cluster's vertex."""
    at = faces.select("fid", F.explode("verts").alias("root"))
    return points.select("pid", "x", "y", "z").join(member, "pid").join(at, "root").select("pid", "x", "y", "z", "fid")


def map_attributes(points: DataFrame, member: DataFrame, vertices: DataFrame, faces: DataFrame, grid: DataFrame, scale: float,
                   colours: tuple[str, ...] = (), smoothness: float = 0.8, tolerance: float = 1e-4, block: int = 4096) -> DataFrame:
    """(texel, h, colours...): the detail map of a mesh. Every point is projected on its
    best incident face; its height and colours are data at the texels around it, smoothed
    by the Laplacian of all texels. Texels of faces that no data reaches are 0."""
    from .tables import cut

    values = ("h", *colours)
    hit = project(incident(points, member, faces).join(corners(faces, vertices), "fid"), scale)
    hit = cut(hit.join(points.select("pid", *colours), "pid"), "projected")
    w = interpolation_weights(hit.select(F.col("pid").alias("obs"), "fid", "u", "v"), grid, faces)
    data = w.join(hit.select(F.col("pid").alias("obs"), *[F.col(c).cast("double").alias(c) for c in values]), "obs").select(
        "obs", F.col("texel").alias("col"), "w", *values)
    m, rhs = normal_equations(laplacian(texel_neighbours(grid, faces)), cut(data, "data"), values, smoothness)
    m = cut(m, "system")
    blocks = m.select("row").distinct().select("row", F.expr(f"row div {block}").alias("block"))
    out = solve(m, cut(rhs, "right"), blocks, values, tolerance)
    return clamp_colours(out.withColumnRenamed("row", "texel"), colours)


def clamp_colours(texels: DataFrame, colours: tuple[str, ...] = ("l", "a", "b")) -> DataFrame:
    return texels.select(*[F.greatest(F.lit(0.0), F.least(F.lit(65535.0), c)).alias(c) if c in colours else F.col(c)
                           for c in texels.columns])


def fine_mesh(vertices: DataFrame, faces: DataFrame, grid: DataFrame, texels: DataFrame | None = None, triangles: bool = False,
              r: int = R) -> tuple[DataFrame, DataFrame]:
    """Vertices (root is the texel) and faces (fid, verts) of the tessellated mesh: r^2
    small quads of a quad (twice as many triangles if asked for), r^2 small triangles of a
    triangle, displaced along the normal by the texels' heights (texel, h)."""
    c = corners(faces, vertices).select("fid", F.size("corners").alias("n"), *[
        F.get("corners", F.lit(k))[f].alias(f"{p}{k}{f[-1]}") for k in range(4) for p, fs in (("p", "xyz"), ("m", ("nx", "ny", "nz"))) for f in fs])
    g = grid.join(c, "fid").withColumns({"u": F.expr(f"i / double({r})"), "v": F.expr(f"j / double({r})")})
    mix = lambda p, a: (f"CASE WHEN n = 4 THEN {E.bilinear(*[f'{p}{k}{a}' for k in range(4)], 'u', 'v')} "  # noqa: E731
                        f"ELSE {E.barycentric(*[f'{p}{k}{a}' for k in range(3)], 'u', 'v')} END")
    at = g.selectExpr("fid", "texel", *[f"{mix('p', a)} AS {a}" for a in "xyz"], *[f"{mix('m', a)} AS m{a}" for a in "xyz"])
    at = at.groupBy("texel").agg(F.min_by(F.struct("x", "y", "z", "mx", "my", "mz"), "fid").alias("s")).select("texel", "s.*")
    at = at.select("texel", "x", "y", "z", *[F.expr(t).alias(f"n{a}") for t, a in zip(E.unit(E.vec("m")), "xyz")])
    if texels is not None:
        at = at.join(texels.select("texel", "h"), "texel", "left").select(
            "texel", *[F.expr(f"{a} + coalesce(h * n{a}, 0e0)").alias(a) for a in "xyz"], "nx", "ny", "nz")
    key = grid.join(faces.select("fid", F.size("verts").alias("n")), "fid")
    quad = [("n = 4", ((0, 0), (1, 0), (1, 1), (0, 1)))]
    split = [("n = 4", ((0, 0), (1, 0), (1, 1))), ("n = 4", ((0, 0), (1, 1), (0, 1)))]
    small = [("n = 3", ((0, 0), (1, 0), (0, 1))), ("n = 3", ((1, 1), (0, 1), (1, 0)))]
    parts = None
    for where, offsets in [*(split if triangles else quad), *small]:
        part = key.where(where).select("fid", (F.col("i")).alias("ci"), F.col("j").alias("cj"))
        for k, (di, dj) in enumerate(offsets):
            part = part.join(grid.select("fid", (F.col("i") - di).alias("ci"), (F.col("j") - dj).alias("cj"), F.col("texel").alias(f"t{k}")),
                             ["fid", "ci", "cj"])
        verts = F.array(*[f"t{k}" for k in range(len(offsets))])
        parts = part.select(verts.alias("verts")) if parts is None else parts.union(part.select(verts))
    return at.withColumnRenamed("texel", "root"), parts.select(F.xxhash64("verts").alias("fid"), "verts")


def wireframe(faces: DataFrame, grid: DataFrame, r: int = R) -> DataFrame:
    """(fid, verts): every edge in r parts, each a face of no area (a, b, b) for programs
    that know no lines."""
    n = grid.join(faces.select("fid", F.size("verts").alias("n")), "fid")
    side = lambda axis, at, where: n.where(where).select("fid", F.lit(axis).alias("side"), F.expr(at).alias("k"), "texel")
    rim = (side(0, "i", "j = 0").union(side(1, "j", "i = 0")).union(side(2, "j", f"n = 4 AND i = {r}"))
           .union(side(3, "i", f"n = 4 AND j = {r}")).union(side(4, "i", f"n = 3 AND i + j = {r}")))
    pairs = rim.alias("a").join(rim.alias("b"), F.expr("a.fid = b.fid AND a.side = b.side AND b.k = a.k + 1"))
    ends = pairs.select(F.least("a.texel", "b.texel").alias("s"), F.greatest("a.texel", "b.texel").alias("t")).distinct()
    return ends.select(F.xxhash64("s", "t").alias("fid"), F.array("s", "t", "t").alias("verts"))


def smooth_points(points: DataFrame, radius: float, amount: float, axes: tuple[float, float, float] = (0.0, 0.0, 1.0),
                  brush: tuple[tuple[float, float, float], float] | None = None) -> DataFrame:
    """One step of the smoothing brush: points move towards the Gaussian mean of their
    neighbours by a share along two tangents and the normal. brush, a centre and a
    radius, leaves points outside it where they are."""
    from .spatial import radius_join

    inside = points
    if brush is not None:
        inside = points.where(F.expr(f"{E.dist2(E.vec(''), tuple(map(repr, map(float, brush[0]))))} <= {float(brush[1]) ** 2!r}"))
    near = radius_join(inside, points, radius, ("x", "y", "z")).withColumn("w", F.expr(f"exp(-9e0 * d2 / {radius * radius!r})"))
    mean = near.groupBy("src").agg(*[(F.sum(F.col("w") * F.col(f"b_{c}")) / F.sum("w")).alias(f"m{c}") for c in "xyz"])
    j = points.join(mean.withColumnRenamed("src", "pid"), "pid", "left" if brush is not None else "inner")
    j = j.withColumns({f"m{c}": F.coalesce(f"m{c}", c) for c in "xyz"})
    b, c = E.tangent_frame(E.vec("n"))
    j = j.withColumns({f"b{k}": F.expr(t) for k, t in zip("xyz", b)} | {f"c{k}": F.expr(t) for k, t in zip("xyz", c)}
                      | {f"d{k}": F.expr(f"m{k} - {k}") for k in "xyz"})
    d = E.vec("d")
    move = {k: f"{amount!r} * (" + " + ".join(f"{s!r} * {E.dot(d, E.vec(p))} * {p}{k}" for s, p in zip(axes, "bcn")) + ")" for k in "xyz"}
    new = {k: F.expr(f"{k} + {m}").alias(k) for k, m in move.items()}
    return j.select(*[new.get(k, F.col(k)) for k in points.columns])


def fill_hole(rim: np.ndarray, targets: np.ndarray, colours: np.ndarray | None = None, per_cell: int = 5, cell: float | None = None):
    """Positions (and colours) at targets: a thin-plate height field over the rim's
    principal plane, with at most per_cell centres for each cell of the plane."""
    centre = rim.mean(0)
    _, _, vt = np.linalg.svd(rim - centre, full_matrices=False)
    uv, h = (rim - centre) @ vt[:2].T, (rim - centre) @ vt[2]
    size = cell or max(1e-12, float(np.ptp(uv, axis=0).max()) / 8)
    keys = pd.Series(list(map(tuple, np.floor(uv / size).astype(int))))
    keep = keys.groupby(keys).cumcount().to_numpy() < per_cell
    tuv = (targets - centre) @ vt[:2].T
    height = kernels.thin_plate(uv[keep], h[keep], tuv)
    height = np.clip(height, h.min() - np.ptp(h), h.max() + np.ptp(h))
    out = centre + tuv @ vt[:2] + height[:, None] * vt[2]
    if colours is None:
        return out, None
    shade = np.column_stack([kernels.thin_plate(uv[keep], c[keep], tuv) for c in colours.T.astype(float)])
    return out, np.clip(shade, 0, 65535)
