"""From a smoothed cloud to a mesh: edge classes, contraction, vertices, faces.

What is relational stays in DataFrames; greedy steps whose order matters run as
kernels (see kernels.py), one connected component at a time, as two components
can't influence each other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from . import cellpairs, kernels, lattice
from .graph import connected_components, dense_components
from .tables import cut

FIELDS = lattice.FIELDS


def symmetric(adj: DataFrame) -> DataFrame:
    """Each undirected edge once, src < dst."""
    return adj.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()


def with_fields(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges with the fields of both ends, prefixed a_ and b_."""
    for side, key in (("a", "src"), ("b", "dst")):
        edges = edges.join(points.select(F.col("pid").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in FIELDS]), key)
    return edges


def classify_steps(scale: float, rosy: int = 4, posy: int = 4, lists: str = "spark") -> list[list[str]]:
    """Select lists that turn with_fields() rows into (src, dst, d_dir, error, du,
    dv, class): the lattice shift between the ends' nearest lattice points.
    lists names how the engine writes lists and structs."""
    ends = [f"{s}_{c}" for s in "ab" for c in FIELDS]
    a, b = (lambda f: E.vec(f"a_{f}")), (lambda f: E.vec(f"b_{f}"))
    k0, k1, t0, t1 = E.vec("k0"), E.vec("k1"), E.vec("t0"), E.vec("t1")

    def name(v, prefix):
        return [f"{t} AS {prefix}{c}" for t, c in zip(v, "xyz")]

    one = E.compatible_steps(a("q"), a("n"), b("q"), b("n"), rosy, ["src", "dst", *ends], "k0", "k1")
    axes = [f"{k}{c}" for k in ("k0", "k1", "t0", "t1") for c in "xyz"]
    two = ["src", "dst", *ends, *axes[:6], *name(E.second_axis(k0, a("n"), posy), "t0"),
           *name(E.second_axis(k1, b("n"), posy), "t1"),
           *name(E.middle_point(a(""), a("n"), b(""), b("n")), "m")]
    at0 = E.lattice_coordinates(a("o"), k0, a("n"), E.vec("m"), scale, posy)
    at1 = E.lattice_coordinates(b("o"), k1, b("n"), E.vec("m"), scale, posy)
    three = ["src", "dst", *ends, *axes, *[f"floor({t}) AS {n}" for t, n in zip(at0 + at1, ("u0", "v0", "u1", "v1"))]]
    gap = E.sub(E.lattice_point(a("o"), k0, t0, "u0", "v0", scale), E.lattice_point(b("o"), k1, t1, "u1", "v1", scale))
    four = ["src", "dst", *axes, "u0", "v0", "u1", "v1", *name(gap, "g")]
    # The 16 corner pairs, k = 4 i + j: one small expression, evaluated 16 times.
    ti, tj, bi, bj = "floor(k / 8)", "floor(k / 2) % 2", "floor(k / 4) % 2", "k % 2"
    d = [f"(g{c} + {scale!r} * ({bi} * k0{c} + {ti} * t0{c} - {bj} * k1{c} - {tj} * t1{c}))" for c in "xyz"]
    cost = " + ".join(f"pow({x}, 2)" for x in d)
    best = (f"array_min(transform(sequence(0, 15), k -> struct({cost} AS cost, k AS k)))" if lists == "spark"
            else f"list_min(list_transform(range(16), lambda k: struct_pack(cost := {cost}, k := k)))")
    gap_dir = E.dist2(k0, k1)
    five = ["src", "dst", f"{gap_dir} AS d_dir", "u0", "v0", "u1", "v1", f"{best} AS best"]
    six = ["src", "dst", "d_dir", "best.cost AS error",
           "CAST(u0 + floor(best.k / 4) % 2 - u1 - best.k % 2 AS BIGINT) AS du",
           "CAST(v0 + floor(best.k / 8) - v1 - floor(best.k / 2) % 2 AS BIGINT) AS dv"]
    diagonal = "abs(du) = 1 AND abs(dv) = 1" if posy == 4 else "false"
    seven = ["src", "dst", "d_dir", "error", "du", "dv",
             f"CASE WHEN abs(du) > 1 OR abs(dv) > 1 OR ({diagonal}) THEN 'drop' "
             "WHEN du = 0 AND dv = 0 THEN 'collapse' ELSE 'link' END AS class"]
    return [*one, two, three, four, five, six, seven]


def classify(edges: DataFrame, points: DataFrame, scale: float, rosy: int = 4, posy: int = 4) -> DataFrame:
    fields = lattice.packed(points)
    for side, key in (("a", "src"), ("b", "dst")):
        edges = edges.join(fields.select(F.col("pid").alias(key), F.col("fields").alias(f"{side}_fields")), key)
    return lattice.classified(edges, scale, rosy, posy)


def classify_within(points: DataFrame, radius: float, scale: float, rosy: int = 4, posy: int = 4) -> DataFrame:
    """classify() of all pairs within the radius: the join that finds a pair brings its
    fields along, so pairs, many times the points, are not shuffled to either end."""
    return lattice.classified(pairs_with_fields(points, radius), scale, rosy, posy)


def pairs_with_fields(points: DataFrame, radius: float) -> DataFrame:
    from .spatial import radius_pairs

    return radius_pairs(lattice.packed(points), radius, ("fields",))


def collapsed_within(points: DataFrame, radius: float, scale: float, rosy: int = 4, posy: int = 4) -> tuple[DataFrame, DataFrame]:
    """(src, dst, error, class) of pairs within the radius, and (pid, root): every point with
    its component of collapse pairs.

    Of the pairs only those are computed that can say anything new. Some of them, in number
    like the points, give components first; then all pairs between different ones are
    classified, which the first table holds but for those dropped, and join them. A pair
    inside a component neither joins anything nor links two vertices."""
    fields = cut(lattice.packed(points), "fields")
    few = lattice.classified(cellpairs.sparse_pairs(fields, radius), scale, rosy, posy).where("class = 'collapse'")
    first = cut(clusters(points, dense_components(few, "src", "dst").selectExpr("node AS pid", "component AS root")), "clusters")
    cl = cut(cellpairs.classified(fields.join(first, "pid"), radius, scale, rosy, posy, apart=True, kinds=("collapse", "link")), "classified")
    more = cl.where("class = 'collapse'")
    for end in ("src", "dst"):
        more = more.join(first.select(F.col("pid").alias(end), F.col("root").alias(f"{end}_root")), end)
    joined = dense_components(more, "src_root", "dst_root").selectExpr("node AS root", "component")
    return cl, first.join(joined, "root", "left").select("pid", F.coalesce("component", "root").alias("root"))


def field_energy(classified: DataFrame) -> DataFrame:
    return classified.agg(F.sum("d_dir").alias("direction"), F.sum("error").alias("position"))


def contract(classified: DataFrame) -> DataFrame:
    """(pid, root): collapse edges in order of error merge clusters unless these are
    linked already. Greedy within a component of collapse edges."""
    collapse = classified.where("class = 'collapse'").select("src", "dst", "error")
    comp = cut(connected_components(collapse, "src", "dst"), "components")
    c = collapse.join(comp.withColumnRenamed("node", "src"), "src").select("component", "src", "dst", "error")
    links = (classified.where("class = 'link'").select("src", "dst")
             .join(comp.select(F.col("node").alias("src"), "component"), "src")
             .join(comp.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
             .where("component = other").select("component", "src", "dst", F.lit(None).cast("double").alias("error")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        merges = pdf[pdf["error"].notna()].sort_values(["error", "src", "dst"])
        barred = pdf[pdf["error"].isna()]
        roots = kernels.contract(list(zip(merges["src"], merges["dst"])), list(zip(barred["src"], barred["dst"])))
        return pd.DataFrame({"pid": list(roots), "root": list(roots.values())})

    return c.union(links).groupBy("component").applyInPandas(run, "pid long, root long")


def clusters(points: DataFrame, roots: DataFrame) -> DataFrame:
    """(pid, root) for every point; points that merged with nothing are their own."""
    return points.select("pid").join(roots, "pid", "left").select("pid", F.coalesce("root", "pid").alias("root"))


def centroids(points: DataFrame, member: DataFrame, scale: float) -> DataFrame:
    """Vertices: weights fall with the distance of the position field from the point."""
    w = f"exp(-9.0 * {E.dist2(E.vec('o'), E.vec(''))} / {scale * scale!r})"
    j = points.join(member, "pid").withColumn("w", F.expr(w))
    sums = j.groupBy("root").agg(
        F.count("*").alias("members"), F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"o{c}")).alias(f"o{c}") for c in "xyz"],
        *[F.sum(F.col("w") * F.col(f"n{c}")).alias(f"n{c}") for c in "xyz"])
    return sums.select("root", "members", *[F.expr(f"o{c} / w").alias(c) for c in "xyz"],
                       *[F.expr(t).alias(f"n{c}") for t, c in zip(E.unit(E.vec("n")), "xyz")])


def vertex_links(classified: DataFrame, member: DataFrame) -> DataFrame:
    """(a, b) links between clusters, a < b."""
    m = member.select("pid", "root")
    j = (classified.where("class = 'link'").join(m.select(F.col("pid").alias("src"), F.col("root").alias("ra")), "src")
         .join(m.select(F.col("pid").alias("dst"), F.col("root").alias("rb")), "dst"))
    return j.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct()


def spurious(vertices: DataFrame) -> DataFrame:
    """Vertices made of few points: collapses at most min(20, a tenth of the average)."""
    limit = vertices.agg(F.least(F.lit(20.0), F.avg(F.col("members") - 1) / 10).alias("limit"))
    return vertices.join(F.broadcast(limit)).where("members - 1 <= limit").select("root")


def drop_vertices(links: DataFrame, gone: DataFrame) -> DataFrame:
    return (links.join(gone.select(F.col("root").alias("a")), "a", "left_anti")
            .join(gone.select(F.col("root").alias("b")), "b", "left_anti").select("a", "b"))


def ring_order(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, w, rank): the neighbours of every vertex by falling angle in its tangent
    plane, ties by id."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(
        links.select(F.col("b").alias("v"), F.col("a").alias("w")))
    cols = ("x", "y", "z", "nx", "ny", "nz")
    j = both.join(vertices.select(F.col("root").alias("v"), *cols), "v").join(
        vertices.select(F.col("root").alias("w"), *[F.col(c).alias(f"w{c}") for c in "xyz"]), "w")
    b, c = E.tangent_frame(E.vec("n"))
    d = E.sub(E.vec("w"), E.vec(""))
    angle = F.expr(f"atan2({E.dot(c, d)}, {E.dot(b, d)})")
    w = Window.partitionBy("v").orderBy(F.round(angle, 9).desc(), "w")
    return j.select("v", "w", F.row_number().over(w).alias("rank"))


def successors(ring: DataFrame) -> DataFrame:
    """(a, b, c): after the dart a->b comes b->c, c following a around b."""
    w = Window.partitionBy("v").orderBy("rank")
    first = F.first("w").over(w)
    nxt = F.coalesce(F.lead("w").over(w), first)
    return ring.select(F.col("w").alias("a"), F.col("v").alias("b"), nxt.alias("c"))


def simple_orbits(ring: DataFrame, longest: int = 8) -> DataFrame:
    """(face, degree, verts): closed successor walks of 3 to `longest` different
    vertices, each once, from its smallest vertex."""
    nxt = cut(successors(ring), "darts")
    walk = nxt.where("a < b AND a < c").select(F.col("a").alias("start"), F.array("a", "b").alias("verts"), "b", "c")
    found = None
    for degree in range(3, longest + 1):
        step = walk.select("start", F.concat("verts", F.array("c")).alias("verts"), F.col("b").alias("a"), F.col("c").alias("b"))
        step = step.join(nxt, ["a", "b"])
        closed = step.where("c = start").join(nxt.select(
            F.col("a").alias("b"), F.col("b").alias("start"), F.col("c").alias("again")), ["b", "start"]).where("again = verts[1]")
        faces = closed.select(F.lit(degree).alias("degree"), "verts")
        found = faces if found is None else found.union(faces)
        walk = step.where("c > start AND NOT array_contains(verts, c)").select("start", "verts", "b", "c")
    return found


def trace_faces(ring: DataFrame, quads_first: bool = True) -> DataFrame:
    """(orbit, degree, verts): greedy walks around the rings, of 3 to 8 vertices, no dart
    used twice; then holes, walked from unused darts whose twin is used.

    A walk never leaves the orbit of its first dart under the successor, so orbits, found
    as components of darts, are walked one by one: a task holds the rim of a face or hole,
    not a mesh. Holes are walked in rounds until none gives a face."""
    darts = successors(ring).join(ring.select(F.col("v").alias("a"), F.col("w").alias("b"), "rank"), ["a", "b"])
    darts = cut(darts.withColumns({"dart": F.xxhash64("a", "b"), "next": F.xxhash64("b", "c")}), "darts")
    orbit = connected_components(darts.where("dart <> next"), "dart", "next")
    darts = cut(darts.join(orbit.withColumnRenamed("node", "dart"), "dart").select(
        F.col("component").alias("orbit"), "a", "b", "c", "rank"), "orbits")

    def walk(holes: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["a", "rank"])
            steps = dict(zip(zip(pdf["a"].tolist(), pdf["b"].tolist()), pdf["c"].tolist()))
            used = set(zip(pdf.loc[pdf["used"], "a"].tolist(), pdf.loc[pdf["used"], "b"].tolist())) if holes else set()
            start = [d for d, t in zip(steps, pdf["twin"].tolist()) if t] if holes else list(steps)
            faces = kernels.walk_orbit(steps, start, used, None if holes else quads_first)
            return pd.DataFrame({"orbit": pd.Series([int(pdf["orbit"].iloc[0])] * len(faces), dtype="int64"),
                                 "degree": pd.Series([len(f) for f in faces], dtype="int32"),
                                 "verts": pd.Series(faces, dtype=object)})

        return run

    schema = "orbit long, degree int, verts array<long>"
    faces = cut(darts.groupBy("orbit").applyInPandas(walk(False), schema), "faces")
    while True:
        taken = cut(face_edges(faces.select(F.xxhash64("verts").alias("fid"), "verts")).select("a", "b").distinct(), "taken")
        mark = darts.join(taken.withColumn("used", F.lit(True)), ["a", "b"], "left").join(
            taken.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("twin")), ["a", "b"], "left").fillna(False, ["used", "twin"])
        mark = mark.withColumn("twin", F.col("twin") & ~F.col("used"))
        open_orbits = mark.where("twin").select("orbit").distinct()
        more = cut(mark.join(open_orbits, "orbit", "left_semi").groupBy("orbit").applyInPandas(walk(True), schema), "holes")
        if more.isEmpty():
            return faces
        faces = cut(faces.union(more), "faces")


def duplicate_faces(faces: DataFrame) -> DataFrame:
    """Faces (verts) by a rotation-free key, with how often each occurs."""
    low = "array_position(verts, array_min(verts))"
    key = F.expr(f"array_join(concat(slice(verts, {low}, size(verts)), slice(verts, 1, {low} - 1)), '-')")
    return faces.groupBy(key.alias("key")).count().withColumnRenamed("count", "copies")


def face_edges(faces: DataFrame) -> DataFrame:
    """(fid, pos, a, b): the directed edges of (fid, verts)."""
    return (faces.select("fid", "verts", F.posexplode("verts").alias("pos", "a"))
            .select("fid", "pos", "a", F.expr("verts[(pos + 1) % size(verts)]").alias("b")))


def edge_table(faces: DataFrame) -> DataFrame:
    """(v0, v1, faces): undirected edges with their number of faces."""
    return (face_edges(faces).groupBy(F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"))
            .agg(F.countDistinct("fid").alias("faces")))


def nonmanifold(edges: DataFrame) -> DataFrame:
    return edges.where("faces > 2")


def boundary(edges: DataFrame) -> DataFrame:
    return edges.where("faces = 1")


def artefacts(faces: DataFrame) -> DataFrame:
    """Faces of non-manifold edges none of whose edges has exactly two faces: all of
    them are crowded or open."""
    inc = face_edges(faces).select("fid", F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"))
    counts = inc.join(edge_table(faces), ["v0", "v1"]).groupBy("fid").agg(
        F.max("faces").alias("most"), F.max(F.when(F.col("faces") == 2, 1).otherwise(0)).alias("sound"))
    return counts.where("most > 2 AND sound = 0").select("fid")


def without_artefacts(faces: DataFrame) -> DataFrame:
    """faces (fid, verts) after artefacts are taken away one by one: an edge that is
    down to two faces keeps them. A round takes the artefacts that have the smallest
    fid on each of their crowded edges, which is what one by one in order of fid does."""
    left = cut(faces.select("fid", "verts"), "faces")
    while True:
        found = cut(artefacts(left), "artefacts")
        inc = face_edges(left).select("fid", F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"))
        crowded = inc.join(found, "fid").join(nonmanifold(edge_table(left)).select("v0", "v1"), ["v0", "v1"])
        least = crowded.groupBy("v0", "v1").agg(F.min("fid").alias("least"))
        go = crowded.join(least, ["v0", "v1"]).groupBy("fid").agg(F.max(F.col("fid") != F.col("least")).alias("waits"))
        go = cut(go.where("not waits").select("fid"), "taken")
        if go.isEmpty():
            return left
        left = cut(left.join(go, "fid", "left_anti"), "faces")


#: A quad further from its plane than this, by the volume of its corners over the cubed
#: mean diagonal, is two triangles.
NONPLANAR = 0.1


def split_quads(faces: DataFrame, vertices: DataFrame, limit: float = NONPLANAR, always: bool = False) -> DataFrame:
    """Triangles and nearly planar quads (all quads are split if always): other quads
    become two triangles along the shorter diagonal."""
    f = faces.where("size(verts) = 4").select("fid", *[F.col("verts")[i].alias(f"v{i}") for i in range(4)])
    for i in range(4):
        f = f.join(vertices.select(F.col("root").alias(f"v{i}"), *[F.col(c).alias(f"p{i}{c}") for c in "xyz"]), f"v{i}")
    p = [E.vec(f"p{i}") for i in range(4)]
    volume = E.dot(E.cross(E.sub(p[1], p[0]), E.sub(p[2], p[0])), E.sub(p[3], p[0]))
    f = f.withColumns({"volume": F.expr(volume), "d02": F.expr(f"sqrt({E.dist2(p[0], p[2])})"), "d13": F.expr(f"sqrt({E.dist2(p[1], p[3])})")})
    bent = F.lit(True) if always else F.expr(f"coalesce(abs(volume / nullif(pow(0.5e0 * (d02 + d13), 3), 0)), 0) > {limit!r}")
    parts = F.when(~bent, F.array(F.array("v0", "v1", "v2", "v3"))).when(
        F.col("d02") < F.col("d13"), F.array(F.array("v0", "v1", "v2"), F.array("v0", "v2", "v3"))).otherwise(
        F.array(F.array("v0", "v1", "v3"), F.array("v1", "v2", "v3")))
    cut_up = f.select("fid", F.explode(parts).alias("verts"))
    return faces.where("size(verts) <> 4").select("fid", "verts").union(cut_up)


def split_polygons(faces: DataFrame, vertices: DataFrame, posy: int = 4) -> DataFrame:
    """(fid, part, verts): faces cut into regular pieces (see kernels.split_polygon), one
    face a group."""
    corner = faces.select("fid", F.posexplode("verts").alias("k", "root")).join(
        vertices.select("root", "x", "y", "z"), "root").select("fid", "k", "root", "x", "y", "z")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        pos = {int(r): p for r, p in zip(pdf["root"], pdf[["x", "y", "z"]].to_numpy(float))}
        parts = kernels.split_polygon([int(r) for r in pdf["root"]], pos, posy)
        return pd.DataFrame({"fid": pdf["fid"].iloc[0], "part": range(len(parts)), "verts": parts})

    small = faces.where(f"size(verts) <= {4 if posy == 4 else 3}")
    whole = small.select("fid", F.lit(0).cast("long").alias("part"), "verts")
    large = faces.select("fid").join(small.select("fid"), "fid", "left_anti")
    cut_up = corner.join(large, "fid", "left_semi").groupBy("fid").applyInPandas(run, "fid long, part long, verts array<long>")
    return whole.union(cut_up)


def compact(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Vertices that have a link."""
    used = links.select(F.col("a").alias("root")).union(links.select(F.col("b").alias("root"))).distinct()
    return vertices.join(used, "root", "left_semi").select(*vertices.columns)


def simplify(links: DataFrame, vertices: DataFrame, scale: float, posy: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b), vertices, and (root, into) of merged vertices, after vertices near a
    link were snapped to it and, for squares, diagonals removed. Sequential within a
    connected component, which one task holds."""
    comp = connected_components(links)
    cols = ("x", "y", "z", "nx", "ny", "nz")
    v = vertices.join(comp.select(F.col("node").alias("root"), "component"), "root").select(
        "component", F.lit(True).alias("is_vertex"), F.col("root").alias("a"), F.lit(None).cast("long").alias("b"), *cols)
    e = links.join(comp.select(F.col("node").alias("a"), "component"), "a").select(
        "component", F.lit(False).alias("is_vertex"), "a", "b", *[F.lit(None).cast("double").alias(c) for c in cols])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pts, edges = pdf[pdf["is_vertex"]].sort_values("a"), pdf[~pdf["is_vertex"]]
        pos = {int(r): p for r, p in zip(pts["a"], pts[["x", "y", "z"]].to_numpy(float))}
        nor = {int(r): p for r, p in zip(pts["a"], pts[["nx", "ny", "nz"]].to_numpy(float))}
        left, merged = kernels.simplify(sorted(zip(edges["a"].astype(int), edges["b"].astype(int))), pos, nor, scale, posy == 4)
        rows = [("link", a, b, *[None] * 6) for a, b in left] + [("merge", a, b, *[None] * 6) for a, b in merged.items()]
        rows += [("vertex", r, None, *pos[r], *nor[r]) for r in pos if r not in merged]
        return pd.DataFrame(rows, columns=["kind", "a", "b", *cols]).astype({"b": "Int64"})

    schema = "kind string, a long, b long, " + ", ".join(f"{c} double" for c in cols)
    out = cut(v.union(e).groupBy("component").applyInPandas(run, schema), "simple")
    moved = out.where("kind = 'vertex'").select(F.col("a").alias("root"), *[F.col(c).alias(f"m{c}") for c in cols])
    gone = out.where("kind = 'merge'").select(F.col("a").alias("root"), F.col("b").alias("into"))
    new = (vertices.join(gone, "root", "left_anti").join(moved, "root", "left")
           .select(*[F.coalesce(f"m{c}", c).alias(c) if c in cols else F.col(c) for c in vertices.columns]))
    return out.where("kind = 'link'").select("a", "b"), new, gone


def merge_vertices(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links after vertices of (src, dst) pairs became one, the smallest of each chain."""
    comp = connected_components(pairs, "src", "dst")
    for end in ("a", "b"):
        links = (links.join(comp.select(F.col("node").alias(end), F.col("component").alias("to")), end, "left")
                 .withColumn(end, F.coalesce("to", end)).select("a", "b"))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def asymmetric(adj: DataFrame) -> DataFrame:
    """Directed pairs (src, dst) whose reverse is missing; none in a sound graph."""
    back = adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return adj.select("src", "dst").join(back, ["src", "dst"], "left_anti").distinct()


def backed(candidates: DataFrame, faces: DataFrame) -> DataFrame:
    """(fid, other): existing faces that share every edge of a candidate, of which it
    would be the back side or a copy."""
    key = lambda f, n: face_edges(f).select(F.col("fid").alias(n), F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"))
    size = candidates.select("fid", F.size("verts").alias("n"))
    shared = key(candidates, "fid").join(key(faces, "other"), ["v0", "v1"]).where("fid <> other").groupBy("fid", "other").count()
    return shared.join(size, "fid").where("count = n").select("fid", "other")


def single_faces(faces: DataFrame) -> DataFrame:
    """Of faces (fid, verts) with the same vertices, front, back or turned, the one of
    the smallest fid."""
    first = faces.groupBy(F.sort_array("verts").alias("key")).agg(F.min_by("verts", "fid").alias("verts"), F.min("fid").alias("fid"))
    return first.select("fid", "verts")


def dense_ids(rows: DataFrame, cols: tuple[str, ...], name: str) -> DataFrame:
    """rows, distinct in cols, with 0, 1, 2... in the order of cols: ranks within range
    partitions, plus what the partitions before hold."""
    part = cut(rows.repartitionByRange(*cols).withColumn("part", F.spark_partition_id()), "ids")
    before, n = [(-1, 0)], 0
    for r in part.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        before.append((r["part"], n))
        n += r["count"]
    start = rows.sparkSession.createDataFrame(before, "part int, start long")
    w = Window.partitionBy("part").orderBy(*cols)
    return (part.join(F.broadcast(start), "part").withColumn(name, F.col("start") + F.row_number().over(w) - 1)
            .select(*rows.columns, name))


def signed_edges(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eid, v0, v1), and (fid, pos, eid) where an edge walked from its larger vertex has
    the id -eid - 1."""
    fe = face_edges(faces)
    edges = dense_ids(fe.select(F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1")).distinct(), ("v0", "v1"), "eid")
    signed = fe.withColumns({"v0": F.least("a", "b"), "v1": F.greatest("a", "b")}).join(edges, ["v0", "v1"]).select(
        "fid", "pos", F.when(F.col("a") < F.col("b"), F.col("eid")).otherwise(-F.col("eid") - 1).alias("eid"))
    return edges.select("eid", "v0", "v1"), signed


def inconsistent(faces: DataFrame, incidence: DataFrame) -> DataFrame:
    """(problem, fid, v0, v1): edges of faces that incidence (fid, v0, v1) lacks, and
    incidences that no face has; none in a sound mesh."""
    have = face_edges(faces).select("fid", F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"))
    key = ["fid", "v0", "v1"]
    lacks = have.join(incidence.select(*key), key, "left_anti").select(F.lit("lacking").alias("problem"), *key)
    return lacks.union(incidence.select(*key).join(have, key, "left_anti").select(F.lit("dangling"), *key))


def inner_edges(polygons: DataFrame, parts: DataFrame) -> DataFrame:
    """(v0, v1, vertex): edges of parts (fid, verts) of a polygon (fid, verts) that are
    not its own, each with the polygon's other vertices: when one of those dies, so does
    the edge."""
    pair = [F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1")]
    numbered = parts.select(F.col("fid").alias("polygon"), "verts").withColumn("fid", F.xxhash64("polygon", "verts"))
    inner = face_edges(numbered).join(numbered.select("fid", "polygon").distinct(), "fid").select("polygon", *pair).distinct()
    own = face_edges(polygons).select(F.col("fid").alias("polygon"), *pair)
    inner = inner.join(own, ["polygon", "v0", "v1"], "left_anti")
    corner = polygons.select(F.col("fid").alias("polygon"), F.explode("verts").alias("vertex"))
    return inner.join(corner, "polygon").where("vertex <> v0 AND vertex <> v1").select("v0", "v1", "vertex").distinct()


def duplicate_vertices(vertices: DataFrame, links: DataFrame, scale: float) -> DataFrame:
    """Linked vertices with another linked vertex within a quarter of the scale."""
    from .spatial import radius_pairs

    used = links.select(F.col("a").alias("root")).union(links.select(F.col("b").alias("root"))).distinct()
    v = vertices.join(used, "root", "left_semi").select(F.col("root").alias("pid"), "x", "y", "z")
    return radius_pairs(v, scale / 4)


def diagonals(links: DataFrame) -> DataFrame:
    """Links whose ends have exactly two common neighbours."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(
        links.select(F.col("b").alias("v"), F.col("a").alias("w")))
    common = (links.join(both.select(F.col("v").alias("a"), F.col("w").alias("m")), "a")
              .join(both.select(F.col("v").alias("b"), F.col("w").alias("m")), ["b", "m"])
              .groupBy("a", "b").count().where("count = 2").select("a", "b"))
    return common


def delete_cascade(points: DataFrame, gone: DataFrame, member: DataFrame, edges: DataFrame,
                   faces: DataFrame, dependent: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What remains of vertices, edges (v0, v1) and faces (fid, verts) when points
    are deleted: a vertex dies with any of its points, an edge with an end or with a
    vertex that it depends on (inner_edges), a face with an edge."""
    dead = member.join(gone.select("pid"), "pid", "left_semi").select(F.col("root").alias("dead")).distinct()
    vertices = member.select("root").distinct().join(dead, F.col("root") == F.col("dead"), "left_anti")
    left = (edges.join(dead, F.col("v0") == F.col("dead"), "left_anti")
            .join(dead, F.col("v1") == F.col("dead"), "left_anti"))
    if dependent is not None:
        left = left.join(dependent.join(dead, F.col("vertex") == F.col("dead")).select("v0", "v1").distinct(), ["v0", "v1"], "left_anti")
    lost = (face_edges(faces).select("fid", F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"))
            .join(left.select("v0", "v1"), ["v0", "v1"], "left_anti").select("fid").distinct())
    return vertices, left, faces.join(lost, "fid", "left_anti")
