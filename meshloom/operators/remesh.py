"""From points to a mesh, end to end: fields, extraction, detail map, tessellation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extract as X
from . import hierarchy as H
from . import solver
from . import texels as T
from .graph import without_leaves
from .tables import cut


@dataclass
class Mesh:
    """vertices (root, members, x...nz), faces (fid, verts) of triangles and quads, and
    which vertex a point went to: member (pid, root)."""

    vertices: DataFrame
    faces: DataFrame
    member: DataFrame


def fields(points: DataFrame, scale: float, rosy: int = 4, posy: int = 4) -> DataFrame:
    """Smoothed fields of points (pid, x, y, z, nx, ny, nz) on a grid that suits them."""
    plan = H.grid_plan(points)
    origin = min(plan[c] for c in "xyz") - plan["cell"]
    return solver.solve(points.select("pid", "x", "y", "z", "nx", "ny", "nz"), scale, origin, plan["cell"],
                        max(1, int(plan["levels"]) - 1), rosy, posy)


#: Called with the name of a stage and its table: neighbours, classified, members, collapsed,
#: polygons, mesh.
Stage = Callable[[str, DataFrame], None]


def extract(solved: DataFrame, scale: float, rosy: int = 4, posy: int = 4, on_stage: Stage = lambda name, table: None) -> Mesh:
    """The mesh of a cloud with fields: contraction to lattice vertices, links between
    them, simplification, faces traced around every vertex, cut to triangles and quads.
    on_stage sees the tables in between, for programs that extend the extraction."""
    edges = X.symmetric(solver.neighbours(solved, scale))
    on_stage("neighbours", edges)
    classes = cut(X.classify(edges, solved, scale, rosy, posy), "classified")
    on_stage("classified", classes)
    member = cut(X.clusters(solved, X.contract(classes)), "members")
    on_stage("members", member)
    vertices = cut(X.centroids(solved, member, scale), "vertices")
    links = X.drop_vertices(X.vertex_links(classes, member), X.spurious(vertices))
    links, vertices, merged = X.simplify(cut(links, "links"), vertices, scale, posy)
    member = (member.join(merged, "root", "left").select("pid", F.coalesce("into", "root").alias("root")))
    links = without_leaves(links)
    on_stage("collapsed", links)
    vertices = cut(X.compact(vertices, links), "vertices")
    ring = cut(X.ring_order(links, vertices), "ring")
    polygons = cut(X.trace_faces(ring, posy == 4).select(F.xxhash64("verts").alias("fid"), "verts"), "polygons")
    on_stage("polygons", polygons)
    parts = X.split_polygons(polygons, vertices, posy)
    pieces = X.split_quads(parts.select(F.xxhash64("fid", "part").alias("fid"), "verts"), vertices)
    single = X.single_faces(pieces.select(F.xxhash64("verts").alias("fid"), "verts"))
    mesh = Mesh(vertices, X.without_artefacts(single), cut(member, "members"))
    on_stage("mesh", mesh.faces)
    return mesh


def detail(mesh: Mesh, points: DataFrame, scale: float, smoothness: float = 0.8, colours: tuple[str, ...] = (),
           triangles: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the fine mesh, displaced by the detail map of the points."""
    used = mesh.vertices.join(mesh.faces.select(F.explode("verts").alias("root")).distinct(), "root", "left_semi")
    grid = cut(T.numbered_mesh(used, mesh.faces), "grid")
    texels = T.map_attributes(points, mesh.member, mesh.vertices, mesh.faces, grid, scale, colours, smoothness)
    return T.fine_mesh(mesh.vertices, mesh.faces, grid, cut(texels, "texels"), triangles)
