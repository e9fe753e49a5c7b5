"""A scan file in, a fine mesh out: python -m meshloom.batch -i IN -o OUT.ply"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import hierarchy as H
from .operators import remesh
from .operators.normals import with_normals
from .operators.tables import cut
from .sources import load_scan, write_ply
from .sources.readers import scan_faces


def run(spark: SparkSession, source: str | DataFrame, target: str, sym: int = 4, scale: float = 1.0, smooth: float = 0.8,
        tri: bool = False) -> dict[str, float]:
    """Load a scan (or take points), find its normals, solve the fields of the symmetry
    sym, extract a mesh with edges of scale times the automatic length, map the points'
    detail on it and write the fine mesh to target. Returns what was done, in numbers."""
    faces = None
    if isinstance(source, str):
        points, faces = load_scan(spark, source), scan_faces(spark, source)
    else:
        points = source
    points = cut(H.valid(with_normals(points, faces)), "points")
    length = scale * H.auto_scale(points).first()["scale"]
    solved = cut(remesh.fields(points, length, sym, sym), "solved")
    mesh = remesh.extract(solved, length, sym, sym)
    vertices, small = remesh.detail(mesh, points, length, smooth, triangles=tri)
    vertices, small = cut(vertices, "fine"), cut(small, "fine-faces")
    write_ply(vertices, small, target)
    return {"scale": length, "points": points.count(), "vertices": mesh.vertices.count(), "faces": mesh.faces.count(),
            "fine_vertices": vertices.count(), "fine_faces": small.count()}


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    def positive(x: str) -> float:
        if float(x) <= 0:
            raise argparse.ArgumentTypeError("must be above 0")
        return float(x)

    def share(x: str) -> float:
        if not 0 <= float(x) < 1:
            raise argparse.ArgumentTypeError("must be in [0, 1)")
        return float(x)

    p = argparse.ArgumentParser(prog="meshloom.batch", description=__doc__)
    p.add_argument("-i", required=True, help="scan file (.ply, .obj, .xyz, .3d, .aln, .frames)")
    p.add_argument("-o", required=True, help="fine mesh (.ply)")
    p.add_argument("--sym", type=int, choices=(4, 6), default=4, help="symmetry of the fields")
    p.add_argument("--scale", type=positive, default=1.0, help="factor of the automatic edge length")
    p.add_argument("--smooth", type=share, default=0.8, help="smoothness of the detail map")
    p.add_argument("--tri", action="store_true", help="triangles only")
    return p.parse_args(words)


def main(words: list[str] | None = None) -> None:
    a = arguments(words)
    spark = SparkSession.builder.appName("meshloom").getOrCreate()
    for name, value in run(spark, a.i, a.o, a.sym, a.scale, a.smooth, a.tri).items():
        print(f"{name}: {value:g}")


if __name__ == "__main__":
    main()
