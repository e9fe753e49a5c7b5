"""Online integration: one batch of points after another, and the mesh of what there is.

A session is a folder of immutable parts. A version adds parts, never rewrites one: the
points it adds, the ids it takes away, the signed sums of what changed, and a small file
that names them. That file is written last, so a batch that fails leaves the state as it
was, and a batch of a stream that runs again after its commit is found by its number and
skipped. Work and writes of a batch follow its own size, but for the checks it asks for.

A point carries the version that added it (its generation). It is there unless a later
version takes its id away; an update takes the id away and adds it anew. Many small parts
are folded into one by compact()."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import hierarchy as H
from ..operators import remesh, solver
from ..operators.graph import delete_path
from ..operators.normals import with_normals
from ..operators.register import align
from ..operators.spatial import without_overlap
from ..operators.tables import cut

COLS = ("pid", "x", "y", "z", "nx", "ny", "nz")
POINTS = "pid long, x double, y double, z double, nx double, ny double, nz double, code long, version long"
GONE = "pid long, version long"
NODES = "level int, cell long, " + ", ".join(f"{c} double" for c in H.SUMS)
FIELDS = "level int, " + ", ".join(f"{c} {'long' if c == 'pid' else 'double'}" for c in ("pid", *solver.FIELDS))
PARTS = {"points": POINTS, "gone": GONE, "nodes": NODES}


class Session:
    """A session's tables under a folder: points, nodes and fields by version, statistics."""

    def __init__(self, spark: SparkSession, path: str, origin: float = -16.0, cell: float = 0.08, levels: int = 6,
                 capacity: float | None = H.CAPACITY):
        self.spark, self.path, self.origin, self.cell, self.levels = spark, path.rstrip("/"), origin, cell, levels
        self.capacity = capacity
        self.listeners: list[Callable[[str, int], None]] = []

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs("versions")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())

    def facts(self) -> list[dict]:
        """What every version was and took, from its file."""
        v = self.versions()
        if not v:
            return []
        rows = self.spark.read.text(f"{self.path}/versions/*", wholetext=True).collect()
        return sorted((json.loads(r[0]) for r in rows), key=lambda f: f["version"])

    def statistics(self) -> DataFrame:
        """A row for each version: event, points added, points taken away, points whose
        fields were solved, milliseconds."""
        return self.spark.createDataFrame(
            [(f["version"], f["event"], f["added"], f["taken"], f.get("solved", 0), f["ms"]) for f in self.facts()],
            "version long, event string, new_points long, removed_points long, optimized_points long, ms long")

    def _read(self, kind: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{p}" for f in self.facts() for p in f[kind]]
        return self.spark.read.schema(PARTS[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], PARTS[kind])

    def points(self) -> DataFrame:
        last = self._read("gone").groupBy("pid").agg(F.max("version").alias("taken"))
        return (self._read("points").join(last, "pid", "left").where("taken IS NULL OR version >= taken")
                .select(*[c.split()[0] for c in POINTS.split(", ")]))

    def nodes(self) -> DataFrame:
        return H.merge(self._read("nodes")).select(*[c.split()[0] for c in NODES.split(", ")])

    def fields(self, level: int = 0) -> DataFrame | None:
        """Solved fields of the last version that has them, or None."""
        solved = [f["fields"] for f in self.facts() if f.get("fields")]
        return (self.spark.read.schema(FIELDS).parquet(f"{self.path}/fields/{solved[-1]}").where(F.col("level") == level).drop("level")
                if solved else None)

    def _write(self, kind: str, name: str, df: DataFrame, schema: str) -> int:
        path = f"{self.path}/{kind}/{name}"
        df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path).count()

    def _commit(self, event: str, began: float, added: DataFrame | None = None, taken: DataFrame | None = None, **facts) -> int:
        """Write the parts of a version, then its file. added: coded points; taken: ids with
        the points they had."""
        v = (self.versions() or [0])[-1] + 1
        new: dict = {"version": v, "event": event, "points": [], "gone": [], "nodes": [], "added": 0, "taken": 0}
        changes = []
        if taken is not None:
            new["taken"] = self._write("gone", str(v), taken.select("pid").distinct().withColumn("version", F.lit(v)), GONE)
            new["gone"] = [str(v)]
            changes.append(H.deltas(taken, self.levels, -1))
        if added is not None:
            new["added"] = self._write("points", str(v), added.withColumn("version", F.lit(v)), POINTS)
            new["points"] = [str(v)]
            changes.append(H.deltas(self.spark.read.schema(POINTS).parquet(f"{self.path}/points/{v}"), self.levels))
        if changes:
            self._write("nodes", str(v), H.summed(*changes), NODES)
            new["nodes"] = [str(v)]
        self._publish(new | facts | {"ms": round(1000 * (time.time() - began))})
        return v

    def _publish(self, facts: dict) -> None:
        fs, p = self._fs(f"versions/.{facts['version']}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()
        final = self._fs(f"versions/{facts['version']}")[1]
        fs.delete(final, False)
        fs.rename(p, final)
        for f in self.listeners:
            f(facts["event"], facts["version"])

    def _coded(self, points: DataFrame) -> DataFrame:
        return H.codes(points.select(*COLS), self.origin, self.cell, 18)

    def integrate(self, scan: DataFrame, register: float | None = None, overlap: float | None = None,
                  batch: str | None = None, faces: DataFrame | None = None) -> int:
        """Add a scan: normals, cleaning, registration within an error if asked, what
        overlaps within a distance left out, cells kept from overfilling unless the session's
        capacity is None. Points whose id
        is there already are left out. A batch of this name that was added before is
        skipped; returns its version."""
        began, known = time.time(), self.facts()
        for f in known:
            if batch is not None and f.get("batch") == batch:
                return f["version"]
        scan = H.valid(with_normals(scan.select(*COLS), faces))
        if known:
            points = self.points()
            if register:
                scan = H.transformed(scan, align(scan, points, register))
            if overlap:
                scan = without_overlap(scan, points, overlap).select(*scan.columns)
            scan = scan.join(points.select("pid"), "pid", "left_anti").select(*COLS)
        coded = self._coded(scan.dropDuplicates(["pid"]))
        if known and self.capacity is not None:
            coded = H.with_capacity(coded, self.nodes(), self.capacity)
        return self._commit("scan", began, coded, batch=batch)

    def change(self, updates: DataFrame | None = None, deletes: DataFrame | None = None, event: str = "edit") -> int:
        """Replace points by their id (unknown ones are added), and delete others."""
        began, ids = time.time(), None
        for part in (updates, deletes):
            if part is not None:
                ids = part.select("pid") if ids is None else ids.union(part.select("pid"))
        taken = cut(self.points().join(ids.distinct(), "pid", "left_semi"), "taken") if ids is not None else None
        return self._commit(event, began, None if updates is None else self._coded(updates), taken)

    def remove_scan(self, version: int) -> int:
        """Take away what is left of the points that a version added."""
        return self.change(deletes=self.points().where(F.col("version") == version), event="scan removed")

    def delete_sphere(self, centre: tuple[float, float, float], radius: float) -> int:
        """Delete the points within a sphere."""
        inside = F.expr(f"{E.dist2(E.vec(''), tuple(map(repr, map(float, centre))))} <= {float(radius) ** 2!r}")
        return self.change(deletes=self.points().where(inside), event="sphere deleted")

    def solve(self, scale: float, rosy: int = 4, posy: int = 4) -> int:
        """Solve the fields of all points, or, where an earlier version has them, of what
        changed since."""
        began, points, known = time.time(), cut(self.points(), "points"), self.facts()
        solved = [f for f in known if f.get("fields")]
        before = changed = None
        if solved:
            since = solved[-1]["version"]
            before = {level: self.fields(level) for level in range(self.levels + 1)}
            lost = self._read("gone").where(F.col("version") > since).select("pid")
            old = self._read("points").where(F.col("version") <= since).join(lost.distinct(), "pid", "left_semi").select("pid", "x", "y", "z")
            changed = cut(points.where(F.col("version") > since).select("pid", "x", "y", "z").union(old), "changed")
        levels = solver.solve_levels(points.select(*COLS), scale, self.origin, self.cell, self.levels, rosy, posy,
                                     before=before, changed=changed)
        every = None
        for level, df in levels.items():
            df = df.withColumn("level", F.lit(level))
            every = df if every is None else every.unionByName(df)
        v = (self.versions() or [0])[-1] + 1
        self._write("fields", str(v), every, FIELDS)
        n = points.count() if changed is None else changed.count()
        return self._commit("solved", began, fields=str(v), solved=n)

    def mesh(self, scale: float, rosy: int = 4, posy: int = 4) -> remesh.Mesh:
        """The mesh of the solved fields."""
        return remesh.extract(self.fields().join(self.points().select("pid"), "pid", "left_semi"), scale, rosy, posy)

    def compact(self) -> int:
        """A version whose parts are the state as it is, in one; earlier ones are kept for
        undo(), not read any more."""
        began, v = time.time(), (self.versions() or [0])[-1] + 1
        self._write("points", str(v), self.points(), POINTS)
        self._write("nodes", str(v), self.nodes(), NODES)
        keep = [f for f in self.facts() if f.get("fields")]
        facts = {"version": v, "event": "compact", "points": [str(v)], "gone": [], "nodes": [str(v)], "added": 0, "taken": 0,
                 "ms": round(1000 * (time.time() - began))}
        old = self.versions()
        self._publish(facts | ({"fields": keep[-1]["fields"]} if keep else {}))
        for x in old:
            fs, p = self._fs(f"versions/{x}")
            fs.rename(p, self._fs(f"versions/.before-{v}-{x}")[1])
        return v

    def undo(self) -> int | None:
        """Drop the last version; after compact(), what it folded comes back."""
        v = self.versions()
        if v:
            fs, p = self._fs(f"versions/{v[-1]}")
            for s in fs.listStatus(self._fs("versions")[1]):
                name = s.getPath().getName()
                if name.startswith(f".before-{v[-1]}-"):
                    fs.rename(s.getPath(), self._fs(f"versions/{name.rsplit('-', 1)[1]}")[1])
            fs.delete(p, False)
        return (self.versions() or [None])[-1]

    def reset(self) -> None:
        delete_path(self.spark, self.path)

    def save(self, path: str) -> None:
        """Copy the state to another folder, as a session of one version."""
        other = Session(self.spark, path, self.origin, self.cell, self.levels, self.capacity)
        other._write("points", "1", self.points(), POINTS)
        other._write("nodes", "1", self.nodes(), NODES)
        facts = {"version": 1, "event": "saved", "points": ["1"], "gone": [], "nodes": ["1"], "added": 0, "taken": 0, "ms": 0,
                 "settings": {"origin": self.origin, "cell": self.cell, "levels": self.levels, "capacity": self.capacity}}
        solved = [f["fields"] for f in self.facts() if f.get("fields")]
        if solved:
            self.spark.read.schema(FIELDS).parquet(f"{self.path}/fields/{solved[-1]}").write.mode("overwrite").parquet(f"{path}/fields/1")
            facts["fields"] = "1"
        other._publish(facts)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Session:
        """A saved session, with its settings."""
        session = cls(spark, path)
        for f in session.facts():
            for name, value in f.get("settings", {}).items():
                setattr(session, name, value)
        return session


def integrate_stream(stream: DataFrame, session: Session, checkpoint: str, name: str = "stream", **options):
    """Start a query that integrates every micro-batch of a stream of points; a batch that
    is delivered again is skipped."""

    def batch(df: DataFrame, batch_id: int) -> None:
        if not df.isEmpty():
            session.integrate(df, batch=f"{name}/{batch_id}", **options)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
