"""Named queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cloud_queries, mesh_queries, topology_queries  # noqa: F401  (they register their queries)
from ..operators import hierarchy as H
from ..operators import spatial as S
from ..operators.tables import cloud

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(cloud_queries.QUERIES)
ORACLES: dict[str, str] = dict(cloud_queries.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level roll-up of the cloud, with how many radius neighbours a cell's points have."""
    q = cloud_queries
    points = H.codes(cloud(spark, sf_dir), q.ORIGIN, q.CELL)
    degree = S.radius_join(points, points, q.RADIUS).groupBy("src").agg(F.count("*").alias("near"))
    near = (points.select("pid", F.expr("shiftright(code, 12)").alias("cell")).join(degree, F.col("pid") == F.col("src"))
            .groupBy("cell").agg(F.avg("near").alias("near")))
    nodes = H.means(H.deltas(points, q.LEVELS))
    return H.rounded(nodes.join(near.withColumn("level", F.lit(1)), ["level", "cell"], "left"))
