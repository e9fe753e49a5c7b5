"""Operator 5 - line dedup by distinct-site spread.

A line is boilerplate if it stands on at least MIN_SITES distinct sites (values of
the site column) and in at least as many different texts; the second condition keeps a
page that was mirrored widely from being cut to nothing. Every distinct line is known
by a 64-bit hash of its trimmed text. Per hash two HyperLogLog sketches, of its sites
and of the hashes of its texts, are built where the texts are read and merged by
aggregation: a line that a third of all texts contain is one row of each map task
before anything is shuffled. Lines with both estimates above the threshold by more
than MARGIN are boilerplate, those with one below it by more are not. Only lines
between, and no others, get exact distinct counts from a second reading of the texts.

The boilerplate lines are joined to (line, text, position) rows with a salt on the
hash, as one line may hold a large share of the rows; texts without such a line are
never rebuilt. Positions meet their row by its id and a 64-bit hash of its text.

A line is a \\n-split part; lines that are empty after trimming spaces are never
boilerplate, all others are counted, however short, and texts of any length are read
whole. A null site is a site of its own. Null texts have no lines and stay null; an
empty text stays empty. Rows without an id are counted and cut like any other. Repeated
rows count once, as one text, and each is cut; two texts of one id are two texts. Ties
need no rule. A text of boilerplate alone becomes empty. An empty table gives no rows.
Extra columns are kept, except one named n_cut, which the operator's own replaces;
other names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, read_table

MIN_SITES = 8
#: Relative distance from the threshold within which counts are exact: more than six
#: standard errors of a sketch (1.04 / sqrt(2^LG_K)).
MARGIN = 0.15
LG_K = 11
SALTS = 32


def _lines(docs: DataFrame, *more) -> DataFrame:
    """(..., pos, h) for every line that is not empty, of rows with text."""
    hashes = F.transform(F.split(F.col("text"), "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))
    return docs.select(*more, F.posexplode(hashes).alias("pos", "h")).where("h is not null")


def _salted(spots: DataFrame) -> DataFrame:
    return spots.withColumn("salt", F.pmod(F.xxhash64("id", "whole"), F.lit(SALTS)).cast("int"))


def _all_salts(lines: DataFrame) -> DataFrame:
    return lines.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _base(docs: DataFrame, text_col: str, site_col: str, id_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("whole"),
                       F.coalesce(F.col(site_col).cast("string"), F.lit("\0")).alias("site"))


def boilerplate(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                min_sites: int = MIN_SITES, shelf: Shelf | None = None) -> DataFrame:
    """(h, sites, texts) of the lines on at least min_sites distinct sites, in as many
    texts; the counts of lines far above the threshold are estimates."""
    shelf = shelf or Shelf(docs.sparkSession, "line-dedup")
    spots = _lines(_base(docs, text_col, site_col, id_col), "site", "whole")
    near, far = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    spread = shelf.put("spread", spots.groupBy("h").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"), F.hll_sketch_agg("whole", F.lit(LG_K)).alias("t"))
        .select("h", F.hll_sketch_estimate("s").alias("sites"), F.hll_sketch_estimate("t").alias("texts"))
        .where((F.col("sites") >= near) & (F.col("texts") >= near)))
    is_sure = (F.col("sites") > far) & (F.col("texts") > far)
    again = _lines(_base(docs, text_col, site_col, id_col), "id", "site", "whole")
    close = _salted(again).join(_all_salts(spread.where(~is_sure)), ["h", "salt"])

    def count(of: str) -> DataFrame:
        return close.select("h", of).distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)

    exact = count("site").withColumnRenamed("n", "sites").join(count("whole").withColumnRenamed("n", "texts"), "h")
    return shelf.put("wide", spread.where(is_sure).unionByName(exact))


def strip_boilerplate(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                      min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines cut from text_col, and n_cut, the lines cut."""
    cols = [c for c in docs.columns if c != "n_cut"]
    found = boilerplate(docs, site_col, id_col, text_col, min_sites).select("h")
    spots = _salted(_lines(_base(docs, text_col, site_col, id_col), "id", "whole"))
    cuts = spots.join(_all_salts(found), ["h", "salt"]).groupBy("id", "whole").agg(F.collect_set("pos").alias("cut"))
    row = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), docs[id_col].alias("own_id"),
                      F.xxhash64(docs[text_col].cast("string")).alias("own_whole"))
    joined = row.join(cuts, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_whole") == F.col("whole")), "left")
    text = F.col("row")[text_col]
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("cut", i)), "\n")
    n = F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_cut")
    new = F.when(F.col("cut").isNull(), text).otherwise(kept).alias(text_col)
    return joined.select(*[new if c == text_col else F.col("row")[c].alias(c) for c in cols], n)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_boilerplate(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_cut", "text")


def oracle(documents: str = "documents", columns: str = "doc_id, n_cut, text") -> str:
    """DuckDB SQL for strip_boilerplate() over a table expression."""
    return f"""
WITH src AS (SELECT * FROM {documents}),
spot AS (
  SELECT row_id, source, whole, pos, x FROM (
    SELECT row_id, source, whole, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS x
    FROM (SELECT row_number() OVER () AS row_id, source, text AS whole, string_split(text, chr(10)) AS l FROM src))
),
bad AS (
  SELECT trim(x, ' ') AS k FROM spot WHERE trim(x, ' ') <> ''
  GROUP BY k HAVING count(DISTINCT coalesce(source, chr(0))) >= {MIN_SITES} AND count(DISTINCT whole) >= {MIN_SITES}
),
kept AS (
  SELECT row_id, string_agg(x, chr(10) ORDER BY pos) FILTER (bad.k IS NULL) AS t, count(bad.k) AS n
  FROM spot LEFT JOIN bad ON trim(x, ' ') = bad.k GROUP BY row_id
),
dedup AS (
  SELECT src.* EXCLUDE (text), CASE WHEN n = 0 THEN text ELSE coalesce(t, '') END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_cut
  FROM (SELECT *, row_number() OVER () AS row_id FROM src) src LEFT JOIN kept USING (row_id)
)
SELECT {columns} FROM dedup
"""


ORACLE = oracle()
