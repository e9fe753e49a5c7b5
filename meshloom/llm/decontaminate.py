"""Operator 9 [native] - benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over some consecutive words; only positions marked 1 are
hashed, so a substituted word at any other position doesn't hide a shared
passage. Every text position is hashed under every mask and joined with the
hashes of the benchmark items. Hits of one text, item and diagonal (text
position minus item position) collapse to one row, which is verified: the words
of the item are compared with those of the text along the diagonal, and some
window of min(WINDOW, item length) words must agree in at least NUM of DEN. Of all
ways to substitute as many words as that allows, the two masks hit 0.95 or more for
every length of item, all of them for most (the tests enumerate them).

Only DataFrame functions are used. The benchmark's hashes are broadcast while
their number is at most BROADCAST_ROWS (counted first); beyond that both sides
are shuffled by hash and texts rejoined; both ways give the same rows. Partial
aggregation leaves one row per text, item and diagonal before the shuffle, so a
passage that a third of all texts contain is as even as any other.

Texts and items are lower-cased (A-Z) and split at ASCII white space. Null or empty
texts, and texts and items with fewer than MIN_WORDS words, have no hits; texts of any
length are compared whole. Rows are told apart by id and words: of two texts (or items)
of one id each is compared, and leaks() reports the best of them, once for the id and
the item. Ties of the best diagonal go to the smallest start. Rows without an id are not
reported by leaks(), but drop_leaks() judges them like others. Empty tables give no
rows, or drop none. Columns besides id and text are unused, and kept by drop_leaks().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .quality import let, words_of

#: Fixed masks: 1 = compared, 0 = ignored.
MASKS = ("111011", "11010011")
MIN_WORDS = 8
#: Verification: NUM of DEN words in a window of WINDOW words.
WINDOW, NUM, DEN = 20, 8, 10
BROADCAST_ROWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tokens(text: Column) -> Column:
    return words_of(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER))


def _seeds(words: Column) -> Column:
    """For every mask the hashes at all positions."""

    def one(w: Column, m: int, mask: str) -> Column:
        offsets = [o for o, c in enumerate(mask) if c == "1"]
        every = F.transform(w, lambda x, i: F.xxhash64(F.lit(m), *[F.get(w, i + o) for o in offsets]))
        return F.slice(every, F.lit(1), F.greatest(F.lit(0), F.size(w) - (len(mask) - 1)))

    def hashes(w: Column) -> Column:
        return F.array(*[one(w, m, mask) for m, mask in enumerate(MASKS)])

    return let(F.transform(words, lambda x: F.xxhash64(x)), hashes)


def _positions(df: DataFrame, *keep: str) -> DataFrame:
    return (df.select(*keep, F.explode(_seeds(F.col("words"))).alias("one"))
            .select(*keep, F.posexplode("one").alias("pos", "h")))


def _checked(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str,
             item_text_col: str) -> DataFrame:
    """Verified diagonals (doc, text_hash, item, diag, best, n, m); text_hash is of the words."""
    words = _tokens(F.col(item_text_col))
    items = (benchmark.select(F.col(item_col).alias("item"), words.alias("words"))
             .where(F.col("item").isNotNull() & (F.size("words") >= MIN_WORDS))
             .withColumn("item_hash", F.xxhash64("words")))
    seeds = _positions(items, "item", "item_hash").select("item", "item_hash", F.col("pos").alias("ipos"), "h")
    texts = (docs.select(F.col(id_col).alias("doc"), _tokens(F.col(text_col)).alias("words"))
             .where(F.size("words") >= MIN_WORDS).withColumn("text_hash", F.xxhash64("words")))
    key = ("doc", "text_hash", "item", "item_hash", "diag")
    diag = (F.col("pos") - F.col("ipos")).alias("diag")
    item_words = items.select("item", "item_hash", F.col("words").alias("iw")).dropDuplicates(["item", "item_hash"])
    own = ["item", "item_hash"]
    if seeds.count() <= BROADCAST_ROWS:
        hits = (_positions(texts, "doc", "text_hash", "words").join(F.broadcast(seeds), "h")
                .groupBy(*key[:4], diag).agg(F.first("words").alias("words")))
        hits = hits.join(F.broadcast(item_words), own)
    else:
        hits = _positions(texts, "doc", "text_hash").join(seeds, "h").select(*key[:4], diag).distinct()
        whole = texts.dropDuplicates(["doc", "text_hash"])
        hits = (hits.alias("a").join(whole.alias("b"), F.expr("a.doc <=> b.doc and a.text_hash = b.text_hash"))
                .select(*[f"a.{k}" for k in key], "b.words").join(item_words, own))
    equal = F.transform("iw", lambda w, j: F.when(F.get(F.col("words"), F.col("diag") + j) == w, 1).otherwise(0))
    span = F.least(F.lit(WINDOW), F.size("iw"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("iw") - span + 1), lambda s: F.aggregate(
        F.slice(F.col("eq"), s, span), F.lit(0), lambda a, x: a + x)))
    return (hits.withColumn("eq", equal).withColumn("best", best)
            .where(F.col("best") * DEN >= span * NUM)
            .select(*key, F.aggregate("eq", F.lit(0), lambda a, x: a + x).alias("n"), "best", F.size("iw").alias("m")))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per text and item that share a passage: id_col, item_col, n_match
    (equal words along the best diagonal), best_window (most equal words in a
    window), item_words, doc_start (text position of the item's first word)."""
    checked = _checked(docs.where(F.col(id_col).isNotNull()), benchmark, id_col, text_col, item_col, item_text_col)
    top = checked.groupBy("doc", "item").agg(F.max(F.struct("best", "n", (-F.col("diag")).alias("d"), "m")).alias("t"))
    return top.select(F.col("doc").alias(id_col), F.col("item").alias(item_col),
                      F.col("t.n").cast("long").alias("n_match"), F.col("t.best").cast("long").alias("best_window"),
                      F.col("t.m").cast("long").alias("item_words"), (-F.col("t.d")).cast("long").alias("doc_start"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of docs without a leak, all their columns."""
    found = (_checked(docs, benchmark, id_col, text_col, item_col, item_text_col)
             .select("doc", "text_hash").distinct())
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"),
                      F.xxhash64(_tokens(F.col(text_col))).alias("words_hash"))
    return row.join(found, F.expr("id <=> doc and words_hash = text_hash"), "left_anti").select("row.*")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _key(mask: str, m: int) -> str:
    parts = ", ".join(f"w[i + {o}]" for o, c in enumerate(mask) if c == "1")
    return f"concat_ws(' ', '{m}', {parts})"


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for leaks() over a table expression of documents."""
    def seeds(table: str, key: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {key}, i, {_key(mask, m)} AS h FROM (SELECT {key}, w, unnest(range(1, len(w) - {len(mask)} + 2)) AS i"
            f" FROM {table})" for m, mask in enumerate(MASKS))

    toks = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),"
            " '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')")
    return f"""
WITH b AS (SELECT item_id, {toks} AS w FROM benchmark), b2 AS (SELECT * FROM b WHERE len(w) >= {MIN_WORDS}),
d AS (SELECT doc_id, {toks} AS w FROM {documents}), d2 AS (SELECT * FROM d WHERE len(w) >= {MIN_WORDS}),
bs AS ({seeds('b2', 'item_id')}), ds AS ({seeds('d2', 'doc_id')}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS diag FROM ds JOIN bs USING (h)),
pos AS (
  SELECT doc_id, item_id, diag, len(b2.w) AS m, j,
         CASE WHEN diag + j >= 1 AND d2.w[diag + j] = b2.w[j] THEN 1 ELSE 0 END AS e
  FROM hits JOIN d2 USING (doc_id) JOIN b2 USING (item_id), unnest(range(1, len(b2.w) + 1)) AS t(j)
),
win AS (
  SELECT doc_id, item_id, diag, m, j, sum(e) OVER (PARTITION BY doc_id, item_id, diag) AS n,
         sum(e) OVER (PARTITION BY doc_id, item_id, diag ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s
  FROM pos
),
best AS (
  SELECT doc_id, item_id, diag, m, n, max(s) AS best FROM win WHERE j <= m - least({WINDOW}, m) + 1
  GROUP BY ALL HAVING max(s) * {DEN} >= least({WINDOW}, m) * {NUM}
)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_match, CAST(best AS BIGINT) AS best_window,
       CAST(m AS BIGINT) AS item_words, CAST(diag AS BIGINT) AS doc_start
FROM best QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, n DESC, diag) = 1
"""


ORACLE = oracle()
