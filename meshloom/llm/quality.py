"""Operator 3 [native] - quality rules as a bitmask ledger.

Every rule is measured and judged once per text; the ledger stores the
measurements and one integer whose bit r says that rule r failed. A policy is a
versioned mask over those bits, so changing a policy never reads a text again,
and ablations (what would a policy without one rule keep?) are bit operations
over the ledger, counted in a single aggregation.

Only DataFrame functions are used. Everything is computed inside a row, so no
text is shuffled or exploded and a hot source or key cannot skew the work; the
repeated-window measure sorts positions, n log n in the words of one text.

Distinct words are counted in windows of VARIETY_WINDOW words and added up, as their
share of a whole text falls with its length; the ledger's n_distinct_words is that
of the whole text. The SQL judges the whole text.

Null and empty texts have zero words and fail min_words; texts of any length are judged
whole. Ties and repeated rows are judged row by row, a null id is kept. An empty table
gives no rows. Columns besides id and text are ignored, or kept by `keep_passing`, which
adds none, so that no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

SPACES = r"[\x20\x09-\x0D]+"
#: Fixed values of the contract: symbols counted, window length.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Words of a window in which the variety of words is judged.
VARIETY_WINDOW = 1000


def let(value: Column, body) -> Column:
    """body(value) with value evaluated exactly once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _repeat_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more."""

    def covered(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda acc, x: acc + x))

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(g) == F.size(F.array_distinct(g)), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    def paired(x: Column, step: int) -> Column:
        return F.transform(x, lambda h, i: F.xxhash64(h, F.get(x, i + step)))

    # Hashes of 2, 4, then 8 words, each from two of the last.
    windows = let(paired(words, 1), lambda two: let(paired(two, 2), lambda four: F.slice(
        paired(four, 4), F.lit(1), F.size(words) - (WINDOW - 1))))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, count))


def _varied_words(words: Column) -> Column:
    """Distinct words of each window of VARIETY_WINDOW words, added up; the last
    window may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(VARIETY_WINDOW))
    return F.aggregate(starts, F.lit(0).cast("long"), lambda acc, i: acc + F.size(
        F.array_distinct(F.slice(words, i, F.lit(VARIETY_WINDOW)))))


def _measures(text: Column) -> Column:
    def of(words: Column, t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
        return let(lines, lambda ls: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
            _varied_words(words).alias("n_varied_words")))

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(words_of(t), lambda w: of(w, t)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
            "n_shouts", "n_varied_words")
#: Rule r fails a text where its condition holds; r is the bit. Append only.
RULES = {
    "min_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "few_distinct_words": "100 * n_varied_words < 30 * n_words",
    "shouting": "4 * n_shouts > n_words",
}
BITS = {name: 1 << r for r, name in enumerate(RULES)}
#: Versioned policies: which rules reject.
POLICIES = {
    "base": BITS["min_words"] | BITS["repeated_windows"],
    "v1": sum(BITS.values()),
}


def _judged(measured: Column) -> Column:
    """The ledger entry of a struct of measures: without the helper, with failure_bits."""
    bits = F.lit(0)
    for name, condition in RULES.items():
        left, sign, right = _terms(condition)
        fails = _value(left, measured) > _value(right, measured) if sign == ">" else _value(left, measured) < _value(right, measured)
        bits = bits + F.when(fails, F.lit(BITS[name])).otherwise(F.lit(0))
    return F.struct(*[measured[c].alias(c) for c in MEASURES if c != "n_varied_words"], bits.cast("long").alias("failure_bits"))


def _terms(condition: str) -> tuple[str, str, str]:
    left, sign, right = condition.partition(" > ") if " > " in condition else condition.partition(" < ")
    return left, sign.strip(), right


def _value(term: str, measured: Column) -> Column:
    """A measure, a number, or their product."""
    out = F.lit(1)
    for x in term.split(" * "):
        out = out * (F.lit(int(x)) if x.isdigit() else measured[x])
    return out


def entry(text: Column) -> Column:
    """Struct of the measurements and failure_bits of a text, each rule judged once."""
    return let(_measures(text), _judged)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the measurements and failure_bits, one row per row of docs."""
    return docs.select(F.col(id_col), entry(F.col(text_col)).alias("entry")).select(id_col, "entry.*")


def verdict(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failure_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(table: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: rows that fail it, rows only it rejects,
    and rows kept without it; one partial aggregation over the ledger."""
    mask = POLICIES[policy]
    bits = F.col("failure_bits").bitwiseAND(F.lit(mask))
    hit = bits.alias("bits")
    counts = table.select(hit).groupBy("bits").count()
    rules = [(n, b) for n, b in BITS.items() if b & mask]
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"),
                 F.when(F.col("bits").bitwiseAND(F.lit(b)) != 0, F.col("count")).otherwise(0).alias("fails"),
                 F.when(F.col("bits") == b, F.col("count")).otherwise(0).alias("only"),
                 F.when(F.col("bits").bitwiseAND(F.lit(mask & ~b)) == 0, F.col("count")).otherwise(0).alias("kept"))
        for n, b in rules]))).groupBy("rule").agg(
            F.sum("fails").alias("fails"), F.sum("only").alias("only_this_rule"), F.sum("kept").alias("kept_without"))


def keep_passing(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """Rows of docs, all their columns, that the policy keeps by their ledger entries."""
    bits = entry(docs[text_col])["failure_bits"]
    return docs.where(bits.bitwiseAND(F.lit(POLICIES[policy])) == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger(read_table(spark, sf_dir, "documents"))
    return t.withColumns({"base_failed": F.col("failure_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0,
                          "kept": verdict("v1")})


_CONDITIONS = list((RULES | {"few_distinct_words": "100 * n_distinct_words < 30 * n_words"}).items())
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS i FROM w WHERE len(words) > {WINDOW})
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct_words,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts
  FROM w LEFT JOIN cov USING (doc_id)
), b AS (
  SELECT *, CAST({' + '.join(f'(CASE WHEN {c} THEN {1 << r} ELSE 0 END)' for r, (_, c) in enumerate(_CONDITIONS))} AS BIGINT)
         AS failure_bits FROM m
)
SELECT *, (failure_bits & {POLICIES['base']}) <> 0 AS base_failed, (failure_bits & {POLICIES['v1']}) = 0 AS kept FROM b
"""
