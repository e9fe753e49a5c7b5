"""Operator 7 - URL filters with redirect equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the
longest fitting rule of a URL decides. URLs that redirect to each other or name
each other canonical are aliases: a page's <link rel=canonical> and <meta
http-equiv=refresh> give edges between URLs, distributed connected components
give the classes. A URL without a rule of its own is blocked if its class has a
blocked URL and no URL that a rule explicitly allows; a rule of its own always
decides.

URLs are nodes by the hash of scheme-less, fragment-less text, so http and https
are one node. Few pages have edges, and only URLs on edges take part in the
components; pages meet their class in a left join that adaptive execution can
split when one URL holds many pages. Only DataFrame functions are used.

Null urls and urls without "://" have an empty host and path and no rule. Null
html has no edges; html of any length is searched whole. A page's first canonical link
and first refresh count, their attributes in any order. Relative targets, with "//" too,
are resolved against the page's URL; those of a scheme without "://" (mailto:) are
ignored. The SQL knows one order of the attributes and targets with "://" or a leading
"/" only. Repeated rows are answered each, a null id is kept. Of two fitting rules of equal length the one of the
larger name decides, of the same rule given twice the block. An empty table gives no rows. Other columns are unused, so their names cannot
clash. URLs are known by 64-bit hashes; among N on edges N^2 / 2^65 pairs of equal hashes
are expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import read_table, written

#: Fixed values of the contract: (host, path, action).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))
#: Of the SQL.
CANONICAL = r"""(?i)<link\b[^>]*\brel=["']?canonical["']?[^>]*\bhref=["']?([^"'>\s]+)"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv=["']?refresh["']?[^>]*\burl=["']?([^"'>\s]+)"""
TAG = r"""(?i)<(?:link|meta)(?=[\s/])[^>]*"""
#: One attribute with its value; quoted values are passed over whole.
ATTRIBUTE = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"?|'[^']*'?|[^\s"'>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The node of a URL; null without a host."""
    rest = F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^#]*)", 1)
    host = host_of(url)
    return F.when(host != "", F.xxhash64(F.concat(host, rest)))


def decide(rules, host: Column, path: Column) -> Column:
    """Struct (size, rule, action) of the longest fitting rule, or null."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")))
            for h, p, a in rules]
    return F.array_max(F.array(*fits))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name; empty without one."""
    same = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)),
                    lambda x: F.lower(F.regexp_extract(x, r"^([^\s=]+)", 1)) == name)
    value = F.regexp_extract(F.coalesce(F.get(same, F.lit(0)), F.lit("")), r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
    return F.trim(F.regexp_replace(value, r"""^["']|["']$""", ""))


def _targets(html: Column) -> Column:
    """Array of the targets of the first canonical link and the first refresh."""
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    links = F.filter(tags, lambda t: F.startswith(F.lower(t), F.lit("<link")) & F.array_contains(
        F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(tags, lambda t: F.startswith(F.lower(t), F.lit("<meta"))
                     & (F.lower(_attribute(t, "http-equiv")) == "refresh"))
    hrefs = F.transform(links, lambda t: _attribute(t, "href"))
    urls = F.transform(metas, lambda t: F.regexp_extract(
        _attribute(t, "content"), r"""(?i)^[\s0-9.]*[;,]?\s*url\s*=\s*["']?\s*([^"'\s]+)""", 1))
    first = lambda x: F.coalesce(F.get(F.filter(x, lambda u: u != ""), F.lit(0)), F.lit(""))
    return F.array(first(hrefs), first(urls))


def _without_dots(path: Column) -> Column:
    """An absolute path without its . and .. segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(
            F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"),
                    F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(""))


def resolved(src: Column, to: Column) -> Column:
    """The target to of a page src as a URL; null if it is none."""
    scheme = F.regexp_extract(src, r"^([^/?#]*?:)//", 1)
    site = F.regexp_extract(src, r"^([^/?#]*?://[^/?#]*)", 1)
    path = path_of(src)
    query = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    full = F.when(F.startswith(to, F.lit("/")), own).otherwise(F.concat(folder, own))
    return (F.when(F.regexp_like(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), to)
            .when(F.regexp_like(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")) | (site == ""), None)
            .when(F.startswith(to, F.lit("//")), F.concat(scheme, to))
            .when(F.startswith(to, F.lit("#")), src)
            .when(F.startswith(to, F.lit("?")), F.concat(site, path, to))
            .otherwise(F.concat(site, _without_dots(full), query)))


def edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) URLs of redirect and canonical-link edges."""
    html = F.col(html_col)
    some = pages.where(F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh")))
    found = some.select(F.col(url_col).alias("src"), F.explode(_targets(html)).alias("to")).where("to <> ''")
    return (found.select("src", resolved(F.col("src"), F.col("to")).alias("dst"))
            .where("src is not null and dst is not null"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """id_col, host, path, rule, verdict; one row per row of pages."""
    links = written(edges(pages, url_col, html_col), "links")
    ends = links.select(F.col("src").alias("url")).union(links.select(F.col("dst").alias("url"))).distinct()
    nodes = (ends.select(node_of(F.col("url")).alias("node"), decide(rules, host_of(F.col("url")), path_of(F.col("url")))
                         .alias("d")).where("node is not null").groupBy("node").agg(F.max("d.action").alias("action")))
    pairs = links.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b"))
    classes = connected_components(pairs)
    blocked = (classes.join(nodes, "node").groupBy("component")
               .agg(F.max(F.col("action") == "block").alias("block"), F.max(F.col("action") == "allow").alias("allow"))
               .where("block and not coalesce(allow, false)").select("component"))
    bad = classes.join(blocked, "component").select("node", F.lit(True).alias("alias_blocked"))
    out = (pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
                        node_of(F.col(url_col)).alias("node"))
           .withColumn("d", decide(rules, F.col("host"), F.col("path"))))
    verdict = F.coalesce("d.action", F.when(F.col("alias_blocked"), F.lit("block")).otherwise("allow"))
    return out.join(bad, "node", "left").select(
        id_col, "host", "path", F.col("d.rule").alias("rule"), verdict.alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


def _sql_parts(url: str) -> tuple[str, str, str]:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return (f"translate(regexp_extract({rest}, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}')",
            f"regexp_extract({rest}, '(?s)^[^/?#]*([^?#]*)', 1)",
            f"regexp_extract({rest}, '(?s)^[^/?#]*([^#]*)', 1)")


def _sql_rule(host: str, path: str, what: str) -> str:
    cases = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(
        f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') "
        f"THEN '{h + p if what == 'rule' else a}'" for h, p, a in cases) + " END"


def _oracle() -> str:
    host, path, rest = _sql_parts("u")
    canonical, refresh = CANONICAL.replace("'", "''"), REFRESH.replace("'", "''")
    return f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS u, html FROM pages),
raw AS (
  SELECT u AS src, regexp_extract(html, '{canonical}', 1) AS t FROM p
  UNION ALL SELECT u, regexp_extract(html, '{refresh}', 1) FROM p
),
link AS (
  SELECT src, CASE WHEN contains(t, '://') THEN t
                   WHEN starts_with(t, '/') THEN regexp_extract(src, '^(.*?://[^/?#]*)', 1) || t END AS dst
  FROM raw WHERE t <> ''
),
ends AS (SELECT DISTINCT u, {host} AS h, {path} AS pa, {host} || {rest} AS node
         FROM (SELECT src AS u FROM link UNION SELECT dst FROM link WHERE dst IS NOT NULL)),
pair AS (SELECT a.node AS x, b.node AS y FROM link JOIN ends a ON link.src = a.u JOIN ends b ON link.dst = b.u
         WHERE a.h <> '' AND b.h <> ''),
both_ways AS (SELECT x, y FROM pair UNION SELECT y, x FROM pair),
reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
cls AS (SELECT r.x AS node, bool_or(({_sql_rule('e.h', 'e.pa', 'action')}) = 'block') AS block,
               bool_or(({_sql_rule('e.h', 'e.pa', 'action')}) = 'allow') AS allow
        FROM reach r JOIN ends e ON r.y = e.node GROUP BY r.x),
q AS (SELECT page_id, {host} AS host, {path} AS path, {host} || {rest} AS node FROM p)
SELECT page_id, host, path, {_sql_rule('host', 'path', 'rule')} AS rule,
       coalesce({_sql_rule('host', 'path', 'action')},
                CASE WHEN coalesce(block, false) AND NOT coalesce(allow, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN cls USING (node)
"""


ORACLE = _oracle()
