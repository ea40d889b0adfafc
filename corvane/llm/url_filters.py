"""URL filtering: rules by host and path, then a list of canonical URLs.

The list is turned into a split-block Bloom filter, a table of 256-bit blocks
built by one grouped ``bit_or``.  Every URL probes one block; only possible
hits go on to an exact hash join with the list, which removes the filter's
false positives.  Everything is built from SQL functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Query parameters that do not change the page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL = 16
#: Filters up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
BLOCK_ROW_BYTES = 64


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without the last slash, then the query's
    parameters in order, without tracking ones.  Null without ``://``."""
    rest = _rest(url)
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(F.locate("://", url) > 0, F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits.  A
    rule fits its host and all subdomains if the path starts with its path;
    of equally long rules the one that sorts first by text is taken."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _masks(key: Column) -> tuple[list[Column], Column]:
    """Four 64-bit masks with two bits each, one for every 32-bit word of a
    block; and the hash that picks the block."""
    bits = F.xxhash64(F.lit("bits"), key)
    at = [F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(8)]
    bit = lambda i, up: F.call_function("shiftleft", F.lit(1).cast("long"), at[i] + up)
    return [bit(2 * j, 0).bitwiseOR(bit(2 * j + 1, 32)) for j in range(4)], F.xxhash64(key)


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w3): the filter, one row for every block that has a key."""
    masks, pick = _masks(F.col(key))
    return (
        listed.select(F.pmod(pick, F.lit(n_blocks)).alias("block"), *[m.alias(f"m{j}") for j, m in enumerate(masks)])
        .groupBy("block")
        .agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(4)])
    )


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Judge every row of ``pages``: its columns, then ``host``, ``path``,
    ``rule`` and ``verdict``.

    ``listed`` has one column of canonical URLs (repeats and nulls are fine).
    A fitting rule decides; without one, a listed URL is blocked and any other
    allowed.  A null URL, or one without ``://``, has an empty host and path,
    fits no rule and is allowed.  Rows are kept as often as they come; columns
    of these four names that ``pages`` has already are replaced.  An empty
    list blocks nothing.
    """
    known = listed.toDF("__listed").where(F.col("__listed").isNotNull()).distinct()
    n = known.count()
    n_blocks = max(1, n * BITS_PER_URL // 256)
    blocks = bloom_blocks(known, "__listed", n_blocks)
    if n_blocks * BLOCK_ROW_BYTES <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    # The caller's columns travel as one, so that none can clash with those made here.
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{url}`").alias("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    masks, pick = _masks(F.col("key"))
    rows = (
        rows.select("row", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"), canonical_url(F.col("url")).alias("key"))
        .withColumns({"rule": rule, "verdict": verdict})
        .withColumns({"at": F.pmod(pick, F.lit(n_blocks)), **{f"m{j}": m for j, m in enumerate(masks)}})
    )
    passes = F.lit(True)
    for j in range(4):
        passes = passes & (F.col(f"w{j}").bitwiseAND(F.col(f"m{j}")) == F.col(f"m{j}"))
    may = F.coalesce(passes, F.lit(False)) & F.col("key").isNotNull() & F.col("verdict").isNull()
    probed = rows.join(blocks, F.col("at") == F.col("block"), "left").select("row", "host", "path", "rule", "verdict", "key", may.alias("may"))
    out = lambda df, says: df.select(*[F.col("row").getField(c).alias(c) for c in keep], "host", "path", "rule", says.alias("verdict"))
    clear = out(probed.where(~F.col("may")), F.coalesce("verdict", F.lit("allow")))
    exact = probed.where(F.col("may")).join(known, F.col("key") == F.col("__listed"), "left")
    return clear.unionByName(out(exact, F.when(F.col("__listed").isNotNull(), "block").otherwise("allow")))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, against the canonical URLs of pages that came by a feed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    feed = pages.where(F.col("url").rlike("[?&]utm_source=feed")).select(canonical_url(F.col("url")))
    return filter_urls(pages, feed).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, url, rest,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM parts),
canon AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'),
              lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS kept
  FROM split),
keyed AS (
  SELECT *, CASE WHEN strpos(url, '://') > 0 THEN
       regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END
     END AS key
  FROM canon),
listed AS (SELECT DISTINCT key FROM keyed WHERE regexp_matches(url, '[?&]utm_source=feed') AND key IS NOT NULL),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT k.page_id, k.url, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM keyed) k JOIN rules r
    ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.p)
  GROUP BY 1, 2)
SELECT k.page_id, k.host, k.path, b.rule,
       coalesce(b.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN best b ON k.page_id = b.page_id AND k.url = b.url LEFT JOIN listed l ON k.key = l.key
"""
