"""URL filter: host and path rules, then a list of URLs behind a blocked Bloom filter. DataFrame operations only.

A listed URL is compared in canonical form (scheme, `www.`/`m.` prefix, fragment, tracking parameters, `.html` and
closing slashes removed; remaining parameters sorted). Possible hits of the Bloom filter go to an exact join, so false
positives change nothing. The filter has at most `max_filter_bytes`, whatever the list's length: a longer list only
lets more rows through to the exact join. So the broadcast is bounded.

Defined results: a null URL or one without `://` has empty host and path, fits no rule, is not listed and is allowed.
Repeated rows are each judged. An empty list blocks nothing. Other columns of the input pass through `judge`; its
own columns (host, path, rule, verdict) replace those of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, table, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BITS_PER_URL, MAX_FILTER_BYTES, LANES, SALTS, MAX_RULES = 16, 8 << 20, 8, 8, 500
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(_after(url), F.lit("")), "^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Null where the URL is null, has no `://` or no host."""
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    bare = F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), r"(\.html)?/*$", ""))
    return F.when(host(url) != "", F.concat_ws("?", bare, F.when(F.size(kept) > 0, F.array_join(kept, "&"))))


def ruled(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its action. rules: (action, host + path), at most MAX_RULES, as they become one expression."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: list single URLs instead")
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later conditions stand outside, so the longest wins
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, action = F.when(fits, rule).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def _bits(key: Column) -> list[Column]:
    g = F.xxhash64(key, F.lit("lanes"))
    return [F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(LANES)]


def _set(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, lane0..): blocks of eight 64-bit lanes, one bit of each lane for a key."""
    bits = _bits(F.col("canon"))
    each = keys.select(F.pmod(F.xxhash64("canon"), F.lit(n_blocks)).alias("block"), *[_set(b).alias(f"lane{i}") for i, b in enumerate(bits)])
    return each.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, *, url: str = "url", bits_per_url: int = BITS_PER_URL, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict. listed: URLs (in column `url`) that are blocked if no rule fits."""
    keys = written(listed.select(canonical(F.col("url")).alias("canon")).where("canon is not null").distinct(), "listed")
    n = keys.count()
    n_blocks = max(1, min(max_filter_bytes // (8 * LANES), math.ceil(n * bits_per_url / (64 * LANES))))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*own).alias("row"), F.col(url).alias("u"))
    rows = rows.select("row", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"), canonical(F.col("u")).alias("canon"))
    name, action = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "action": action}).withColumn("block", F.when(F.col("action").isNull(), F.pmod(F.xxhash64("canon"), F.lit(n_blocks))))
    rows = rows.join(F.broadcast(bloom(keys, n_blocks)), "block", "left")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canon"))):
        hit = hit & (F.col(f"lane{i}").bitwiseAND(_set(bit)) != 0)
    possible = F.coalesce(F.col("action").isNull() & F.col("canon").isNotNull() & hit, F.lit(False))
    rows = rows.select("row", "host", "path", "rule", "action", F.when(possible, F.col("canon")).alias("canon"))
    # Only possible hits are shuffled; a very common URL is dealt over SALTS keys. All other rows stay where they were read.
    hits = rows.where("canon is not null").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    exact = keys.select("canon", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("listed"))
    judged = ("row", "host", "path", "rule", "action", "listed")
    out = hits.join(exact, ["canon", "salt"], "left").select(*judged).unionByName(rows.where("canon is null").withColumn("listed", F.lit(None).cast("boolean")).select(*judged))
    verdict = F.coalesce(F.col("action"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("row.*", "host", "path", "rule", verdict.alias("verdict"))


#: Pages with this in their html have been found to be junk; their URLs are the list.
JUNK = "%%%"


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").contains(JUNK)).select("url")
    return judge(pages.select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH a AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, html, rest, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(coalesce(rest, ''), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params FROM a),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canon,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM b),
l AS (SELECT DISTINCT canon FROM c WHERE contains(html, '%%%') AND canon IS NOT NULL)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN l USING (canon)
"""
