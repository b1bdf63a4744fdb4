"""Shards by a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 by (bucket, id, size, crc32), where the bucket is the first hexadecimal digits of the MD5 of
the keys' text; a keyed Feistel network over the smallest even number of bits that holds n, walked until it falls below n,
permutes the numbers; shard = p mod shards and slot = p div shards. So the order is a reproducible shuffle, shard sizes in rows differ by one at most (law `rows`),
slots have no gaps, and anyone who knows n and the key can compute a number's place, or invert it.

Defined results: a null text has size 16 and crc32 0; rows with null ids are numbered like others; repeated rows get a
place each, and which of equal rows gets which place makes no difference. An empty table gives no rows. `assign` needs
unique names in the input and replaces its own columns (shard, slot).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, table, written

SHARDS, ROUNDS, KEY, NUMBER_BUCKETS, COMMON_ROWS = 40, 6, 0x5EED, 4096, 100_000
#: The round function's modulus and multiplier: small enough for plain 64-bit SQL.
PRIME, FACTOR = (1 << 31) - 1, 48_271


def round_keys(key: int = KEY, rounds: int = ROUNDS) -> list[int]:
    return [(key * 40_503 + r * 2_654_435_761) % PRIME for r in range(rounds)]


def _round(half: np.ndarray, key: int) -> np.ndarray:
    x = (half + key) % PRIME
    x = (x * x % PRIME * FACTOR + key) % PRIME
    return x ^ (x >> 15)


def permute(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The places of numbers (0 to n - 1) in the shuffle of n rows; with inverse, the numbers at places."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, keys = (1 << half) - 1, round_keys(key, rounds)
    out = np.array(numbers, dtype=np.int64)
    todo = np.arange(len(out))
    while len(todo):  # cycle walking: ends, as a permutation leads back below n
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys if not inverse else reversed(keys):
            if inverse:
                left, right = right ^ (_round(left, k) & mask), left
            else:
                left, right = right, left ^ (_round(right, k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


def _spread(rows: DataFrame, keys: list[str], buckets: int, common: int) -> DataFrame:
    """rows, with buckets of their own (from `buckets` on) for equal keys that would fill one. Equal rows may change places, so the order stays reproducible."""
    sizes = [(r["bucket"], r["count"]) for r in rows.groupBy("bucket").count().collect()]  # at most `buckets` rows
    limit = max(common, 4 * sum(n for _, n in sizes) // buckets)
    full = [b for b, n in sizes if n > limit]
    found = rows.where(F.col("bucket").isin(full)).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).orderBy(*keys).collect() if full else []  # at most buckets / 4
    if not found:
        return rows
    own, at = [], buckets
    for r in found:
        parts = -(-r["_n"] // limit)
        own.append((*[r[k] for k in keys], at, parts))
        at += parts
    names = [f"_k{i}" for i in range(len(keys))]
    shape = ", ".join([*[f"{n} {rows.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True)], "_at int", "_parts int"])
    same = [F.col(k).eqNullSafe(F.col(n)) for n, k in zip(names, keys, strict=True)]
    marked = rows.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(rows.sparkSession.createDataFrame(own, shape)), same, "left")
    bucket = F.coalesce(F.col("_at") + F.pmod("_row", "_parts"), "bucket").cast("int")
    return written(marked.withColumn("bucket", bucket).drop("_row", "_at", "_parts", *names), "spread")


def numbered(rows: DataFrame, keys: list[str], buckets: int = NUMBER_BUCKETS, common: int = COMMON_ROWS) -> tuple[DataFrame, int]:
    """rows with `number`, 0 to n - 1 without gaps, in the order of (hash bucket, keys), very common keys last; and n."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    rows = written(rows.withColumn("bucket", F.floor(bucket * buckets / F.lit(1 << 32)).cast("int")), "numbered")
    rows = _spread(rows, keys, buckets, common)
    sizes = rows.groupBy("bucket").count().collect()  # some 1.5 times `buckets` rows at most
    starts, n = [], 0
    for bucket, size in sorted((r["bucket"], r["count"]) for r in sizes):
        starts.append((bucket, n))
        n += size
    first = rows.sparkSession.createDataFrame(starts, "bucket int, first long")
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    return rows.withColumn("within", within).join(F.broadcast(first), "bucket").withColumn("number", F.col("first") + F.col("within") - 1).drop("bucket", "within", "first"), n


def assign(rows: DataFrame, keys: list[str], shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """rows with shard and slot."""
    rows, n = numbered(rows.drop("shard", "slot", "number"), keys)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, key))

    at = rows.withColumn("place", place("number"))
    return at.withColumns({"shard": F.pmod("place", F.lit(shards)).cast("int"), "slot": F.floor(F.col("place") / F.lit(shards)).cast("long")}).drop("place", "number")


def write_shards(docs: DataFrame, keys: list[str], shards: int = SHARDS, key: int = KEY) -> str:
    """docs as Parquet folders shard=0.. in the shared folder, rows of a file in slot order; the folder's path."""
    path = fresh_path(docs.sparkSession, "shards")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = assign(docs, keys, shards, key)
    placed.repartitionByRange(int(parts), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    out = assign(docs, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _network(x: str, half: str) -> str:
    """One pass of the network over x, as SQL."""
    left, right = f"({x} >> {half})", f"({x} & ((1::BIGINT << {half}) - 1))"
    out = f"SELECT *, {left} AS a0, {right} AS b0 FROM src"
    for i, k in enumerate(round_keys()):
        mixed = f"((((b{i} + {k}) % {PRIME}) * ((b{i} + {k}) % {PRIME}) % {PRIME} * {FACTOR} + {k}) % {PRIME})"
        out = f"SELECT *, b{i} AS a{i + 1}, xor(a{i}, xor(m{i}, m{i} >> 15) & ((1::BIGINT << {half}) - 1)) AS b{i + 1} FROM (SELECT *, {mixed} AS m{i} FROM ({out}))"
    return out


#: The CRC of each text's UTF-8 bytes goes by a table of 256 entries, which the first relation makes by the rule.
SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_of),
u AS (SELECT doc_id, text, flatten(list_transform(string_split(coalesce(text, ''), ''), lambda ch: CASE WHEN ch = '' THEN []::BIGINT[] WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
  WHEN unicode(ch) < 2048 THEN [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)]::BIGINT[] WHEN unicode(ch) < 65536 THEN [224 + (unicode(ch) >> 12), 128 + ((unicode(ch) >> 6) & 63), 128 + (unicode(ch) & 63)]::BIGINT[]
  ELSE [240 + (unicode(ch) >> 18), 128 + ((unicode(ch) >> 12) & 63), 128 + ((unicode(ch) >> 6) & 63), 128 + (unicode(ch) & 63)]::BIGINT[] END)) AS bytes FROM documents),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM u, t),
n AS (SELECT count(*) AS n, CAST(greatest(1, ceil(len(bin(greatest(count(*) - 1, 1))) / 2)) AS INT) AS half FROM d),
k AS (SELECT *, CAST(floor(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || size || '|' || text_crc32), 1, 8) AS BIGINT) * {NUMBER_BUCKETS} / 4294967296.0) AS INT) AS bucket FROM d),
r AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM k),
walk AS (SELECT doc_id, size, text_crc32, x, 0 AS turn FROM r
  UNION ALL SELECT doc_id, size, text_crc32, (a{ROUNDS} << half) | b{ROUNDS}, turn + 1 FROM ({_network('x', 'half').replace('FROM src', 'FROM (SELECT * FROM walk, n WHERE turn = 0 OR x >= n) src')}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INT) AS shard, CAST(x // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM walk, n WHERE turn > 0 AND x < n
"""
