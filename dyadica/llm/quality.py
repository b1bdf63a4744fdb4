"""Quality rules: text statistics, and the log-likelihood ratio of hashed n-grams. DataFrame operations only.

Tokens are runs of letters, digits and `_`, or runs of other visible characters. Unigrams and bigrams are hashed into
buckets, whose number grows with the square root of the corpus's bytes, as vocabularies do (`buckets_of`); two multinomials
with add-one smoothing count them, one over all documents, one over trusted documents. The log ratios are a constant of the plan, 4 bytes
a bucket: 4 MB for 30 GB, 256 MB for 100 TB. A
document's score is the mean, over its n-grams, of ln P_trusted - ln P_raw; it is kept if the score is at least THRESHOLD.
Every document is judged the same way, by whole text. The trusted multinomial is fitted on at most TRUSTED_ROWS trusted
rows, those with the smallest hash of their id; raw counts cover all documents.

Defined results: a null or empty text has no words, counts of 0, score 0.0, and fails the base rules. Without trusted
documents all ratios are those of a uniform target. Equal rows get equal results; other columns pass through `score`,
whose own columns replace those of the same name.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GROUP_BYTES, WORD, let, long_rows, table, written

BUCKETS, PER_ROOT, TRUSTED_ROWS, THRESHOLD = 1 << 14, 4, 50_000, -0.25
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SYMBOLS = "[#*$%&|<>]"
BLANKS = r"[\x20\x09-\x0D]+"
#: Bits of a window's place in the numbers that are sorted.
PLACE_BITS = 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur at least twice. Windows are compared by a 64-bit hash of their words' hashes."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    windows = F.when(F.size(w) > 5, let(hashed, lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)])), F.lit(1), F.size(h) - 4)))
    return F.coalesce(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h))), F.lit(0).cast("long"))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash is there twice.

    A number made of a hash's upper bits and the window's place sorts as fast as numbers do, and brings equal hashes together unless different ones
    share these bits; where any do, or places don't fit, hash and place are sorted whole.
    """
    mask = F.lit((1 << PLACE_BITS) - 1).cast("long")
    packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
    whole = lambda s, i: F.get(hashes, F.get(s, i).bitwiseAND(mask).cast("int"))
    upper = lambda x: F.shiftright(x, PLACE_BITS)

    def short(s: Column) -> Column:
        mixed = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: (upper(F.get(s, i)) == upper(F.get(s, i - 1))) & (whole(s, i) != whole(s, i - 1)))
        twice = F.filter(s, lambda x, i: F.coalesce((upper(x) == upper(F.get(s, i - 1))) | (upper(x) == upper(F.get(s, i + 1))), F.lit(False)))
        return F.when(~mixed, F.transform(twice, lambda x: x.bitwiseAND(mask).cast("int")))

    def long(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), F.lit(False)))
        return F.transform(twice, lambda x: x["i"])

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.coalesce(F.when(F.size(hashes) < 1 << PLACE_BITS, let(packed, short)), let(ranked, long))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("sum"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(5), p - acc["last"])).alias("sum"))
    return F.aggregate(F.sort_array(places), start, step, lambda acc: acc["sum"])


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    cut = F.array_remove(F.split(text, BLANKS), "")  # the same words as a search for WORD finds, in less time
    chars = lambda w: F.length(F.array_join(w, "")).cast("long")
    found = let(cut, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"), chars(w).alias("c")))
    return {
        "found": found,
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def buckets_of(size: int) -> int:
    """Buckets for a corpus of so many bytes: a power of two, BUCKETS at least."""
    return max(BUCKETS, 1 << math.ceil(math.log2(max(PER_ROOT * math.sqrt(size), 1))))


def grams(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's unigrams and bigrams."""
    h = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    two = buckets & (buckets - 1) == 0  # then the lower bits are the remainder
    place = lambda x: (x.bitwiseAND(F.lit(buckets - 1).cast("long")) if two else F.pmod(x, F.lit(buckets))).cast("int")
    pairs = lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a)), lambda x, y: place(F.xxhash64(x, y)))
    return let(h, lambda a: F.concat(F.transform(a, place), F.when(F.size(a) > 1, pairs(a)).otherwise(F.array().cast("array<int>"))))


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row: `ratio`, an array of ln P_trusted - ln P_raw by bucket."""
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(trusted_rows)
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left")
    each = flagged.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), F.explode(grams(F.col("text"), buckets)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    cells = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("r"), F.sum("target").alias("t"))  # `buckets` cells
    return cells.select(F.transform("c", lambda x: (F.ln((x["target"] + 1) / (F.col("t") + buckets)) - F.ln((x["raw"] + 1) / (F.col("r") + buckets))).cast("float")).alias("ratio"))


@contextlib.contextmanager
def held(row: DataFrame) -> Iterator[Column]:
    """The only value of row as a constant: a variable of the session, which a plan that is analysed inside keeps as a literal.

    Joined to documents, the value would be copied for each of them, and subqueries may not stand beside lambdas.
    """
    spark, name = row.sparkSession, f"_held_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {name} {row.schema[0].dataType.simpleString()}")
    try:
        spark.sql(f"SET VAR {name} = (SELECT * FROM {{row}})", row=row)
        yield F.expr(name)
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")


def score(docs: DataFrame, trusted: DataFrame, *, buckets: int | None = None, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) with the base measures, base_failed, llr and kept. trusted: doc_id of trusted documents."""
    made = (*MEASURES, "base_failed", "llr", "kept", "found")
    buckets = buckets or buckets_of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    ratio = written(ratios(docs, trusted, buckets, trusted_rows).withColumnRenamed("ratio", "_ratio"), "ratios")
    with held(ratio) as whole:
        mean = let(grams(F.col("text"), buckets), lambda g: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(whole, b)) / F.greatest(F.size(g), F.lit(1)))
        scored = docs.withColumn("llr", mean)
    rows = scored.select(*[c for c in docs.columns if c not in made], *[c.alias(k) for k, c in measures(F.col("text")).items()], "llr")
    rows = rows.withColumns({"n_words": F.col("found.n"), "n_repeat_words": F.col("found.r"), "word_chars": F.col("found.c")}).drop("found")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def trusted_of(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def query(spark, sf_dir):
    out = score(table(spark, sf_dir, "documents"), trusted_of(table(spark, sf_dir, "labels")))
    return out.select("doc_id", *MEASURES, "base_failed", "kept", F.round("llr", 9).alias("llr"))


def stage(spark, docs, sf_dir):
    """The documents that the rules keep."""
    with long_rows(spark):
        return written(score(docs, trusted_of(table(spark, sf_dir, "labels"))).where("kept").select(*docs.columns), "kept", GROUP_BYTES)
