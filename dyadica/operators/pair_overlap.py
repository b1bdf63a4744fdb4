"""Overlap of counted pairs (as `sources.transcripts.pairs` reads them from a file), against two expectations, for any closed class and any number of nouns.

n nouns, s pairs, bias (the share of each noun's commonest determiner), r = s / n, empirical (the share of nouns seen with every determiner of
the group; 0 with one determiner), simple (mean of 1 - b^f - (1 - b)^f over nouns of f pairs, b being 0.82), predicted (mean over ranks of
the expected overlap at the same b, where the noun of rank i has the share i^-bias / H(bias): the bias serves as Zipf's exponent) and slope
(of ln f on ln rank). predicted is null where a noun's share isn't above 0, slope where there is one noun.

Sums over ranks are dealt out in blocks of BLOCK, so no row, task or window holds a group's nouns; ranks come from the histogram of frequencies,
which has at most sqrt(2 s) rows for a group.

Defined results: pairs whose det, noun or count is null, or whose count is below 1, are left out; repeated pairs add up; a group
without pairs has no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formulas import BLOCK

#: Fixed value: the bias that is held to be universal.
UNIVERSAL = 0.82


def _over_blocks(rows: DataFrame, keep: Sequence[str], low: str, high: str, sums: dict[str, str], tasks: int) -> DataFrame:
    """keep and, by name, sums of expressions in `i` over whole numbers i from low to high, dealt out over tasks; rows are unique in keep."""
    dealt = rows.withColumn("_b", F.expr(f"explode(sequence(0, CAST(({high} - {low}) DIV {BLOCK} AS BIGINT)))")).repartition(tasks, *keep, "_b")
    own = f"sequence({low} + _b * {BLOCK}, least({low} + (_b + 1) * {BLOCK} - 1, {high}))"
    return dealt.groupBy(*keep).agg(*[F.sum(F.expr(f"aggregate({own}, 0D, (acc, i) -> acc + {x})")).alias(name) for name, x in sums.items()])


def pair_overlap(pairs: DataFrame, keys: Sequence[str] = (), b: float = UNIVERSAL, count: str = "count", tasks: int = 32) -> DataFrame:
    """A row for each group of pairs (keys, det, noun, count). Groups whose keys are null are groups too."""
    names = [f"_k{i}" for i in range(len(keys))]
    given = pairs.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "det", "noun", F.col(count).cast("long").alias("f")).where("det IS NOT NULL AND noun IS NOT NULL AND f >= 1")
    # One number stands for the keys, so that null keys join as others do.
    group = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("")
    each = given.withColumn("g", group).groupBy("g", *names, "det", "noun").agg(F.sum("f").alias("f"))
    nouns = each.groupBy("g", *names, "noun").agg(F.sum("f").alias("f"), F.max("f").alias("top"), F.count("*").alias("dets"))
    classes = each.select("g", "det").distinct().groupBy("g").agg(F.count("*").alias("n_dets"))
    whole = F.when((F.col("dets") == F.col("n_dets")) & (F.col("n_dets") > 1), 1).otherwise(0)
    simple = 1 - F.pow(F.lit(b), F.col("f")) - F.pow(F.lit(1 - b), F.col("f"))
    base = nouns.join(classes, "g").groupBy("g", *names).agg(F.count("*").alias("n"), F.sum("f").alias("s"), (F.sum("top") / F.sum("f")).alias("bias"), F.avg(whole).alias("empirical"), F.avg(simple).alias("simple"))
    # Predicted: the harmonic sum first, then the shares.
    h = _over_blocks(base.select("g", "n", "s", "bias"), ["g", "n", "s", "bias"], "1L", "n", {"h": "pow(i, -bias)"}, tasks)
    p = "(pow(i, -bias) / h)"
    share = f"(1 - pow({p} * {b} + 1 - {p}, s) - pow({p} * {1 - b} + 1 - {p}, s) + pow(1 - {p}, s))"
    shares = _over_blocks(h, ["g", "n", "s", "bias", "h"], "1L", "n", {"total": share}, tasks).withColumn("i", F.col("n"))
    predicted = shares.select("g", F.expr(f"CASE WHEN s > 1 AND {share} > 0 THEN total / n END").alias("predicted"))
    # Slope: nouns of one frequency have neighbouring ranks.
    first = Window.partitionBy("g").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = nouns.groupBy("g", "f").agg(F.count("*").alias("c")).withColumn("hi", F.sum("c").over(first)).withColumn("lo", F.col("hi") - F.col("c") + 1)
    logs = _over_blocks(runs, ["g", "f", "c", "lo", "hi"], "lo", "hi", {"x": "ln(i)", "xx": "ln(i) * ln(i)"}, tasks)
    y = F.ln("f")
    sums = logs.groupBy("g").agg(F.sum("c").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum(F.col("c") * y).alias("y"), F.sum(F.col("x") * y).alias("xy"))
    slope = sums.where("n > 1").select("g", F.expr("(n * xy - x * y) / (n * xx - x * x)").alias("slope"))
    out = base.join(predicted, "g", "left").join(slope, "g", "left")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "n", "s", "bias", (F.col("s") / F.col("n")).alias("r"), "empirical", "predicted", "simple", "slope")


def query(spark, sf_dir, store=None, always=()):
    """The overlap of each language's pairs."""
    from ..catalogue import frame

    pairs = frame(spark, sf_dir, "SELECT lang, det, noun, count(*) AS n_pairs FROM docsites GROUP BY lang, det, noun", store, always)
    return pair_overlap(pairs, ["lang"], count="n_pairs").select("lang", "n", "s", *[F.round(c, 8).alias(c) for c in ("bias", "r", "empirical", "predicted", "simple", "slope")])


#: Behind the relations: one list of n numbers for each language, and a rank for each noun.
SQL = """
, pc AS (SELECT lang, det, noun, count(*) AS f FROM docsites GROUP BY lang, det, noun),
pn AS (SELECT lang, noun, CAST(sum(f) AS BIGINT) AS f, max(f) AS top, count(*) AS dets FROM pc GROUP BY lang, noun),
pd AS (SELECT lang, count(DISTINCT det) AS n_dets FROM pc GROUP BY lang),
pr AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f DESC) AS rk FROM pn),
pb AS (SELECT pr.lang, count(*) AS n, CAST(sum(f) AS BIGINT) AS s, sum(top) / CAST(sum(f) AS DOUBLE) AS bias, avg(CASE WHEN dets = n_dets AND n_dets > 1 THEN 1e0 ELSE 0e0 END) AS empirical,
  avg(1 - pow(0.82e0, f) - pow(0.18e0, f)) AS simple, CASE WHEN count(*) > 1 THEN regr_slope(ln(f), ln(rk)) END AS slope FROM pr JOIN pd ON pd.lang = pr.lang GROUP BY pr.lang),
ph AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: pow(i, -bias))) AS h FROM pb),
pl AS (SELECT *, list_transform(range(1, n + 1), lambda i: 1 - pow(0.82e0 * pow(i, -bias) / h + 1 - pow(i, -bias) / h, s) - pow(0.18e0 * pow(i, -bias) / h + 1 - pow(i, -bias) / h, s) + pow(1 - pow(i, -bias) / h, s)) AS shares FROM ph)
SELECT lang, n, s, round(bias, 8) AS bias, round(s / CAST(n AS DOUBLE), 8) AS r, round(empirical, 8) AS empirical, round(CASE WHEN s > 1 AND shares[n] > 0 THEN list_sum(shares) / n END, 8) AS predicted, round(simple, 8) AS simple, round(slope, 8) AS slope FROM pl
"""
