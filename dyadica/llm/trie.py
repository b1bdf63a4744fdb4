"""The prefix trie of conversations, by fingerprints of their prefixes.

Turns are sorted by range over the executors. numpy scans each partition: it numbers the turns of each conversation and
sums their hashes, times powers of a base, modulo two primes. What a conversation has in one partition is continued
in the next by the lengths and sums of its parts, of which a partition shares two conversations at most with others; so a
conversation may hold any part of the rows. The sum up to a turn is the prefix's fingerprint. A rebuilt conversation's
fingerprints follow from those of its own turns and of the conversation that lends its first turns, without another scan.

Prefixes of equal depth and fingerprint are candidates for one node. Every candidate's last turn is held against that of its
group's representative, the smallest one. As a fingerprint less its last turn's hash is its parent's, groups whose last turns are all equal, at all
depths, have members with equal prefixes throughout. Groups that hold different turns, or turns of different parents, are split by
parent, role and text, until there are none; the parts are known by their smallest conversation.

A node is known by its smallest conversation and its depth. Sums over subtrees are rolled up by doubling: after k rounds a
node has what lies less than 2 ** k below it, and passes it to its ancestor 2 ** k above, the node of the same
conversation there. So the number of rounds is the logarithm of the depth. The ids of the conversations that end in a node are joined block by block and hashed as a stream.

Defined results: turns are in order of turn (null first), role and text; null roles and texts are empty; repeated rows are
turns of their own. Rows without a conv_id are in no conversation. h counts the digits' CRC as unsigned; c - c % 20 keeps the
sign that Spark gives. Other columns are not read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_common, table, written

FAMILY, HEADS, BLOCK_IDS = 20, 4, 4096
#: Fixed values: (prime, base) of the two fingerprints.
BASES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 69_069_069))
KEYS = ["depth", "f1", "f2", "part"]


def power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo prime."""
    out, factor, left = np.ones(len(exponents), "int64"), base % prime, exponents.astype("int64")
    while left.any():
        out = np.where(left & 1, out * factor % prime, out)
        factor, left = factor * factor % prime, left >> 1
    return out


def scan(conv: np.ndarray, hashes: list[np.ndarray], bases=BASES) -> tuple[np.ndarray, list[np.ndarray]]:
    """For rows sorted by conversation: the place in the conversation, from 1, and the sums of hash * base ** place so far, by prime."""
    n = len(conv)
    new = np.ones(n, bool)
    new[1:] = conv[1:] != conv[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = np.arange(n) - first + 1
    sums = []
    for h, (prime, base) in zip(hashes, bases, strict=True):
        terms = h % prime * power(base, place, prime) % prime
        total = np.cumsum(terms)  # below 2 ** 31 each, so 2 ** 32 rows fit
        sums.append((total - (total[first] - terms[first])) % prime)
    return place, sums


def numbered(turns: DataFrame, bases=BASES) -> DataFrame:
    """turns (conv, turn, role, text) with place, f1 and f2 within each conversation; written."""
    order = ["conv", "turn", "role", "text"]
    sized = turns.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", "role", F.lit(1))})
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, count, carried = None, 0, [0, 0]
        for rows in batches:
            if not len(rows):
                continue
            conv = rows["conv"].to_numpy()
            place, sums = scan(conv, [rows["h1"].to_numpy(), rows["h2"].to_numpy()], bases)
            same = int(np.searchsorted(conv != conv[0], True)) if last == conv[0] else 0
            for s, (prime, base), before in zip(sums, bases, carried, strict=True):
                s[:same] = (before + s[:same] * pow(base, count, prime)) % prime
            place[:same] += count
            last, count, carried = conv[-1], int(place[-1]), [int(s[-1]) for s in sums]
            yield rows.drop(columns=["turn", "h1", "h2"]).assign(place=place, f1=sums[0], f2=sums[1])

    rows = written(ranged.mapInPandas(run, "conv long, role string, text string, at int, place long, f1 long, f2 long"), "turns")
    runs = rows.groupBy("conv", "at").agg(F.max_by(F.struct("place", "f1", "f2"), "place").alias("end"))
    spread = runs.join(runs.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv"), "conv")

    def carry(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        count, sums, out = 0, [0, 0], []
        for r in parts.sort_values("at").itertuples():
            out.append((key[0], r.at, count, *sums))
            sums = [(s + pow(base, count, prime) * int(f)) % prime for s, f, (prime, base) in zip(sums, (r.f1, r.f2), bases, strict=True)]
            count += int(r.place)
        return pd.DataFrame(out, columns=["conv", "at", "before", "b1", "b2"])

    # Two rows for each partition at most; a conversation has one for each that it lies in.
    carried = spread.select("conv", "at", "end.*").groupBy("conv").applyInPandas(carry, "conv long, at int, before long, b1 long, b2 long")
    at = rows.join(F.broadcast(written(carried, "carried")), ["conv", "at"], "left").na.fill(0, ["before", "b1", "b2"])

    @F.pandas_udf("f1 long, f2 long")
    def shifted(before: pd.Series, f1: pd.Series, f2: pd.Series, b1: pd.Series, b2: pd.Series) -> pd.DataFrame:
        out = [(b.to_numpy() + power(base, before.to_numpy(), prime) * f.to_numpy()) % prime for f, b, (prime, base) in zip((f1, f2), (b1, b2), bases, strict=True)]
        return pd.DataFrame({"f1": out[0], "f2": out[1]})

    whole = at.withColumn("s", shifted("before", "f1", "f2", "b1", "b2"))
    return written(whole.select("conv", "role", "text", (F.col("place") + F.col("before")).alias("place"), "s.f1", "s.f2"), "numbered")


def lent(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(rows: DataFrame, convs: DataFrame, bases=BASES) -> DataFrame:
    """(conv, depth, role, text, f1, f2, n) of all rebuilt conversations, with a row of depth 0 for each; n: their turns. rows: numbered(); convs: conv, n."""
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<struct<place:bigint,role:string,text:string,f1:bigint,f2:bigint>>")
    heads = rows.where(F.col("place") < HEADS).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "f1", "f2"))).alias("head"))  # three turns each
    known = convs.withColumns({"base": F.col("conv") - F.col("conv") % FAMILY, "h": lent(F.col("conv"))})
    own = known.join(heads, "conv", "left").join(heads.select(F.col("conv").alias("base"), F.col("head").alias("other")), "base", "left")
    own = own.withColumns({"head": F.coalesce("head", empty), "taken": F.slice(F.coalesce("other", empty), F.lit(1), F.col("h").cast("int"))})
    own = own.withColumn("m", F.size("taken").cast("long"))
    end = lambda c, i: F.coalesce(F.get(c, i - 1), F.struct(zero.alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), zero.alias("f1"), zero.alias("f2")))
    mine = end(F.col("head"), F.least(F.col("h"), F.size("head")).cast("int"))
    theirs = end(F.col("taken"), F.col("m").cast("int"))
    own = own.withColumns({"o1": mine["f1"], "o2": mine["f2"], "t1": theirs["f1"], "t2": theirs["f2"], "total": F.col("m") + F.greatest(F.col("n") - F.col("h"), zero)})
    own = written(own.select("conv", "n", "h", "m", "o1", "o2", "t1", "t2", "total", "taken"), "families")
    # A place moves by m - h, so the sums of what follows are divided by the base's powers.
    moved = join_common(rows, own.drop("taken"), ["conv"], "n").where("place > h")
    shift = F.col("m") - F.col("h")
    out = {}
    for i, (prime, base) in enumerate(bases, 1):
        back = [pow(pow(base, k, prime), -1, prime) for k in range(HEADS)]
        factor = F.element_at(F.array(*[F.lit(x).cast("long") for x in back]), (1 - shift).cast("int"))
        out[f"f{i}"] = F.pmod(F.col(f"t{i}") + F.pmod(F.col(f"f{i}") - F.col(f"o{i}"), F.lit(prime)) * factor, F.lit(prime))
    moved = moved.withColumns(out).select("conv", (F.col("place") + shift).alias("depth"), "role", "text", "f1", "f2", F.col("total").alias("n"))
    first = own.select("conv", F.explode("taken").alias("x"), "total").select("conv", F.col("x.place").alias("depth"), "x.role", "x.text", "x.f1", "x.f2", F.col("total").alias("n"))
    root = own.select("conv", zero.alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"), zero.alias("f1"), zero.alias("f2"), F.col("total").alias("n"))
    return written(root.unionByName(first).unionByName(moved).withColumns({"part": zero, "above": zero}), "rebuilt")


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with `part` such that equal KEYS mean equal prefixes; and the nodes by KEYS: conv (the smallest), n_convs and words of the last turn.

    above: the part of the prefix that is one turn shorter.
    """
    turn = F.struct("above", "role", "text")
    while True:
        groups = rows.groupBy(*KEYS).agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.min(turn).alias("representative"), F.max(turn).alias("other"))
        groups = written(groups.select(*KEYS, "node", "n_convs", "representative.text", (F.col("representative") != F.col("other")).alias("mixed")), "groups")
        if groups.where("mixed").isEmpty():
            words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long")
            return rows, groups.select(*KEYS, "node", "n_convs", words.alias("words"))
        # Only where fingerprints collide. A part's smallest conversation is in no other part; a whole group's 0 ends with its split.
        marked = join_common(rows, groups.select(*KEYS, "mixed", "n_convs"), KEYS, "n_convs").drop("n_convs")
        own = marked.where("mixed").groupBy(*KEYS, "above", "role", "text").agg(F.min("conv").alias("new"))
        split = marked.where("mixed").join(own, [*KEYS, "above", "role", "text"]).withColumn("part", F.col("new")).drop("new")
        rows = written(marked.where("NOT mixed").unionByName(split).drop("mixed"), "split")
        above = rows.select("conv", (F.col("depth") + 1).alias("depth"), F.col("part").alias("now"))
        rows = written(rows.join(above, ["conv", "depth"], "left").withColumn("above", F.coalesce("now", "above")).drop("now"), "split")


def ends(members: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): the digest of the ascending ids of the conversations that end in each node. members: node, depth, conv."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted ids as comma-joined blocks of BLOCK_IDS."""
        key, held, out = None, [], []
        for rows in batches:
            for node, depth, conv in zip(rows["node"].tolist(), rows["depth"].tolist(), rows["conv"].tolist(), strict=True):
                if held and ((node, depth) != key or len(held) == BLOCK_IDS):
                    out.append((*key, held[0], ",".join(map(str, held))))
                    held = []
                key = (node, depth)
                held.append(conv)
            if out:
                yield pd.DataFrame(out, columns=["node", "depth", "first", "ids"])
                out = []
        if held:
            yield pd.DataFrame([(*key, held[0], ",".join(map(str, held)))], columns=["node", "depth", "first", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for rows in batches:
            out = []
            for node, depth, ids in zip(rows["node"].tolist(), rows["depth"].tolist(), rows["ids"].tolist(), strict=True):
                if (node, depth) == key:
                    digest.update(b"," + ids.encode())
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (node, depth), hashlib.sha256(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["node", "depth", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["node", "depth", "ends_sha256"])

    order = ["node", "depth", "conv"]
    blocks = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(runs, "node long, depth long, first long, ids string")
    whole = blocks.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")  # a row for BLOCK_IDS ids
    return whole.mapInPandas(digests, "node long, depth long, ends_sha256 string")


def rolled_up(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """nodes (node, depth, leaves, saved) with both summed over each subtree. members: conv, depth, node."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    step = 1
    places = members.select(F.col("conv").alias("node"), "depth", F.col("node").alias("up"))
    while step <= deepest:
        below = nodes.where(F.col("depth") >= step).withColumn("depth", F.col("depth") - step)
        sums = below.join(places, ["node", "depth"]).groupBy(F.col("up").alias("node"), "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        added = nodes.join(sums, ["node", "depth"], "left").na.fill(0, ["l", "s"])
        nodes = written(added.select("node", "depth", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved")), "rolled")
        step *= 2
    return nodes


def trie(conversations: DataFrame, *, bases=BASES) -> DataFrame:
    """The nodes of conversations (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = numbered(turns, bases)
    rows, groups = verified(rebuilt(rows, rows.groupBy("conv").agg(F.count("*").alias("n")), bases))
    members = join_common(rows.select("conv", *KEYS, "n"), groups.select(*KEYS, "node", "n_convs"), KEYS, "n_convs")
    members = written(members.select("conv", "depth", "node", (F.col("depth") == F.col("n")).alias("ends")), "members")
    nodes = groups.select("node", "depth", "n_convs", "words")
    up = members.select(F.col("conv").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = written(nodes.join(up, ["node", "depth"], "left"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, ["node", "depth"], "left").na.fill(0, ["n_children"]), "nodes")
    own = nodes.select("node", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"))
    out = nodes.join(rolled_up(own, members), ["node", "depth"]).join(ends(members.where("ends")), ["node", "depth"], "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest.alias("ends_sha256"))


def query(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))


#: The low two bits of a CRC are those of the whole table-driven CRC, whose table the first relation makes by the rule.
SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_of),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM turns),
lends AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: unicode(ch)::BIGINT), lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 4 AS h FROM ids, t),
taken AS (SELECT l.conv_id, l.h, count(b.place) AS m FROM lends l LEFT JOIN turns b ON b.conv_id = l.base AND b.place <= l.h GROUP BY l.conv_id, l.h),
rebuilt AS (SELECT l.conv_id, b.place AS depth, b.role, b.text FROM lends l JOIN turns b ON b.conv_id = l.base AND b.place <= l.h
  UNION ALL SELECT k.conv_id, o.place - k.h + k.m AS depth, o.role, o.text FROM taken k JOIN turns o ON o.conv_id = k.conv_id AND o.place > k.h),
lists AS (SELECT i.conv_id, coalesce(list({{'r': r.role, 't': r.text}} ORDER BY r.depth) FILTER (r.depth IS NOT NULL), []) AS seq FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id),
prefixes AS (SELECT conv_id, len(seq) AS n, d.depth, seq[1:d.depth] AS prefix FROM lists, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS depth) d),
nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ended,
  CASE WHEN depth > 0 THEN (count(*) - 1) * len(regexp_extract_all(prefix[depth].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved FROM prefixes GROUP BY depth, prefix),
kin AS (SELECT c.depth, c.prefix, c.conv_id, c.n_convs, c.ended, c.saved, p.conv_id AS parent FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM kin WHERE depth > 0 GROUP BY parent, depth),
whole AS (SELECT k.*, coalesce(c.n, 0) AS n_children FROM kin k LEFT JOIN children c ON c.parent = k.conv_id AND c.depth = k.depth),
ancestors AS (SELECT w.saved, CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END AS leaf, d.depth, w.prefix[1:d.depth] AS prefix FROM whole w, LATERAL (SELECT unnest(range(0, w.depth + 1)) AS depth) d),
sums AS (SELECT depth, prefix, sum(saved) AS saved, sum(leaf) AS leaves FROM ancestors GROUP BY depth, prefix)
SELECT w.conv_id, w.depth, w.parent AS parent_conv_id, w.n_convs, w.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(w.ended) AS ends_sha256 FROM whole w JOIN sums s ON s.depth = w.depth AND s.prefix = w.prefix
"""
