"""Exact Jaccard self-join of word 5-shingle sets by a partition of the universe, with a pigeonhole.

Sets fall into bands by size, each as wide as two linked sets may differ, so linked sets lie in one band or in neighbours;
a set joins the schemes of its own band and of the one below. A scheme hashes the universe into m segments. Linked sets
differ in at most H tokens, so at least m - H of their segments are equal; m leaves some slack above H. The key of a
segment is a hash of its tokens. Costs decide which keys count:

- Empty segments have no key. A set with too few others (m - H or more are empty) also gives the one-deletion
  neighbourhood of its segments: of two such sets some segment differs by one token at most. Very small sets for which
  even that isn't certain also give what is left of them without up to H tokens: two of them that are linked meet in their
  intersection.
- Keys of more than HOT texts (common passages) are left out for each set that keeps, without them, more keys than the
  pairs' difference can use up. Pairs whose number of common keys is too small for a link are dropped before any set is read.
- What remains in common keys (groups of many near copies) is compared with one text of each key, at first of two of a
  text's keys only, and joined into components. A text too few of whose tokens occur in other components is done. That is repeated with other texts while it
  thins the rest out. What is left is compared across components: each with each under keys of few texts, and block by
  block, as products of matrices, under others. A pair of components that is linked in a block needs one link only.

Pairs are verified by intersecting the sets. Copies of a text (the same words) are one text throughout. Texts and shingles are
known by 64-bit hashes. Word sequences of fewer than 5 words are one shingle.

Defined results: a null or empty text has no shingles and is linked with nothing; a null id stays null, with a null
component; rows that repeat an id each get a row, and all texts with words of one id are linked with each other, as they are
one document; its rows without words keep the id itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, batches_of, drop_written, join_common, lower_ascii, mix, table, words, written
from .url_filter import _bits, _set, bloom

PERCENT, SHINGLE, HOT, SLACK, BUCKET_TOKENS, TOKEN_BYTES, STAR_ROUNDS, THINNED, PRUNINGS, FEW, BLOCK, LOCAL_EDGES = 80, 5, 8, 0.15, 6_000_000, 6, 8, 0.7, 4, 32, 256, 500_000
HEAD = np.dtype([("cls", "<i8"), ("size", "<u4"), ("own", "<i4"), ("below", "<i4"), ("keys", "<u4")])


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Sorted hashes of the k-word shingles of a list of words."""
    n = F.size(w)
    long = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    short = F.array(F.xxhash64(F.array_join(w, " "), F.lit("short")))
    return F.when(n >= k, F.sort_array(F.array_distinct(long))).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, w, cls): words, and the hash that texts are known by."""
    return docs.select("doc_id", words(lower_ascii(F.coalesce("text", F.lit("")))).alias("w")).select("doc_id", "w", F.xxhash64("w").alias("cls"))


def bounds(percent: int, most: int) -> list[int]:
    """Lower ends of the bands; the last is above most."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return [*out, max(out[-1] + 1, -(-out[-1] * 100 // percent))]


def scheme(percent: int, end: int) -> tuple[int, int]:
    """(segments, most differing tokens) for pairs whose smaller set has fewer than `end` tokens."""
    small = end - 1
    differ = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
    return differ + 1 + math.ceil(SLACK * differ), differ


def keys_of(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (48 bits, the lowest says whether the scheme's number is odd) and their sets' positions; and each set's spare keys in its own scheme and the one below."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends = bounds(percent, int(sizes.max(initial=1)))
    band = np.searchsorted(ends, sizes, side="right") - 1
    tokens = mix(np.concatenate(sets).astype(np.int64).view(np.uint64)) if len(sets) else np.empty(0, np.uint64)
    keys, owners, spare = [], [], np.zeros((len(sets), 2), dtype=np.int64)
    low, high = (tokens & np.uint64(0x3FFFFFF)).astype(np.int64), ((tokens >> np.uint64(26)) & np.uint64(0x3FFFFFF)).astype(np.int64)
    plan = np.array([scheme(percent, ends[b + 1]) for b in range(len(ends) - 1)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)

    def key(a, b, segment, number, kind):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(b.astype(np.uint64) + np.uint64(kind * 0xD1B54A32D192ED03 % (1 << 64)))
        x = mix(x ^ mix(segment.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + number.astype(np.uint64)))
        return (x >> np.uint64(16)) & ~np.uint64(1) | (number.astype(np.uint64) & np.uint64(1))

    for down in (0, 1):
        number = band - down
        m, differ = plan[np.maximum(number, 0)].T
        m = np.where((sizes > 0) & (number >= 0), m, 0)
        first = np.concatenate([[0], np.cumsum(m)])
        live = m[owner] > 0
        at = ((mix(tokens + np.uint64(77)) >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + first[owner]
        count = np.bincount(at[live], minlength=first[-1])
        a = np.bincount(at[live], weights=low[live], minlength=first[-1]).astype(np.int64)
        b = np.bincount(at[live], weights=high[live], minlength=first[-1]).astype(np.int64)
        of = np.repeat(np.arange(len(sets)), m)
        within = np.arange(first[-1]) - first[of]
        full = count > 0
        keys.append(key(a[full], b[full], within[full], number[of[full]], 1))
        owners.append(of[full])
        empty = np.bincount(of[~full], minlength=len(sets))
        spare[:, down] = np.where(m > 0, m - differ - empty, 1)
        risky = (m > 0) & (spare[:, down] <= 0)
        if risky.any():
            part = full & risky[of]
            keys.append(key(a[part], b[part], within[part], number[of[part]], 2))
            owners.append(of[part])
            t = live & risky[owner]
            t[t] = count[at[t]] > 1
            keys.append(key(a[at[t]] - low[t], b[at[t]] - high[t], at[t] - first[owner[t]], number[owner[t]], 2))
            owners.append(owner[t])
            two = np.bincount(of[count > 1], minlength=len(sets))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for i in np.nonzero(risky & (2 * two <= differ))[0]:  # few, and small
                x, y = (part[starts[i] : starts[i + 1]] for part in (low, high))
                lost = [c for n in range(int(differ[i]) + 1) for c in combinations(range(len(x)), n)]
                a_, b_ = (np.array([v.sum() - v[list(c)].sum() for c in lost], dtype=np.int64) for v in (x, y))
                keys.append(key(a_, b_, np.zeros(len(lost), dtype=np.int64), np.full(len(lost), number[i]), 3))
                owners.append(np.full(len(lost), i))
    return np.concatenate(keys), np.concatenate(owners), spare


def _indexer(percent: int, buckets: int):
    """Batches of (doc_id, missing, cls, tokens) to (bucket, payload): HEADs of sets, then their keys of that bucket, 6 bytes each; in buckets below 0, ROWs of documents."""

    def flush(cls: list[int], sets: list[np.ndarray], docs: list[tuple]) -> pd.DataFrame:
        rows = [(-1 - abs(docs[0][1]) % buckets, np.array(docs, dtype=ROW).tobytes())]
        if not sets:
            return pd.DataFrame(rows, columns=["bucket", "payload"])
        keys, owners, spare = keys_of(sets, percent)
        bucket = (mix(keys) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.lexsort((owners, bucket))
        keys, owners, bucket = keys[order], owners[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        heads = np.zeros(len(sets), dtype=HEAD)
        heads["cls"], heads["size"], heads["own"], heads["below"] = cls, [len(s) for s in sets], spare[:, 0], spare[:, 1]
        for i in range(buckets):
            mine, k = owners[cuts[i] : cuts[i + 1]], keys[cuts[i] : cuts[i + 1]]
            if len(mine):
                here, n = np.unique(mine, return_counts=True)
                head = heads[here]
                head["keys"] = n
                rows.append((i, np.uint32(len(here)).tobytes() + head.tobytes() + k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "payload"])

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cls, sets, docs, held, seen = [], [], [], 0, set()
        for batch in batches:
            for doc_id, missing, c, tokens in zip(batch["doc_id"], batch["missing"], batch["cls"], batch["tokens"], strict=True):
                docs.append((doc_id, c, len(tokens), missing))
                if len(tokens) and c not in seen:
                    seen.add(c)
                    cls.append(c)
                    sets.append(np.asarray(tokens, dtype=np.int64))
                    held += len(tokens)
            if held > 2_000_000 or len(docs) > 100_000:
                yield flush(cls, sets, docs)
                cls, sets, docs, held = [], [], [], 0
        if docs:
            yield flush(cls, sets, docs)

    return index


ROW = np.dtype([("doc_id", "<i8"), ("cls", "<i8"), ("n", "<i8"), ("missing", "?")])
FOUND = "run long, a long, b long, n int, odd int, size_a long, size_b long, spare_a int, spare_b int"


def _meet(percent: int, hot: int):
    """The payloads of a bucket to pairs under keys of few texts (run null), texts under common keys (b null), or documents (odd -1: id, text, size)."""

    names = [c.split()[0] for c in FOUND.split(", ")]

    def documents(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(payload, ROW) for payload in rows["payload"]])
        out = pd.DataFrame({"a": pd.Series(x["doc_id"]).astype("Int64").mask(x["missing"]), "b": x["cls"], "size_a": x["n"], "odd": -1})
        return out.assign(**{c: pd.array([None] * len(x), dtype="Int64") if c == "run" else 0 for c in names if c not in out.columns})[names]

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return documents(rows)
        heads, keys = [], []
        for payload in rows["payload"]:
            n = int(np.frombuffer(payload, "<u4", 1)[0])
            heads.append(np.frombuffer(payload, HEAD, n, 4))
            raw = np.frombuffer(payload, np.uint8, offset=4 + n * HEAD.itemsize).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), dtype=np.uint8)
            wide[:, :6] = raw
            keys.append(wide.view("<u8").ravel())
        head, key = np.concatenate(heads), np.concatenate(keys)
        who = np.repeat(np.arange(len(head)), head["keys"])
        order = np.lexsort((head["cls"][who], key))
        key, who = key[order], who[order]
        once = np.ones(len(key), dtype=bool)
        once[1:] = (key[1:] != key[:-1]) | (head["cls"][who[1:]] != head["cls"][who[:-1]])
        key, who = key[once], who[once]
        start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        length = np.diff(np.append(start, len(key)))
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(2, hot + 1):
            s = start[length == k]
            i, j = np.triu_indices(k, 1)
            left.append((s[:, None] + i).ravel())
            right.append((s[:, None] + j).ravel())
        left, right = np.concatenate(left), np.concatenate(right)
        odd = (key[left] & np.uint64(1)).astype(np.int64)
        left, right = who[left], who[right]
        small, large = np.minimum(head["size"][left], head["size"][right]).astype(np.int64), np.maximum(head["size"][left], head["size"][right]).astype(np.int64)
        fits = small * 100 >= large * percent
        ends = bounds(percent, int(head["size"].max(initial=1)))
        number = np.searchsorted(ends, small, side="right") - 1
        fits &= number % 2 == odd  # keys of the scheme that the pair's smaller set decides
        left, right, number = left[fits], right[fits], number[fits]
        swap = head["cls"][left] > head["cls"][right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        pairs = pd.DataFrame({"a": head["cls"][left], "b": head["cls"][right], "odd": number % 2, "size_a": head["size"][left].astype(np.int64), "size_b": head["size"][right].astype(np.int64)})
        for side, at in (("a", left), ("b", right)):
            band = np.searchsorted(ends, head["size"][at], side="right") - 1
            pairs[f"spare_{side}"] = np.where(band == number, head["own"][at], head["below"][at])
        pairs = pairs.groupby(["a", "b"], sort=False).agg(n=("odd", "size"), odd=("odd", "first"), size_a=("size_a", "first"), size_b=("size_b", "first"), spare_a=("spare_a", "first"), spare_b=("spare_b", "first")).reset_index()
        pairs["run"] = pd.array([None] * len(pairs), dtype="Int64")
        common = np.repeat(length > hot, length)
        at, odd = who[common], (key[common] & np.uint64(1)).astype(np.int64)
        band = np.searchsorted(ends, head["size"][at], side="right") - 1
        members = pd.DataFrame({"run": pd.array(key[common].astype(np.int64), dtype="Int64"), "a": head["cls"][at], "b": pd.array([None] * len(at), dtype="Int64"), "n": 1, "odd": odd, "size_a": head["size"][at].astype(np.int64), "size_b": 0, "spare_a": np.where(band % 2 == odd, head["own"][at], head["below"][at]), "spare_b": 0})
        pairs["b"] = pairs["b"].astype("Int64")
        return pd.concat([pairs, members])[names]

    return meet


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(root, to) of every end of the edges that one task holds: to is the same throughout a component."""
    held = [batch.to_numpy() for batch in batches]
    ends = np.concatenate(held) if held else np.empty((0, 2), dtype=np.int64)
    node, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    to = np.arange(len(node))
    while (to[a] != to[b]).any():
        x, y = to[a], to[b]
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to != to[to]).any():
            to = to[to]
    yield pd.DataFrame({"root": node, "to": node[to]})


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame | None:
    """(cls, root) of every end of edges (a, b). Each round every node goes to the neighbour of least random rank, or stays; edges within a node vanish, so some log n rounds suffice.

    The last `local` edges, 16 bytes each, are finished by one task instead of further rounds, which would shuffle next to nothing.
    """
    edges, labels, turn = written(edges.select("a", "b").where("a <> b").distinct(), "edges"), None, 0
    while left := edges.count():
        turn += 1
        before, old = labels, edges
        if left <= local:
            step, edges = written(edges.coalesce(1).mapInPandas(_finished, "root long, to long"), "low"), None
        else:
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), c.alias("node"))
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("low")).select(F.col("a").alias("root"), F.when(F.col("low") < rank(F.col("a")), F.col("low.node")).otherwise(F.col("a")).alias("to"))
            step = written(low, "low")
            moved = edges.join(step.select(F.col("root").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("root").alias("b"), F.col("to").alias("y")), "b")
            edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        if labels is None:
            labels = step.select(F.col("root").alias("cls"), F.col("to").alias("root"))
        else:
            labels = written(labels.join(step, "root", "left").select("cls", F.coalesce("to", "root").alias("root")), "labels")
        drop_written(old, *([] if before is None or turn <= 2 else [before]))
        if edges is None:
            break
    return labels


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("of_a")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("of_b")), "b")
    both = two.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("i"), (F.size("of_a") + F.size("of_b")).alias("s"))
    return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def _marked(runs: DataFrame) -> DataFrame:
    """runs with `common`: whether a run has a thousandth of all rows or more, as at most 1,000 runs have. runs: a written table."""
    weights = written(runs.groupBy("run").agg(F.count("*").alias("weight")), "run-weights")
    total = weights.agg(F.sum("weight")).first()[0] or 0
    common = weights.where(F.col("weight") * 1000 >= total).limit(1000).select("run", F.lit(True).alias("common"))
    return runs.join(F.broadcast(common), "run", "left").withColumn("common", F.coalesce("common", F.lit(False)))


def _beside(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """runs of these groups (run, common and others; a row for each run): common runs by a broadcast, the others by a shuffle. Both are read twice, so they should be written tables."""
    common = F.col("common")
    hot = runs.where(common).join(F.broadcast(groups.where(common).drop("common").limit(1000)), "run")
    return hot.unionByName(runs.where(~common).join(groups.where(~common).drop("common"), "run"))


def _leads(runs: DataFrame) -> DataFrame:
    """Two runs of each text, those of the least and the largest key: near copies mostly agree in these, as minhashes do."""
    run = F.struct("run", "common")
    ends = written(runs.groupBy("cls", "size").agg(F.min(run).alias("low"), F.max(run).alias("high")), "ends")
    return written(ends.select("low.run", "cls", "size", "low.common").unionByName(ends.where("low.run <> high.run").select("high.run", "cls", "size", "high.common")), "leads")


def _star(runs: DataFrame, turn: int) -> DataFrame:
    """runs beside one text of each run, its pivot, drawn by a hash that differs from turn to turn. A run may hold most texts: see _beside. runs: a written table."""
    of = F.struct(F.xxhash64("cls", F.lit(turn)).alias("rank"), F.col("cls").alias("pivot"), F.col("size").alias("pivot_size"), *([F.col("root").alias("pivot_root")] if "root" in runs.columns else []))
    pivots = written(runs.groupBy("run", "common").agg(F.min(of).alias("p")), "pivots")
    return _beside(runs, pivots).select(*runs.columns, "p.*").where("cls <> pivot")


def link(docs: DataFrame, percent: int = PERCENT, hot: int = HOT, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """docs (doc_id, text): one row for each with n_shingles and component_id."""
    with batches_of(docs.sparkSession, 500):  # texts may be long
        return _link(docs, percent, hot, bucket_tokens)


def _link(docs: DataFrame, percent: int, hot: int, bucket_tokens: int) -> DataFrame:
    every = texts(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / TOKEN_BYTES / bucket_tokens))
    doc_id = F.col("doc_id").cast("long")
    sets = every.select(F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), doc_id.isNull().alias("missing"), "cls", shingles(F.col("w")).alias("tokens"))  # pandas rounds ids beside nulls
    dealt = sets.mapInPandas(_indexer(percent, buckets), "bucket int, payload binary").repartition(2 * buckets, "bucket")
    found = written(dealt.groupBy("bucket").applyInPandas(_meet(percent, hot), FOUND), "found")
    rows = found.where("odd = -1").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("size_a").alias("n_shingles"))
    found = found.where("odd <> -1")
    members = found.where("b is null").select("run", F.col("a").alias("cls"), "odd", F.col("size_a").alias("size"), F.col("spare_a").alias("spare"))
    lost = written(members.groupBy("cls", "odd").agg(F.count("*").alias("lost"), F.min("spare").alias("spare")), "lost")
    # A set that keeps enough other keys leaves common ones.
    runs = written(members.join(lost.where("lost >= spare").select("cls", "odd"), ["cls", "odd"], "left_semi").select("run", "cls", "size"), "runs")
    runs = written(_marked(runs), "runs")
    pairs = found.where("b is not null").groupBy("a", "b", "odd").agg(F.sum("n").alias("n"), F.min("size_a").alias("size_a"), F.min("size_b").alias("size_b"), F.min("spare_a").alias("spare_a"), F.min("spare_b").alias("spare_b"))
    for side in "ab":
        pairs = pairs.join(lost.select(F.col("cls").alias(side), "odd", F.col("lost").alias(f"lost_{side}")), [side, "odd"], "left")
    least = F.greatest(*[F.col(f"spare_{s}") - F.coalesce(f"lost_{s}", F.lit(0)) for s in "ab"], F.lit(1))
    tested = written(pairs.where(F.col("n") >= least).select("a", "b"), "pairs")
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    ordered = lambda p, x, y: p.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    first = ordered(_star(_leads(runs), 0).where(fits(F.col("size"), F.col("pivot_size"))), "cls", "pivot")
    todo = written(tested.unionByName(first).distinct(), "todo")
    needed = todo.select(F.col("a").alias("cls")).union(todo.select("b")).union(runs.select("cls")).distinct()
    needed = written(needed, "needed")
    chosen = written(_chosen(texts(docs.where(F.col("text").rlike(WORD))), needed), "sets")
    edges, tested, labels, left, last = None, None, None, runs.count(), False
    for turn in range(1, STAR_ROUNDS + 2):
        if turn == 1 and todo.isEmpty() and runs.isEmpty():
            break
        good = written(verified(todo, chosen, percent), "links")
        edges = good if edges is None else edges.unionByName(good)
        tested = todo if tested is None else tested.unionByName(todo)
        labels = components(edges)
        if last or runs.isEmpty():
            break
        if labels is not None:
            runs = runs.drop("root", "texts").join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        else:
            runs = runs.drop("root", "texts").withColumn("root", F.col("cls"))
        runs = _unresolved(runs, chosen, percent)
        if runs.isEmpty():
            break
        before, left = left, runs.count()
        if turn < STAR_ROUNDS and left <= THINNED * before:
            more = ordered(_star(runs, turn).where((F.col("root") != F.col("pivot_root")) & fits(F.col("size"), F.col("pivot_size"))), "cls", "pivot")
        else:
            last = True
            edges = edges.unionByName(_blocks(runs, chosen, percent))
            small = runs.where(F.col("texts") <= FEW)
            other = small.select("run", *[F.col(c).alias(f"{c}_2") for c in ("cls", "size", "root")])
            met = small.join(other, "run").where((F.col("cls") < F.col("cls_2")) & (F.col("root") != F.col("root_2")) & fits(F.col("size"), F.col("size_2")))
            more = ordered(met, "cls", "cls_2")
        todo = written(more.join(tested, ["a", "b"], "left_anti"), "todo")
    return _labelled(rows, labels)


def _chosen(every: DataFrame, needed: DataFrame) -> DataFrame:
    """(cls, tokens), once each, of the texts in needed. A Bloom filter of bounded size keeps the other texts out of the shuffle."""
    n = needed.count()
    blocks = max(1, min(131_072, math.ceil(n * 16 / 512)))
    filters = bloom(needed.select(F.col("cls").cast("string").alias("canon")), blocks)
    canon = F.col("cls").cast("string")
    rows = every.withColumn("block", F.pmod(F.xxhash64(canon), F.lit(blocks))).join(F.broadcast(filters), "block")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(canon)):
        hit = hit & (F.col(f"lane{i}").bitwiseAND(_set(bit)) != 0)
    # Each task sends a text's set once, however many copies it reads.
    few = rows.where(hit).select("cls", shingles(F.col("w")).alias("tokens")).groupBy("cls").agg(F.any_value("tokens").alias("tokens"))
    return few.join(needed, "cls", "left_semi")


def _unresolved(runs: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Runs with texts of several components, without texts that can't be linked to another component: too few of their tokens occur in any.

    `texts` is a run's number of texts, or more, where some have been left out since.
    """

    def split(r: DataFrame) -> DataFrame:
        mixed = r.groupBy("run", "common").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("texts")).where("x <> y")
        return written(_beside(r.drop("texts"), written(mixed.drop("x", "y"), "mixed")), "runs")

    runs = split(written(runs, "rooted"))
    for _ in range(PRUNINGS):
        if runs.isEmpty():
            break
        tokens = written(runs.select("cls", "root", "size").distinct().join(chosen, "cls").select("cls", "root", "size", F.explode("tokens").alias("token")), "tokens")
        shared = tokens.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
        able = tokens.join(shared, "token", "left_semi").groupBy("cls", "size").count().where(F.col("count") * 100 >= F.col("size") * percent).select("cls")
        kept = written(runs.join(able, "cls", "left_semi"), "able")
        drop_written(tokens)
        if kept.count() > THINNED * runs.count():
            return kept
        runs = split(kept)
    return runs


def _blocks(runs: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Links between components among the texts of runs of more than FEW texts.

    Texts that meet in such runs form clusters; blocks of some BLOCK texts of like size of a cluster are compared by a product of
    matrices, block by block. Only one link for each pair of components leaves a task.
    """
    runs = written(runs.where(F.col("texts") > FEW), "long-runs")
    met = components(runs.select(F.col("cls").alias("a"), F.col("run").alias("b")))  # should a run's number be a text's, clusters only become larger
    if met is None:
        return runs.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
    docs = written(runs.select("cls", "size", F.col("root").alias("part")).distinct().join(met.withColumnRenamed("root", "cluster"), "cls"), "clusters")
    sizes = docs.groupBy("cluster", "size").agg(F.count("*").alias("weight"))  # the window orders sizes, not texts
    before = F.sum("weight").over(Window.partitionBy("cluster").orderBy("size")) - F.col("weight")
    sizes = written(sizes.select("cluster", "size", "weight", F.floor(before / BLOCK).alias("first"), F.ceil(F.col("weight") / BLOCK).alias("parts")), "cluster-sizes")
    docs = join_common(docs, sizes, ["cluster", "size"], "weight")
    docs = written(docs.select("cls", "size", "part", "cluster", (F.col("first") + F.pmod(F.xxhash64("cls", F.lit("block")), "parts")).alias("block")), "blocks")
    blocks = docs.groupBy("cluster", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    left, right = blocks.select("cluster", F.col("block").alias("i"), "high"), blocks.select("cluster", F.col("block").alias("j"), "low")
    pairs = left.join(right, "cluster").where((F.col("i") <= F.col("j")) & (F.col("high") * 100 >= F.col("low") * percent))
    sides = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    held = docs.join(chosen, "cls").join(sides, ["cluster", "block"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        first = (rows["block"] == rows["i"]).to_numpy()
        one, two = np.nonzero(first)[0], np.nonzero((rows["block"] == rows["j"]).to_numpy())[0]
        sizes = rows["size"].to_numpy()
        doc = np.repeat(np.arange(len(rows)), [len(t) for t in rows["tokens"]])
        token, count = np.unique(np.concatenate(list(rows["tokens"])), return_inverse=True, return_counts=True)[1:]
        kept = count[token] > 1
        doc, token = doc[kept], token[kept]
        order = np.argsort(token, kind="stable")
        doc, token = doc[order], token[order]
        both = np.zeros((len(one), len(two)), dtype=np.float32)
        for low in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
            a, b = np.searchsorted(token, [low, low + 4096])
            if a < b:
                x = np.zeros((len(rows), 4096), dtype=np.float32)
                x[doc[a:b], token[a:b] - low] = 1
                both += x[one] @ x[two].T
        both = both.astype(np.int64)
        cls, part = rows["cls"].to_numpy(), rows["part"].to_numpy()
        good = 100 * both >= percent * (sizes[one][:, None] + sizes[two][None, :] - both)
        i, j = np.nonzero(good & (part[one][:, None] != part[two][None, :]) & (cls[one][:, None] != cls[two][None, :]))
        _, once = np.unique(np.stack([part[one][i], part[two][j]]), axis=1, return_index=True)
        x, y = cls[one][i][once], cls[two][j][once]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    return written(held.groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long"), "block-links")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The smallest id of each component, for every row."""
    known = rows.where("doc_id is not null and n_shingles > 0")
    several = written(known.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.count("*").alias("weight")).where("x <> y"), "several")
    if not several.isEmpty():  # texts of one id
        same = join_common(known, several, ["doc_id"], "weight").where("cls <> x").select(F.col("cls").alias("a"), F.col("x").alias("b"))
        before = [labels.select(F.col("cls").alias("a"), F.col("root").alias("b"))] if labels is not None else []
        for more in before:
            same = same.unionByName(more)
        labels = components(same)
    classes = known.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    if labels is not None:
        classes = classes.join(labels, "cls", "left")
        classes = classes.withColumn("root", F.coalesce("root", "cls"))
    else:
        classes = classes.withColumn("root", F.col("cls"))
    classes = written(classes, "classes")
    groups = classes.groupBy("root").agg(F.min("least").alias("component"), F.sum("copies").alias("size"), F.count("*").alias("weight")).where("size > 1")
    groups = written(groups, "groups")
    placed = join_common(classes, groups, ["root"], "weight").where("component is not null").select("cls", "component", "copies")
    out = join_common(rows, written(placed, "placed"), ["cls"], "copies")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def query(spark, sf_dir):
    """The Jaccard join of all documents."""
    return link(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """One document of each group of near copies, the one with the smallest id; documents without words all stay, and so do rows without an id.

    Of rows that repeat an id, one stays for each of its texts, the least row.
    """
    keep = written(link(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept-ids")
    once = docs.join(keep.where("rows = 1"), "doc_id", "left_semi")
    again = docs.join(keep.where("rows > 1"), "doc_id", "left_semi")
    least = again.groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(least).unionByName(docs.where("doc_id is null"))
