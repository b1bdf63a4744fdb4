"""Best-fit packing into sequences of several permitted lengths.

A document of `length` tokens is cut at the largest permitted length; whole cuts fill a sequence each, and what remains
is packed. Within a group of documents (dealt by a hash of the id; their number follows the input), pieces go, longest
first, to the fullest open bin that holds them, whatever its size. Where none does, another bin is opened: each permitted
size that holds the piece is filled, on trial, with the longest of the pieces still to come that fit, and the size whose bin,
downsized to its contents, then costs least for each token is opened. At the end each bin is downsized to the smallest
permitted length that holds its contents. A group's packings that always open one size (or, for a longer piece, the next
that holds it) are made too, and the packing of least cost stays. A sequence of c tokens costs c + OVERHEAD + c * c / SPAN:
a share for each token, one for each sequence, and attention's.

`sequences` then makes the packed sequences themselves, here of a byte-level model's tokens: a text's UTF-8 bytes and
END, a byte that UTF-8 never has, after each document.

Defined results: every row is packed, once for each time it occurs. A length that is null or below 0 counts 0; documents
of length 0 get a row of length 0 in some bin. Texts are never shortened; a null text is empty and still has its END. Null
ids are packed like others. An empty table gives no rows. Of other columns only those named here are read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

SIZES, OVERHEAD, SPAN, GROUP_ROWS = (2048, 4096, 8192, 16384), 64, 65536, 20_000
SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, bin_size long, bin_offset long"
END = b"\xff"


def cost(size: int) -> float:
    return size + OVERHEAD + size * size / SPAN


def holding(n: int, sizes=SIZES) -> int:
    """The smallest permitted size that holds n tokens."""
    return next(s for s in sizes if s >= n)


def cheapest(lengths: list[int], i: int, sizes=SIZES, cost=cost) -> int:
    """The size to open for piece i: the one that costs least for each token when the longest of the later pieces that fit fill it."""
    best: tuple[float, int] | None = None
    for size in sizes:
        if size < lengths[i]:
            continue
        room, at = size - lengths[i], i + 1
        while room:
            at = bisect_left(lengths, -room, at, key=lambda n: -n)
            if at == len(lengths) or not lengths[at]:
                break
            room -= lengths[at]
            at += 1
        held = size - room
        each = cost(holding(held, sizes)) / max(held, 1)
        if best is None or each < best[0]:
            best = each, size
    return best[1]


def best_fit(lengths: list[int], opened: int | None = None, sizes=SIZES, cost=cost) -> list[list[int]]:
    """Bins of positions in lengths, which is in descending order. Without `opened` each bin's size is the `cheapest`, else that size or the next that holds the piece."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = cheapest(lengths, i, sizes, cost) if opened is None else max(opened, holding(n, sizes)), len(bins)
            bins.append([])
        bins[b].append(i)
        if left - n:
            insort(room, (left - n, b))
    return bins


def pack(lengths: list[int], sizes=SIZES, cost=cost) -> list[tuple[int, list[int]]]:
    """(size, positions) of the bins for lengths, none above the largest size, in descending order."""
    best: tuple[float, list] | None = None
    for opened in (None, *sizes):
        sized = [(holding(sum(lengths[i] for i in b), sizes), b) for b in best_fit(lengths, opened, sizes, cost)]
        total = sum(cost(s) for s, _ in sized)
        if best is None or total < best[0]:
            best = total, sized
    return best[1]


def groups_of(docs: DataFrame, group_rows: int) -> int:
    """How many groups docs are dealt into."""
    return max(1, math.ceil(docs.count() / group_rows))


def pack_documents(docs: DataFrame, sizes=SIZES, cost=cost, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows SCHEMA for docs (doc_id, length): where each piece of each document lies."""
    sizes = tuple(sorted(sizes))
    top = sizes[-1]
    docs = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("length"), F.lit(0)).cast("long"), F.lit(0)).alias("length")), "lengths")
    groups = groups_of(docs, group_rows)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "missing", "doc_id"], ascending=[False, True, True], kind="stable")
        ids, totals = [None if m else i for i, m in zip(rows["doc_id"].tolist(), rows["missing"].tolist(), strict=True)], rows["length"].tolist()
        out, n, base = [], 0, key[0] << 32
        rest = []
        for i, total in enumerate(totals):
            whole = total // top
            for p in range(whole):
                out.append((ids[i], p, p * top, top, base + n, top, 0))
                n += 1
            if total % top or not total:
                rest.append((total % top, whole, i))
        rest.sort(key=lambda r: -r[0])
        for size, members in pack([r[0] for r in rest], sizes, cost) if rest else ():
            at = 0
            for m in members:
                length, whole, i = rest[m]
                out.append((ids[i], whole, whole * top, length, base + n, size, at))
                at += length
            n += 1
        columns = list(zip(*out, strict=True))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pd.DataFrame({k: pd.Series(v, dtype="Int64" if k != "piece" else "int32") for k, v in zip(names, columns, strict=True)})

    dealt = docs.withColumn("group", F.pmod(F.xxhash64("doc_id", "length"), F.lit(groups)).cast("long"))
    # Only rows that repeat an id fill a group far beyond group_rows: such groups are dealt on, row by row.
    large = written(dealt.groupBy("group").agg(F.ceil(F.count("*") / F.lit(group_rows)).alias("parts")).where("parts > 2"), "large-groups")
    spread = dealt.withColumn("row", F.monotonically_increasing_id()).join(large, "group", "left")
    spread = spread.withColumn("group", F.col("group") + groups * F.pmod("row", F.coalesce("parts", F.lit(1))))
    # A null id beside large ones would make pandas round them.
    rows = spread.select("group", "length", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"))
    return rows.groupBy("group").applyInPandas(one, SCHEMA)


def byte_lengths(docs: DataFrame) -> DataFrame:
    """A byte-level model's tokens: the text's UTF-8 bytes, and one that ends the document."""
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("length"))


def sequences(docs: DataFrame, sizes=SIZES, cost=cost, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The packed sequences of docs (doc_id, text): bin_id, bin_size, n_tokens, doc_ids, starts (of each document's piece in the text), offsets (in the sequence) and tokens (binary).

    Texts are shuffled once, to the task of their group, where they meet their places and all bins of that group are filled. docs is read
    twice, so it should be a written table. Rows are known by a hash of id and text; if any two agree in it, by numbers of their own in a copy.
    """
    text = F.coalesce("text", F.lit(""))
    of = lambda row: docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row.alias("row"))
    size = (F.octet_length("text") + 1).cast("long")
    rows = of(F.xxhash64("doc_id", text))
    lengths = written(rows.select(F.col("row").alias("doc_id"), size.alias("length")), "text-lengths")
    if not lengths.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = written(of(F.monotonically_increasing_id()), "texts")
        lengths = rows.select(F.col("row").alias("doc_id"), size.alias("length"))
    groups = groups_of(lengths, group_rows)
    placed = pack_documents(lengths, sizes, cost, group_rows).withColumnRenamed("doc_id", "row")
    # A group dealt on has a number that differs from its own by a multiple of groups.
    places = placed.select(F.pmod(F.shiftright("bin_id", 32), F.lit(groups)).cast("long").alias("group"), "row", F.struct("bin_id", "bin_size", "bin_offset", "start", "length").alias("place"))
    held = rows.select(F.pmod(F.xxhash64("row", size), F.lit(groups)).cast("long").alias("group"), "row", "doc_id", "text")
    met = held.unionByName(places, allowMissingColumns=True).repartition("group").groupBy("group", "row").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text"), F.collect_list("place").alias("places"))
    pieces = met.select("group", "doc_id", F.concat(F.col("text").cast("binary"), F.lit(END)).alias("whole"), F.explode("places").alias("at"))
    cut = F.col("whole").substr((F.col("at.start") + 1).cast("int"), F.col("at.length").cast("int"))
    pieces = pieces.select("group", "at.bin_id", "at.bin_size", F.struct("at.bin_offset", "doc_id", "at.start", cut.alias("bytes")).alias("p"))
    bins = pieces.groupBy("group", "bin_id", "bin_size").agg(F.sort_array(F.collect_list("p")).alias("p"))
    tokens = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"]))
    part = lambda c: F.transform("p", lambda x: x[c])
    return bins.select("bin_id", "bin_size", F.octet_length(tokens).cast("long").alias("n_tokens"), part("doc_id").alias("doc_ids"), part("start").alias("starts"), part("bin_offset").alias("offsets"), tokens.alias("tokens"))


def query(spark, sf_dir):
    return pack_documents(byte_lengths(table(spark, sf_dir, "documents")))


def stage(spark, docs, sf_dir):
    """The packed sequences, each with the ids of its documents."""
    return sequences(docs)
