"""A hidden Markov language model of whole texts, trained by Baum-Welch.

Tokens are lower-cased (A-Z) words, then one end. All words of the training texts are counted; the base model gives a token of
count c the probability (c + 0.5) / (N + 0.5 (V + 1)). In the Markov model the most frequent words (`classes_of`: as
many as the square root of the tokens, LEAST_CLASSES at least) and the end are classes of their own, and each other word falls into
one of BUCKETS classes by its CRC, where it has (c + 0.5) / (C + 0.5 (V + 1)) of the bucket's C tokens and V words. So a
word's place within its class doesn't depend on the state: a text's probability is that of its classes, by the forward
recursion, times the shares within the buckets, which a join with the counts gives. Nothing but the classes' table
(classes x STATES numbers) is broadcast.

Texts are encoded once. Each round, every partition runs the forward and backward recursions over all training texts and
emits its expected counts by class; Spark adds these up, and the driver (classes x STATES numbers) makes the next tables. A
task has some 64 tokens for each class at least, so what it emits stays below what it reads. Each class keeps its
smoothed share of all tokens over the states together; a share MIX of it goes to all states alike.

Both recursions run over segments of SEGMENT tokens, all segments of a batch at once. A segment's transfer matrix, from any state at
its start, composes with its neighbours', which gives the exact vectors at all segment bounds; so a long text takes no longer for
each token than a short one, and the likelihood is that of the whole text. Vectors are scaled every SCALED tokens.

Defined results: a null or empty text has the end only. A null id isn't held out. Without training texts N and V are 0, and
a bucket's unseen word has the whole bucket. Repeated rows count and are scored each. Only doc_id and text are read. An
empty table gives no rows. Sums of floating-point counts depend on the order of tasks in their last digits.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

STATES, ROUNDS, SEGMENT, BUCKETS, LEAST_CLASSES, MIX, DELTA = 8, 5, 512, 256, 8192, 0.02, 0.5
STICK, SPREAD, SEED, BATCH_TOKENS, HELD_WORDS, SCALED = 0.9, 0.7, 12, 1 << 18, 1 << 20, 8
END = b""
TRANSITIONS, FIRST, LIKELIHOOD = -1, -2, -3


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text as lower-cased bytes, which split at the same six characters, and the end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all texts; the end is the empty word. A task adds up HELD_WORDS different words before it passes them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                held.update(tokens(text.as_py()))
                if len(held) >= HELD_WORDS:
                    yield counted(held)
                    held.clear()
        if held:
            yield counted(held)

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def classes_of(n: int) -> int:
    """Frequent words with a class of their own, for so many tokens: a power of two."""
    return max(LEAST_CLASSES, 1 << math.ceil(math.log2(max(math.sqrt(n), 1))))


def vocabulary(counts: DataFrame, classes: int | None = None) -> dict:
    """The classes of a written table of counts. Buckets' and frequent words' totals come to the driver: classes + BUCKETS rows."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where("word <> ''")
    top = words.orderBy(F.desc("c"), "word").limit(classes or classes_of(n)).collect()
    ends = counts.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    code = {END: 0} | {r["word"].encode(): i + 1 for i, r in enumerate(top)}
    seen, types = np.zeros(len(code) + BUCKETS), np.ones(len(code) + BUCKETS)
    seen[: len(code)] = [ends, *[r["c"] for r in top]]
    types[len(code) :] = 1  # the bucket's unseen word
    rare = words.where((F.col("c") < top[-1]["c"]) | (F.col("c") == top[-1]["c"]) & (F.col("word") > top[-1]["word"])) if top else words
    for r in rare.groupBy(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BUCKETS)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        seen[len(code) + r["b"]], types[len(code) + r["b"]] = r["c"], r["v"] + 1
    return {"n": int(n), "v": int(v), "code": code, "seen": seen, "total": seen + DELTA * types}


def id_type(classes: int) -> str:
    """The numbers that an encoded text is made of."""
    return "<u2" if classes <= 1 << 16 else "<u4"


def encode(docs: DataFrame, vocab: dict) -> DataFrame:
    """Each text's classes, what frequent words give to the base score and to known tokens, and its other words with their number; written, with a number for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # as many words as classes

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        code, frequent = vocab["code"], len(vocab["code"])
        kind = id_type(len(vocab["total"]))
        size = np.dtype(kind).itemsize
        all_tokens = vocab["n"] + DELTA * (vocab["v"] + 1)
        base = np.log10(vocab["seen"] + DELTA) - math.log10(all_tokens)
        base[frequent:] = -math.log10(all_tokens)  # the rest comes by the join
        within = np.zeros(len(base))
        within[frequent:] = -np.log10(vocab["total"][frequent:])
        known = ((vocab["seen"] > 0) & (np.arange(len(base)) < frequent)).astype("int64")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, n, rare, times, different = [], [], [], [], []
                for text in part.column("text").cast(pa.binary()):
                    words = tokens(text.as_py())
                    found = np.fromiter(map(code.get, words, itertools.repeat(-1)), "int32", len(words))
                    others = [words[i] for i in np.flatnonzero(found < 0)]
                    if others:
                        found[found < 0] = [frequent + zlib.crc32(w) % BUCKETS for w in others]
                        own = Counter(others)
                        rare.extend(own)
                        times.extend(own.values())
                        different.append(len(own))
                    else:
                        different.append(0)
                    ids.append(found)
                    n.append(len(found))
                ends, flat = np.concatenate([[0], np.cumsum(n)]), np.concatenate(ids)
                sums = [np.add.reduceat(x[flat], ends[:-1]) for x in (known, base, within)]
                packed = flat.astype(kind).tobytes()
                listed = pa.array([packed[size * a : size * b] for a, b in itertools.pairwise(ends.tolist())], pa.binary())
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()).cast(pa.string()), pa.array(times, pa.int32())], ["word", "times"])
                rare_listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(different)]), pa.int32()), pairs)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), *map(pa.array, sums), listed, rare_listed]
                yield pa.record_batch(columns, [c.split()[0] for c in shape.split("; ")])

    shape = "doc_id long; held_out boolean; n_tokens long; n_frequent long; base double; within double; ids binary; rare array<struct<word:string,times:int>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return written(rows.mapInArrow(own, shape.replace("; ", ", ")).withColumn("row", F.monotonically_increasing_id()), "encoded")


def first_model(vocab: dict, states: int = STATES, seed: int = SEED) -> dict:
    """States that like to stay, with the classes' shares, disturbed at random."""
    noise = np.exp(SPREAD * np.random.default_rng(seed).standard_normal((len(vocab["total"]), states)))
    emit = vocab["total"][:, None] * noise / noise.sum(1, keepdims=True)
    stay = np.eye(states) * STICK + (1 - STICK) / states
    return {"first": np.full(states, 1 / states), "next": stay, "emit": emit / emit.sum(0)}


class Segments:
    """The segments of a batch of sequences, longest first in `order`."""

    def __init__(self, lengths: np.ndarray, size: int):
        starts = np.cumsum(lengths) - lengths
        self.parts = -(-lengths // size)
        self.of_first = np.cumsum(self.parts) - self.parts
        doc = np.repeat(np.arange(len(lengths)), self.parts)
        number = np.arange(len(doc)) - self.of_first[doc]
        self.start, self.length = starts[doc] + number * size, np.minimum(size, lengths[doc] - number * size)
        self.more, self.has_next, self.is_first = self.parts[doc] > 1, number < self.parts[doc] - 1, number == 0
        self.order = np.argsort(-self.length, kind="stable")

    def steps(self, chosen: np.ndarray) -> tuple[np.ndarray, list[slice]]:
        """The tokens of `chosen`, which is in descending order of length, by their place in the segment, and the slice of these for each place."""
        lengths, start = self.length[chosen], self.start[chosen]
        counts = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        ends = np.cumsum(counts)
        at = np.concatenate([start[:n] + t for t, n in enumerate(counts)]) if len(chosen) else np.zeros(0, "int64")
        return at, [slice(e - n, e) for n, e in zip(counts, ends, strict=True)]


def scaled(x: np.ndarray) -> np.ndarray:
    return x / (x @ np.ones(x.shape[-1]))[..., None]


def bounds(ids: np.ndarray, segments: Segments, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """By segment: the scaled probabilities of the state before its first token, given what came before; and, up to a factor, the likelihood of its tokens and all later ones by that state."""
    k = len(model["first"])
    before, after = np.tile(model["first"], (len(segments.start), 1)), np.ones((len(segments.start), k))
    chosen = segments.order[segments.more[segments.order]]
    if not len(chosen):
        return before, after
    at, steps = segments.steps(chosen)
    obs = model["emit"][ids[at]]
    moves = np.tile(np.eye(k), (len(chosen), 1, 1))
    for t, step in enumerate(steps):
        n = step.stop - step.start
        moves[:n] = ((moves[:n] * obs[step][:, None, :]).reshape(-1, k) @ model["next"]).reshape(-1, k, k)
        if t % SCALED == SCALED - 1:
            moves[:n] = scaled(moves[:n].reshape(n, -1)).reshape(n, k, k)
    moves = scaled(moves.reshape(len(chosen), -1)).reshape(-1, k, k)
    place = np.zeros(len(segments.start), "int64")
    place[chosen] = np.arange(len(chosen))
    for j in range(1, segments.parts.max()):
        own = segments.of_first[segments.parts > j] + j
        before[own] = scaled(np.einsum("sk,skl->sl", before[own - 1], moves[place[own - 1]]))
    for j in range(segments.parts.max() - 1, -1, -1):
        own = segments.of_first[(segments.parts > j) & (segments.parts > 1)] + j
        behind = np.where(segments.has_next[own][:, None], after[np.minimum(own + 1, len(after) - 1)], 1.0)
        after[own] = scaled(np.einsum("skl,sl->sk", moves[place[own]], behind))
    return before, after


def forward(obs: np.ndarray, steps: list[slice], x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """By token, up to a factor: the probabilities of the state and of all up to it; and ln P by segment. x: the states' probabilities before each segment."""
    alpha, logs, x = np.empty_like(obs), np.zeros(len(x)), x.copy()
    one = np.ones(x.shape[1])
    for t, step in enumerate(steps):
        n = step.stop - step.start
        a = np.multiply(x[:n], obs[step], out=alpha[step])
        x[:n] = a @ model["next"]
        if t % SCALED == SCALED - 1:
            scale = x[:n] @ one
            x[:n] /= scale[:, None]
            logs[:n] += np.log(scale)
    return alpha, logs + np.log(x @ one)


def likelihoods(ids: np.ndarray, lengths: np.ndarray, model: dict, size: int = SEGMENT) -> np.ndarray:
    """ln P of each sequence of classes."""
    if not len(lengths):
        return np.zeros(0)
    segments = Segments(lengths, size)
    at, steps = segments.steps(segments.order)
    logs = np.empty(len(segments.order))
    logs[segments.order] = forward(model["emit"][ids[at]], steps, bounds(ids, segments, model)[0][segments.order], model)[1]
    return np.add.reduceat(logs, segments.of_first)


def expected(ids: np.ndarray, lengths: np.ndarray, model: dict, into: dict, size: int = SEGMENT) -> None:
    """Adds the expected counts of the sequences to `into`: emit (class, state), next, first, and ln P."""
    segments = Segments(lengths, size)
    order, move = segments.order, model["next"]
    at, steps = segments.steps(order)
    ids_at = ids[at]
    obs = model["emit"][ids_at]
    before, after = bounds(ids, segments, model)
    gamma, logs = forward(obs, steps, before[order], model)
    # Of each segment's next one, by state: the likelihood of what comes; where there is none it is 1.
    later = np.where(segments.has_next[:, None], after[np.minimum(np.arange(len(order)) + 1, len(order) - 1)], 1.0)[order]
    goes_on, done = segments.has_next[order], 0
    one = np.ones(len(move))
    for t, step in reversed(list(enumerate(steps))):
        n = step.stop - step.start
        a = gamma[step]
        beta = later[:n] @ move.T
        x = a * beta
        mass = x @ one
        a /= mass[:, None]
        new = slice(done, n)  # segments that end here; the last token of a sequence has no next one
        a[new][~goes_on[new]] = 0
        into["next"] += move * (a.T @ later[:n])
        np.multiply(beta, obs[step], out=later[:n])
        if t % SCALED == 0:
            later[:n] = scaled(later[:n])
        gamma[step] = x / mass[:, None]
        done = n
    for s in range(len(move)):
        into["emit"][:, s] += np.bincount(ids_at, gamma[:, s], len(into["emit"]))
    into["first"] += gamma[steps[0]][segments.is_first[order]].sum(0)
    into["log"] += logs.sum()


def in_batches(batch: pa.RecordBatch, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, lengths) of groups of rows of some BATCH_TOKENS tokens, at least one row."""
    kind = id_type(classes)
    texts = batch.column("ids").to_pylist()
    lengths = np.array([len(x) for x in texts], "int64") // np.dtype(kind).itemsize
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + BATCH_TOKENS, side="right")))
        yield np.frombuffer(b"".join(texts[at:end]), kind), lengths[at:end]
        at = end


def one_round(encoded: DataFrame, model: dict, tasks: int) -> dict:
    """Expected counts of all training texts. encoded: ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    states, classes = len(model["first"]), len(model["emit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = {"emit": np.zeros((classes, states)), "next": np.zeros((states, states)), "first": np.zeros(states), "log": 0.0}
        for batch in batches:
            for ids, lengths in in_batches(batch, classes):
                expected(ids, lengths, shared.value, into)
        rows = np.flatnonzero(into["emit"].any(1))
        keys = np.concatenate([rows, [TRANSITIONS - 3 * s for s in range(states)], [FIRST, LIKELIHOOD]])
        values = np.concatenate([into["emit"][rows], into["next"], into["first"][None], np.full((1, states), into["log"])])
        yield pa.record_batch([pa.array(keys, pa.int32()), *[pa.array(values[:, s]) for s in range(states)]], ["key", *[f"s{s}" for s in range(states)]])

    few = encoded.select("ids").coalesce(tasks)
    rows = few.mapInArrow(run, ", ".join(["key int", *[f"s{s} double" for s in range(states)]]))
    got = rows.groupBy("key").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).toPandas().set_index("key")  # a row for each class and state
    out = {"emit": np.zeros((classes, states)), "next": np.zeros((states, states)), "first": np.zeros(states), "log": 0.0}
    for key, values in zip(got.index, got.to_numpy(), strict=True):
        if key >= 0:
            out["emit"][key] = values
        elif key == FIRST:
            out["first"] = values
        elif key == LIKELIHOOD:
            out["log"] = float(values[0])
        else:
            out["next"][(TRANSITIONS - key) // 3] = values
    return out


def maximised(found: dict, vocab: dict) -> dict:
    """The tables for the next round. Each class's smoothed total is divided among the states as its expected counts are."""
    share = found["emit"].sum(0)
    share = share / share.sum() if share.sum() else np.full(len(share), 1 / len(share))
    sums = found["emit"].sum(1, keepdims=True)
    own = np.where(sums > 0, found["emit"] / np.where(sums > 0, sums, 1), share)
    emit = vocab["total"][:, None] * ((1 - MIX) * own + MIX * share)
    move, first = found["next"] + DELTA, found["first"] + DELTA
    return {"first": first / first.sum(), "next": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(0)}


def train(encoded: DataFrame, vocab: dict, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> dict:
    """The model after `rounds` rounds over encoded (ids) training texts; `logs` has ln P of all of them before each round."""
    model, logs = first_model(vocab, states, seed), []
    tasks = max(1, vocab["n"] // (64 * len(vocab["total"])))
    for _ in range(rounds if vocab["n"] else 0):
        found = one_round(encoded, model, tasks)
        logs.append(found["log"])
        model = maximised(found, vocab)
    return model | {"logs": logs}


def score(encoded: DataFrame, counts: DataFrame, vocab: dict, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all rows."""
    shared = encoded.sparkSession.sparkContext.broadcast({k: model[k] for k in ("first", "next", "emit")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [likelihoods(ids, lengths, shared.value) for ids, lengths in in_batches(batch, len(shared.value["emit"]))]
            kept = [c for c in batch.schema.names if c != "ids"]
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(np.concatenate(logs) / math.log(10) if logs else np.zeros(0))], [*kept, "path"])

    shape = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, within double"
    scored = encoded.select(*[c.split()[0] for c in shape.split(", ")], "ids").mapInArrow(run, shape + ", path double")
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    found = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + DELTA)).alias("shares"))
    rows = scored.join(found, "row", "left")
    shares = F.coalesce("shares", F.lit(0.0))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocab["n"]).cast("long").alias("train_tokens"), (F.col("base") + shares).alias("base_score"), (F.col("path") + F.col("within") + shares).alias("score"))


def fit_and_score(docs: DataFrame, *, states: int = STATES, rounds: int = ROUNDS, classes: int | None = None) -> DataFrame:
    """Scores of docs (doc_id, text), learnt from those that aren't held out."""
    docs = docs.select("doc_id", "text")
    counts = written(count_words(docs.where(~held_out(F.col("doc_id")))), "counts")
    vocab = vocabulary(counts, classes)
    encoded = encode(docs, vocab)
    model = train(encoded.where("NOT held_out"), vocab, states, rounds)
    return score(encoded, counts, vocab, model)


def query(spark, sf_dir):
    return fit_and_score(table(spark, sf_dir, "documents"))
