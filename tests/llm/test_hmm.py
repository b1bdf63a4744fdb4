"""The hidden Markov language model against sums over all state paths, and its query against a loop."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dyadica.llm import hmm
from dyadica.llm.common import table, written

SF = "/root/testdata/sf0.001"


def random_model(rng, classes, states):
    return {"first": rng.dirichlet(np.ones(states)), "next": rng.dirichlet(np.ones(states), states), "emit": rng.dirichlet(np.ones(classes), states).T}


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_expected_counts_over_all_paths(size):
    rng = np.random.default_rng(1)
    classes, states = 5, 3
    m, lengths = random_model(rng, classes, states), np.array([1, 7, 4, 2, 5])
    ids = rng.integers(0, classes, lengths.sum()).astype("int32")
    want, logs, at = {"emit": np.zeros((classes, states)), "next": np.zeros((states, states)), "first": np.zeros(states)}, [], 0
    for n in lengths:
        seq, at = ids[at : at + n], at + n
        own, total = {k: np.zeros_like(v) for k, v in want.items()}, 0.0
        for path in itertools.product(range(states), repeat=int(n)):
            p = m["first"][path[0]] * math.prod(m["emit"][c, s] for c, s in zip(seq, path)) * math.prod(m["next"][a, b] for a, b in itertools.pairwise(path))
            total += p
            own["first"][path[0]] += p
            for c, s in zip(seq, path):
                own["emit"][c, s] += p
            for a, b in itertools.pairwise(path):
                own["next"][a, b] += p
        logs.append(math.log(total))
        for k in want:
            want[k] += own[k] / total
    into = {"emit": np.zeros((classes, states)), "next": np.zeros((states, states)), "first": np.zeros(states), "log": 0.0}
    hmm.expected(ids, lengths, m, into, size)
    assert all(np.allclose(into[k], want[k], atol=1e-12) for k in want) and math.isclose(into["log"], sum(logs))
    assert np.allclose(hmm.likelihoods(ids, lengths, m, size), logs, atol=1e-12)


def test_long_sequences_keep_their_scale():
    """Far below the smallest double; segments don't change the result."""
    rng = np.random.default_rng(2)
    m, lengths = random_model(rng, 400, 4), np.array([5000, 3, 257, 256])
    ids = rng.integers(0, 400, lengths.sum()).astype("int32")
    one, many = hmm.likelihoods(ids, lengths, m, 10_000), hmm.likelihoods(ids, lengths, m)
    assert one[0] < -20_000 and np.allclose(one, many, rtol=1e-12)


def test_training_raises_the_likelihood(spark):
    counts = written(hmm.count_words(table(spark, SF, "documents")), "counts")
    vocab = hmm.vocabulary(counts, 300)
    logs = hmm.train(hmm.encode(table(spark, SF, "documents"), vocab), vocab, rounds=6)["logs"]
    assert len(logs) == 6 and all(b > a for a, b in itertools.pairwise(logs))


def rows():
    out = [(1, None), (2, ""), (3, "  \n"), (4, "The the THE dog"), (4, "The the THE dog"), (None, "null é É ID"), (2**53 + 1, "x\x0by\tz"), (2**53 + 3, "word " * 700)]
    rng = np.random.default_rng(3)
    return out + [(100 + i, " ".join(rng.choice(["a", "the", "dog", "cat", f"odd{i}", f"Rare{i % 7}", "ran", "."], 1 + i % 30))) for i in range(90)]


@pytest.mark.parametrize("classes", [3, None])
def test_scores_equal_a_loop(spark, classes):
    d = spark.createDataFrame([(i, t, 0.5) for i, t in rows()], "doc_id long, text string, score double")
    split = lambda t: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    seen = Counter(w for i, t in rows() if not held(i) for w in split(t))
    n, v = sum(seen.values()), len(seen)
    got = hmm.fit_and_score(d, classes=classes, rounds=2).collect()
    assert len(got) == len(rows()) and any(held(i) for i, _ in rows())
    # The same model once more, its sums by plain recursions over words.
    counts = written(hmm.count_words(d.where(~hmm.held_out(hmm.F.col("doc_id")))), "counts")
    vocab = hmm.vocabulary(counts, classes)
    model = hmm.train(hmm.encode(d, vocab).where("NOT held_out"), vocab, rounds=2)
    frequent = {w.decode(): k for w, k in vocab["code"].items()}
    assert len(frequent) == (4 if classes else v)
    buckets = {b: [w for w in seen if w not in frequent and zlib.crc32(w.encode()) % hmm.BUCKETS == b] for b in range(hmm.BUCKETS)}

    def log10(text):
        state, total = model["first"], 0.0
        for w in split(text):
            b = zlib.crc32(w.encode()) % hmm.BUCKETS
            c = frequent[w] if w in frequent else len(frequent) + b
            state = state * model["emit"][c]
            share = 1.0 if w in frequent else (seen[w] + 0.5) / (sum(seen[x] for x in buckets[b]) + 0.5 * (len(buckets[b]) + 1))
            total += math.log10(state.sum() * share)
            state = state / state.sum() @ model["next"]
        return total

    base = lambda t: sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t))
    want = sorted((repr(i), held(i), len(split(t)), sum(seen[w] > 0 for w in split(t)), n, round(base(t), 6), round(log10(t), 5)) for i, t in rows())
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in got) == want
    assert np.allclose(model["emit"].sum(0), 1) and np.allclose(model["next"].sum(1), 1)


def test_no_training_texts_and_no_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    d = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    got = hmm.fit_and_score(d).collect()
    assert len(got) == len(held) and all(r.train_tokens == r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)
    assert hmm.fit_and_score(d.limit(0)).count() == 0


def test_states_help_on_held_out_texts(spark):
    out = hmm.query(spark, "/root/testdata/sf0.01").where("held_out").agg(hmm.F.sum("base_score").alias("b"), hmm.F.sum("score").alias("s"), hmm.F.sum("n_tokens").alias("n")).first()
    assert (out.s - out.b) / out.n > 0.1
