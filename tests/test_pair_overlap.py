"""Overlap of pair files, attested inputs and the equivalence of corpora, against loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from dyadica import catalogue
from dyadica.functions.stats import t_p_value
from dyadica.operators import pair_overlap as po
from dyadica.sources import transcripts

SF = "/root/testdata/sf0.01"


def loop(pairs, b=0.82):
    """pairs: counts by (det, noun)."""
    nouns, dets = defaultdict(Counter), {d for d, _ in pairs}
    for (d, n), c in pairs.items():
        nouns[n][d] += c
    freq = {n: sum(c.values()) for n, c in nouns.items()}
    n, s = len(nouns), sum(freq.values())
    bias = sum(max(c.values()) for c in nouns.values()) / s
    h = sum(i**-bias for i in range(1, n + 1))
    shares = [1 - (p * b + 1 - p) ** s - (p * (1 - b) + 1 - p) ** s + (1 - p) ** s for p in (i**-bias / h for i in range(1, n + 1))]
    y = np.log(sorted(freq.values(), reverse=True))
    slope = np.polyfit(np.log(np.arange(1, n + 1)), y, 1)[0] if n > 1 else None
    whole = sum(len(c) == len(dets) for c in nouns.values()) / n if len(dets) > 1 else 0
    return n, s, bias, s / n, whole, sum(shares) / n if s > 1 and shares[-1] > 0 else None, sum(1 - b**f - (1 - b) ** f for f in freq.values()) / n, slope


def same(row, want):
    return all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-9)) for a, b in zip(row, want, strict=True))


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_groups_equal_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(po, "BLOCK", block)
    rng = random.Random(5)
    groups = {"x": Counter(), "y": Counter(), None: Counter(), "one": Counter({("a", "wug"): 1}), "single": Counter({("the", "w"): 3, ("the", "v"): 3})}
    for name, dets in (("x", ["a", "the"]), ("y", ["a", "the", "my"]), (None, ["the", "a"])):
        for _ in range(300):
            groups[name][rng.choice(dets), f"n{int(rng.paretovariate(0.9)) % 60}"] += 1
    rows = [(g, d, n, c, "x") for g, own in groups.items() for (d, n), c in own.items()]
    rows += [("x", None, "n1", 4, ""), ("x", "a", None, 4, ""), ("y", "a", "n1", None, ""), ("y", "a", "n1", 0, "")]
    rows += [(g, d, n, 1, "again") for g, d, n, *_ in rows[:20]]
    for g, d, n, *_ in rows[:20]:
        groups[g][d, n] += 1
    got = {r[0]: r[1:] for r in po.pair_overlap(spark.createDataFrame(rows, "s string, det string, noun string, count int, bias string").withColumnRenamed("s", "n"), ["n"]).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert same(got[g], loop(own)), (g, got[g], loop(own))


def test_a_file_and_nothing(spark, tmp_path):
    lines = ["a dog", "the dog", "a dog", "bad", "the cat", "a b c", "", " the  dog "]
    (tmp_path / "p.txt").write_text("\n".join(lines))
    found = po.pair_overlap(transcripts.pairs(spark, str(tmp_path / "p.txt"))).collect()
    assert len(found) == 1 and same(found[0], loop(Counter({("a", "dog"): 2, ("the", "dog"): 2, ("the", "cat"): 1})))
    assert po.pair_overlap(spark.createDataFrame([], "det string, noun string, count long")).collect() == []


def test_many_nouns(spark):
    """A million nouns in one group, with the sum by numpy."""
    n = 1_000_000
    row = po.pair_overlap(spark.range(n).selectExpr("CASE WHEN id % 5 = 0 THEN 'a' ELSE 'the' END AS det", "id AS noun", "1 AS count")).first()
    p = 1.0 / np.arange(1, n + 1)
    p /= p.sum()
    assert (row.n, row.s, row.bias, row.slope) == (n, n, 1.0, 0.0)
    assert math.isclose(row.predicted, np.mean(1 - (p * 0.82 + 1 - p) ** n - (p * (1 - 0.82) + 1 - p) ** n + (1 - p) ** n), rel_tol=1e-7)


def test_attested_inputs_equal_a_loop(spark):
    sites = catalogue.frame(spark, SF, "SELECT dyad, session, line_num, pair_index, speaker, det, item FROM sites").collect()
    used = defaultdict(set)
    for r in sites:
        used[r.dyad, r.session, r.item, r.speaker].add(r.det)
    both = lambda r, at: all(len(used[r.dyad, at, r.item, w]) == 2 for w in ("child", "mother"))
    sessions = defaultdict(set)
    for r in sites:
        sessions[r.dyad].add(r.session)
    spoken = sorted((r for r in sites if r.speaker in ("child", "mother", "other_adult")), key=lambda r: (r.session, r.line_num, r.pair_index))
    last, want = {}, set()
    for r in spoken:
        before = last.get((r.session, r.item))
        if before == ("child" if r.speaker == "mother" else "mother") and any(at <= r.session and both(r, at) for at in sessions[r.dyad]):
            want.add((r.session, r.line_num, r.pair_index))
        last[r.session, r.item] = r.speaker
    got = catalogue.QUERIES["attested_inputs"](spark, SF).collect()
    assert want and {(r.session, r.line_num, r.pair_index) for r in got} == want and len(got) == len(want)
    assert all(r.has_prior_mention and r.full_input_mlm.count("\n") >= 1 for r in got)


def test_equivalence_of_corpora(spark):
    rates = defaultdict(lambda: defaultdict(list))
    for r in catalogue.frame(spark, SF, "SELECT dyad, session, speaker, det, previous_det FROM transitions").collect():
        rates[r.speaker, r.session % 2][r.dyad].append(r.det != r.previous_det)
    got = catalogue.QUERIES["corpus_equivalence"](spark, SF).collect()
    assert len(got) >= 2
    for r in got:
        even, odd = ([np.mean(x) for x in rates[r.speaker, i].values()] for i in (0, 1))
        assert (r.n_even, r.n_odd) == (len(even), len(odd))
        v, w = np.var(even, ddof=1) / len(even), np.var(odd, ddof=1) / len(odd)
        t, df = (np.mean(even) - np.mean(odd)) / math.sqrt(v + w), (v + w) ** 2 / (v**2 / (len(even) - 1) + w**2 / (len(odd) - 1))
        assert math.isclose(r.t, t, abs_tol=1e-6) and math.isclose(r.df, df, abs_tol=1e-5)
        assert math.isclose(r.p, t_p_value(float(t), float(df)), abs_tol=2e-6)
