"""The prefix trie against a loop over all prefixes, with colliding fingerprints and a conversation that holds most rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from dyadica.llm import trie

SHAPE = "conv_id long, turn long, role string, text string, depth string, part string"


def expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 4, int(np.fmod(c, 20)) if abs(c) < 2**50 else c % 20
        whole[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = {}
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ids = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out[min(convs), len(prefix)] = (parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest())
    return out


def found(frame):
    got = frame.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SHAPE)


def some(rng, n):
    rows = []
    for c in n:
        for turn in range(rng.randrange(7)):
            rows.append((c, rng.choice([None, turn, turn, 5]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "a  b", "c", None, "", "é\x0bx"])))
    return rows


@pytest.mark.parametrize("bases", [trie.BASES, ((7, 3), (5, 2))])
def test_trie_equals_a_loop(spark, bases):
    rng = random.Random(4)
    rows = some(rng, [*range(70), -1, -7, -20, -21, 2**53 + 1, 2**53 + 3])
    rows += [(None, 1, "user", "none"), (40, 1, "user", "a b"), (40, 1, "user", "a b"), (41, 1, "user", "a b"), (41, 1, "user", "a b")]
    rows += [(c, 0, "user", "common first turn") for c in range(200, 260)] + [(300, None, None, None), (301, 3, "x", "long " * 5000)]
    assert found(trie.trie(frame(spark, rows), bases=bases)) == expected(rows)


def test_trie_of_one_long_conversation(spark, monkeypatch):
    """Half of all rows in one conversation, over many partitions; its family takes turns from it."""
    monkeypatch.setattr(trie, "BLOCK_IDS", 3)
    rng = random.Random(6)
    rows = [(20, i, "user", f"t {i % 3}") for i in range(150)] + [(27, i, "user", f"t {i % 3}") for i in range(149)] + some(rng, range(21, 27)) + [(c, 0, "a", "b") for c in range(500, 520)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(trie.trie(frame(spark, rows))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing(spark):
    assert trie.trie(frame(spark, [])).count() == 0
    assert trie.trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_scan_equals_plain_sums():
    rng = np.random.default_rng(7)
    conv = np.sort(rng.integers(0, 6, 60))
    hashes = [rng.integers(-(2**63), 2**63 - 1, 60) for _ in range(2)]
    place, sums = trie.scan(conv, hashes)
    for i in range(60):
        own = [j for j in range(i + 1) if conv[j] == conv[i]]
        assert place[i] == len(own)
        for h, s, (prime, base) in zip(hashes, sums, trie.BASES, strict=True):
            assert s[i] == sum(int(h[j]) * pow(base, k + 1, prime) for k, j in enumerate(own)) % prime


def test_query_equals_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = {(r[0], r[1]): tuple(r[2:]) for r in duck.execute(trie.SQL).fetchall()}
    assert found(trie.query(spark, "/root/testdata/sf0.001")) == want
