"""The fill-in-middle operator against a loop over code points, also where texts are cut into chunks."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dyadica.llm import fim

SHAPE = "doc_id long, text string, lang string, form string"


def expected(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "\t\n", "a", " a", "a ", "<P", "<P>", "x<<M>y", "<S >", "<SP>", "é 日本 🎈 z", "\x0b\x0c\r", "ab" * 30 + "<", " " * 70]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "bc", " ", "\n ", "é", "日本", "🎈", "<", "P", "S>", ">", "<P", " "]) for _ in range(rng.randrange(60))))
    return [(i, t) for i, t in enumerate(out)] + [(i + 1000, "one two three four " * (1 + i % 7)) for i in range(60)]


@pytest.mark.parametrize("chunk", [3, 16, 32_768])
def test_fim_equals_a_loop(spark, monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rows = [*texts(), (3, "one two three"), (3, "one two three"), (None, "a b c d e f g h")]
    d = spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], SHAPE)
    out = fim.transform(d)
    assert set(out.columns) == {"doc_id", "text", "lang", *fim.MADE}
    got = out.select("*", fim.restore(F.col("output"), F.col("form")).alias("restored")).collect()
    assert sorted(map(repr, [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got])) == sorted(map(repr, [(i, t, *expected(i, t)) for i, t in rows]))
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and fim.transform(d.limit(0)).count() == 0


def test_fim_of_a_giant_text(spark):
    """A text of 64 chunks, of which a third of all rows are copies, cut as the loop cuts it."""
    giant = ("word été 日本 <b> " * 40 + "\n") * 2_600
    ids = [i for i in range(200) if expected(i, "a b")[1] != "plain"][:6]
    d = spark.createDataFrame([(i, giant) for i in ids] + [(500 + i, "a b c") for i in range(12)], "doc_id long, text string")
    assert len(giant.encode()) > 64 * fim.CHUNK
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.transform(d).collect()}
    assert all(got[i] == expected(i, giant) for i in ids)


def test_transition_functions_compose():
    data = "a <P<M>  <S>b<\t\n<P>c ".encode()
    after, ended, seen = fim._automaton()
    for cut in range(len(data) + 1):
        parts = [fim.tree(x)[-1] for x in (data[:cut], data[cut:], data)]
        joined = fim.compose(parts[0], parts[1])
        assert all((a == b).all() for a, b in zip(joined, parts[2], strict=True))
    for start in range(fim.STATES):
        state, n, hits = start, 0, 0
        for i, c in enumerate(fim.CLASS_OF[list(data)]):
            if ended[state, c]:
                n += 1
                assert fim.locate(fim.tree(data), data, start, n) == i
            hits, state = hits + seen[state, c], after[state, c]
        whole = fim.tree(data)[-1]
        assert (whole[0][0, start], whole[1][0, start], whole[2][0, start]) == (state, n, hits)
