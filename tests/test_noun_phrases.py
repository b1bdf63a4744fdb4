"""Noun phrases: sentences checked by hand, the fold against every path of tags, odd rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from dyadica.operators import noun_phrases as np_
from dyadica.plans.store import Store

CORPUS = [
    "The dog is big. A dog was here. I see the dog. Where is the ball? The ball is red. You want a ball.",
    "The big dog is here. A big ball. I like the red ball. The red truck is there. A truck is on the road.",
    "The dogs are here. We see the trucks. They eat. You run. I run to the road. The fire is hot. A fire!",
    "I sleep. You sleep. The cat sleeps. We bark. They bark. You can bark. Do you bark? The little cat is in the box.",
    "A little box. The cat. The box. The children are here. An apple is in the box. He will eat an apple.",
    "The fire truck is big. The old box of the dog. An old truck. The house is old. A house.",
]
#: Text, and the pairs that are in it.
BY_HAND = [
    ("The dog is here.", [("the", "dog", 0)]),
    ("I see a big dog.", [("a", "dog", 1)]),
    ("The dogs are here.", []),
    ("The big dogs are here.", []),
    ("Give an apple to the red truck", [("a", "apple", 0), ("the", "truck", 1)]),
    ("the children eat", []),
    ("The fire truck is red", [("the", "truck", 1)]),
    ("The dog's ball is red", []),  # its gap is two: dog and 's
    ("the little old box.", []),  # two words before the head
    ("The dog bark.", [("the", "dog", 0)]),  # seen behind pronouns, so no noun
    ("the the ball", [("the", "ball", 0)]),
    ("THE BALL.\nA\ncat", [("the", "ball", 0)]),  # a line ends behind the last determiner
    ("a", []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def model(spark):
    return np_.Model(spark.createDataFrame([(t,) for t in [*CORPUS, None, ""]], "text string"), Store(spark), "hand")


def test_sentences_by_hand(spark, model):
    rows = [(i, t) for i, (t, _) in enumerate(BY_HAND)]
    got = {}
    for r in model.pairs(spark.createDataFrame(rows, "id int, text string"), ["id"]).orderBy("id", "det_token").collect():
        got.setdefault(r.id, []).append((r.det, r.noun, r.gap))
    assert {i: got.get(i, []) for i, _ in rows} == {i: own for i, (_, own) in enumerate(BY_HAND)}


def test_fold_equals_every_path(spark, model):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS + ["the zorb's blicks run a wug dog box."])], "id int, text string")
    found = {tuple(r.words): r.tags for r in model.phrases(texts, ["id"]).collect()}
    known = model.words.select("word", "head", "modifier", "other")
    rows = spark.createDataFrame([(w,) for w in {w for k in found for w in k}], "word string").join(known, "word", "left")
    score = {r.word: r.e for r in rows.select("word", model.emissions(F.col("word")).alias("e")).collect()}
    for words, tags in found.items():
        best = None
        for path in itertools.product(np_.TAGS, repeat=len(words)):
            total = sum(model.moves[s][t] + score[w][np_.TAGS.index(t)] for s, t, w in zip(("D", *path), path, words))
            best = max(best or (total, ""), (total, "".join(path)))
        assert tags == best[1], words
    assert len(found) > 30


def test_repeated_rows_other_columns_and_nothing(spark, model):
    rows = [(1, "the dog is here", "x")] * 3 + [(None, "a ball.", None)]
    got = model.pairs(spark.createDataFrame(rows, "id int, text string, tags string"), ["id"]).collect()
    assert sorted((r.id or 0, r.noun) for r in got) == [(0, "ball")] + [(1, "dog")] * 3
    assert model.pairs(spark.createDataFrame([], "id int, text string"), ["id"]).count() == 0
    empty = np_.Model(spark.createDataFrame([], "text string"), Store(spark), "none")
    assert (empty.v, empty.total) == (0, {"M": 0, "H": 0, "O": 0})
    assert empty.pairs(spark.createDataFrame(rows, "id int, text string, tags string"), ["id"]).count() <= 4
    with pytest.raises(ValueError):
        model.pairs(spark.createDataFrame(rows, "id int, text string, tags string"), ["id"], max_gap=2)


def test_long_text(spark, model):
    text = "the big dog is here. " * 20_000
    assert model.pairs(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).groupBy("noun", "gap").count().collect() == [("dog", 1, 20_000)]
