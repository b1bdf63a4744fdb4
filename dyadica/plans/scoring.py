"""Scorers of closed sets of candidates, by type of model, and extractors of determiner-noun pairs.

A scorer takes (state, prompt, forms) and gives a log score for each form. `register` adds one for a type, with a loader
that makes its state once for each Python worker. The scorers that are here need no weights: the log-likelihood of a form
comes from a hash of model, prompt and form, which is the same in every run. Scorers of real models plug in the same way.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cac import determiner_argmax, distribution, draw

Scorer = Callable[[object, str, list[str]], dict[str, float]]
DETERMINERS = {"a": ["a", "an"], "the": ["the"]}
BLANKS = {"mlm": "[MASK]", "ar": "___", "seq2seq": "___"}
EMPTY = -1000.0
_scorers: dict[str, tuple[Callable, Scorer]] = {}


def register(model_type: str, load: Callable[[dict], object], scorer: Scorer) -> None:
    _scorers[model_type] = (load, scorer)


def scorer_of(model_type: str) -> tuple[Callable, Scorer]:
    if model_type not in _scorers:
        raise ValueError(f"no scorer for model type {model_type}")
    return _scorers[model_type]


def forms_of(candidates: dict[str, list[str]]) -> list[str]:
    """All forms, each once, in order."""
    return list(dict.fromkeys(f for forms in candidates.values() for f in forms))


def context_limit(*limits: int | None, default: int = 512) -> int:
    """The least of the limits from 1 to 100,000; the default if there is none."""
    return min((x for x in limits if x is not None and 1 <= x <= 100_000), default=default)


def _level(config: dict, text: str) -> float:
    return -1 - zlib.crc32(f"{config.get('name')}@{config.get('revision') or 'main'}|{text}".encode()) / 2**32 * 4


def _masked(config, prompt: str, forms: list[str]) -> dict[str, float]:
    """One score for each form at the mask; none without a mask."""
    return {f: _level(config, prompt.replace(BLANKS["mlm"], f, 1)) for f in forms} if BLANKS["mlm"] in prompt else {}


def _sentence(config, prompt: str, forms: list[str]) -> dict[str, float]:
    """The sum over the words of the whole sentence with the form in the blank."""
    if BLANKS["ar"] not in prompt:
        return {}
    whole = {f: prompt.replace(BLANKS["ar"], f, 1).split() for f in forms}
    return {f: sum(_level(config, " ".join(w[max(0, i - 2) : i + 1])) for i in range(len(w))) if w else EMPTY for f, w in whole.items()}


def _span(config, prompt: str, forms: list[str]) -> dict[str, float]:
    """The target between two sentinels, for the prompt with the first one in the blank."""
    if BLANKS["seq2seq"] not in prompt:
        return {}
    source = prompt.replace(BLANKS["seq2seq"], "<extra_id_0>", 1)
    return {f: _level(config, f"{source}|<extra_id_0> {f} <extra_id_1>") for f in forms}


for _type, _f in (("mlm", _masked), ("ar", _sentence), ("seq2seq", _span)):
    register(_type, dict, _f)


def score(prompts: DataFrame, config: dict, candidates: dict[str, list[str]] = DETERMINERS, prompt: str = "prompt") -> DataFrame:
    """prompts with `probs`, a map from category to probability: log scores merged within categories and normalised, uniform if no form has a score. config: name, type and what the loader takes."""
    load, scorer = scorer_of(config["type"])
    forms = forms_of(candidates)

    @F.pandas_udf("map<string,double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        state = load(config)
        for batch in batches:
            yield pd.Series([{k: float(v) for k, v in scorer(state, p, forms).items() if math.isfinite(v)} if p is not None else {} for p in batch], dtype=object)

    return prompts.withColumn("probs", distribution(scores(F.col(prompt)), candidates))


def score_each(prompts: DataFrame, configs: dict[int, dict], key: Sequence[str], candidates: dict[str, list[str]] = DETERMINERS) -> DataFrame:
    """prompts (`work`, `prompt`, ...) with `probs`, as `score` makes them, by the model that `work` names in configs.

    Rows are dealt out by range of work and key, so that a task has few models, one after another, and a model's rows go to as many
    tasks as they need; a task's state changes when the model does. Models with the same configuration share a state.
    """
    loaders = {i: scorer_of(c["type"]) for i, c in configs.items()}
    forms = forms_of(candidates)
    shape = prompts.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = own = None
        for rows in batches:
            found = []
            for work, prompt in zip(rows["work"], rows["prompt"], strict=True):
                load, scorer = loaders[work]
                if own != configs[work]:
                    state, own = load(configs[work]), configs[work]
                found.append({k: float(v) for k, v in scorer(state, prompt, forms).items() if math.isfinite(v)} if prompt is not None else {})
            yield rows.assign(scores=found)

    ranged = prompts.repartitionByRange("work", *key).sortWithinPartitions("work")
    scored = ranged.mapInPandas(run, shape + ",scores:map<string,double>")
    return scored.withColumn("probs", distribution(F.col("scores"), candidates)).drop("scores")


def with_determiners(scored: DataFrame, *key: str, seed: int = 0) -> DataFrame:
    """Both readouts of the determiner's distribution."""
    p = F.col("probs")
    return scored.withColumns({"P_a": F.element_at(p, "a"), "P_the": F.element_at(p, "the"), "predicted_det_argmax": determiner_argmax(p), "predicted_det_sample": draw(p, ["a", "the"], *[F.col(k) for k in key], seed=seed)})


class PairExtractor(Protocol):
    def extract(self, text: str) -> list[str]:
        """The pairs `det noun` of a text."""


class NativePairs:
    """Determiners followed by another word, at most max_gap words on; an becomes a. The native site relation has a gap of 0."""

    def __init__(self, max_gap: int = 0):
        self.max_gap = max_gap

    def extract(self, text: str) -> list[str]:
        words = re.findall(r"[^\W\d_]+", text or "")
        out = []
        for i, w in enumerate(words):
            if w.lower() in ("a", "an", "the") and i + 1 + self.max_gap < len(words):
                noun = words[i + 1 + self.max_gap]
                if not {x.lower() for x in words[i + 1 : i + 2 + self.max_gap]} & {"a", "an", "the"}:
                    out.append(f"{'the' if w.lower() == 'the' else 'a'} {noun}")
        return out

    def extract_from_lines(self, lines: list[str]) -> list[str]:
        return [p for line in lines for p in self.extract(line)]


class SpacyPairs(NativePairs):
    """Noun chunks whose first word is a determiner and whose root is a singular noun; needs spaCy."""

    def __init__(self, model: str = "en_core_web_sm", max_gap: int = 1):
        import spacy

        super().__init__(max_gap)
        self.nlp = spacy.load(model, disable=["ner"])

    def extract(self, text: str) -> list[str]:
        out = []
        for chunk in self.nlp(text or "").noun_chunks:
            det, root = chunk[0], chunk.root
            if det.pos_ == "DET" and det.lower_ in ("a", "an", "the") and root.tag_ == "NN" and 0 <= root.i - det.i - 1 <= self.max_gap:
                out.append(f"{'the' if det.lower_ == 'the' else 'a'} {root.lemma_}")
        return out


def extract_pairs(texts: DataFrame, make: Callable[[], PairExtractor] = NativePairs, text: str = "text") -> DataFrame:
    """texts with a row for each pair: det and noun. make: called once in each Python worker."""

    @F.pandas_udf("array<string>")
    def pairs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for batch in batches:
            yield pd.Series([own.extract(t) for t in batch], dtype=object)

    each = texts.withColumn("pair", F.explode(pairs(F.col(text))))
    return each.withColumns({"det": F.split("pair", " ")[0], "noun": F.split("pair", " ")[1]}).drop("pair")
