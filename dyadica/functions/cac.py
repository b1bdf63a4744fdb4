"""Closed-set candidate scores: merge, normalise and read out, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distribution(scores: Column, candidates: dict[str, list[str]]) -> Column:
    """Category to probability. scores: map from form to log score; a missing form counts as -infinity; all missing gives the uniform distribution."""
    least = float("-inf")
    of = lambda form: F.coalesce(F.try_element_at(scores, F.lit(form)), F.lit(least))
    forms = [f for forms in candidates.values() for f in forms]
    top = F.greatest(*[of(f) for f in forms], F.lit(least))
    part = {k: sum((F.when(of(f) > least, F.exp(of(f) - top)).otherwise(0.0) for f in v), F.lit(0.0)) for k, v in candidates.items()}
    total = sum(part.values(), F.lit(0.0))
    return F.create_map(*[x for k, v in part.items() for x in (F.lit(k), F.when(total > 0, v / total).otherwise(1.0 / len(candidates)))])


def argmax(probs: Column, categories: list[str]) -> Column:
    """The first category of the largest probability."""
    best = F.array_max(F.map_values(probs))
    out = F.lit(None).cast("string")
    for c in reversed(categories):
        out = F.when(F.element_at(probs, c) == best, c).otherwise(out)
    return out


def determiner_argmax(probs: Column) -> Column:
    """As argmax, but a tie is `the`."""
    return F.when(F.element_at(probs, "the") >= F.element_at(probs, "a"), "the").otherwise("a")


def draw(probs: Column, categories: list[str], *key: Column, seed: int = 0) -> Column:
    """A category drawn by a hash of key and seed, so the same in every run."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    out, below = F.lit(categories[-1]), F.lit(0.0)
    steps = []
    for c in categories:
        below = below + F.element_at(probs, c)
        steps.append((c, below))
    for c, limit in reversed(steps):
        out = F.when(u < limit, c).otherwise(out)
    return out


def mass_on(probs: Column, subset: list[str]) -> Column:
    return F.aggregate(F.map_values(F.map_filter(probs, lambda k, v: k.isin(*subset))), F.lit(0.0), lambda a, x: a + x)


def surprisal(probs: Column, category: str, base: float | None = None) -> Column:
    """-ln p, or to another base; infinite for p of 0."""
    p = F.element_at(probs, category)
    nats = F.when(p > 0, -F.ln(p)).otherwise(float("inf"))
    return nats / F.ln(F.lit(base)) if base else nats
