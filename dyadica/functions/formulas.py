"""Closed formulas as SQL expressions of either dialect."""

from __future__ import annotations

from collections.abc import Sequence

from ..dialect import Dialect


#: Nouns whose shares one row sums up.
BLOCK = 4096
#: Fixed value: the Euler-Mascheroni constant.
GAMMA = 0.5772156649015329


def _share(r: str, s: str, b: str, h: str) -> str:
    """The chance that the noun of rank r is seen with both determiners."""
    p = f"(1 / ({r} * {h}))"
    return f"1 - pow({p} * {b} + 1 - {p}, {s}) - pow({p} * (1 - {b}) + 1 - {p}, {s}) + pow(1 - {p}, {s})"


def _defined(n: str, s: str, b: str, h: str) -> str:
    """Where the rarest noun's share, which is the least, is above 0."""
    return f"{n} > 0 AND {s} > 1 AND {b} > 0 AND {b} < 1 AND {_share(n, s, b, h)} > 0"


def predicted_overlap(d: Dialect, n: str, s: str, b: str, h: str) -> str:
    """Expected share of n nouns (Zipfian, s tokens, bias b) seen with both determiners; h is the n-th harmonic number. Null where it isn't defined, as where a noun's share isn't above 0 (one token). Its sum is one array of n numbers; `with_predicted` deals it out."""
    return f"CASE WHEN {_defined(n, s, b, h)} THEN {d.total('1', n, 'r', _share('r', s, b, h))} / {n} END"


def harmonic(d: Dialect, n: str) -> str:
    return d.total("1", n, "r", "1e0 / r")


def harmonic_series(d: Dialect, n: str, least: int = 64) -> str:
    """The n-th harmonic number without a sum of n terms: beyond `least` by Euler and Maclaurin's series, whose error is below 1 / (240 n ** 8), so less than 2e-17 from 64 on."""
    x = f"CAST({n} AS DOUBLE)"
    series = f"ln({x}) + {GAMMA} + 1 / (2 * {x}) - 1 / (12 * pow({x}, 2)) + 1 / (120 * pow({x}, 4)) - 1 / (252 * pow({x}, 6))"
    return f"CASE WHEN {n} > {least} THEN {series} WHEN {n} > 0 THEN {harmonic(d, f'least({n}, {least})')} END"


def with_predicted(d: Dialect, source: str, columns: Sequence[str], biases: dict[str, str], tasks: int = 32) -> str:
    """SQL of the rows of source, which are unique and have n nouns and s tokens, with the predicted overlap at each bias, by name.

    Spark deals the nouns out in blocks of BLOCK ranks over tasks and adds up the blocks' sums, so a group may have any number
    of nouns: neither a row nor a task holds more than a block at once. Sums are exact but for rounding.
    """
    if not d.spark:
        return f"SELECT {', '.join(columns)}, {', '.join(predicted_overlap(d, 'n', 's', b, 'h') + ' AS ' + name for name, b in biases.items())} FROM (SELECT *, {harmonic(d, 'n')} AS h FROM ({source}) w0) w1"
    own = ", ".join(columns)
    block = f"sequence(block * {BLOCK} + 1, least((block + 1) * {BLOCK}, n))"
    sums = ", ".join(f"sum(aggregate({block}, 0D, (acc, r) -> acc + {_share('r', 's', b, 'h')})) AS sum_{name}" for name, b in biases.items())
    dealt = f"SELECT /*+ REPARTITION({tasks}, block) */ * FROM (SELECT * FROM (SELECT *, {harmonic_series(d, 'n')} AS h FROM ({source}) w0) w1 LATERAL VIEW OUTER explode(CASE WHEN n > 0 THEN sequence(0, CAST((n - 1) DIV {BLOCK} AS BIGINT)) END) w2 AS block) w3"
    final = ", ".join(f"CASE WHEN {_defined('n', 's', b, 'h')} THEN sum_{name} / n END AS {name}" for name, b in biases.items())
    return f"SELECT {own}, {final} FROM (SELECT {own}, h, {sums} FROM ({dealt}) w4 GROUP BY {own}, h) w5"


def p_value(d: Dialect, t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite trigonometric series."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    cos2 = f"(1 / (1 + {t} * {t} / {df}))"
    odd, even = d.fold(df, 3, "k", f"1 + acc * {cos2} * (k - 1) / k"), d.fold(df, 2, "k", f"1 + acc * {cos2} * (k - 1) / k")
    return f"""CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL WHEN {df} = 1 THEN 1 - 2 / pi() * {theta} WHEN {df} % 2 = 1
      THEN 1 - 2 / pi() * ({theta} + sin({theta}) * cos({theta}) * ({odd})) ELSE 1 - sin({theta}) * ({even}) END"""


def p_value_any(d: Dialect, t: str, df: str, steps: int = 4000) -> str:
    """Two-sided p of Student's t for any degrees of freedom from 1 on, by the midpoint rule over the angle; as good as 1e-6 below 2 of them, 1e-8 from 3 on."""
    def area(top: str) -> str:
        return f"{top} / {steps} * {d.total('1', str(steps), 'i', f'pow(cos({top} * (i - 0.5) / {steps}), {df} - 1)')}"

    return f"CASE WHEN {t} IS NOT NULL AND {df} >= 1 THEN 1 - {area(f'atan(abs({t}) / sqrt({df}))')} / ({area('(pi() / 2)')}) END"
