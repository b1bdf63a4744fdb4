"""SQL that Spark and DuckDB both run: texts are the same but for the few functions below."""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def tokens(self, text: str) -> str:
        return rf"regexp_extract_all({text}, '\\p{{L}}+', 0)" if self.spark else rf"regexp_extract_all({text}, '\p{{L}}+')"

    def separators(self, text: str) -> str:
        return rf"split({text}, '\\p{{L}}+')" if self.spark else rf"string_split_regex({text}, '\p{{L}}+')"

    def at(self, array: str, i: str) -> str:
        """The i-th element, from 1; null outside."""
        return f"get({array}, {i} - 1)" if self.spark else f"{array}[{i}]"

    def first(self, array: str, n: str) -> str:
        return f"slice({array}, 1, greatest({n}, 0))" if self.spark else f"{array}[1:greatest({n}, 0)]"

    def chars(self, array: str) -> str:
        return f"aggregate({array}, 0, (acc, x) -> acc + length(x))" if self.spark else f"coalesce(list_sum(list_transform({array}, lambda x: length(x))), 0)"

    def each(self, alias: str, low: str, high: str, source: str) -> str:
        """source with a row for each integer from low to high, as alias; none if high < low."""
        if self.spark:
            return f"{source} LATERAL VIEW explode(CASE WHEN {high} >= {low} THEN sequence({low}, {high}) END) {alias}_t AS {alias}"
        return f"{source}, LATERAL (SELECT unnest(range({low}, {high} + 1)) AS {alias}) {alias}_t"

    def total(self, low: str, high: str, x: str, value: str) -> str:
        """The sum of value over integers x from low to high."""
        if self.spark:
            return f"aggregate(transform(sequence({low}, CAST({high} AS INT)), {x} -> CAST({value} AS DOUBLE)), 0D, (acc, y) -> acc + y)"
        return f"list_sum(list_transform(range({low}, CAST({high} AS INT) + 1), lambda {x}: CAST({value} AS DOUBLE)))"

    def fold(self, n: str, least: int, x: str, value: str) -> str:
        """1, then acc -> value for x = n - 2, n - 4, ... down to least."""
        if self.spark:
            return f"CASE WHEN {n} - 2 < {least} THEN 1D ELSE aggregate(sequence(CAST({n} AS INT) - 2, {least}, -2), 1D, (acc, {x}) -> CAST({value} AS DOUBLE)) END"
        return f"CASE WHEN {n} - 2 < {least} THEN 1.0::DOUBLE ELSE list_reduce(list_transform(range(CAST({n} AS INT) - 2, {least} - 1, -2), lambda v: v::DOUBLE), lambda acc, {x}: {value}, 1.0::DOUBLE) END"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})" if self.spark else f"quantile_cont(CAST({x} AS DOUBLE), {p})"

    def holds_word(self, text: str, word: str) -> str:
        """Whether word, which is letters alone, occurs in text in any case between ASCII word boundaries, as RE2 has them.

        Java's boundaries are Unicode's up to version 18, and it folds dotted and dotless i onto i; both i are replaced by signs that have no case.
        """
        if self.spark:
            edge = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
            plain = lambda x: f"translate({x}, '\u0130\u0131', '\ue000\ue001')"
            return f"rlike({plain(text)}, concat('{edge}(?iu:\\\\Q', {plain(word)}, '\\\\E){edge}'))"
        return f"regexp_matches({text}, '(?i)\\b' || {word} || '\\b')"

    def listed(self, value: str, order: str) -> str:
        return f"array_join(transform(sort_array(collect_list(struct({order}, {value}))), x -> x.{value}), '\\n')" if self.spark else f"string_agg({value}, chr(10) ORDER BY {order})"


SPARK, DUCKDB = Dialect(True), Dialect(False)
