"""Extra, not in the reference: last mentions over a stream of sites, for one speaker's switch rate as sites arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "session long, item string, line_num long, pair_index int, speaker string, det string, previous_det string, previous_speaker string"


def transitions(sites: DataFrame) -> DataFrame:
    """Sites (session, item, line_num, pair_index, speaker, det) with the last mention of the item; rows of a batch are taken in order of (line_num, pair_index)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["line_num", "pair_index"])
        out = []
        for r in rows.itertuples():
            out.append((key[0], key[1], r.line_num, r.pair_index, r.speaker, r.det, *last))
            last = (r.det, r.speaker)
        state.update(last)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return sites.groupBy("session", "item").applyInPandasWithState(update, OUT, "det string, speaker string", "append", "NoTimeout")
