"""The relations that operators build on each other, as common table expressions over `conversations` and `documents`.

A dyad is conv_id mod 12, a session a conversation, a line a turn; user, assistant and system speak as child, mother and
other adult, but the users of every seventh conversation are other adults too, as system turns answer nobody. An item is what makes two sites one: by default the noun's first letter, as invented nouns seldom recur.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..dialect import Dialect
from ..functions.formulas import with_predicted

ITEM = "left(noun, 1)"


def _with_models(d: Dialect) -> dict[str, str]:
    from . import model_relations

    return model_relations.parts(d)


#: A determiner that another word follows. Between two of them lies what the walk needs: lengths, and the next word.
DET = r"(?=[AaTt])(?<!\\p{L})(?i:an?|the)(?=\\P{L}+\\p{L})"


def _sites(d: Dialect, source: str, keys: str) -> str:
    """Determiners followed by another word, with offsets in the text as it is written. Spark cuts each text at its determiners, folds over these pieces and explodes nothing but sites."""
    if d.spark:
        piece, det = "get(z.p, i - 1)", "get(z.d, i - 1)"
        noun, token, start = "get(z.p, i).noun", f"acc.tok + {piece}.words + 1", f"acc.at + {piece}.chars"
        site = f"named_struct('i', {token}, 'start', {start}, 'form', lower({det}), 'noun', {noun})"
        step = f"(acc, i) -> named_struct('at', {start} + length({det}), 'tok', {token}, 'out', CASE WHEN {noun} NOT IN ('', 'a', 'an', 'the') THEN concat(acc.out, array({site})) ELSE acc.out END)"
        none = "CAST(array() AS array<struct<i:int,start:int,form:string,noun:string>>)"
        walk = f"aggregate(sequence(1, size(z.d)), named_struct('at', 0, 'tok', 0, 'out', {none}), {step}, acc -> acc.out)"
        cut = f"transform(split(text, '{DET}'), x -> named_struct('chars', length(x), 'words', size(regexp_extract_all(x, '\\\\p{{L}}+', 0)), 'noun', lower(regexp_extract(x, '^\\\\P{{L}}+(\\\\p{{L}}+)', 1))))"
        # z binds the pieces, which would else be cut anew at each step.
        once = f"get(transform(array(named_struct('p', {cut}, 'd', regexp_extract_all(text, '{DET}', 0))), z -> CASE WHEN size(z.d) > 0 THEN {walk} END), 0)"
        each = f"(SELECT {keys}, text, {once} AS found FROM {source}) AS b LATERAL VIEW OUTER explode(found) s AS site"  # without OUTER, Spark filters by found first and so walks each text again
        return f"""SELECT {keys}, text AS sentence, site.i AS pair_index, site.form AS form, CASE WHEN site.form = 'the' THEN 'the' ELSE 'a' END AS det, site.noun AS noun,
          site.start AS det_char_start, site.start + length(site.form) AS det_char_end FROM {each} WHERE site.i IS NOT NULL"""
    tk = f"(SELECT *, {d.tokens('text')} AS tk, {d.separators('text')} AS sp FROM {source})"
    base = f"(SELECT *, len(tk) AS n_tokens FROM {tk} AS a)"
    each = d.each("i", "1", "n_tokens - 1", f"{base} AS b")
    start = f"{d.chars(d.first('tk', 'i - 1'))} + {d.chars(d.first('sp', 'i'))}"
    det, noun = f"lower({d.at('tk', 'i')})", f"lower({d.at('tk', 'i + 1')})"
    return f"""SELECT {keys}, text AS sentence, CAST(i AS INT) AS pair_index, {det} AS form, CASE WHEN {det} = 'the' THEN 'the' ELSE 'a' END AS det, {noun} AS noun,
      CAST({start} AS INT) AS det_char_start, CAST({start} + length({det}) AS INT) AS det_char_end
      FROM {each} WHERE {det} IN ('a', 'an', 'the') AND {noun} NOT IN ('a', 'an', 'the')"""


def parts(d: Dialect, item: str = ITEM, window: int = 3, budget: int = 400) -> dict[str, str]:
    speaker = "CASE WHEN role = 'user' AND conv_id % 7 <> 3 THEN 'child' WHEN role = 'assistant' THEN 'mother' WHEN role IN ('user', 'system') THEN 'other_adult' END"
    # Spark carries a line's place with its sites, so that no site is joined with its line again; DuckDB joins them.
    place = ", pos, tokens, upto, context_start" if d.spark else ""
    before = ", lag(pos) OVER w AS previous_pos, lag(upto - tokens) OVER w AS previous_before" if d.spark else ""
    return {
        # Utterance stream, with each line's place and the running estimate of tokens (a quarter of the characters, 1 at least).
        "utterances": f"SELECT conv_id % 12 AS dyad, conv_id AS session, turn AS line_num, {speaker} AS speaker, text, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens FROM conversations",
        "lines": f"""SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_num) AS pos, sum(tokens) OVER (PARTITION BY session ORDER BY line_num) AS upto,
          coalesce(first_value(line_num) OVER (PARTITION BY session ORDER BY line_num ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING), -1) AS context_start FROM utterances""",
        "sites0": _sites(d, "lines" if d.spark else "utterances", f"dyad, session, line_num, speaker{place}"),
        "sites": f"SELECT *, {item} AS item FROM sites0",
        "docsites": _sites(d, "documents", "doc_id, lang, source"),
        # The last mention of an item in its session; a case is one by the required other speaker.
        "mentions": f"""SELECT *, lag(det) OVER w AS previous_det, lag(speaker) OVER w AS previous_speaker, lag(line_num) OVER w AS previous_line, lag(sentence) OVER w AS previous_sentence{before}
          FROM sites WHERE speaker IN ('child', 'mother', 'other_adult') WINDOW w AS (PARTITION BY session, item ORDER BY line_num, pair_index)""",
        "transitions": "SELECT * FROM mentions WHERE previous_speaker = CASE WHEN speaker = 'mother' THEN 'child' ELSE 'mother' END",
        "distances": "SELECT *, pos - previous_pos AS true_dist, upto - tokens - previous_before AS tokens_back, tokens AS own_tokens FROM transitions" if d.spark else
        """SELECT t.*, u.pos - p.pos AS true_dist, u.upto - u.tokens - p.upto + p.tokens AS tokens_back, u.tokens AS own_tokens FROM transitions t
          JOIN lines u ON t.session = u.session AND t.line_num = u.line_num JOIN lines p ON t.session = p.session AND t.previous_line = p.line_num""",
        # Items that child and mother have both used with both determiners, from the first session where they had.
        "attested": """SELECT dyad, item, min(session) AS first_session FROM (SELECT dyad, session, item FROM sites WHERE speaker IN ('child', 'mother') GROUP BY dyad, session, item
          HAVING count(DISTINCT CASE WHEN speaker = 'child' THEN det END) = 2 AND count(DISTINCT CASE WHEN speaker = 'mother' THEN det END) = 2) x GROUP BY dyad, item""",
        "restricted": "SELECT t.* FROM transitions t WHERE EXISTS (SELECT 1 FROM attested a WHERE a.dyad = t.dyad AND a.item = t.item AND t.session >= a.first_session)",
        "rates": """SELECT dyad, speaker, count(*) AS n_total, count(CASE WHEN det <> previous_det THEN 1 END) AS n_switch,
          count(CASE WHEN previous_det = 'a' THEN 1 END) AS n_previous_a, count(CASE WHEN previous_det = 'the' THEN 1 END) AS n_previous_the,
          count(CASE WHEN previous_det = 'a' AND det = 'the' THEN 1 END) AS n_to_the, count(CASE WHEN previous_det = 'the' AND det = 'a' THEN 1 END) AS n_to_a FROM transitions GROUP BY dyad, speaker""",
        "dyads": "SELECT *, n_switch / n_total AS tpr FROM (SELECT dyad, speaker, CAST(n_total AS DOUBLE) AS n_total, CAST(n_switch AS DOUBLE) AS n_switch FROM rates) x",
        # The native scorer: log P(form | next letter) from documents, add-one smoothed.
        "formcounts": "SELECT left(noun, 1) AS letter, count(CASE WHEN form = 'a' THEN 1 END) AS n_a, count(CASE WHEN form = 'an' THEN 1 END) AS n_an, count(CASE WHEN form = 'the' THEN 1 END) AS n_the FROM docsites GROUP BY left(noun, 1)",
        "logscores": """SELECT s.dyad, s.session, s.line_num, s.pair_index, s.speaker, s.noun, s.det, s.item,
          ln((coalesce(n_a, 0) + 1) / (coalesce(n_a + n_an + n_the, 0) + 3.0)) AS s_a, ln((coalesce(n_an, 0) + 1) / (coalesce(n_a + n_an + n_the, 0) + 3.0)) AS s_an, ln((coalesce(n_the, 0) + 1) / (coalesce(n_a + n_an + n_the, 0) + 3.0)) AS s_the
          FROM sites s LEFT JOIN formcounts f ON left(s.noun, 1) = f.letter""",
        # Log-sum-exp of the forms of a category, softmax over the categories.
        "distribution": """SELECT *, (exp(s_a - m) + exp(s_an - m)) / (exp(s_a - m) + exp(s_an - m) + exp(s_the - m)) AS p_a, exp(s_the - m) / (exp(s_a - m) + exp(s_an - m) + exp(s_the - m)) AS p_the
          FROM (SELECT *, greatest(s_a, s_an, s_the) AS m FROM logscores) x""",
        # Greatest distances: 1 to 200, and one beyond all.
        "grid": "SELECT explode(sequence(CAST(1 AS BIGINT), CAST(200 AS BIGINT))) AS k_max UNION ALL SELECT 1000000000 AS k_max" if d.spark else "SELECT CAST(unnest(range(1, 201)) AS BIGINT) AS k_max UNION ALL SELECT 1000000000 AS k_max",
        "nouns": "SELECT lang, noun, count(CASE WHEN det = 'a' THEN 1 END) AS a, count(CASE WHEN det = 'the' THEN 1 END) AS the FROM docsites GROUP BY lang, noun",
        **_with_models(d),
        "humans": with_predicted(d, """SELECT dyad, speaker, count(*) AS n, CAST(sum(a + t) AS BIGINT) AS s, sum(greatest(a, t)) / CAST(sum(a + t) AS DOUBLE) AS bias, avg(CASE WHEN a > 0 AND t > 0 THEN 1e0 ELSE 0e0 END) AS empirical
          FROM (SELECT dyad, speaker, noun, count(CASE WHEN det = 'a' THEN 1 END) AS a, count(CASE WHEN det = 'the' THEN 1 END) AS t FROM sites WHERE speaker IN ('child', 'mother') GROUP BY dyad, speaker, noun) n0 GROUP BY dyad, speaker""", ("dyad", "speaker", "n", "s", "bias", "empirical"), {"predicted": "bias"}),
        "counted": "SELECT lang, count(*) AS n, sum(a + the) AS s, sum(greatest(a, the)) / CAST(sum(a + the) AS DOUBLE) AS bias FROM nouns GROUP BY lang",
    }


def rendered(k: int, label: str, here: bool = False) -> str:
    """SQL of (session, line_num, pos, context): the k lines before each line, and with `here` the line itself, each behind its label; one window of Spark, no join."""
    frame = f"ROWS BETWEEN {k} PRECEDING AND {'CURRENT ROW' if here else '1 PRECEDING'}"
    return f"SELECT session, line_num, pos, array_join(collect_list({label} || text) OVER (PARTITION BY session ORDER BY line_num {frame}), '\\n') AS context FROM lines"


def budgeted(rooms: Iterable[int], shown: str | None = None) -> str:
    """SQL of the lines with, for each room c: n_c earlier lines that fit into c tokens beside the line's own, start_c, the first of them, used_c, their tokens, and, with `shown`, context_c, which joins that text of theirs.

    A line v lies in the frame of t if what t and the lines behind v have fits, so the lines that fit begin behind the frame's first one; only
    where everything up to t fits do they begin with the session. One frame over the running sum for each room, on one sort of a session.
    """
    columns, frames, out = [], [], []
    for c in dict.fromkeys(rooms):
        frames.append(f"f{c} AS (PARTITION BY session ORDER BY upto RANGE BETWEEN {c} PRECEDING AND CURRENT ROW)")
        columns += [f"count(*) OVER f{c} AS seen_{c}", f"first_value(next_line) OVER f{c} AS next_{c}", f"first_value(upto) OVER f{c} AS upto_{c}"] + ([f"collect_list({shown}) OVER f{c} AS shown_{c}"] if shown else [])
        n = f"CASE WHEN tokens > {c} OR pos = 1 THEN 0 WHEN upto <= {c} THEN pos - 1 ELSE seen_{c} - 2 END"
        out += [f"CAST({n} AS BIGINT) AS n_{c}", f"CASE WHEN {n} > 0 THEN CASE WHEN upto <= {c} THEN first_line ELSE next_{c} END END AS start_{c}", f"CASE WHEN {n} > 0 THEN upto - tokens - CASE WHEN upto <= {c} THEN 0 ELSE upto_{c} END ELSE 0 END AS used_{c}"]
        out += [f"CASE WHEN {n} > 0 THEN array_join(slice(shown_{c}, -1 - CAST({n} AS INT), CAST({n} AS INT)), '') ELSE '' END AS context_{c}"] if shown else []
    first = "SELECT *, lead(line_num) OVER s AS next_line, first_value(line_num) OVER s AS first_line FROM lines WINDOW s AS (PARTITION BY session ORDER BY line_num)"
    return f"SELECT session, line_num, speaker, pos, tokens, upto, {', '.join(out)} FROM (SELECT *, {', '.join(columns)} FROM ({first}) b0 WINDOW {', '.join(frames)}) b1"


def as_of(keys: str, curve: str, values: Iterable[str], grid: str, name: str = "k_max") -> str:
    """SQL of keys, name and values: for each point of grid the values of the last row of curve (keys, dist, values) at or before it, if there is one.

    Points and rows are sorted together, once for each key, so the work is linear in both.
    """
    v = list(values)
    points = f"SELECT {keys}, CAST({name} AS BIGINT) AS dist, 1 AS point, {', '.join(f'CAST(NULL AS DOUBLE) AS {x}' for x in v)} FROM (SELECT DISTINCT {keys} FROM ({curve}) c0) k0 CROSS JOIN ({grid}) g0"
    rows = f"SELECT {keys}, CAST(dist AS BIGINT) AS dist, 0 AS point, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in v)} FROM ({curve}) c1"
    last = ", ".join(f"last_value({x}, true) OVER w AS {x}" for x in v)
    return f"SELECT {keys}, dist AS {name}, {', '.join(v)} FROM (SELECT {keys}, dist, point, {last} FROM ({rows} UNION ALL {points}) u0 WINDOW w AS (PARTITION BY {keys} ORDER BY dist, point ROWS UNBOUNDED PRECEDING)) u1 WHERE point = 1 AND {v[0]} IS NOT NULL"


def named(text: str) -> list[str]:
    """The relations and tables that a text reads, as often as it does."""
    return re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*(\w+)", text)


def needed(final: str, known: dict[str, str]) -> list[str]:
    """The relations behind final, each after those that it reads."""
    found, todo = set(), [final]
    while todo:
        for name in named(todo.pop()):
            if name in known and name not in found:
                found.add(name)
                todo.append(known[name])
    return [n for n in known if n in found]


def shared(final: str, known: dict[str, str]) -> list[str]:
    """Those that are read more than once and that aren't mere projections or constants."""
    names = needed(final, known)
    reads = [x for text in (final, *(known[n] for n in names)) for x in named(text)]
    return [n for n in names if reads.count(n) > 1 and n not in ("models", "utterances", "grid")]


def sql(d: Dialect, final: str, stored: Iterable[str] = (), **options) -> str:
    """final with the relations that it needs in front; stored ones are read from tables `stored_<name>`."""
    known = {n: f"SELECT * FROM stored_{n}" if n in set(stored) else text for n, text in parts(d, **options).items()}
    order = needed(final, known)
    return ("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" if order else "") + final
