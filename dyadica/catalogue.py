"""The queries over the driver's tables, and their SQL. A query is one text for both engines, on the relations in operators.relations."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from . import reports
from .dialect import DUCKDB, SPARK, Dialect
from .functions.formulas import p_value, with_predicted
from .functions.labels import family, stars
from .operators import noun_phrases, pair_overlap
from .operators.relations import as_of, budgeted, named, needed, parts, rendered, shared, sql
from .plans.store import Store, signature

TABLES = ("conversations", "documents", "labels")


def rate(x: str, y: str) -> str:
    return f"round({x} / CAST(nullif({y}, 0) AS DOUBLE), 9)"


def _ttest(d: Dialect, source: str, keys: str) -> str:
    """t, df and p of `x` against 0 in groups of source."""
    k = f"{keys}, " if keys else ""
    stats = f"SELECT {k}count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM ({source}) q {'GROUP BY ' + keys if keys else ''}"
    t = f"SELECT *, n - 1 AS df, CASE WHEN n > 1 THEN mean / nullif(sd / sqrt(n), 0) END AS t FROM ({stats}) s"
    return f"SELECT {k}n, round(mean, 9) AS mean_difference, round(t, 7) AS t, CAST(df AS INT) AS df, round({p_value(d, 't', 'df')}, 8) AS p FROM ({t}) t0"


RATES = f"""n_total, n_switch, n_total - n_switch AS n_maintained, {rate('n_to_the', 'n_previous_a')} AS tpr_the, {rate('n_to_a', 'n_previous_the')} AS tpr_a, {rate('n_switch', 'n_total')} AS tpr_overall, {rate('n_total - n_switch', 'n_total')} AS maintenance_rate"""
SUMS = RATES.replace("AS n_switch", "")


def counted(keys: str, source: str) -> str:
    return f"""SELECT {keys}, {RATES} FROM (SELECT {keys}, count(*) AS n_total, count(CASE WHEN det <> previous_det THEN 1 END) AS n_switch, count(CASE WHEN previous_det = 'a' THEN 1 END) AS n_previous_a,
      count(CASE WHEN previous_det = 'the' THEN 1 END) AS n_previous_the, count(CASE WHEN previous_det = 'a' AND det = 'the' THEN 1 END) AS n_to_the, count(CASE WHEN previous_det = 'the' AND det = 'a' THEN 1 END) AS n_to_a
      FROM {source} GROUP BY {keys}) x"""


FAMILY = family("base_name", "model_type")


def texts(d: Dialect) -> dict[str, str]:
    q = {}
    # Sites, strings
    q["sites"] = "SELECT dyad, session, line_num, speaker, pair_index, form, det, noun, det_char_start, det_char_end FROM sites"
    q["pair_counts"] = "SELECT lang, det, noun, count(*) AS n FROM docsites GROUP BY lang, det, noun"
    q["mask_sentence"] = "SELECT session, line_num, pair_index, " + ("overlay(sentence PLACING '[MASK]' FROM det_char_start + 1 FOR det_char_end - det_char_start)" if d.spark else "substr(sentence, 1, det_char_start) || '[MASK]' || substr(sentence, det_char_end + 1)") + " AS masked FROM sites"
    q["speaker_labels"] = "SELECT session, line_num, CASE WHEN speaker = 'child' THEN 'Child' ELSE 'Mother' END AS spoken, CASE WHEN speaker = 'child' THEN '*CHI' WHEN speaker = 'mother' THEN '*MOT' ELSE '*OTH' END AS childes FROM lines"
    q["normalised_text"] = f"SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', ''{'' if d.spark else ', ' + chr(39) + 'g' + chr(39)})) AS normal FROM documents"
    q["determiner_normal"] = "SELECT form, CASE WHEN lower(trim(form)) IN ('a', 'an') THEN 'a' ELSE lower(trim(form)) END AS det, count(*) AS n FROM sites GROUP BY form"
    # Overlap by counts
    q["overlap_counts"] = "SELECT c.lang, c.n AS n_types, c.s AS n_tokens, round(c.bias, 9) AS bias, round(c.s / CAST(c.n AS DOUBLE), 9) AS r, round(e.empirical, 9) AS empirical, round(e.simple, 9) AS simple_expected FROM counted c JOIN (SELECT n.lang, avg(CASE WHEN n.a > 0 AND n.the > 0 THEN 1 ELSE 0 END) AS empirical, avg(1 - pow(k.bias, n.a + n.the) - pow(1 - k.bias, n.a + n.the)) AS simple FROM nouns n JOIN counted k ON n.lang = k.lang GROUP BY n.lang) e ON c.lang = e.lang"
    q["yang_predicted"] = f"SELECT lang, n, s, round(predicted, 9) AS predicted, round(predicted_at_082, 9) AS predicted_at_082 FROM ({with_predicted(d, 'SELECT * FROM counted', ('lang', 'n', 's', 'bias'), {'predicted': 'bias', 'predicted_at_082': '0.82'})}) x"
    q["zipf_slope"] = f"SELECT lang, count(*) AS n, round(regr_slope(ln(f), ln(rk)), 8) AS slope FROM ({reports.ranked(d)}) x GROUP BY lang"
    # Sequence
    q["transitions"] = "SELECT dyad, session, line_num, pair_index, speaker, item, noun, det, previous_det, previous_speaker, previous_line, concat(previous_det, '->', det) AS transition FROM transitions"
    q["first_mentions"] = "SELECT session, item, speaker, line_num, pair_index FROM mentions WHERE previous_det IS NULL"
    q["true_dist"] = "SELECT session, line_num, pair_index, item, true_dist FROM distances"
    q["context_start"] = "SELECT s.session, s.line_num, s.pair_index, u.context_start FROM sites s JOIN lines u ON s.session = u.session AND s.line_num = u.line_num"
    q["context_budget"] = f"SELECT session, line_num, n_390 AS n_lines, coalesce(start_390, -1) AS start_line, used_390 AS tokens, n_390 < pos - 1 AS truncated FROM ({budgeted([390])}) b" if d.spark else "SELECT t.session, t.line_num, count(u.line_num) AS n_lines, coalesce(min(u.line_num), -1) AS start_line, coalesce(sum(u.tokens), 0) AS tokens, count(u.line_num) < t.pos - 1 AS truncated FROM lines t LEFT JOIN lines u ON u.session = t.session AND u.line_num < t.line_num AND 400 - t.tokens - 10 > 0 AND t.upto - t.tokens - u.upto + u.tokens <= 400 - t.tokens - 10 GROUP BY t.session, t.line_num, t.pos"
    spoken = "CASE WHEN speaker = 'child' THEN 'Child: ' ELSE 'Mother: ' END"
    q["context_render"] = f"SELECT session, line_num, context FROM ({rendered(3, spoken, here=True)}) x" if d.spark else f"SELECT session, line_num, {d.listed('shown', 'pos')} AS context FROM (SELECT t.session, t.line_num, u.pos, concat(CASE WHEN u.speaker = 'child' THEN 'Child' ELSE 'Mother' END, ': ', u.text) AS shown FROM lines t JOIN lines u ON u.session = t.session AND u.line_num >= t.context_start AND u.line_num <= t.line_num AND (t.context_start >= 0 OR u.line_num = t.line_num)) x GROUP BY session, line_num"
    q["intervening"] = "SELECT t.session, t.line_num, t.pair_index, t.item, count(DISTINCT s.line_num) AS n_between FROM transitions t LEFT JOIN sites s ON s.session = t.session AND s.line_num > t.previous_line AND s.line_num < t.line_num GROUP BY t.session, t.line_num, t.pair_index, t.item"
    q["running_tokens"] = "SELECT session, line_num, tokens, upto FROM lines"
    # Reference switching
    q["tpr_by_session"] = counted("dyad, session, speaker", "transitions")
    q["tpr_by_dyad"] = counted("dyad, speaker", "transitions")
    q["tpr_every_speaker"] = "SELECT s.session, k.speaker, coalesce(t.n, 0) AS n_total FROM (SELECT DISTINCT session FROM sites) s CROSS JOIN (VALUES ('child'), ('mother'), ('other_adult')) AS k(speaker) LEFT JOIN (SELECT session, speaker, count(*) AS n FROM transitions GROUP BY session, speaker) t ON t.session = s.session AND t.speaker = k.speaker"
    q["attested_items"] = "SELECT dyad, item, first_session FROM attested"
    q["tpr_restricted"] = counted("dyad, session, speaker", "restricted")
    q["tpr_totals"] = f"SELECT dyad, speaker, sum(n_total) AS n_total, sum(n_switch) AS n_switch, {rate('sum(n_switch)', 'sum(n_total)')} AS tpr FROM rates GROUP BY ROLLUP (speaker, dyad)"
    q["tpr_mean_of_means"] = "SELECT speaker, count(*) AS n_dyads, round(avg(tpr), 9) AS mean_tpr, round(stddev_samp(tpr), 9) AS sd_tpr, round(sum(n_switch) / sum(n_total), 9) AS pooled FROM dyads GROUP BY speaker"
    q["tpr_dyad_table"] = f"SELECT dyad, sum(CASE WHEN speaker = 'child' THEN n_total ELSE 0 END) AS n_child, {rate('sum(CASE WHEN speaker = ' + chr(39) + 'child' + chr(39) + ' THEN n_switch ELSE 0 END)', 'sum(CASE WHEN speaker = ' + chr(39) + 'child' + chr(39) + ' THEN n_total ELSE 0 END)')} AS mother_to_child, {rate('sum(CASE WHEN speaker = ' + chr(39) + 'mother' + chr(39) + ' THEN n_switch ELSE 0 END)', 'sum(CASE WHEN speaker = ' + chr(39) + 'mother' + chr(39) + ' THEN n_total ELSE 0 END)')} AS child_to_mother FROM rates GROUP BY dyad"
    # Candidate scoring
    q["form_counts"] = "SELECT letter, n_a, n_an, n_the FROM formcounts"
    q["cac_distribution"] = "SELECT session, line_num, pair_index, round(p_a, 9) AS p_a, round(p_the, 9) AS p_the FROM distribution"
    q["readouts"] = "SELECT session, line_num, pair_index, CASE WHEN p_the >= p_a THEN 'the' ELSE 'a' END AS determiner_argmax, CASE WHEN p_a >= p_the THEN 'a' ELSE 'the' END AS first_argmax, round(p_a + p_the, 9) AS mass_on_both, round(-ln(p_the), 9) AS surprisal_the, round(-ln(p_the) / ln(2.0), 9) AS bits_the, round(2 * abs(p_the - 0.5), 9) AS confidence FROM distribution"
    q["sampled"] = "SELECT session, line_num, pair_index, CASE WHEN ((session * 7919 + line_num * 104729 + pair_index * 1299709 + 17) % 1000003) / 1000003.0 < p_a THEN 'a' ELSE 'the' END AS drawn FROM distribution"
    # Analytical metrics
    product = "exp(sum(CASE WHEN {0} IS NOT NULL THEN ln(greatest({0}, 1e-300)) END))"
    by_noun = f"SELECT dyad, speaker, count(*) AS n, sum(k) AS s, sum(greatest(sa, st)) / sum(k) AS bias, avg(coalesce(greatest(0.0, ov), 0.0)) AS empirical, sum(correct) / CAST(sum(k) AS DOUBLE) AS accuracy FROM (SELECT dyad, speaker, noun, count(*) AS k, sum(p_a) AS sa, sum(p_the) AS st, 1 - {product.format('p_the')} - {product.format('p_a')} AS ov, count(CASE WHEN (CASE WHEN p_the >= 0.5 THEN 'the' ELSE 'a' END) = det THEN 1 END) AS correct FROM distribution GROUP BY dyad, speaker, noun) g GROUP BY dyad, speaker"
    analytical = with_predicted(d, by_noun, ("dyad", "speaker", "n", "s", "bias", "empirical", "accuracy"), {"predicted": "bias"})
    q["analytical_overlap"] = f"SELECT dyad, speaker, n, s, round(bias, 9) AS bias, round(empirical, 9) AS empirical, round(accuracy, 9) AS accuracy, round(predicted, 9) AS predicted FROM ({analytical}) x"
    q["analytical_tpr"] = "SELECT t.dyad, t.speaker, count(*) AS n_total, round(avg(abs(CASE WHEN t.previous_det = 'the' THEN 1 ELSE 0 END - p.p_the)), 9) AS tpr_overall, round(avg(CASE WHEN t.previous_det = 'a' THEN p.p_the END), 9) AS tpr_the, round(avg(CASE WHEN t.previous_det = 'the' THEN 1 - p.p_the END), 9) AS tpr_a FROM transitions t JOIN distribution p ON t.session = p.session AND t.line_num = p.line_num AND t.pair_index = p.pair_index GROUP BY t.dyad, t.speaker"
    # Distance and window
    histogram = "SELECT speaker, true_dist AS dist, count(*) AS n, count(CASE WHEN det <> previous_det THEN 1 END) AS k FROM distances GROUP BY speaker, true_dist"
    curve = f"SELECT speaker, dist, sum(n) OVER w AS n, sum(k) OVER w AS k FROM ({histogram}) h WINDOW w AS (PARTITION BY speaker ORDER BY dist)"
    joined = f"SELECT c.speaker, g.k_max, max(c.n) AS n, max(c.k) AS k, max(c.dist) AS at FROM grid g JOIN ({curve}) c ON c.dist <= g.k_max GROUP BY c.speaker, g.k_max"
    of_grid = as_of("speaker", f"SELECT *, dist AS at FROM ({curve}) c2", ("n", "k", "at"), "SELECT k_max FROM grid") if d.spark else joined
    q["tpr_by_k"] = f"SELECT k_max, speaker, n AS n_cases, round(k / CAST(n AS DOUBLE), 9) AS tpr FROM ({of_grid}) x"
    # A window above 200 resolves to the grid's 200.
    q["window_asof"] = f"SELECT w.name, c.speaker, c.at AS at_dist, c.n AS n_cases FROM (VALUES ('small', 1), ('medium', 3), ('large', 500)) AS w(name, width) JOIN ({of_grid}) c ON c.k_max = least(w.width, 200)"
    q["distance_hist"] = "SELECT b.label, b.low, count(CASE WHEN d.speaker = 'child' THEN 1 END) AS child, count(CASE WHEN d.speaker = 'mother' THEN 1 END) AS mother, count(d.speaker) AS total FROM (VALUES ('1', 0, 1), ('2', 1, 2), ('3-5', 2, 5), ('6-50', 5, 50), ('over 50', 50, 1000000000)) AS b(label, low, high) LEFT JOIN distances d ON d.true_dist > b.low AND d.true_dist <= b.high GROUP BY b.label, b.low"
    q["distance_percentiles"] = f"SELECT speaker, count(*) AS n, {', '.join(f'round({d.percentile(chr(116)+chr(114)+chr(117)+chr(101)+chr(95)+chr(100)+chr(105)+chr(115)+chr(116), p / 100)}, 9) AS p{p}' for p in (50, 75, 90, 100))} FROM distances GROUP BY speaker"
    q["near_far"] = "SELECT speaker, count(*) AS n, round(avg(CASE WHEN true_dist > 2 THEN 100 ELSE 0 END), 9) AS percent_far, round(avg(CASE WHEN true_dist <= 2 THEN CASE WHEN det <> previous_det THEN 1 ELSE 0 END END), 9) AS tpr_near, round(avg(CASE WHEN true_dist > 2 THEN CASE WHEN det <> previous_det THEN 1 ELSE 0 END END), 9) AS tpr_far FROM distances GROUP BY speaker"
    q["in_window_audit"] = "SELECT in_window, count(*) AS n, round(avg(CASE WHEN det <> previous_det THEN 1 ELSE 0 END), 9) AS tpr FROM (SELECT *, tokens_back + own_tokens <= 400 AS in_window FROM distances) x GROUP BY in_window"
    q["antecedent_visible"] = "SELECT session, line_num, pair_index, " + d.holds_word("previous_sentence", "noun") + " AS visible FROM transitions"
    # Inference
    q["ttest_1samp"] = _ttest(d, "SELECT speaker, tpr - 0.5 AS x FROM dyads", "speaker")
    q["ttest_paired"] = _ttest(d, "SELECT c.tpr - m.tpr AS x FROM dyads c JOIN dyads m ON c.dyad = m.dyad WHERE c.speaker = 'child' AND m.speaker = 'mother'", "")
    q["ttest_welch"] = "SELECT round((c.mean - m.mean) / sqrt(c.v / c.n + m.v / m.n), 7) AS t, round(pow(c.v / c.n + m.v / m.n, 2) / (pow(c.v / c.n, 2) / (c.n - 1) + pow(m.v / m.n, 2) / (m.n - 1)), 7) AS df FROM (SELECT count(*) AS n, avg(tpr) AS mean, var_samp(tpr) AS v FROM dyads WHERE speaker = 'child') c CROSS JOIN (SELECT count(*) AS n, avg(tpr) AS mean, var_samp(tpr) AS v FROM dyads WHERE speaker = 'mother') m"
    q["pearson"] = f"SELECT n, round(r, 9) AS r, round({p_value(d, '(r * sqrt((n - 2) / nullif(1 - r * r, 0)))', '(n - 2)')}, 8) AS p FROM (SELECT count(*) AS n, corr(c.tpr, m.tpr) AS r FROM dyads c JOIN dyads m ON c.dyad = m.dyad WHERE c.speaker = 'child' AND m.speaker = 'mother') x"
    # Reports
    base = "element_at(split(model_name, '/'), -1)" if d.spark else "split(model_name, '/')[-1]"
    named_models = f"(SELECT *, {base} AS base_name FROM scored_models) m"
    q["model_family"] = f"SELECT model_name, base_name, model_type, {FAMILY} AS family, n_sites FROM {named_models}"
    q["label_accuracy"] = "SELECT d.lang, count(*) AS n, round(avg(CASE WHEN (d.n_chars >= 500) = (l.quality = 1) THEN 1 ELSE 0 END), 9) AS accuracy FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang"
    q["pivot_confidence"] = "SELECT noun, round(avg(CASE WHEN speaker = 'child' THEN 2 * abs(p_the - 0.5) END), 9) AS child, round(avg(CASE WHEN speaker = 'mother' THEN 2 * abs(p_the - 0.5) END), 9) AS mother FROM distribution GROUP BY noun"
    band = "SELECT *, row_number() OVER (ORDER BY confidence DESC, session, line_num, pair_index) AS hi, row_number() OVER (ORDER BY confidence, session, line_num, pair_index) AS lo FROM (SELECT t.session, t.line_num, t.pair_index, round(2 * abs(p.p_the - 0.5), 9) AS confidence FROM distances t JOIN distribution p ON t.session = p.session AND t.line_num = p.line_num AND t.pair_index = p.pair_index WHERE t.speaker = 'child' AND t.true_dist <= 10) c"
    q["annotation_sample"] = f"SELECT 'high' AS band, session, line_num, pair_index, confidence FROM ({band}) x WHERE hi <= 36 UNION ALL SELECT 'low' AS band, session, line_num, pair_index, confidence FROM ({band}) y WHERE lo <= 36"
    q["joint_table"] = "SELECT o.dyad, o.speaker, o.n AS n_nouns, t.n_total, a.n AS n_sites FROM (SELECT dyad, speaker, count(DISTINCT noun) AS n FROM sites GROUP BY dyad, speaker) o JOIN rates t ON o.dyad = t.dyad AND o.speaker = t.speaker LEFT JOIN (SELECT dyad, speaker, count(*) AS n FROM sites GROUP BY dyad, speaker) a ON a.dyad = o.dyad AND a.speaker = o.speaker"
    q["old_new_compare"] = "SELECT coalesce(o.dyad, n.dyad) AS dyad, coalesce(o.speaker, n.speaker) AS speaker, o.n AS n_restricted, n.n_total AS n_unrestricted FROM (SELECT dyad, speaker, count(*) AS n FROM restricted GROUP BY dyad, speaker) o FULL OUTER JOIN rates n ON o.dyad = n.dyad AND o.speaker = n.speaker"
    q["sig_stars"] = f"SELECT speaker, round(p, 7) AS p, {stars('p')} AS stars, coalesce(p > 0.05, false) AS passes FROM ({reports.tested(d, 'SELECT speaker, empirical - predicted AS x FROM humans', 'speaker')}) v"
    q["unique_labels"] = f"SELECT model_name, model_type, CASE WHEN count(*) OVER (PARTITION BY family) > 1 THEN concat(family, ' ', CAST(row_number() OVER (PARTITION BY family ORDER BY model_name) AS STRING)) ELSE family END AS label FROM (SELECT model_name, model_type, {FAMILY} AS family FROM {named_models}) x"
    q["unmatched"] = "SELECT s.session, s.line_num, s.pair_index FROM sites s LEFT ANTI JOIN transitions t ON s.session = t.session AND s.line_num = t.line_num AND s.pair_index = t.pair_index" if d.spark else "SELECT s.session, s.line_num, s.pair_index FROM sites s ANTI JOIN transitions t ON s.session = t.session AND s.line_num = t.line_num AND s.pair_index = t.pair_index"
    q.update(reports.texts(d))
    return q


def input_key(spark, sf_dir: str, store: Store) -> str:
    """What tables in a store that outlives the application depend on, besides rules."""
    return signature(spark, *[f"{sf_dir}/{t}.parquet" for t in TABLES]) if store.kept else ""


def frame(spark, sf_dir: str, final: str, store: Store | None = None, always: Iterable[str] = ()):
    """final over the tables of sf_dir. Relations that it reads more than once, and those of `always` that it reads, are tables of the store."""
    store = store or Store(spark)
    known = parts(SPARK)
    names = needed(final, known)
    several = set(shared(final, known)) | set(always)
    done: dict[str, DataFrame] = {}

    def bound(text: str) -> DataFrame:
        text = sql(SPARK, text, stored=done)
        tables = {**{f"stored_{n}": done[n] for n in done}, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}}
        used = [n for n in tables if n in named(text)]
        text = re.sub(rf"\b(FROM|JOIN)(\s+\(?\s*)({'|'.join(used)})\b", r"\1\2{\3}", text) if used else text
        return spark.sql(_braces(text, used), **{n: tables[n] for n in used})

    of_input = input_key(spark, sf_dir, store)
    for name in names:
        if name in several:
            own = sql(SPARK, f"SELECT * FROM {name}")
            done[name] = store.relation(name, own + of_input, lambda: bound(known[name]))  # noqa: B023
    return bound(final)


def spark_text(name: str) -> str:
    """The whole SQL of a query for Spark."""
    return sql(SPARK, texts(SPARK)[name])


def _run(name: str):
    text = texts(SPARK)[name]

    def query(spark, sf_dir, store: Store | None = None, always: Iterable[str] = ()):
        out = frame(spark, sf_dir, text, store, always)
        return out.withColumns({c: out[c].cast("bigint") for c in LONG.get(name, ())})

    return query


def _braces(text: str, used) -> str:
    """text for str.format: braces that aren't tables are doubled."""
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    return text


def _clean(spark, sf_dir, store=None, always=()):
    from pyspark.sql import functions as F

    from .functions.textnorm import clean

    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", clean(F.col("text")).alias("clean"))


#: Columns whose whole-number types differ between the engines; both cast them.
LONG = {"overlap_counts": ["n_tokens"], "yang_predicted": ["s"], "true_dist": ["true_dist"], "context_budget": ["tokens"], "running_tokens": ["upto"], "tpr_totals": ["n_total", "n_switch"], "tpr_dyad_table": ["n_child"],
        "analytical_overlap": ["s"], "tpr_by_k": ["n_cases"], "window_asof": ["at_dist", "n_cases"], **reports.LONG}


def _duck(name: str, text: str) -> str:
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in LONG.get(name, ()))
    return f"SELECT * REPLACE ({casts}) FROM ({sql(DUCKDB, text)}) q" if casts else sql(DUCKDB, text)


def _ngrams(spark, sf_dir, store=None, always=()):
    from .plans import ngram

    return ngram.query(spark, sf_dir, store, always)


def _behind(relation: str, text: str) -> str:
    """text, which goes on with the expressions, behind those that relation needs."""
    return sql(DUCKDB, f"SELECT * FROM {relation}").rsplit("\nSELECT", 1)[0] + text


def _ngrams_sql() -> str:
    from .plans import ngram

    return _behind("sites", ngram.SQL)


QUERIES = {name: _run(name) for name in texts(SPARK)} | {"text_clean": _clean, "ngram_scores": _ngrams, "noun_phrases": noun_phrases.query, "pair_overlap": pair_overlap.query}
SQL = {name: _duck(name, text) for name, text in texts(DUCKDB).items()} | {"ngram_scores": _ngrams_sql(), "noun_phrases": noun_phrases.duck_sql(), "pair_overlap": _behind("docsites", pair_overlap.SQL)}
