"""Queries with a model dimension, significance tests, summaries, inputs of experiments and report tables, as texts for both engines."""

from __future__ import annotations

from .dialect import Dialect
from .functions import labels as L
from .functions.formulas import p_value, p_value_any, with_predicted
from .operators.model_relations import ROOMS
from .operators.relations import as_of, budgeted, rendered

KEYS = "model_name, model_type, dyad, speaker"
#: Whom models are compared with, pooled and by dyad, where they aren't paired with children or mothers.
REFERENCE = "other_adult"
#: Tokens per type and observed overlap of the twelve children and their mothers, as published.
YANG_VALIAN = {
    "child": ((4.06, 5.22, 4.36, 11.60, 3.09, 3.01, 3.51, 5.78, 4.78, 3.30, 4.13, 6.81), (0.33, 0.32, 0.33, 0.46, 0.22, 0.21, 0.24, 0.33, 0.29, 0.26, 0.26, 0.37)),
    "mother": ((9.18, 8.62, 6.42, 8.57, 8.55, 4.77, 5.04, 5.67, 5.74, 5.77, 7.71, 7.91), (0.40, 0.34, 0.35, 0.40, 0.30, 0.30, 0.27, 0.36, 0.31, 0.31, 0.35, 0.35)),
}


def r9(x: str, name: str, digits: int = 9) -> str:
    return f"round({x}, {digits}) AS {name}"


def t_of(mean: str, sd: str, n: str) -> str:
    return f"CASE WHEN {n} > 1 THEN {mean} / nullif({sd} / sqrt({n}), 0) END"


def tested(d: Dialect, source: str, keys: str, name: str = "x") -> str:
    """keys, n, mean, sd, t and p of `name` against 0, unrounded. Nulls don't count; fewer than two values or no spread give null t and p."""
    k = f"{keys}, " if keys else ""
    stats = f"SELECT {k}count({name}) AS n, avg({name}) AS mean, stddev_samp({name}) AS sd FROM ({source}) q0 {'GROUP BY ' + keys if keys else ''}"
    t = f"SELECT *, {t_of('mean', 'sd', 'n')} AS t FROM ({stats}) q1"
    return f"SELECT {k}n, mean, sd, t, {p_value(d, 't', '(n - 1)')} AS p FROM ({t}) q2"


def texts(d: Dialect) -> dict[str, str]:
    q: dict[str, str] = {}
    overlap = "SELECT * FROM model_overlaps"

    # Overlap and switch rates for each model, type, dyad and speaker
    q["model_predictions"] = f"SELECT model_name, model_type, session, line_num, pair_index, {r9('p_a', 'p_a')}, {r9('p_the', 'p_the')}, argmax, sampled FROM predictions"
    q["model_overlap"] = f"SELECT {KEYS}, n, s, {r9('bias', 'emp_bias')}, {r9('empirical', 'empirical')}, {r9('predicted', 'naive_predicted')}, {r9('accuracy', 'accuracy')} FROM ({overlap}) x"
    q["model_tpr"] = f"SELECT {KEYS}, {r9('tpr_overall', 'tpr_overall')}, {r9('tpr_the', 'tpr_the')}, {r9('tpr_a', 'tpr_a')}, n_total, n_previous_a, n_previous_the FROM model_dyads"
    q["overlap_long"] = f"SELECT model_name || '|' || model_type AS model_key, dyad, speaker, kind, {r9('value', 'value')} FROM (SELECT *, 'empirical' AS kind, empirical AS value FROM ({overlap}) a UNION ALL SELECT *, 'predicted' AS kind, predicted AS value FROM ({overlap}) b) x WHERE empirical IS NOT NULL"
    zipfian = with_predicted(d, "SELECT * FROM counted", ("lang", "n", "s", "bias"), {"predicted": "bias", "predicted_at_082": "0.82"})
    q["overlap_all_stats"] = f"""SELECT c.lang, c.n, c.s, {r9('c.bias', 'bias')}, {r9('c.s / CAST(c.n AS DOUBLE)', 'r')}, {r9('e.empirical', 'empirical')}, {r9('e.simple', 'simple')}, {r9('z.slope', 'slope', 7)}, {r9('c.predicted', 'predicted')}, {r9('c.predicted_at_082', 'predicted_at_082')}
      FROM ({zipfian}) c JOIN (SELECT n.lang, avg(CASE WHEN n.a > 0 AND n.the > 0 THEN 1 ELSE 0 END) AS empirical, avg(1 - pow(k.bias, n.a + n.the) - pow(1 - k.bias, n.a + n.the)) AS simple FROM nouns n JOIN counted k ON n.lang = k.lang GROUP BY n.lang) e ON c.lang = e.lang
      JOIN (SELECT lang, regr_slope(ln(f), ln(rk)) AS slope FROM ({ranked(d)}) y GROUP BY lang) z ON z.lang = c.lang"""

    # Significance
    differ = f"SELECT model_name, model_type, speaker, empirical - predicted AS x, empirical, predicted, bias, accuracy, dyad FROM ({overlap}) x"
    sig = f"SELECT t.model_name, t.model_type, t.speaker, t.n, m.mean_empirical, m.sd_empirical, m.mean_predicted, m.sd_predicted, m.mean_bias, m.mean_accuracy, t.t, t.p FROM ({tested(d, differ, 'model_name, model_type, speaker')}) t JOIN (SELECT model_name, model_type, speaker, avg(empirical) AS mean_empirical, stddev_samp(empirical) AS sd_empirical, avg(predicted) AS mean_predicted, stddev_samp(predicted) AS sd_predicted, avg(bias) AS mean_bias, avg(accuracy) AS mean_accuracy FROM ({differ}) f GROUP BY model_name, model_type, speaker) m ON t.model_name = m.model_name AND t.model_type = m.model_type AND t.speaker = m.speaker"
    q["overlap_significance"] = f"SELECT model_name, model_type, speaker, n, {r9('mean_empirical', 'empirical')}, {r9('mean_predicted', 'predicted')}, {r9('t', 't', 6)}, {r9('p', 'p', 7)}, {L.stars('p')} AS stars, {L.mark('p')} AS passes FROM ({sig}) x"
    q["overlap_summary"] = f"SELECT model_name, model_type, speaker, {r9('mean_empirical', 'mean_empirical')}, {r9('sd_empirical', 'sd_empirical')}, {r9('mean_bias', 'mean_bias')}, {r9('p', 'p', 7)} FROM ({sig}) x"
    q["accuracy_summary"] = f"SELECT model_name, speaker, count(*) AS n_dyads, {r9('avg(accuracy)', 'accuracy')} FROM model_bias GROUP BY model_name, speaker"
    adults = f"(SELECT count(*) AS n, avg(tpr) AS mean, var_samp(tpr) AS v, sum(n_switch) / sum(n_total) AS pooled FROM dyads WHERE speaker = '{REFERENCE}')"
    child = "SELECT model_name, model_type, count(tpr_overall) AS n, avg(tpr_overall) AS mean, stddev_samp(tpr_overall) AS sd FROM model_dyads WHERE speaker = 'child' GROUP BY model_name, model_type"
    one = f"SELECT c.*, a.pooled, a.mean AS adult_mean, {t_of('(c.mean - a.pooled)', 'c.sd', 'c.n')} AS t1, (c.mean - a.mean) / nullif(sqrt(c.sd * c.sd / c.n + a.v / a.n), 0) AS tw, pow(c.sd * c.sd / c.n + a.v / a.n, 2) / nullif(pow(c.sd * c.sd / c.n, 2) / nullif(c.n - 1, 0) + pow(a.v / a.n, 2) / nullif(a.n - 1, 0), 0) AS dfw FROM ({child}) c CROSS JOIN {adults} a WHERE c.n > 1"
    pair = lambda who: tested(d, f"SELECT m.model_name, m.model_type, m.tpr_overall - h.tpr AS x FROM model_dyads m JOIN dyads h ON h.dyad = m.dyad WHERE m.speaker = 'child' AND h.speaker = '{who}'", "model_name, model_type")
    four = f"SELECT o.*, {p_value(d, 'o.t1', '(o.n - 1)')} AS p1, {p_value_any(d, 'o.tw', 'o.dfw')} AS pw, c.n AS n_c, c.t AS tc, c.p AS pc, m.n AS n_m, m.t AS tm, m.p AS pm FROM ({one}) o LEFT JOIN ({pair('child')}) c ON c.model_name = o.model_name AND c.model_type = o.model_type LEFT JOIN ({pair('mother')}) m ON m.model_name = o.model_name AND m.model_type = o.model_type"
    q["model_four_tests"] = f"""SELECT model_name, model_type, n AS n_model_dyads, {r9('mean', 'mean_model_tpr')}, {r9('sd', 'sd_model_tpr')}, n_c AS n_paired_child, n_m AS n_paired_mother, {r9('adult_mean', 'mean_adult_tpr')}, {r9('pooled', 'adult_population_mean')},
      {r9('t1', 'onesample_t', 6)}, {r9('p1', 'p_1sample', 7)}, {r9('tw', 'welch_t', 6)}, {r9('dfw', 'welch_df', 6)}, {r9('pw', 'p_welch', 6)}, {r9('tc', 'paired_child_t', 6)}, {r9('pc', 'p_paired_child', 7)}, {r9('tm', 'paired_mother_t', 6)}, {r9('pm', 'p_paired_mother', 7)},
      coalesce(p1 > 0.05, false) AS passes_one, coalesce(p1 > 0.05 AND pw > 0.05 AND pc > 0.05 AND pm > 0.05, false) AS passes_four FROM ({four}) x"""
    means = "SELECT model_name, model_type, dyad, avg(contrib) AS mt, avg(human_switch) AS ht, avg(CASE WHEN in_window THEN contrib END) AS mw, avg(CASE WHEN in_window THEN human_switch END) AS hw, count(CASE WHEN in_window THEN 1 END) AS k FROM cases WHERE speaker = 'child' GROUP BY model_name, model_type, dyad"
    every, within = tested(d, f"SELECT model_name, model_type, mt - ht AS x FROM ({means}) m0", "model_name, model_type"), tested(d, f"SELECT model_name, model_type, mw - hw AS x FROM ({means}) m1", "model_name, model_type")
    fixed = f"SELECT g.*, a.p AS all_p, w.p AS win_p, w.n AS win_n FROM (SELECT model_name, model_type, avg(mt) AS all_model, avg(ht) AS all_human, avg(mw) AS win_model, avg(hw) AS win_human, stddev_samp(mw) AS win_sd, CAST(sum(k) AS BIGINT) AS n_window FROM ({means}) m2 GROUP BY model_name, model_type) g JOIN ({every}) a ON a.model_name = g.model_name AND a.model_type = g.model_type JOIN ({within}) w ON w.model_name = g.model_name AND w.model_type = g.model_type"
    q["corrected_in_window"] = f"SELECT model_name, model_type, {r9('all_model', 'all_model')}, {r9('all_human', 'all_human')}, {r9('all_p', 'all_p', 7)}, coalesce(all_p > 0.05, false) AS all_pass, {r9('CASE WHEN win_n > 1 THEN win_model END', 'win_model')}, {r9('CASE WHEN win_n > 1 THEN win_human END', 'win_human')}, {r9('win_p', 'win_p', 7)}, coalesce(win_p > 0.05, false) AS win_pass, n_window FROM ({fixed}) x"
    hist = "(SELECT dyad, speaker, true_dist AS dist, count(*) AS n, count(CASE WHEN det <> previous_det THEN 1 END) AS sw FROM distances GROUP BY dyad, speaker, true_dist) h"
    running = f"SELECT dyad, speaker, dist, sum(n) OVER w AS n, sum(sw) OVER w AS sw FROM {hist} WINDOW w AS (PARTITION BY dyad, speaker ORDER BY dist)"
    of_dyads = as_of("dyad, speaker", running, ("n", "sw"), "SELECT k_max FROM grid") if d.spark else f"SELECT g.k_max, h.dyad, h.speaker, sum(h.n) AS n, sum(h.sw) AS sw FROM grid g JOIN {hist} ON h.dist <= g.k_max GROUP BY g.k_max, h.dyad, h.speaker"
    per_k = f"SELECT k_max, dyad, speaker, n, sw, sw / CAST(n AS DOUBLE) AS rate FROM ({of_dyads}) pk"
    pooled = f"SELECT k_max, sum(sw) / CAST(sum(n) AS DOUBLE) AS pooled, sum(n) AS n FROM ({per_k}) pk0 WHERE speaker = '{REFERENCE}' GROUP BY k_max"
    against = tested(d, f"SELECT k.k_max, k.speaker, k.rate - r.pooled AS x FROM ({per_k}) k LEFT JOIN ({pooled}) r ON r.k_max = k.k_max WHERE k.speaker <> '{REFERENCE}'", "k_max, speaker")
    both = tested(d, f"SELECT a.k_max, a.rate - b.rate AS x FROM ({per_k}) a JOIN ({per_k}) b ON a.k_max = b.k_max AND a.dyad = b.dyad WHERE a.speaker = 'child' AND b.speaker = 'mother'", "k_max")
    sums = f"SELECT k_max, speaker, avg(rate) AS tpr, CAST(sum(n) AS BIGINT) AS n_cases FROM ({per_k}) pk1 WHERE speaker <> '{REFERENCE}' GROUP BY k_max, speaker"
    q["tests_by_k"] = f"SELECT s.k_max, s.speaker, {r9('s.tpr', 'tpr')}, s.n_cases, {r9('a.t', 't', 6)}, {r9('a.p', 'p', 7)}, {r9('b.t', 'pair_t', 6)}, {r9('b.p', 'pair_p', 7)}, {r9('r.pooled', 'adult_pooled')}, CAST(coalesce(r.n, 0) AS BIGINT) AS adult_n FROM ({sums}) s JOIN ({against}) a ON a.k_max = s.k_max AND a.speaker = s.speaker LEFT JOIN ({both}) b ON b.k_max = s.k_max LEFT JOIN ({pooled}) r ON r.k_max = s.k_max"
    human = "SELECT * FROM humans"
    q["human_overlap"] = f"SELECT dyad, speaker, n, s, {r9('bias', 'emp_bias')}, {r9('s / CAST(n AS DOUBLE)', 'r')}, {r9('empirical', 'empirical')}, {r9('predicted', 'naive_zipf_predicted')} FROM ({human}) x"
    q["human_overlap_stats"] = f"SELECT t.speaker, t.n, {r9('m.e', 'mean_empirical')}, {r9('m.sd', 'sd_empirical')}, {r9('m.b', 'mean_bias')}, {r9('t.t', 't', 6)}, {r9('t.p', 'p', 7)} FROM ({tested(d, f'SELECT speaker, empirical - predicted AS x FROM ({human}) h0', 'speaker')}) t JOIN (SELECT speaker, avg(empirical) AS e, stddev_samp(empirical) AS sd, avg(bias) AS b FROM ({human}) h1 GROUP BY speaker) m ON m.speaker = t.speaker"
    wide = f"(SELECT dyad, max(CASE WHEN speaker = 'child' THEN bias END) AS cb, max(CASE WHEN speaker = 'mother' THEN bias END) AS mb, max(CASE WHEN speaker = 'child' THEN empirical END) AS ce, max(CASE WHEN speaker = 'mother' THEN empirical END) AS me FROM ({human}) h2 GROUP BY dyad) w"
    four_bias = [("child bias, 0.82", "cb - 0.82"), ("mother bias, 0.82", "mb - 0.82"), ("child bias, mother bias", "cb - mb"), ("child overlap, mother overlap", "ce - me")]
    q["bias_tests"] = "SELECT test, n, " + f"{r9('mean', 'difference')}, {r9('t', 't', 6)}, {r9('p', 'p', 7)} FROM (" + tested(d, " UNION ALL ".join(f"SELECT '{name}' AS test, {x} AS x FROM {wide}" for name, x in four_bias), "test") + ") x"
    rows = ", ".join(f"('{who}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for who, (xs, ys) in YANG_VALIAN.items() for x, y in zip(xs, ys, strict=True))
    points = f"SELECT speaker, 'published' AS source, x, y FROM (VALUES {rows}) AS v(speaker, x, y) UNION ALL SELECT speaker, 'corpus' AS source, s / CAST(n AS DOUBLE) AS x, empirical AS y FROM humans"
    q["literature_pearson"] = f"SELECT speaker, source, n, {r9('r', 'r')}, round({p_value(d, '(r * sqrt((n - 2) / nullif(1 - r * r, 0)))', '(n - 2)')}, 8) AS p FROM (SELECT speaker, source, count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM ({points}) p0 GROUP BY speaker, source) c"

    # Curves and references by window
    curve = "SELECT model_name, model_type, dyad, true_dist AS dist, count(*) AS n, sum(contrib) AS c, max(window_lines) AS w FROM cases WHERE speaker = 'child' GROUP BY model_name, model_type, dyad, true_dist"
    summed = f"SELECT model_name, model_type, dyad, w, dist, sum(n) OVER f AS n, sum(c) OVER f AS c FROM ({curve}) u WINDOW f AS (PARTITION BY model_name, model_type, dyad, w ORDER BY dist)"
    of_models = as_of("model_name, model_type, dyad, w", summed, ("n", "c"), "SELECT k_max FROM grid") if d.spark else f"SELECT g.k_max, u.model_name, u.model_type, u.dyad, u.w, sum(u.n) AS n, sum(u.c) AS c FROM grid g JOIN ({curve}) u ON u.dist <= g.k_max GROUP BY g.k_max, u.model_name, u.model_type, u.dyad, u.w"
    q["model_curve"] = f"SELECT k_max, model_name, model_type, CASE WHEN k_max <= w THEN round(avg(c / n), 9) END AS tpr FROM ({of_models}) x GROUP BY k_max, model_name, model_type, w"
    rates = f"SELECT k_max, avg(CASE WHEN speaker = 'child' THEN rate END) AS c, avg(CASE WHEN speaker = 'mother' THEN rate END) AS m, avg(CASE WHEN speaker = 'other_adult' THEN rate END) AS o FROM ({per_k}) pk2 GROUP BY k_max"
    q["human_envelope"] = f"SELECT k_max, {r9('least(c, m, o)', 'low')}, {r9('greatest(c, m, o)', 'high')} FROM ({rates}) x"
    counts = f"SELECT speaker, dist, sum(n) OVER w AS n, sum(sw) OVER w AS sw FROM (SELECT speaker, dist, sum(n) AS n, sum(sw) AS sw FROM {hist} GROUP BY speaker, dist) h3 WINDOW w AS (PARTITION BY speaker ORDER BY dist)"
    # K runs from 1 to 200 and beyond all; a window above 200 gets K = 200, one below the first K the first.
    at_grid = as_of("speaker", counts, ("n", "sw"), "SELECT k_max FROM grid") if d.spark else f"SELECT g.k_max, c.speaker, max(c.n) AS n, max(c.sw) AS sw FROM grid g JOIN ({counts}) c ON c.dist <= g.k_max GROUP BY g.k_max, c.speaker"
    q["window_reference"] = f"SELECT m.model_name, m.model_type, s.speaker, least(greatest(m.window_lines, 1), 200) AS k, round(c.sw / CAST(c.n AS DOUBLE), 9) AS reference FROM models m CROSS JOIN (VALUES ('child'), ('mother')) AS s(speaker) LEFT JOIN ({at_grid}) c ON c.speaker = s.speaker AND c.k_max = least(greatest(m.window_lines, 1), 200)"
    forty = "SELECT explode(sequence(0, 39)) AS i" if d.spark else "SELECT unnest(range(0, 40)) AS i"
    q["k_grid"] = f"SELECT g.k, c.speaker, CAST(c.n AS BIGINT) AS n_cases FROM (SELECT DISTINCT CAST(floor(1 + i * (200 - 1) / 39.0) AS BIGINT) AS k FROM ({forty}) i0) g JOIN ({at_grid}) c ON c.k_max = g.k"
    q["context_cap"] = f"SELECT {r9('avg_tokens', 'avg_tokens')}, tokens, CAST(greatest(10, CAST(floor(tokens / avg_tokens) AS BIGINT) + 5) AS BIGINT) AS max_lines FROM (SELECT greatest(1.0, sum(length(text)) / CAST(greatest(count(*), 1) AS DOUBLE) / 4.0) AS avg_tokens FROM (SELECT text FROM utterances WHERE text IS NOT NULL ORDER BY session, line_num LIMIT 2000) s) a CROSS JOIN (SELECT greatest(512, max({_window('model_name', 'model_type')})) AS tokens FROM models) b"
    q["window_tiers"] = "SELECT model_name, model_type, window_lines, CASE WHEN window_lines < 20 THEN 'small' WHEN window_lines < 80 THEN 'medium' ELSE 'large' END AS tier, n_sites FROM scored_models"

    # Audits and summaries
    q["visibility_audit"] = f"SELECT model_name, model_type, count(*) AS n, {r9('100 * avg(CASE WHEN in_window THEN 0e0 ELSE 1e0 END)', 'percent_out')}, row_number() OVER (ORDER BY avg(CASE WHEN in_window THEN 0e0 ELSE 1e0 END) DESC, model_name, model_type) AS place FROM cases GROUP BY model_name, model_type"
    strip = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]', ''{'' if d.spark else ', ' + chr(39) + 'g' + chr(39)}))"
    near = "SELECT t.session, t.line_num, t.pair_index, t.noun, t.true_dist, t.previous_sentence, t.sentence, t.speaker, u.pos FROM distances t JOIN lines u ON u.session = t.session AND u.line_num = t.line_num"
    near = "SELECT session, line_num, pair_index, noun, true_dist, previous_sentence, sentence, speaker, pos FROM distances" if d.spark else near
    shown = (lambda w, label: f"SELECT session, line_num, context FROM ({rendered(w, label.replace('u.', '') + ' || chr(32)')}) r WHERE pos > 1") if d.spark else lambda w, label: f"SELECT t.session, t.line_num, t.pair_index, {d.listed('shown', 'pos')} AS context FROM (SELECT t.session, t.line_num, t.pair_index, u.pos, {label} || ' ' || u.text AS shown FROM ({near}) t JOIN lines u ON u.session = t.session AND u.pos >= t.pos - {w} AND u.pos < t.pos) t GROUP BY t.session, t.line_num, t.pair_index"
    here = "c.session = t.session AND c.line_num = t.line_num" + ("" if d.spark else " AND c.pair_index = t.pair_index")
    childes = "CASE WHEN u.speaker = 'child' THEN '*CHI:' WHEN u.speaker = 'mother' THEN '*MOT:' ELSE '*OTH:' END"
    q["input_audit"] = f"SELECT in_window, count(*) AS n, {r9('100 * avg(CASE WHEN held THEN 1e0 ELSE 0e0 END)', 'percent_held')}, CASE WHEN in_window THEN avg(CASE WHEN held THEN 1e0 ELSE 0e0 END) > 0.999 END AS sound FROM (SELECT t.true_dist <= 3 AS in_window, contains({strip('c.context')}, {strip('t.previous_sentence')}) AS held FROM ({near}) t JOIN ({shown(3, childes)}) c ON {here}) x GROUP BY in_window"
    word = d.holds_word("c.context", "t.noun")
    q["annotation_prompts"] = f"SELECT t.session, t.line_num, t.pair_index, c.context || chr(10) || CASE WHEN t.speaker = 'child' THEN '*CHI: ' WHEN t.speaker = 'mother' THEN '*MOT: ' ELSE '*OTH: ' END || substr(s.sentence, 1, s.det_char_start) || '____' || substr(s.sentence, s.det_char_end + 1) AS prompt, {word} AS noun_present FROM ({near}) t JOIN ({shown(10, childes)}) c ON {here} JOIN sites s ON s.session = t.session AND s.line_num = t.line_num AND s.pair_index = t.pair_index"
    # Eligible: a child's site of distance 10 at most that three models have scored, whose noun is in the prompt; ranked by the least confidence.
    three = "SELECT p.session, p.line_num, p.pair_index, count(*) AS n_models, avg(2 * abs(p.p_the - 0.5)) AS mean_conf, min(2 * abs(p.p_the - 0.5)) AS min_conf, count(CASE WHEN p.p_the > 0.5 THEN 1 END) AS n_the FROM predictions p WHERE p.model_name IN ('ltg/ltg-bert-bnc', 'roberta-base', 'google/t5-base') AND p.p_the IS NOT NULL GROUP BY p.session, p.line_num, p.pair_index HAVING count(DISTINCT p.model_name) = 3"
    eligible = f"SELECT t.session, t.line_num, t.pair_index, round(e.mean_conf, 9) AS mean_conf, round(e.min_conf, 9) AS min_conf, e.n_the FROM ({near}) t JOIN ({three}) e ON e.session = t.session AND e.line_num = t.line_num AND e.pair_index = t.pair_index JOIN ({shown(10, childes)}) c ON {here} WHERE t.speaker = 'child' AND t.true_dist <= 10 AND {word}"
    order = "session, line_num, pair_index"
    band = lambda name, way: f"SELECT '{name}' AS band, * FROM (SELECT * FROM ({eligible}) e0 ORDER BY min_conf {way}, mean_conf {way}, {order} LIMIT 36) {name}_b"
    q["annotation_bands"] = f"SELECT * FROM ({band('high', 'DESC')} UNION ALL {band('low', 'ASC')}) x"
    q["band_limits"] = f"SELECT band, count(*) AS n, min(min_conf) AS least, max(min_conf) AS most FROM ({q['annotation_bands']}) x GROUP BY band"
    q["other_adult_dyads"] = "SELECT dyad, count(*) AS n_total, count(DISTINCT session) AS n_sessions, round(avg(CASE WHEN det <> previous_det THEN 1e0 ELSE 0e0 END), 9) AS tpr, round(avg(CASE WHEN previous_det = 'a' THEN CASE WHEN det = 'the' THEN 1e0 ELSE 0e0 END END), 9) AS tpr_the, round(avg(CASE WHEN previous_det = 'the' THEN CASE WHEN det = 'a' THEN 1e0 ELSE 0e0 END END), 9) AS tpr_a FROM transitions WHERE speaker = 'other_adult' GROUP BY dyad"
    q["session_nouns"] = f"SELECT s.dyad, s.session, s.speaker, s.n_nouns, coalesce(a.n_attested, 0) AS n_attested, coalesce(t.n_total, 0) AS n_total, {r9('t.tpr', 'tpr')} FROM (SELECT dyad, session, k.speaker, count(DISTINCT CASE WHEN sites.speaker = k.speaker THEN noun END) AS n_nouns FROM sites CROSS JOIN (VALUES ('child'), ('mother'), ('other_adult')) AS k(speaker) GROUP BY dyad, session, k.speaker) s LEFT JOIN (SELECT s.session, count(DISTINCT s.item) AS n_attested FROM sites s JOIN attested a ON a.dyad = s.dyad AND a.item = s.item AND a.first_session <= s.session GROUP BY s.session) a ON a.session = s.session LEFT JOIN (SELECT session, speaker, count(*) AS n_total, avg(CASE WHEN det <> previous_det THEN 1e0 ELSE 0e0 END) AS tpr FROM transitions GROUP BY session, speaker) t ON t.session = s.session AND t.speaker = s.speaker"
    q["dyad_tpr_table"] = "SELECT dyad, count(CASE WHEN speaker = 'child' THEN 1 END) AS n_child, " + ", ".join(f"round(avg(CASE WHEN speaker = '{w}' AND previous_det = '{p}' THEN CASE WHEN det <> previous_det THEN 1e0 ELSE 0e0 END END), 9) AS {w}_tpr_{o}" for w in ("child", "mother") for p, o in (("a", "the"), ("the", "a"))) + " FROM transitions WHERE speaker IN ('child', 'mother') GROUP BY dyad"
    q["distance_describe"] = f"SELECT speaker, count(*) AS n, round(avg(true_dist), 9) AS mean, round(stddev_samp(true_dist), 9) AS sd, min(true_dist) AS least, max(true_dist) AS most, round({d.percentile('true_dist', 0.5)}, 9) AS median FROM distances GROUP BY speaker"
    q["near_far_dyads"] = f"SELECT n.speaker, n.n, n.median, n.percent_far, {r9('avg(m.tpr)', 'tpr')}, {r9('avg(m.near)', 'tpr_near')}, {r9('avg(m.far)', 'tpr_far')} FROM (SELECT speaker, count(*) AS n, round({d.percentile('true_dist', 0.5)}, 9) AS median, round(avg(CASE WHEN true_dist > 50 THEN 1e2 ELSE 0e0 END), 9) AS percent_far FROM distances GROUP BY speaker) n JOIN (SELECT dyad, speaker, avg(x) AS tpr, avg(CASE WHEN true_dist <= 50 THEN x END) AS near, avg(CASE WHEN true_dist > 50 THEN x END) AS far FROM (SELECT dyad, speaker, true_dist, CASE WHEN det <> previous_det THEN 1e0 ELSE 0e0 END AS x FROM distances) y GROUP BY dyad, speaker) m ON m.speaker = n.speaker GROUP BY n.speaker, n.n, n.median, n.percent_far"
    stacked = "SELECT model_name, model_type, dyad, session, speaker, 'argmax' AS method, argmax AS said, det, previous_det FROM cases UNION ALL SELECT model_name, model_type, dyad, session, speaker, 'sampled' AS method, sampled AS said, det, previous_det FROM cases"
    q["prediction_tpr"] = "SELECT model_name, model_type, dyad, speaker, method, n_sessions, n_total, n_previous_a, n_previous_the, n_to_the, n_to_a, n_total - n_switch AS n_maintained, n_correct, round(n_to_the / CAST(nullif(n_previous_a, 0) AS DOUBLE), 9) AS tpr_the, round(n_to_a / CAST(nullif(n_previous_the, 0) AS DOUBLE), 9) AS tpr_a, round(n_switch / CAST(n_total AS DOUBLE), 9) AS tpr_overall, round(1 - n_switch / CAST(n_total AS DOUBLE), 9) AS maintenance_rate, round(n_correct / CAST(n_total AS DOUBLE), 9) AS accuracy FROM (SELECT model_name, model_type, dyad, speaker, method, count(DISTINCT session) AS n_sessions, count(*) AS n_total, count(CASE WHEN previous_det = 'a' THEN 1 END) AS n_previous_a, count(CASE WHEN previous_det = 'the' THEN 1 END) AS n_previous_the, count(CASE WHEN previous_det = 'a' AND said = 'the' THEN 1 END) AS n_to_the, count(CASE WHEN previous_det = 'the' AND said = 'a' THEN 1 END) AS n_to_a, count(CASE WHEN said <> previous_det THEN 1 END) AS n_switch, count(CASE WHEN said = det THEN 1 END) AS n_correct FROM (" + stacked + ") s GROUP BY model_name, model_type, dyad, speaker, method) x"
    first = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, noun ORDER BY line_num, pair_index) AS rn FROM predictions WHERE model_name = 'roberta-base') f WHERE rn = 1"
    q["matched_predictions"] = f"SELECT t.session, t.noun, count(*) AS n_cases, count(p.session) AS n_matched, count(*) - count(p.session) AS n_unmatched FROM transitions t LEFT JOIN ({first}) p ON p.session = t.session AND p.noun = t.noun AND p.line_num = t.line_num GROUP BY t.session, t.noun"

    # Inputs of the experiments
    label = "CASE WHEN {0} = 'child' THEN 'Child' ELSE 'Mother' END"
    said = label.format("speaker")
    q["cross_speaker_inputs"] = f"""SELECT session, line_num, pair_index, speaker, noun, det AS original_det, previous_det, previous_speaker, previous_line, coalesce(previous_speaker = CASE WHEN speaker = 'mother' THEN 'child' ELSE 'mother' END, false) AS has_prior_mention,
      coalesce({label.format('previous_speaker')} || ': ' || previous_sentence || chr(10), '') || {said} || ': ' || substr(sentence, 1, det_char_start) || '[MASK]' || substr(sentence, det_char_end + 1) AS full_input_mlm,
      coalesce({label.format('previous_speaker')} || ': ' || previous_sentence || chr(10), '') || {said} || ': ' || substr(sentence, 1, det_char_start) || '___' || substr(sentence, det_char_end + 1) AS full_input_ar,
      substr(sentence, 1, det_char_start) || '{{MASK}}' || substr(sentence, det_char_end + 1) AS masked_position
      FROM (SELECT session, line_num, pair_index, speaker, noun, det, sentence, det_char_start, det_char_end, CASE WHEN ok THEN previous_det END AS previous_det, CASE WHEN ok THEN previous_speaker END AS previous_speaker, CASE WHEN ok THEN previous_line END AS previous_line, CASE WHEN ok THEN previous_sentence END AS previous_sentence
        FROM (SELECT *, previous_speaker = CASE WHEN speaker = 'mother' THEN 'child' ELSE 'mother' END AS ok FROM mentions) m) x"""
    q["intervening_rows"] = f"SELECT t.session, t.line_num, t.pair_index, {d.listed('shown', 'place')} AS between_lines FROM (SELECT DISTINCT t.session, t.line_num, t.pair_index, s.line_num AS place, s.speaker || ': ' || s.sentence AS shown FROM transitions t JOIN sites s ON s.session = t.session AND s.line_num > t.previous_line AND s.line_num < t.line_num) t GROUP BY t.session, t.line_num, t.pair_index"
    q["discourse_inputs"] = "SELECT s.dyad, s.session, s.line_num, s.pair_index, s.speaker, s.noun, s.det AS original_det, s.det_char_start, s.det_char_end, substr(s.sentence, 1, s.det_char_start) || '{{MASK}}' || substr(s.sentence, s.det_char_end + 1) AS masked_position, u.context_start AS context_start_line_num FROM sites s JOIN lines u ON u.session = s.session AND u.line_num = s.line_num".replace("{{", "{").replace("}}", "}")
    q["cross_speaker_inputs"] = q["cross_speaker_inputs"].replace("{{MASK}}", "{MASK}")
    # The attested mode: cases with a mention by the other speaker, of items that both have used with both determiners by that session.
    q["attested_inputs"] = f"SELECT c.* FROM ({q['cross_speaker_inputs']}) c JOIN restricted t ON t.session = c.session AND t.line_num = c.line_num AND t.pair_index = c.pair_index WHERE c.has_prior_mention"
    # Two corpora, the even and the odd sessions: Welch's test of their dyads' rates for each speaker.
    halves = "SELECT speaker, session % 2 AS corpus, dyad, avg(CASE WHEN det <> previous_det THEN 1e0 ELSE 0e0 END) AS tpr FROM transitions GROUP BY speaker, session % 2, dyad"
    of_half = lambda i: f"(SELECT speaker, count(*) AS n, avg(tpr) AS mean, var_samp(tpr) AS v FROM ({halves}) h WHERE corpus = {i} GROUP BY speaker)"
    welch = f"SELECT a.speaker, a.n AS n_even, b.n AS n_odd, a.mean AS mean_even, b.mean AS mean_odd, (a.mean - b.mean) / nullif(sqrt(a.v / a.n + b.v / b.n), 0) AS t, pow(a.v / a.n + b.v / b.n, 2) / nullif(pow(a.v / a.n, 2) / nullif(a.n - 1, 0) + pow(b.v / b.n, 2) / nullif(b.n - 1, 0), 0) AS df FROM {of_half(0)} a JOIN {of_half(1)} b ON b.speaker = a.speaker"
    q["corpus_equivalence"] = f"SELECT speaker, n_even, n_odd, {r9('mean_even', 'mean_even')}, {r9('mean_odd', 'mean_odd')}, {r9('t', 't', 7)}, {r9('df', 'df', 7)}, {r9(p_value_any(d, 't', 'df'), 'p', 6)} FROM ({welch}) w"
    # A prompt's budget is the model's; a target that doesn't fit alone is skipped. Whole lines only.
    fits = ", ".join(f"WHEN {r} THEN struct(n_{r - 10} AS n, start_{r - 10} AS start)" for r in ROOMS)
    fits = f"CASE m.room {fits.replace(', WHEN', ' WHEN')} END"
    rooms = "(SELECT *, CAST(max_tokens / 8 AS INT) AS room FROM models) m"
    q["discourse_budget"] = f"SELECT model_name, model_type, session, line_num, tokens, f.n AS context_length, coalesce(f.start, line_num) AS start_line, f.n < pos - 1 AS truncated FROM (SELECT m.model_name, m.model_type, t.session, t.line_num, t.tokens, t.pos, {fits} AS f FROM {rooms} JOIN ({budgeted([r - 10 for r in ROOMS])}) t ON t.tokens + 10 <= m.room) x" if d.spark else "SELECT m.model_name, m.model_type, t.session, t.line_num, t.tokens, count(u.line_num) AS context_length, coalesce(min(u.line_num), t.line_num) AS start_line, count(u.line_num) < t.pos - 1 AS truncated FROM (SELECT *, CAST(max_tokens / 8 AS INT) AS room FROM models) m CROSS JOIN lines t LEFT JOIN lines u ON u.session = t.session AND u.pos < t.pos AND t.upto - t.tokens - u.upto + u.tokens <= m.room - t.tokens - 10 WHERE t.tokens + 10 <= m.room GROUP BY m.model_name, m.model_type, t.session, t.line_num, t.tokens, t.pos"
    q["isolated_scores"] = f"SELECT model_name, model_type, dyad, speaker, count(*) AS n, {r9('avg(p_the)', 'mean_the')}, {r9('avg(CASE WHEN argmax = det THEN 1e0 ELSE 0e0 END)', 'argmax_accuracy')}, {r9('avg(CASE WHEN sampled = det THEN 1e0 ELSE 0e0 END)', 'sample_accuracy')} FROM predictions GROUP BY model_name, model_type, dyad, speaker"

    # Names and cells
    q["model_keys"] = f"SELECT model_name, model_type || '::' || model_name AS model_key, base_name, {L.arch('model_type')} AS arch, {L.family('base_name', 'model_type')} AS family, CASE WHEN model_type = 'mlm' THEN '' ELSE '_' || model_type END AS suffix FROM (SELECT s.*, k.base_name FROM scored_models s JOIN models k ON k.model_name = s.model_name) m"
    gap, mark = ("\\\\s+([.,!?;:])", "$1") if d.spark else ("\\s+([.,!?;:])", "\\1")
    space, g = ("\\\\s+" if d.spark else "\\s+"), ("" if d.spark else ", 'g'")
    q["punctuation_normal"] = f"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '{gap}', '{mark}'{g}), '{space}', ' '{g})) AS normal FROM conversations"
    cells = f"SELECT v.speaker, v.p, m.mean AS m, m.sd FROM ({tested(d, 'SELECT speaker, empirical - predicted AS x FROM humans', 'speaker')}) v JOIN (SELECT speaker, avg(empirical) AS mean, stddev_samp(empirical) AS sd FROM humans GROUP BY speaker) m ON m.speaker = v.speaker"
    q["report_cells"] = f"SELECT speaker, {L.stars('p')} AS stars, {L.p_text(d, 'p')} AS p_text, {L.mark('p')} AS mark, {L.test_cell(d, 'p')} AS cell, {L.mean_sd(d, 'm', 'sd')} AS mean_sd FROM ({cells}) x"

    # Report tables
    child_sig = f"(SELECT * FROM ({sig}) g0 WHERE speaker = 'child') o"
    tprs = f"(SELECT model_name, model_type, avg(tpr_overall) AS tpr, stddev_samp(tpr_overall) AS sd FROM model_dyads WHERE speaker = 'child' GROUP BY model_name, model_type) t"
    full = f"SELECT k.base_name, {L.arch('o.model_type')} AS arch, o.*, t.tpr, t.sd AS sd_tpr, f.p1, a.accuracy FROM {child_sig} JOIN {tprs} ON t.model_name = o.model_name AND t.model_type = o.model_type JOIN models k ON k.model_name = o.model_name LEFT JOIN ({four}) f ON f.model_name = o.model_name AND f.model_type = o.model_type LEFT JOIN (SELECT model_name, avg(accuracy) AS accuracy FROM model_bias WHERE speaker = 'child' GROUP BY model_name) a ON a.model_name = o.model_name"
    q["joint_results"] = f"SELECT model_name, arch, {r9('mean_bias', 'bias')}, {r9('mean_empirical', 'empirical')}, {r9('mean_predicted', 'predicted')}, {r9('tpr', 'tpr')}, {r9('p', 'p_overlap', 7)}, {r9('p1', 'p_tpr', 7)}, {r9('accuracy', 'accuracy')}, row_number() OVER (ORDER BY tpr DESC, model_name) AS ypos FROM ({full}) x"
    q["full_results_table"] = f"SELECT base_name AS model, arch, {L.fixed(d, 'mean_bias')} AS bias, {L.mean_sd(d, 'mean_empirical', 'sd_empirical')} AS empirical, {L.mean_sd(d, 'mean_predicted', 'sd_predicted')} AS predicted, {L.mean_sd(d, 'tpr', 'sd_tpr')} AS tpr, {L.test_cell(d, 'p')} AS dxn_test, {L.test_cell(d, 'p1')} AS tpr_test, {L.fixed(d, 'accuracy')} AS accuracy FROM ({full}) x"
    specs = ", ".join(f"({i + 1}, '{m}')" for i, m in enumerate(L.MAIN_MODELS))
    q["main_table"] = f"SELECT s.place, x.model, x.arch, x.dxn_test, x.tpr_test, x.accuracy FROM (VALUES {specs}) AS s(place, model) JOIN ({q['full_results_table']}) x ON x.model = s.model"
    q["cross_significance"] = f"SELECT o.model_name, o.model_type, {L.p_text(d, 'o.p')} AS overlap_p, {L.stars('o.p')} AS overlap_stars, {L.p_text(d, 'f.p1')} AS tpr_p, {L.stars('f.p1')} AS tpr_stars FROM {child_sig} LEFT JOIN ({four}) f ON f.model_name = o.model_name AND f.model_type = o.model_type"
    q["human_validation"] = f"SELECT h.dyad, h.speaker, h.n, h.s, {r9('h.bias', 'bias')}, {r9('h.empirical', 'empirical')}, {r9('h.predicted', 'predicted')}, r.n_total AS n_tpr, {r9('r.tpr', 'tpr')} FROM ({human}) h LEFT JOIN (SELECT dyad, speaker, CAST(n_total AS BIGINT) AS n_total, tpr FROM dyads) r ON r.dyad = h.dyad AND r.speaker = h.speaker"
    q["human_summary"] = "SELECT speaker, count(DISTINCT dyad) AS n_dyads, count(DISTINCT session) AS n_sessions, count(*) AS n_lines, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM utterances WHERE speaker IS NOT NULL GROUP BY speaker"
    q["facet_points"] = f"SELECT {L.family('k.base_name', 'o.model_type')} AS family, o.model_name, facet, {r9('value', 'value')} FROM (SELECT model_name, model_type, 'overlap' AS facet, mean_empirical - mean_predicted AS value FROM {child_sig} UNION ALL SELECT model_name, model_type, 'tpr' AS facet, tpr AS value FROM {tprs} UNION ALL SELECT model_name, model_type, 'accuracy' AS facet, mean_accuracy AS value FROM {child_sig}) o JOIN models k ON k.model_name = o.model_name"
    return q


def _window(name: str, kind: str) -> str:
    """Tokens that a model attends to, by its name and type."""
    return f"CASE WHEN {kind} = 'ar' OR contains(lower({name}), 'gpt') OR contains(lower({name}), 'llama') OR contains(lower({name}), 'causal') OR contains(lower({name}), 'opt') THEN 1024 ELSE 512 END"


def ranked(d: Dialect) -> str:
    """lang, frequency and rank of every noun. Ranks come from a histogram of frequencies, so no window sees every noun."""
    counts = "SELECT lang, f, m, sum(m) OVER (PARTITION BY lang ORDER BY f DESC) - m AS before FROM (SELECT lang, CAST(a + the AS DOUBLE) AS f, count(*) AS m FROM nouns GROUP BY lang, a + the) h"
    each = "LATERAL (SELECT explode(sequence(1, CAST(g.m AS INT))) AS i) i" if d.spark else "LATERAL (SELECT unnest(range(1, CAST(g.m AS INT) + 1)) AS i) i"
    return f"SELECT g.lang, g.f, CAST(g.before + i.i AS DOUBLE) AS rk FROM ({counts}) g, {each}"


#: Whole-number columns whose types differ between the engines.
LONG = {"k_grid": ["k"], "tests_by_k": ["n_cases", "adult_n"], "distance_describe": ["least", "most"], "window_reference": ["k"], "context_cap": ["tokens", "max_lines"]}
