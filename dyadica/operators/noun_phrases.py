"""Noun phrases behind determiners by a hidden Markov model whose counts come from the corpus: no tagged text, no weights.

Tokens are words (an apostrophe may part letters, as in `dog's`), sentence marks and line breaks, lower-cased. A window is a
determiner and the WIDTH tokens behind it. Tags are M (modifier), H (head) and O (anything else); function words, determiners, marks and the
end of a text are O, possessives M.

Counts. A word between a determiner and a token that is O is a head; a word that is ever a head is attested. Where another word follows it, the
first is a modifier and the second its head if the second is attested, else the first is a head before an O. Behind pronouns and auxiliaries (CUES) a word is an O. These
counts, each with DELTA added, give emissions and transitions; an O ends the phrase, so only O follows it. Scores are whole millionths of ln, so equal paths tie in any order of
summing; of these the last in alphabetical order wins. `decode` is Viterbi's recursion as a fold over the window.

The phrase is the run of M and H behind the determiner; its last word is the head, the words before it the gap (a possessive counts
two). A pair has a last word that is tagged H and doesn't look plural, and a gap of max_gap at most; an becomes a.

Defined results: null and empty texts, and texts without determiners, have no rows; a text that is there twice has its rows twice; columns other than
the keys and the text are not looked at. With an empty corpus all scores are the smoothed ones. Words that the corpus doesn't have get DELTA.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import Store

WIDTH, DELTA, NEVER, END = 3, 0.5, -(10**12), "."
TAGS = ("D", "M", "H", "O")
TOKEN = r"\p{L}+(?:['’]\p{L}+)?|[.!?;:\n]"
DETERMINERS = ("a", "an", "the")
# English function words, those behind which verbs stand, and plurals without a regular ending.
CUES = ("i", "you", "he", "she", "it", "we", "they", "who", "to", "not", "will", "would", "can", "could", "shall", "should", "may", "might", "must", "do", "does", "did", "don't", "can't", "let's")
FUNCTION = (
    *CUES, *DETERMINERS, "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their", "me", "him", "us", "them", "and", "or", "but", "if", "when", "because", "so", "than", "then",
    "of", "in", "on", "at", "by", "for", "with", "from", "into", "over", "under", "about", "up", "down", "out", "off", "as", "is", "isn't", "are", "aren't", "was", "wasn't", "were", "am", "be", "been", "being",
    "has", "have", "had", "what", "where", "which", "there", "here", "no", "yes", "very", "too", "now",
)
IRREGULAR = ("men", "women", "people", "children", "feet", "teeth", "geese", "mice")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _plural(w: Column) -> Column:
    return w.isin(*IRREGULAR) | w.rlike("[^sui]s$") & (F.length(w) > 3)


def _other(w: Column) -> Column:
    return w.isin(*FUNCTION) | ~w.rlike(r"\p{L}")


def _possessive(w: Column) -> Column:
    return w.rlike("['’]s$") & ~w.isin(*FUNCTION)


def _each(texts: DataFrame, keys: Sequence[str], text: str, make) -> DataFrame:
    """Rows of keys and `x`, what make(tokens, token, place) gives for each token, where it isn't null."""
    bound = F.transform(F.array(tokens(F.col(text))), lambda t: F.filter(F.transform(t, lambda w, i: make(t, w, i)), lambda x: x.isNotNull()))
    return texts.where(F.col(text).isNotNull()).select(*keys, F.explode(F.get(bound, F.lit(0))).alias("x"))


class Model:
    """Words with their counts as head, modifier and other (a table of the store), and whole-number scores of transitions."""

    def __init__(self, corpus: DataFrame, store: Store, key: str, text: str = "text"):
        """corpus: rows with `text`. key: what the counts depend on, as the store asks."""

        def pair(t, w, i):
            before, behind = F.get(t, i - 1), F.coalesce(F.get(t, i + 1), F.lit(END))
            kind = F.when(before.isin(*DETERMINERS), "d").when(before.isin(*CUES), "c")
            return F.when(kind.isNotNull() & ~_other(w), F.struct(kind.alias("kind"), w.alias("word"), F.when((kind == "d") & ~_other(behind), behind).alias("next")))

        # Counted before they are shuffled on, so common words are no hot keys.
        seen = store.relation("nounpairs", key, lambda: _each(corpus, [], text, pair).select("x.*").groupBy("kind", "word", "next").agg(F.count("*").alias("n")))

        def lexicon():
            heads = seen.where("kind = 'd' AND next IS NULL").select(F.col("word").alias("next"), F.lit(True).alias("attested"))
            first = seen.where("kind = 'd' AND next IS NOT NULL").join(heads, "next", "left")
            known = F.col("attested").isNotNull()
            parts = seen.where("next IS NULL").select("word", F.when(F.col("kind") == "d", F.col("n")).otherwise(0).alias("head"), F.lit(0).alias("modifier"), F.when(F.col("kind") == "c", F.col("n")).otherwise(0).alias("other"))
            own = first.select("word", F.when(known, 0).otherwise(F.col("n")).alias("head"), F.when(known, F.col("n")).otherwise(0).alias("modifier"), F.lit(0).alias("other"))
            behind = first.select(F.col("next").alias("word"), F.when(known, F.col("n")).otherwise(0).alias("head"), F.lit(0).alias("modifier"), F.when(known, 0).otherwise(F.col("n")).alias("other"))
            return parts.unionByName(own).unionByName(behind).groupBy("word").agg(*[F.sum(c).cast("long").alias(c) for c in ("head", "modifier", "other")])

        self.words = store.relation("nounwords", key, lexicon)
        n = self.words.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(c), F.lit(0)).alias(t) for c, t in (("head", "H"), ("modifier", "M"), ("other", "O"))]).first()
        self.total, self.v = {t: n[t] for t in "MHO"}, n["v"]
        counts = {"D": {"M": n["M"], "H": n["H"] - n["M"]}, "M": {"H": n["M"]}, "H": {"O": n["H"]}}
        self.moves = {s: {t: round(1e6 * math.log((c.get(t, 0) + DELTA) / (sum(c.values()) + DELTA * 3))) if t != "D" else NEVER for t in TAGS} for s, c in counts.items()}
        self.moves["O"] = {t: 0 if t == "O" else NEVER for t in TAGS}

    def emissions(self, word: Column) -> Column:
        """Scores of word for each of TAGS; head, modifier and other are columns, null where the corpus hasn't the word."""
        score = lambda c, tag: F.round(1e6 * F.ln((F.coalesce(F.col(c), F.lit(0)) + DELTA) / (self.total[tag] + DELTA * (self.v + 1)))).cast("long")
        never, none = F.lit(NEVER).cast("long"), F.lit(0).cast("long")
        free = F.array(never, score("modifier", "M"), score("head", "H"), score("other", "O"))
        return F.when(_other(word), F.array(never, never, never, none)).when(_possessive(word), F.array(never, none, never, never)).otherwise(free)

    def decode(self, scores: Column) -> Column:
        """The best path's tags, as a string, of an array of emissions behind a determiner."""
        moves = F.array(*[F.array(*[F.lit(self.moves[s][t]).cast("long") for s in TAGS]) for t in TAGS])
        names = F.array(*map(F.lit, TAGS))
        start = F.array(*[F.struct(F.lit(0 if t == "D" else NEVER).cast("long").alias("score"), F.lit("").alias("path")) for t in TAGS])

        def step(acc, e):
            to = lambda tag, t: F.array_max(F.transform(acc, lambda x, s: F.struct((x["score"] + F.get(F.get(moves, t), s) + F.get(e, t)).alias("score"), F.concat(x["path"], tag).alias("path"))))
            return F.transform(names, to)

        return F.aggregate(scores, start, step, lambda acc: F.array_max(acc)["path"])

    def phrases(self, texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
        """keys, `det_token` (number of the determiner among the tokens, from 1), form, words (the window) and tags, for each determiner of texts."""
        window = lambda t, i: F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), lambda k: F.coalesce(F.get(t, i + k), F.lit(END)))
        sites = _each(texts, keys, text, lambda t, w, i: F.when(w.isin(*DETERMINERS), F.struct((i + 1).alias("det_token"), w.alias("form"), window(t, i).alias("words"))))
        sites = sites.select(*keys, "x.*")
        # Each different window is tagged once.
        each = sites.groupBy("words").agg(F.count("*").alias("_n")).select("words", F.posexplode("words").alias("_k", "word"))
        scored = each.join(self.words.select("word", "head", "modifier", "other"), "word", "left").select("words", "_k", self.emissions(F.col("word")).alias("_e"))
        found = scored.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("_k", "_e"))).alias("_es"))
        tagged = found.select("words", self.decode(F.transform("_es", lambda x: x["_e"])).alias("tags"))
        return sites.join(tagged, "words").select(*keys, "det_token", "form", "words", "tags")

    def pairs(self, texts: DataFrame, keys: Sequence[str], max_gap: int = 1, text: str = "text") -> DataFrame:
        """keys, det_token, form, det, noun and gap of the pairs of texts. max_gap: WIDTH - 2 at most, as the token behind the head decides too."""
        if max_gap > WIDTH - 2:
            raise ValueError(f"max_gap is at most {WIDTH - 2}")
        run = F.regexp_extract("tags", "^[MH]*", 0)
        own = F.slice("words", F.lit(1), F.greatest(F.length(run) - 1, F.lit(0)))
        gap = F.aggregate(own, F.lit(0), lambda acc, w: acc + 1 + F.when(_possessive(w), 1).otherwise(0))
        rows = self.phrases(texts, keys, text).where(run.endswith("H")).withColumns({"gap": gap, "noun": F.get("words", F.length(run) - 1)}).where((F.col("gap") <= max_gap) & ~_plural(F.col("noun")))
        return rows.select(*keys, "det_token", "form", F.when(F.col("form") == "the", "the").otherwise("a").alias("det"), "noun", "gap")


def query(spark, sf_dir, store=None, always=()):
    """The pairs of all conversations, by the counts of all documents."""
    from ..catalogue import input_key

    store = store or Store(spark)
    model = Model(spark.read.parquet(f"{sf_dir}/documents.parquet"), store, input_key(spark, sf_dir, store))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("session"), F.col("turn").alias("line_num"), "text")
    return model.pairs(rows, ["session", "line_num"]).withColumn("det_token", F.col("det_token").cast("long")).withColumn("gap", F.col("gap").cast("long"))


def _in(words: Sequence[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def duck_sql() -> str:
    """Straight from the definition: every path of tags of every window, of which the best is taken."""
    other = lambda w: f"({w} IN {_in(FUNCTION)} OR NOT regexp_matches({w}, '\\p{{L}}'))"
    plural = lambda w: f"({w} IN {_in(IRREGULAR)} OR (regexp_matches({w}, '[^sui]s$') AND length({w}) > 3))"
    possessive = lambda w: f"(regexp_matches({w}, '[''’]s$') AND {w} NOT IN {_in(FUNCTION)})"
    cut = "regexp_extract_all(lower(text), '" + TOKEN.replace("'", "''").replace("\\n", "\n") + "')"
    e = lambda c, total: f"CAST(round(1e6 * ln((coalesce(l.{c}, 0) + 0.5e0) / (s.{total} + 0.5e0 * (s.v + 1)))) AS BIGINT)"
    t = lambda frm, to, x, row: f"SELECT '{frm}' AS frm, '{to}' AS tag, CAST(round(1e6 * ln(({x} + 0.5e0) / ({row} + 1.5e0))) AS BIGINT) AS move FROM sums"
    rows, whole = {"D": {"M": "m", "H": "h - m"}, "M": {"H": "m"}, "H": {"O": "h"}}, {"D": "h", "M": "m", "H": "h"}
    moves = " UNION ALL ".join(t(s, tag, f"({c.get(tag, '0')})", whole[s]) for s, c in rows.items() for tag in "MHO") + " UNION ALL SELECT 'O', 'O', 0"
    step = lambda k: f"p{k} AS (SELECT p.w1, p.w2, p.w3, p.score + m.move + e.e AS score, concat(p.path, e.tag) AS path, e.tag FROM p{k - 1} p JOIN emit e ON e.word = p.w{k} JOIN moves m ON m.frm = p.tag AND m.tag = e.tag)"
    return f"""WITH dt AS (SELECT {cut} AS t FROM documents WHERE text IS NOT NULL),
dk AS (SELECT t[i - 1] AS before, t[i] AS word, coalesce(t[i + 1], '.') AS behind FROM dt, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i) x),
d2 AS (SELECT before IN {_in(DETERMINERS)} AS det, before IN {_in(CUES)} AS cue, word, behind, {other('behind')} AS closed FROM dk WHERE NOT {other('word')}),
att AS (SELECT DISTINCT word FROM d2 WHERE det AND closed),
d3 AS (SELECT d.*, a.word IS NOT NULL AS known FROM d2 d LEFT JOIN att a ON a.word = d.behind AND NOT d.closed),
ev AS (SELECT word, CASE WHEN det AND (closed OR NOT known) THEN 1 ELSE 0 END AS head, CASE WHEN det AND NOT closed AND known THEN 1 ELSE 0 END AS modifier, CASE WHEN cue THEN 1 ELSE 0 END AS other FROM d3 WHERE det OR cue
  UNION ALL SELECT behind, CASE WHEN known THEN 1 ELSE 0 END, 0, CASE WHEN known THEN 0 ELSE 1 END FROM d3 WHERE det AND NOT closed),
lex AS (SELECT word, sum(head) AS head, sum(modifier) AS modifier, sum(other) AS other FROM ev GROUP BY word),
sums AS (SELECT count(*) AS v, coalesce(sum(head), 0) AS h, coalesce(sum(modifier), 0) AS m, coalesce(sum(other), 0) AS o FROM lex),
moves AS ({moves}),
ct AS (SELECT conv_id AS session, turn AS line_num, {cut} AS t FROM conversations WHERE text IS NOT NULL),
win AS (SELECT session, line_num, i AS det_token, t[i] AS form, coalesce(t[i + 1], '.') AS w1, coalesce(t[i + 2], '.') AS w2, coalesce(t[i + 3], '.') AS w3 FROM ct, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i) x WHERE t[i] IN {_in(DETERMINERS)}),
wd AS (SELECT w1 AS word FROM win UNION SELECT w2 FROM win UNION SELECT w3 FROM win),
kinds AS (SELECT w.word, {other('w.word')} AS o, {possessive('w.word')} AS poss, {e('modifier', 'm')} AS em, {e('head', 'h')} AS en, {e('other', 'o')} AS eo FROM wd w LEFT JOIN lex l ON l.word = w.word CROSS JOIN sums s),
emit AS (SELECT word, 'O' AS tag, 0 AS e FROM kinds WHERE o UNION ALL SELECT word, 'M', 0 FROM kinds WHERE poss AND NOT o UNION ALL SELECT word, 'M', em FROM kinds WHERE NOT o AND NOT poss
  UNION ALL SELECT word, 'H', en FROM kinds WHERE NOT o AND NOT poss UNION ALL SELECT word, 'O', eo FROM kinds WHERE NOT o AND NOT poss),
p0 AS (SELECT DISTINCT w1, w2, w3, 0 AS score, '' AS path, 'D' AS tag FROM win), {step(1)}, {step(2)}, {step(3)},
best AS (SELECT *, regexp_extract(path, '^[MH]*') AS run FROM (SELECT *, row_number() OVER (PARTITION BY w1, w2, w3 ORDER BY score DESC, path DESC) AS place FROM p3) x WHERE place = 1),
heads AS (SELECT w.session, w.line_num, w.det_token, w.form, CASE WHEN w.form = 'the' THEN 'the' ELSE 'a' END AS det, CASE length(run) WHEN 1 THEN w.w1 WHEN 2 THEN w.w2 ELSE w.w3 END AS noun,
  length(run) - 1 + CASE WHEN length(run) > 1 AND {possessive('w.w1')} THEN 1 ELSE 0 END + CASE WHEN length(run) > 2 AND {possessive('w.w2')} THEN 1 ELSE 0 END AS gap
  FROM win w JOIN best b ON b.w1 = w.w1 AND b.w2 = w.w2 AND b.w3 = w.w3 WHERE run LIKE '%H')
SELECT session, line_num, CAST(det_token AS BIGINT) AS det_token, form, det, noun, CAST(gap AS BIGINT) AS gap FROM heads WHERE gap <= 1 AND NOT {plural('noun')}"""
