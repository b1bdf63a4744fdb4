"""Fill-in-middle transformation by a parallel automaton scan.

An automaton over UTF-8 bytes counts a text's tokens (a word with the white space before it; white space at the end is one too)
and the control strings in it. Any piece of bytes stands for the automaton's transition function: for each state at its
start, the state at its end, the tokens that ended and the control strings that were seen. Such functions compose
associatively. numpy composes those of neighbouring blocks pairwise, from four bytes up, into a tree; going down the
tree again finds the byte where the k-th token ends.

A text of at most CHUNK bytes is scanned where it lies. A longer one is dealt out in chunks over the executors, each
different text once; each chunk gives its function, composing these resolves the state and the count at each chunk's
start, and those select the one chunk for each cut, which alone is scanned again. A text has less than 2 GB, so at most
65,536 chunks of some 36 bytes are composed together.

`transform` adds n, form, prefix_chars, middle_chars and output; `restore` rebuilds the text from output and form. Text
without control strings is never ambiguous between them, as no control string overlaps another.

Defined results: a null or empty text has no tokens and stays plain, as does a text that holds a control string. A null
id is hashed as no digits. Equal rows get equal results. Columns of the docs pass through; those that this module makes
replace others of the same name. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT, CHUNK = 42, 50, 80, 32_768
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")

#: Classes of bytes: white space, `<`, a control string's letter, `>`, other, and nothing at all, which fills blocks.
SPACE, OPEN, LETTER, CLOSE, OTHER, NOTHING = range(6)
#: States: between words; in a word; in a word behind `<`; behind `<` and a letter.
STATES, BLOCK = 4, 4


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, ended tokens and seen control strings, by state and class."""
    after = np.ones((STATES, 6), "int32")
    after[:, SPACE], after[:, OPEN], after[2, LETTER], after[:, NOTHING] = 0, 2, 3, range(STATES)
    ended, seen = np.zeros((STATES, 6), "int32"), np.zeros((STATES, 6), "int32")
    ended[1:, SPACE], seen[3, CLOSE] = 1, 1
    return after, ended, seen


def _class_of() -> np.ndarray:
    out = np.full(256, OTHER, "int32")
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[ord("<")], out[ord(">")], out[[ord(c) for c in "PSM"]] = OPEN, CLOSE, LETTER
    return out


def _blocks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions of all blocks of BLOCK classes, by their number in base 6."""
    after, ended, seen = _automaton()
    codes = np.arange(6**BLOCK)[:, None]
    at = np.broadcast_to(np.arange(STATES), (6**BLOCK, STATES))
    n, hits = np.zeros(at.shape, "int32"), np.zeros(at.shape, "int32")
    for i in reversed(range(BLOCK)):
        c = codes // 6**i % 6
        n, hits, at = n + ended[at, c], hits + seen[at, c], after[at, c]
    return at.astype("int32"), n, hits


CLASS_OF, BLOCKS = _class_of(), _blocks()
CUTS = StructType().add("n", "long").add("seen", "boolean").add("first", "long").add("last", "long")
ENTRIES = StructType().add("n", "long").add("seen", "boolean").add("entries", ArrayType(StructType().add("state", "long").add("before", "long")))


def compose(first: tuple, second: tuple) -> tuple:
    """The functions of neighbouring pieces, row by row, as functions of the joined pieces."""
    after, ended, seen = first
    at = after + np.arange(0, STATES * len(after), STATES, dtype="int32")[:, None]
    return second[0].ravel()[at], ended + second[1].ravel()[at], seen + second[2].ravel()[at]


def tree(data: bytes) -> list[tuple]:
    """The functions of a piece's blocks, of pairs of them, and so on up to the whole piece."""
    classes = CLASS_OF[np.frombuffer(data, "uint8")]
    width = BLOCK * max(1, 1 << max(0, (-(-len(classes) // BLOCK) - 1)).bit_length())
    padded = np.full(width, NOTHING, "int32")
    padded[: len(classes)] = classes
    codes = padded.reshape(-1, BLOCK) @ (6 ** np.arange(BLOCK - 1, -1, -1, dtype="int32"))
    levels = [tuple(t[codes] for t in BLOCKS)]
    while len(levels[-1][0]) > 1:
        levels.append(compose(tuple(t[0::2] for t in levels[-1]), tuple(t[1::2] for t in levels[-1])))
    return levels


def locate(levels: list[tuple], data: bytes, state: int, k: int) -> int:
    """The byte at which the k-th token (from 1) of a piece entered in `state` has ended."""
    at = 0
    for after, ended, _ in reversed(levels[:-1]):
        at *= 2
        if ended[at, state] < k:
            k, state, at = k - int(ended[at, state]), int(after[at, state]), at + 1
    after, ended, _ = _automaton()
    for i in range(at * BLOCK, len(data)):
        c = CLASS_OF[data[i]]
        k -= ended[state, c]
        if not k:
            return i
        state = after[state, c]
    raise ValueError("the piece has no such token")


@F.pandas_udf(CUTS)
def _cuts(data: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Of whole texts: the number of tokens, whether there is a control string, and where the prefix and the middle end."""
    out = []
    for text, a, b in zip(data, h1, h2, strict=True):
        levels = tree(text)
        n = int(levels[-1][1][0, 0]) + 1 if text else 0
        cuts = sorted((a % (n + 1), b % (n + 1)))
        out.append((n, bool(levels[-1][2][0, 0]), *[0 if not k else len(text) if k == n else locate(levels, text, 0, k) for k in cuts]))
    return pd.DataFrame(out, columns=["n", "seen", "first", "last"])


@F.pandas_udf(BinaryType())
def _function(data: pd.Series) -> pd.Series:
    """The transition function of each chunk."""
    return pd.Series([np.concatenate([t[0] for t in tree(x)[-1]]).astype("<i4").tobytes() for x in data], dtype=object)


@F.pandas_udf(ENTRIES)
def _resolve(functions: pd.Series) -> pd.DataFrame:
    """The functions of each text's chunks, in order, composed from the first state on: state and count where each chunk begins."""
    out = []
    for own in functions:
        state, before, hits, entries = 0, 0, 0, []
        for f in own:
            after, ended, seen = np.frombuffer(f, "<i4").reshape(3, STATES)
            entries.append((state, before))
            state, before, hits = int(after[state]), before + int(ended[state]), hits + int(seen[state])
        out.append((before + 1, hits > 0, entries))
    return pd.DataFrame(out, columns=["n", "seen", "entries"])


@F.pandas_udf(LongType())
def _located(data: pd.Series, state: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([locate(tree(x), x, int(s), int(i)) if i > 0 else 0 for x, s, i in zip(data, state, k, strict=True)], dtype="int64")


def _giant_cuts(giants: DataFrame) -> DataFrame:
    """giants (_data, _h1, _h2, ...) with _cuts, as _cuts gives them, from chunks on all executors."""
    giants = giants.withColumn("_digest", F.sha2("_data", 256))
    size = F.octet_length("_data")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")), lambda i: F.substring(F.col("_data"), i * CHUNK + 1, F.lit(CHUNK)))
    chunks = giants.select("_digest", F.posexplode(pieces).alias("chunk", "data"))
    own = chunks.groupBy("_digest", "chunk").agg(F.first("data").alias("data"))  # one of equal texts; dealt out by chunk
    functions = own.select("_digest", F.struct("chunk", _function("data").alias("f")).alias("f"))
    listed = functions.groupBy("_digest").agg(F.sort_array(F.collect_list("f")).alias("f"))  # 65,536 at most
    resolved = listed.select("_digest", _resolve(F.transform("f", lambda x: x["f"])).alias("_r"))
    rows = giants.join(resolved, "_digest")
    n = F.col("_r.n")
    k1, k2 = F.col("_h1") % (n + 1), F.col("_h2") % (n + 1)
    rows = rows.withColumns({"_k1": F.least(k1, k2), "_k2": F.greatest(k1, k2)})
    ends = []
    for k in ("_k1", "_k2"):
        inner = (F.col(k) > 0) & (F.col(k) < n)
        chunk = F.size(F.filter("_r.entries", lambda e: e["before"] < F.col(k))) - 1  # noqa: B023
        entry = F.get("_r.entries", F.greatest(chunk, F.lit(0)))
        data = F.when(inner, F.substring(F.col("_data"), chunk * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b""))
        local = _located(data, entry["state"], F.when(inner, F.col(k) - entry["before"]).otherwise(F.lit(0).cast("long")))
        ends.append(F.when(inner, chunk.cast("long") * CHUNK + local).when(F.col(k) == 0, 0).otherwise(size.cast("long")))
    made = F.struct(n.alias("n"), F.col("_r.seen").alias("seen"), ends[0].alias("first"), ends[1].alias("last"))
    return rows.withColumn("_cuts", made).drop("_digest", "_r", "_k1", "_k2")


def transform(docs: DataFrame, *, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) with n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    number = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    own = docs.select(*[c for c in docs.columns if c not in MADE], F.coalesce("text", F.lit("")).cast("binary").alias("_data"), *[number(i).alias(f"_h{i + 1}") for i in range(4)])
    long = F.octet_length("_data") > CHUNK
    cut = own.where(~long).withColumn("_cuts", _cuts("_data", "_h1", "_h2")).unionByName(_giant_cuts(own.where(long)))
    part = lambda start, end: F.substring(F.col("_data"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")
    first, last, whole = F.col("_cuts.first"), F.col("_cuts.last"), F.octet_length("_data")
    form = F.when((whole == 0) | F.col("_cuts.seen") | (F.col("_h3") % 100 >= fim_percent), "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.withColumns({"n": F.col("_cuts.n"), "form": form})
    plain = F.col("form") == "plain"
    cut = cut.withColumns({"_p": part(F.lit(0), first), "_m": part(first, last), "_s": part(last, whole)})
    p, m, s = F.col("_p"), F.col("_m"), F.col("_s")
    output = F.when(plain, F.col("_data").cast("string")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    chars = lambda c: F.when(~plain, F.length(c).cast("long"))
    return cut.withColumns({"prefix_chars": chars(p), "middle_chars": chars(m), "output": output}).drop("_data", "_cuts", "_p", "_m", "_s", *[f"_h{i + 1}" for i in range(4)])


def restore(output: Column, form: Column) -> Column:
    """The text from output and form."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def query(spark, sf_dir):
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: hashes: the four numbers of each id. cuts: the texts' tokens, and how many of them end in the prefix and in prefix and middle.
SQL = f"""
WITH hashes AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tk, {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM hashes),
cuts AS (SELECT *, CAST(len(tk) AS BIGINT) AS n, least(h1 % (len(tk) + 1), h2 % (len(tk) + 1)) AS a, greatest(h1 % (len(tk) + 1), h2 % (len(tk) + 1)) AS b FROM numbers),
parts AS (SELECT doc_id, n, text, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(tk[1:a], '') AS p, array_to_string(tk[a + 1:b], '') AS m, array_to_string(tk[b + 1:n], '') AS s FROM cuts),
made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN string_split_regex(output, '<[PSM]>')[2] || string_split_regex(output, '<[PSM]>')[4] || string_split_regex(output, '<[PSM]>')[3]
    ELSE string_split_regex(output, '<[PSM]>')[3] || string_split_regex(output, '<[PSM]>')[4] || string_split_regex(output, '<[PSM]>')[2] END) AS restored_sha256 FROM made
"""
