"""Names, labels and cells of reports, as SQL expressions of either dialect."""

from __future__ import annotations

from ..dialect import Dialect

#: Families by the first rule whose parts all occur in the lower-case base name; a value may depend on the type.
FAMILY_RULES = (
    (("gpt2", "babylm-baseline"), "GPT-2"),
    (("babyberta",), "BabyBERTa"),
    (("elc_bert",), "ELC-BERT"),
    (("elc-bert",), "ELC-BERT"),
    (("ltg-bert",), "LTG-BERT"),
    (("ltgbert",), "LTG-BERT"),
    (("gpt-bert-babylm",), "GPT-BERT (MLM)"),
    (("babylm-baseline-10m-gpt-bert",), {"ar": "GPT-BERT (AR)", "mlm": "GPT-BERT (MLM)"}),
    (("babylm-baseline-100m-gpt-bert",), {"ar": "GPT-BERT (AR)", "mlm": "GPT-BERT (MLM)"}),
    (("roberta-base-strict",), "RoBERTa"),
    (("roberta-med-small",), "RoBERTa (nyu-mll variants)"),
    (("roberta-base-",), "RoBERTa (nyu-mll variants)"),
    (("roberta-base",), "RoBERTa"),
    (("roberta-large",), "RoBERTa"),
    (("babyllama",), "BabyLLaMA"),
    (("baby-llama",), "BabyLLaMA"),
    (("opt-125m-strict",), "OPT-125M"),
    (("opt-125m",), "OPT-125M"),
    (("opt",), "OPT-125M"),
    (("gpt2",), "GPT-2"),
    (("t5-base-strict",), "t5-base"),
    (("t5",), "t5-base"),
)
#: The family of what no rule fits, by type.
FAMILY_FALLBACK = {"mlm": "Other MLM", "ar": "Other AR", "s2s": "Other S2S", "seq2seq": "Other S2S"}
#: The models of the main table, in its order.
MAIN_MODELS = ("ltg-bert-bnc", "roberta-base", "t5-base", "babylm-baseline-100m-gpt-bert-causal-focus", "gpt-bert-babylm-small", "opt-125m", "gpt2", "roberta-base-strict-2023")


def _by_type(kind: str, values: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({kind}) = '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


def family(name: str, kind: str) -> str:
    """The family of a model, by name and type."""
    fallback = _by_type(kind, FAMILY_FALLBACK, "'Other'")
    whens = [(" AND ".join(f"contains(lower({name}), '{n}')" for n in needles), f"'{v}'" if isinstance(v, str) else _by_type(kind, v, fallback)) for needles, v in FAMILY_RULES]
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in whens) + f" ELSE {fallback} END"


def arch(kind: str) -> str:
    return f"CASE WHEN lower({kind}) = 'mlm' THEN 'MLM' WHEN lower({kind}) IN ('ar', 'autoregressive') THEN 'AR' WHEN lower({kind}) IN ('seq2seq', 's2s') THEN 'S2S' ELSE upper({kind}) END"


def stars(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'na' WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"


def fixed(d: Dialect, x: str, digits: int = 3) -> str:
    """x with that many decimals."""
    return f"format_string('%.{digits}f', CAST({x} AS DOUBLE))" if d.spark else f"printf('%.{digits}f', CAST({x} AS DOUBLE))"


def p_text(d: Dialect, p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'NA' WHEN {p} < 0.001 THEN '<0.001' ELSE {fixed(d, p)} END"


def mark(p: str, alpha: float = 0.05) -> str:
    return f"CASE WHEN coalesce({p} > {alpha}, false) THEN 'check' ELSE 'cross' END"


def test_cell(d: Dialect, p: str) -> str:
    return f"{mark(p)} || ' (' || {p_text(d, p)} || ')'"


def mean_sd(d: Dialect, mean: str, sd: str) -> str:
    return f"CASE WHEN {mean} IS NULL THEN 'NA' WHEN {sd} IS NULL THEN {fixed(d, mean)} || ' (NA)' ELSE {fixed(d, mean)} || ' (' || {fixed(d, sd)} || ')' END"
