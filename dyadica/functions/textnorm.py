"""The normaliser of CHAT transcripts: an ordered list of replacements, folded over a column."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and replacements, in the order in which they apply (R1 to R36; then trim, R37).
RULES = (
    (r"^\*[A-Z]+:\s*", ""), (r"\bxxx\b", ""), (r"\byyyy\b", ""), (r"\bwww\b", ""), (r"\[\*[^\]]*?&?=?0(\w+)[^\]]*\]", "$1"), (r"&=0(\w+)", "$1"),
    (r"(\w+)\s*\[/\]\s*\1\b", "$1"), (r"<[^>]+>\s*\[/\]\s*", ""), (r"\b0\w+", ""), (r"&=[^\s]+", ""), (r"&-\w+", ""), (r"&\+[^\s]+", ""), (r"&\w+", ""),
    (r"\[[^\]]*\]", ""), (r"<[^>]*>", ""), (r"\+\.\.\.?", ""), (r"\+/\.?", ""), (r"\+//\.?", ""), (r"\+\^", ""), (r"\+,", ""), (r"\+\+", ""), (r'\+"', ""), (r'"\+', ""),
    (r"[↓↑ˈˌ]", ""), (r"\(\.+\)", ""), (r"\(\d+\.?\d*\)", ""), (r"(\w):+", "$1"), (r"\^", ""), ("≠", ""), ("↫", ""), (r"(\w)\+(\w)", "$1 $2"),
    (r"(\w+)\([^\)]+\)", "$1"), (r"\([^\)]+\)(\w+)", "$1"), (r"@[a-z]", ""), (r"\s+", " "), (r"\s+([.,!?])", "$1"),
)


def clean(text: Column, fix_yyy: bool = False) -> Column:
    """text without annotation marks; null stays null. fix_yyy: also drop `yyy`, which the rules leave."""
    for pattern, replacement in RULES:
        if fix_yyy and "yyyy" in pattern:
            pattern = pattern.replace("yyyy", "yyyy?")
        text = F.regexp_replace(text, "(?U)" + pattern, replacement)
    return F.trim(text)
