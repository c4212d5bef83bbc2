"""Column-level text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The token rule. A token is one CJK ideograph, or a run of
# characters that are neither blank, punctuation, symbol nor CJK, or a single
# punctuation/symbol character. Blanks are listed (tab, LF, VT, FF, CR, space)
# and ranges use \x{...}, so Java regex and RE2 (DuckDB) read the rule the same way.
CJK_RANGES = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
BLANKS = r"\t\n\x{0B}\f\r\x{20}"
TOKEN_PATTERN = (r"[" + CJK_RANGES + r"]"
                 r"|[^" + BLANKS + r"\p{P}\p{S}" + CJK_RANGES + r"]+"
                 r"|[\p{P}\p{S}]")
# The same tokens for Java's regex alone: runs first, and ASCII letters and digits before the slower classes of a character. The
# first character decides between the alternatives, so their order does not matter.
FAST_TOKEN_PATTERN = (r"[0-9A-Za-z[^" + BLANKS + r"\p{P}\p{S}" + CJK_RANGES + r"]]+"
                      r"|[" + CJK_RANGES + r"]"
                      r"|[\p{P}\p{S}]")


def normalize_quotes(c: Column) -> Column:
    """Backtick to apostrophe first, then two apostrophes to a double quote (order matters)."""
    return F.replace(F.replace(c, F.lit("`"), F.lit("'")), F.lit("''"), F.lit('"'))


def coerce_text_col(c: Column, null_text: str = "nan") -> Column:
    """String form of any value; null becomes ``null_text`` (pandas ``str(NaN)`` gives 'nan')."""
    return F.coalesce(c.cast("string"), F.lit(null_text))
