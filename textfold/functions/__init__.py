from .hashing import hash_key, uniform32, TWO32
from .text import normalize_quotes, coerce_text_col, TOKEN_PATTERN
from .numeric import sigmoid, decide, bce_with_logits

__all__ = ["hash_key", "uniform32", "TWO32", "normalize_quotes", "coerce_text_col",
           "TOKEN_PATTERN", "sigmoid", "decide", "bce_with_logits"]
