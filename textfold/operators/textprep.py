"""Corpus preparation (B1-B7): paragraphs, titles, fixed windows, corpus-wide windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import coerce_text_col, normalize_quotes
from ..plans.ordering import _null_safe_join, ordered_prefix


def literal_regex(sep: str) -> str:
    """A regex that matches ``sep`` literally (Java regex), for ``split``."""
    return "".join(ch if ch.isalnum() else "\\x{%04X}" % ord(ch) for ch in sep)


def split_paragraphs(df: DataFrame, col: str = "text", sep: str = "\n\n",
                     out: str = "paragraph", pos: str = "para_no") -> DataFrame:
    """B1: one row per ``sep``-separated piece, empty pieces kept (as Python ``str.split``)."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(F.split(F.col(col), literal_regex(sep), -1)).alias(pos, out))


def drop_first_line(c: Column) -> Column:
    """B2: text after the first newline; a single-line paragraph becomes empty."""
    at = F.instr(c, "\n")
    return F.when(at == 0, F.lit("")).otherwise(F.substr(c, at + 1))


def chunk_text(df: DataFrame, col: str = "text", size: int = 1000,
               out: str = "chunk", pos: str = "chunk_no") -> DataFrame:
    """Non-overlapping ``size``-character windows per row; empty text gives no rows.

    Characters are code points, as in Python slicing.
    """
    rest = [c for c in df.columns if c != col]
    n = F.length(F.col(col))
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / F.lit(size)).cast("int")))
    d = df.select(*rest, F.col(col), F.explode(starts).alias(pos))
    return d.select(*rest, F.col(pos), F.substring(F.col(col), F.col(pos) * size + 1, F.lit(size)).alias(out))


def chunk_stream(df: DataFrame, col: str, bucket: Column, order: Sequence[Column], size: int = 1000,
                 groups_bound: int | None = None, buckets_bound: int = 4096) -> DataFrame:
    """Windows of ``size`` characters over the concatenation of all rows in ``order``.

    ``bucket`` must be monotone in ``order`` (file block, quantile bucket...), and
    ``order`` unique. Each row's global start offset is an exact prefix sum over the
    order columns and lengths alone (see ``plans.ordering``), which is then joined to the
    texts: a broadcast while it is small at run time, else one shuffle of the texts.
    Windows that lie inside one row are cut in place; only the pieces at row
    borders are shuffled and glued, so the shuffle is about ``2 * size`` characters
    per row, not the whole corpus. Returns ``chunk_no`` (0-based) and ``chunk``.
    """
    d = df.select(F.col(col).alias("__t"), bucket.alias("__b"), *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    keys = [f"__o{i}" for i in range(len(order))]
    offsets = ordered_prefix(d.select("__b", *keys, F.length("__t").alias("__len")), F.col("__b"), [F.col(k) for k in keys],
                             weight=F.col("__len"), out="__g", groups_bound=groups_bound, buckets_bound=buckets_bound)
    d = _null_safe_join(d.withColumn("__len", F.length("__t")), offsets.select(*keys, "__g"), keys, broadcast_right=False)
    g, ln = F.col("__g"), F.col("__len")
    wins = F.when(ln > 0, F.sequence(F.floor(g / size), F.floor((g + ln - 1) / size)))
    p = d.select("__t", "__g", "__len", F.explode(wins).alias("w"))
    start = F.greatest(F.col("w") * size, g)
    end = F.least((F.col("w") + 1) * size, g + ln)
    p = p.select(F.col("w").alias("chunk_no"), start.alias("__s"),
                 F.substring("__t", (start - g + 1).cast("int"), (end - start).cast("int")).alias("piece"),
                 (end - start).alias("__plen"))
    whole = p.filter(F.col("__plen") == size).select("chunk_no", F.col("piece").alias("chunk"))
    glued = (p.filter(F.col("__plen") < size)
              .groupBy("chunk_no")
              .agg(F.array_sort(F.collect_list(F.struct("__s", "piece"))).alias("__ps"))
              .select("chunk_no", F.array_join(F.transform("__ps", lambda x: x["piece"]), "").alias("chunk")))
    return whole.unionByName(glued)


def quotes(df: DataFrame, col: str = "text", out: str | None = None) -> DataFrame:
    """Quote normalisation on a column."""
    return df.withColumn(out or col, normalize_quotes(F.col(col)))


def union_corpora(parts: dict[str, DataFrame], col: str = "excerpt") -> DataFrame:
    """Append single-column corpora, tagging each with its ``source`` name."""
    out = None
    for name, d in parts.items():
        t = d.select(F.lit(name).alias("source"), F.col(col))
        out = t if out is None else out.unionByName(t)
    return out


def coerce_text(df: DataFrame, cols: Sequence[str], null_text: str = "nan") -> DataFrame:
    """Cast columns to string, null -> ``null_text``."""
    for c in cols:
        df = df.withColumn(c, coerce_text_col(F.col(c), null_text))
    return df
