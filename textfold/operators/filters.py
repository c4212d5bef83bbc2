"""Row filters, projections and set operations."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordering import range_rank
from .folds import row_count


def non_empty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows whose named fields are all non-empty strings."""
    cond = None
    for c in cols:
        e = F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
        cond = e if cond is None else cond & e
    return df.filter(cond)


def drop_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null (in ``cols`` or in all columns)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def length_between(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """``lo < col <= hi``; pushed down to the Parquet scan."""
    return df.filter((F.col(col) > lo) & (F.col(col) <= hi))


def exclude_category(df: DataFrame, cat: int = 1, col: str = "category") -> DataFrame:
    """C4: drop one category, keeping rows whose category is null."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(cat)))


def head_fraction(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """The first ``int(n / k)`` rows in ``order`` (numeric first column), exact."""
    n = row_count(df)
    ranked = range_rank(df, order, out="__r")
    return ranked.filter(F.col("__r") < F.floor(n / F.lit(k))).drop("__r")


def tag_source(parts: dict[int, DataFrame], col: str = "category") -> DataFrame:
    """Provenance tag added to each source before the union."""
    out = None
    for cat, d in parts.items():
        t = d.withColumn(col, F.lit(cat).cast("int"))
        out = t if out is None else out.unionByName(t)
    return out


def length_bucket(c: Column, edges: Sequence[int] = (32,)) -> Column:
    """Label ``<=e`` for the first edge that holds, else ``>last``."""
    expr = None
    for e in edges:
        expr = F.when(c <= e, F.lit(f"<={e}")) if expr is None else expr.when(c <= e, F.lit(f"<={e}"))
    return expr.otherwise(F.lit(f">{edges[-1]}"))


def build_mlm_pairs(labeled: DataFrame, unlabeled: DataFrame) -> DataFrame:
    """Labelled pairs (label dropped) followed by unlabelled pairs."""
    cols = ["text_a", "text_b"]
    return labeled.select(*cols).unionByName(unlabeled.select(*cols))


def union_texts(a: DataFrame, b: DataFrame, col: str = "excerpt") -> DataFrame:
    """Train and test passages as one text column."""
    return a.select(col).unionByName(b.select(col))


def dedup(df: DataFrame) -> DataFrame:
    """D3: full-row distinct (null-safe). Map-side partial aggregation means a
    text copied into a third of all rows reaches its reducer once per map task."""
    return df.distinct()


def row_digest(cols: Sequence[str]) -> Column:
    """128-bit digest of the values of ``cols``: nulls, empty texts and borders between values are told apart."""
    def one(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))
    return F.unhex(F.md5(F.concat(*[one(c) for c in cols])))


def dedup_by_digest(df: DataFrame, key: str, cols: Sequence[str], digest: Column | None = None) -> DataFrame:
    """D3 for long texts: of rows equal in ``cols`` (null-safe) the one with the smallest ``key`` stays, with all its columns.

    ``key`` is unique. Only digests and keys go through the first exchange. Rows whose digest occurs once stay unread; the values of the others
    alone are compared, so equal digests of different rows lose nothing. The keys that go are written as a table, whose size
    tells the planner whether rows must move at all to drop them.
    """
    ids = df.select(F.col(key).alias("__key"), (row_digest(cols) if digest is None else digest).alias("__digest"))
    twice = ids.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__digest")
    suspects = ids.join(twice, "__digest", "left_semi").select("__key")
    # A bounded list on most data: the size of this table, too, is known before it is used.
    suspects = _written(suspects, "dedup-suspects")
    values = df.select(F.col(key).alias("__key"), *cols).join(suspects, "__key", "left_semi")
    first = values.groupBy(*cols).agg(F.min("__key").alias("__key")).select("__key")
    gone = _written(suspects.join(first, "__key", "left_anti"), "dedup-gone")
    return df.join(gone, df[key] == gone["__key"], "left_anti")


def _written(df: DataFrame, name: str) -> DataFrame:
    from ..session import table_path

    path = table_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix_pseudo(pseudo: DataFrame, train: DataFrame, fold: int, times: int = 3,
               fold_col: str = "kfold", cols: Sequence[str] = ("row_id", "excerpt", "target")) -> DataFrame:
    """Pseudo-labelled rows plus ``times`` copies of the out-of-fold training rows.

    Each copy carries ``copy_no`` (1..times; 0 for pseudo rows) so rows stay keyed.
    """
    tr = (train.filter(F.col(fold_col) != fold).select(*cols)
               .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(times)))))
    ps = pseudo.select(*cols).withColumn("copy_no", F.lit(0))
    return ps.unionByName(tr, allowMissingColumns=True)
