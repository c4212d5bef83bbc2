"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions alone.

Each source has a target number of words. A source's documents are taken ``floor(target / size)`` whole
times for certain; the rest of the target is a sample without replacement. Its documents are ranked by
``(u / (1 - u)) / (p / (1 - p))``, random odds over inclusion odds, where ``u`` is a number drawn from the
document's key and ``p`` the share of the source still to take, unequal between sources. The sample is the
beginning of that order up to the rest, then, in the same order, documents that fit into what is left
(``FILLS`` times), then one more document if that comes nearer to the target than none.

The order within a source is never sorted in one task: ``u`` cuts it into ``BUCKETS`` ranges, whose sums
show the range in which the sample ends, and only that range is sorted. Decisions are a small row per
source. The draw depends on seed and key alone, so reruns agree.

Defined results: null text has size 0; null sources are one source, the last; a document without words
takes no words; rows with one key and size are taken together or not at all; the key of a null
``doc_id`` is the word null; further columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import materialize

SEED = 42
BUCKETS = 4096
FILLS = 3
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 13 hex digits of md5(seed|key)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): all words shared by the weights 1, 2, 3, repeating in source order.
    A target stops at ``MOST_COPIES`` times its source; the excess goes to the others by weight: the level
    that weights are multiplied by is the first, in the order of level at which sources fill up, at which
    the next source isn't full. One row per source goes through these windows, never documents."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", (F.row_number().over(one) - 1) % 3 + 1)
    s = s.withColumn("full", (F.col("source_size") * MOST_COPIES).cast("double"))
    s = s.withColumn("fills_at", F.col("full") / F.col("weight"))
    by_level = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything).cast("double")
                               - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("fills_at"), F.col("level")),
                                       F.when(F.col("level") <= F.col("fills_at"), F.col("fills_at"))).over(everything))
    return s.select("source", "source_size", F.least("full", F.col("weight") * F.col("level")).alias("target"))


def _sample_end(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` has (source, open words). Adds (last, got): the rank key at which the longest beginning
    of ``rows`` (source, key, u, size) that fits into the open words ends, and its words."""
    range_no = F.floor(F.col("u") * BUCKETS).cast("int")
    sums = rows.groupBy("source", range_no.alias("range_no")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("range_no")
    sums = (sums.withColumn("upto", F.sum("words").over(upto))
            .join(plan.select(F.col("source").alias("s"), "open"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    # the range in which the words no longer fit (null: all fit), and the words before it
    ends = sums.groupBy("source").agg(
        F.min(F.when(F.col("upto") > F.col("open"), F.col("range_no"))).alias("range_end"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("open"), F.col("upto"))), F.lit(0)).alias("base"))
    e = ends.select(F.col("source").alias("s"), "range_end", "base")
    inside = (rows.withColumn("range_no", range_no)
              .join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("range_no") == F.col("range_end"))).drop("s")
              .join(plan.select(F.col("source").alias("s"), "open"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    ranked = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("key")))  # with ties
    fits = ranked.filter(F.col("base") + F.col("upto") <= F.col("open")).groupBy("source").agg(
        F.max("key").alias("last_inside"), F.max("upto").alias("inside"))
    f = fits.select(F.col("source").alias("s"), "last_inside", "inside")
    return (ends.join(f, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
            .select(F.col("source").alias("s"), F.col("range_end"), "last_inside",
                    (F.col("base") + F.coalesce("inside", F.lit(0))).alias("got")))


def mix_copies(docs: DataFrame, seed: int = SEED, fills: int = FILLS) -> DataFrame:
    """``docs`` with the columns mix_size, mix_source_size, mix_target and mix_copies: the document's words, those of
    its source, the source's target, and how many whole copies of the document are in the mix."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")),
                        "mix-sizes")
    targets = source_targets(sized)
    targets = targets.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                                 .otherwise(F.lit(0)).cast("bigint"))
    targets = targets.withColumn("open", F.col("target") - F.col("certain") * F.col("source_size"))
    targets = materialize(targets.withColumn("p", F.when(F.col("source_size") > 0, F.col("open") / F.col("source_size"))
                                             .otherwise(F.lit(0.0))), "mix-targets")
    p = targets.select(F.col("source").alias("s"), "p")
    u = uniform(F.col("doc_id"), seed)
    ranked = (sized.withColumn("u", u).join(p, F.col("source").eqNullSafe(F.col("s")))
              .filter((F.col("p") > 0) & (F.col("size") > 0)))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = ranked.select("source", "u", "size", F.struct(odds.alias("odds"), F.col("u").alias("u"),
                                                           F.col("doc_id").alias("doc_id"),
                                                           F.col("size").alias("size")).alias("key"))
    plan = targets.select("source", "open")
    for i in range(fills):
        gate = i > 0  # later rounds: documents not taken yet that fit into the open words
        rows = ranked
        if gate:
            g = plan.select(F.col("source").alias("s"), "open", *[c for c in plan.columns if c.startswith(("end", "last", "gate"))])
            rows = ranked.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            rows = rows.filter((F.col("size") <= F.col("open")) & ~_taken(i, F.col("u"), F.col("key"), F.col("size")))
            rows = rows.select("source", "u", "size", "key")
        end = _sample_end(rows, plan)
        plan = (plan.join(end, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
                .withColumn(f"gate{i}", F.col("open") if gate else F.lit(float("inf")))
                .withColumn(f"any{i}", F.col("got").isNotNull())
                .withColumn("open", F.col("open") - F.coalesce("got", F.lit(0)))
                .withColumnRenamed("range_end", f"end{i}").withColumnRenamed("last_inside", f"last{i}").drop("got"))
        plan = materialize(plan.withColumnRenamed(f"any{i}", f"end_any{i}"), f"mix-round{i}")
    g = plan.withColumnRenamed("source", "s")
    rest = (ranked.join(g, F.col("source").eqNullSafe(F.col("s")))
            .filter(~_taken(fills, F.col("u"), F.col("key"), F.col("size")))
            .filter((F.col("size") > F.col("open")) & (F.col("size") < 2 * F.col("open"))))
    extra = rest.groupBy("source").agg(F.min("key").alias("extra"))
    e = extra.select(F.col("source").alias("x"), "extra")
    plan = materialize(plan.join(e, F.col("source").eqNullSafe(F.col("x")), "left").drop("x").drop("open")
                       .join(targets.withColumnRenamed("source", "y").drop("open"),
                             F.col("source").eqNullSafe(F.col("y"))).drop("y"), "mix-plan")
    plan = plan.select(F.col("source").alias("__s"), *[F.col(c).alias(f"__{c}") for c in plan.columns if c != "source"])
    d = docs.withColumn("__size", size).withColumn("__u", u)
    d = d.join(plan, F.col("source").cast("string").eqNullSafe(F.col("__s")))  # the plan is small: a broadcast by its size
    key = F.struct(((F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))).alias("odds"), F.col("__u").alias("u"),
                   F.col("doc_id").alias("doc_id"), F.col("__size").alias("size"))
    sampled = (F.col("__p") > 0) & (F.col("__size") > 0) & (
        _taken(fills, F.col("__u"), key, F.col("__size"), "__") | F.coalesce(key == F.col("__extra"), F.lit(False)))
    copies = (F.col("__certain") + F.when(sampled, 1).otherwise(0)).cast("bigint")
    return d.select(*docs.columns, F.col("__size").alias("mix_size"), F.col("__source_size").alias("mix_source_size"),
                    F.col("__target").alias("mix_target"), F.when(F.col("__size") > 0, copies).otherwise(0).alias("mix_copies"))


def mix_sources(docs: DataFrame, seed: int = SEED, fills: int = FILLS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row; ``taken`` is the words of all its copies."""
    mixed = mix_copies(docs.select("doc_id", "source", "text"), seed, fills)
    return mixed.select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"),
                        (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, fills: int = FILLS) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as it is taken."""
    copies = F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int"))).alias("__copy")
    return mix_copies(docs, seed, fills).select(*docs.columns, copies).drop("__copy")


def _taken(rounds: int, u: Column, key: Column, size: Column, mark: str = "") -> Column:
    """Whether one of the first ``rounds`` rounds took the document."""
    range_no = F.floor(u * BUCKETS).cast("int")
    out = F.lit(False)
    for i in range(rounds):
        before = (F.coalesce(range_no < F.col(f"{mark}end{i}"), F.lit(True))
                  | F.coalesce((range_no == F.col(f"{mark}end{i}")) & (key <= F.col(f"{mark}last{i}")), F.lit(False)))
        out = out | (F.col(f"{mark}end_any{i}") & (size <= F.col(f"{mark}gate{i}")) & before)
    return out
