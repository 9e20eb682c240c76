"""Mixing sources to target weights by hash thresholds.

Each source's budget becomes whole repeats of all its rows and a remainder. The remainder is taken as the rows whose
hash lies below a threshold. The threshold is found without sorting rows: sizes are summed by source and hash bucket,
the bucket in which the running sum passes the remainder is refined into finer buckets, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens.llm.common import cut, words_column

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
#: Budget as a share of all sizes, and how often a row may be taken at most.
SHARE, REPEATS = 1.5, 2
#: The hash has LEVELS * STEP bits; each level refines one bucket into 2**STEP.
LEVELS, STEP = 4, 12


def row_hash(id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Column:
    """48 bits that depend on a row's id, source and text (rows equal in all three share them)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (id_col, source_col)] + [F.md5(F.coalesce(F.col(text_col), F.lit("")))]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Size and target of each source: shares of the budget by weight, none above `repeats` times its size.

    What a capped source leaves is shared out by weight among the others until none is above its cap. That end state is
    a water level: source s gets min(cap_s, level * weight_s). With the sources in order of cap / weight, the level
    follows from running sums. Rows here are sources, not documents.
    """
    totals = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source_col).asc_nulls_last())
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - (F.sum("cap").over(by_ratio) - F.col("cap"))) / (
        F.sum("weight").over(every) - F.sum("weight").over(by_ratio) + F.col("weight")
    )
    leveled = ranked.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") < F.col("cap"))
    final = F.min(F.when(F.col("below"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    return leveled.withColumn("final", final).select(
        F.col(source_col), "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("final") * F.col("weight"), F.col("cap"))).cast("double").alias("target")
    )


def thresholds(rows: DataFrame, needs: DataFrame, source_col: str = "source", levels: int = LEVELS, step: int = STEP) -> DataFrame:
    """Per source the hash bound under which the sizes sum nearest to `need` (of two as near the lower); `threshold`.

    rows: source, size, hash. A level sums only the rows in the bucket that the level before left open, so that each
    reads 2**step times fewer; its running sums go over 2**step buckets of a source. Rows of one hash are one unit.
    """
    state = needs.select(source_col, F.col("need").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"), F.lit(True).alias("open"))
    for level in range(levels):
        shift = (levels - level - 1) * step
        keyed = state.select(F.col(source_col).alias("__s"), F.col("prefix").alias("__p"), "left", "open")
        inside = rows.withColumn("bucket", F.shiftright("hash", shift)).join(
            keyed.where("open").select("__s", "__p"), F.col(source_col).eqNullSafe(F.col("__s")) & (F.shiftright("bucket", step) == F.col("__p"))
        )
        sums = inside.groupBy(source_col, "bucket").agg(F.sum("size").alias("sum"))
        running = Window.partitionBy(source_col).orderBy("bucket")
        sums = sums.select(F.col(source_col).alias("__t"), "bucket", F.sum("sum").over(running).alias("upto"), "sum")
        passed = (
            keyed.join(sums, F.col("__s").eqNullSafe(F.col("__t")), "left")
            .groupBy("__s", "__p", "left", "open")
            .agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("sum")).alias("before"), "upto"))).alias("at"))
        )
        # at the last level a bucket is one hash: it is taken too if that comes nearer
        nearer = F.when(F.col("at.upto") - F.col("left") < F.col("left") - F.col("at.before"), 1).otherwise(0) if level == levels - 1 else F.lit(0)
        # a source whose rows all fit stays closed, with a bound above every hash that its prefix can have
        # one row a source, cut at each level: the next would else carry the plans of all levels before it, twice
        state = passed.select(
            F.col("__s").alias(source_col),
            F.when(F.col("at").isNotNull(), F.col("left") - F.col("at.before")).otherwise(F.col("left")).alias("left"),
            F.when(F.col("at").isNotNull(), F.col("at.bucket") + nearer).otherwise(F.when(F.col("open"), (F.col("__p") + 1) * (1 << step)).otherwise(F.col("__p") * (1 << step))).alias("prefix"),
            (F.col("open") & F.col("at").isNotNull()).alias("open"),
        )
        state = cut(state)
    return state.select(source_col, F.col("prefix").alias("threshold"))


#: Sources that are joined by broadcast at most: a row takes some 100 bytes, so that 1 MB is the bound.
BROADCAST_SOURCES = 10_000


def mix_plan(rows: DataFrame, source_col: str, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """One row a source: __source, source_size, target, whole (times that every row is taken), threshold (of hashes taken once more)."""
    targets = cut(source_targets(rows, source_col, weights, share, repeats))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("whole", whole.cast("int")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    bounds = thresholds(rows, plan, source_col).select(F.col(source_col).alias("__b"), "threshold")
    plan = plan.join(bounds, F.col(source_col).eqNullSafe(F.col("__b")))
    return cut(plan.select(F.col(source_col).alias("__source"), "source_size", "target", "whole", "threshold"))


def _with_copies(rows: DataFrame, plan: DataFrame, source_col: str, repeats: int) -> DataFrame:
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    copies = F.col("whole") + ((F.col("hash") < F.col("threshold")) & (F.col("whole") < repeats)).cast("int")
    return rows.join(plan, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("copies", copies)


def _measured(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> dict:
    return {"size": words_column(F.col(text_col)), "hash": row_hash(id_col, source_col, text_col)}


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """How often a mix takes each row: id_col, source_col, size (words, null text: 0), source_size, target, copies and taken = size * copies.

    Sources whose target is a whole number of times their size take every row as often; of the others, the rows below
    the hash threshold once more. Hashes depend on the rows alone, so reruns agree. Null sources are one source, in the
    last place. Rows with equal id, source and text are taken together; repeated and null ids, empty texts (size 0) and
    an empty table are fine; extra columns are not read.

    Texts are read once: what is kept of a row (id, source, size, hash) is cut into the shared checkpoint folder. A
    source may hold any share of the rows: sums are combined before the shuffle, and the sources are broadcast only
    after a count has shown that they are few. No row is sorted.
    """
    measured = _measured(docs, id_col, source_col, text_col)
    rows = cut(docs.select(id_col, source_col, *(v.alias(k) for k, v in measured.items())))
    plan = mix_plan(rows, source_col, weights, share, repeats)
    return _with_copies(rows, plan, source_col, repeats).select(id_col, source_col, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The rows of the mix of `mix_sources`, with all columns of docs, each as often as the mix takes it.

    Nulls, empty texts, repeated rows and an empty table are as there; columns may have any names. The texts are not
    shuffled: a second read meets the thresholds.
    """
    measured = _measured(docs, id_col, source_col, text_col)
    rows = cut(docs.select(id_col, source_col, *(v.alias(k) for k, v in measured.items())))
    plan = mix_plan(rows, source_col, weights, share, repeats)
    names = [F.col(f"`{c}`").alias(f"__doc_{i}") for i, c in enumerate(docs.columns)]
    carried = docs.select(*names, F.col(source_col), *(v.alias(k) for k, v in measured.items()))
    taken = _with_copies(carried, plan, source_col, repeats).where("copies > 0")
    each = taken.select(*(f"__doc_{i}" for i in range(len(names))), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return each.select(*(F.col(f"__doc_{i}").alias(c) for i, c in enumerate(docs.columns)))
