"""Agreement and accuracy: kappa, precision and recall over thresholds, splits and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-25: agreement and Cohen's kappa of two label columns; rows with a null in either are left out."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("products"))
    out = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("total"), F.col("products") / (F.col("total") * F.col("total"))
    return out.select(F.col("total").alias("n"), po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def threshold_sweep(rows: DataFrame, score: Column, label: Column, thresholds: list[float]) -> DataFrame:
    """AGG-26: counts, precision, recall and F1 of score >= threshold; one pass over the rows for all thresholds."""
    hit = rows.select(score.alias("s"), label.cast("int").alias("y"))
    sums = hit.agg(
        F.sum("y").alias("pos"), F.count("y").alias("n"), *[x for i, t in enumerate(thresholds) for x in (F.count_if((F.col("s") >= t) & (F.col("y") == 1)).alias(f"tp{i}"), F.count_if((F.col("s") >= t) & (F.col("y") == 0)).alias(f"fp{i}"))]
    )
    each = sums.select("pos", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)])).alias("r")).select("pos", "n", "r.*")
    fn = F.col("pos") - F.col("tp")
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    return each.select("threshold", "tp", "fp", fn.alias("fn"), (F.col("n") - F.col("tp") - F.col("fp") - fn).alias("tn"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def split_by_package(rows: DataFrame, package: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """AGG-31: packages in order of a hash, the first shares to train, then val, the rest test. A package is never split.

    The order is over packages, whose number is small beside the rows'.
    """
    names = rows.select(package).distinct().withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), package)))
    place = (F.row_number().over(Window.orderBy("__h", package)) - 1) / F.count(F.lit(1)).over(Window.partitionBy())
    named = names.withColumn("split", F.when(place < train, "train").when(place < train + val, "val").otherwise("test")).drop("__h")
    return rows.join(named, package)


def cap_negatives(rows: DataFrame, ratio: int, order: Column, split: str = "split", label: str = "label") -> DataFrame:
    """At most `ratio` negatives for each positive in a split, in the given order."""
    pos = rows.where(F.col(label) == 1).groupBy(split).agg((F.count(F.lit(1)) * ratio).alias("__most"))
    w = Window.partitionBy(split, label).orderBy(order)
    ranked = rows.withColumn("__n", F.row_number().over(w)).join(pos, split, "left")
    return ranked.where((F.col(label) == 1) | (F.col("__n") <= F.coalesce("__most", F.lit(0)))).drop("__n", "__most")


def split_stats(rows: DataFrame, words: Column, split: str = "split", label: str = "label", package: str = "package_id") -> DataFrame:
    """MSC-11: counts and word-count percentiles by index. Percentiles come from counts of each word count, not from sorted rows."""
    counts = rows.select(split, words.alias("w"), F.col(label).cast("int").alias("y"), package).groupBy(split, "w").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(split).orderBy("w")
    running = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(split)))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("w")))
    tails = running.groupBy(split).agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 0.95)).alias("p95"))
    base = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("positives"), F.count_distinct(package).alias("packages"))
    return base.join(tails, split)
