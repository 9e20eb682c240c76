"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

Every leaf (shard) draws -ln(u) / weight for a row, u being a hash of the row's key and the leaf. The draw of an inner
node is the least draw below it, which is distributed as a single draw with the node's total weight. A row descends
into the child with the least draw at each level. So a subtree whose weight rises takes rows only into the leaves that
caused it, one whose weight falls gives rows only from the leaves that caused it, and no row moves between two others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Shards of a rack, racks of a region: shard s stands in rack s // 4 and region s // 8.
RACK, REGION = 4, 8
#: Numbering parts of each shard: a row's slot is its part's offset plus its place in the part.
PARTS = 4096
#: Equal rows that become rows again at once.
RUN = 10_000
#: Bytes that a row takes beside its text.
ROW_BYTES = 16


def _draw(key: Column, leaf: Column, weight: Column | float, seed: int) -> Column:
    """Weighted exponential draw of a leaf for a key; the seed and the leaf's number are hashed with the key."""
    bits = F.shiftrightunsigned(F.xxhash64(key, leaf, F.lit(seed)), 11)
    return -F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / weight


def descend(df: DataFrame, key: Column, weights: list[float], out: str, rack: int = RACK, region: int = REGION, seed: int = 7) -> DataFrame:
    """Add column `out`: the leaf of a tree with these leaf weights that a key descends to. No shuffle.

    Leaves are numbered from 0, `rack` to a rack and `region` to a region (a multiple of `rack`). Null keys are hashed
    as such, and rows with equal keys meet in one leaf. A weight of 0 takes no row.
    """
    n = len(weights)
    if not any(w > 0 for w in weights):
        raise ValueError("a weight must be above 0")
    weight = F.array(*[F.lit(float(w)) for w in weights])

    def best(first: Column, size: int, inner: int) -> Column:
        """Number of the child with the least draw among the leaves first..first + size - 1, children holding `inner` leaves."""
        last = F.least(first + F.lit(size), F.lit(n)) - 1
        leaves = F.sequence(first, last)
        draws = F.transform(
            leaves,
            lambda leaf: F.struct(
                F.when(F.element_at(weight, leaf + 1) > 0, _draw(key, leaf, F.element_at(weight, leaf + 1), seed)).otherwise(F.lit(math.inf)).alias("draw"), leaf.alias("leaf")
            ),
        )
        return (F.array_min(draws)["leaf"] / inner).cast("int")

    names = [f"__{out}_{k}" for k in ("region", "rack")]
    df = df.withColumn(names[0], best(F.lit(0), n, region))
    df = df.withColumn(names[1], best(F.col(names[0]) * region, region, rack))
    return df.withColumn(out, best(F.col(names[1]) * rack, rack, 1)).drop(*names)


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, parts: int = PARTS) -> DataFrame:
    """Shard of each row by its id and the shard count alone (law `key`), a slot in it, and its shard with one shard more.

    Returns id_col, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, law, shard, slot (0, 1, ... without
    gaps in each shard) and grown_shard. One more shard takes rows only into itself. Null ids form one key; rows with
    equal ids share a shard and get slots of their own; an empty table gives no rows. Columns of docs beside the id and
    the text are not read, whatever their names.

    The texts are read once, by a narrow stage that keeps 28 bytes a row. Rows that are equal in all of these are one row
    with a count until the end, so that no key is hot. Slots need no order over a whole shard: a row gets a part by a hash
    of what it holds, the parts' counts (shards * parts rows at most, a fixed bound, broadcast) give offsets, and only
    distinct rows of one part are numbered in one task. Counted rows are spread by RUN before they become rows again.
    """
    weights = weights or [1.0] * shards
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    part = F.pmod(F.xxhash64(id_col, "text_crc32", "size", F.lit(11)), F.lit(parts)).cast("int")
    rows = descend(rows, F.col(id_col), weights, "shard").withColumn("__part", part)
    rows = rows.groupBy("shard", "__part", id_col, "text_crc32", "size").agg(F.count(F.lit(1)).alias("__n"))
    counts = rows.groupBy("shard", "__part").agg(F.sum("__n").alias("n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    earlier = Window.partitionBy("shard", "__part").orderBy(id_col, "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__place", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(F.broadcast(offsets), ["shard", "__part"])
    first = (F.col("__offset") + F.col("__place")).alias("__first")
    runs = placed.select(id_col, "size", "text_crc32", "shard", first, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(RUN).cast("long"))).alias("__run"))
    slots = F.explode(F.sequence(F.col("__run"), F.least(F.col("__run") + RUN, F.col("__n")) - 1)).alias("__i")
    out = runs.select("*", slots)
    out = descend(out, F.col(id_col), [*weights, weights[-1]], "grown_shard")
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__first") + F.col("__i")).cast("long").alias("slot"), "grown_shard")
