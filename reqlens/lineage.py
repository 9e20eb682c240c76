"""Stage tables: computed once, kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, functions as F

#: Distinct keys, and bytes of their texts, up to which `once_each` looks values up in a broadcast table.
FEW_KEYS, FEW_BYTES = 20_000, 8 << 20


def stage(df: DataFrame) -> DataFrame:
    """df computed once. Later stages read its columns instead of the expressions behind them, which the optimizer would
    otherwise copy into every filter above; and a lost executor costs no recomputation of them.

    The folder is the one that the session names in spark.checkpoint.dir. Only in local mode (tests) a temporary one will
    do; on a cluster, which could not share it, a missing folder is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="reqlens-checkpoint-"))
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a file that is one partition or a few, dealt out to all cores: what is done to a row costs far more than moving it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once_each(df: DataFrame, sides: dict[str, list[str]], make, few: int = FEW_KEYS, few_bytes: int = FEW_BYTES) -> DataFrame:
    """df with make(*columns) as a new column for each of `sides` (name of the new column: the text columns it depends on).

    The value is made once for each distinct tuple of the texts of all sides, nulls too, and looked up in a broadcast
    table; only where the tuples are more than `few`, or longer than `few_bytes`, it is made for each row in place. df is
    read twice: stage it first.
    """
    names = [f"__key{i}" for i in range(len(next(iter(sides.values()))))]
    each = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(columns, names)]) for columns in sides.values()])
    keys = stage(df.select(F.explode(each).alias("k")).select("k.*").distinct())
    size = sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names), F.lit(0).cast("long"))
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if n > few or total > few_bytes:
        return df.withColumns({name: make(*map(F.col, columns)) for name, columns in sides.items()})
    table = stage(dealt(keys).select(*names, make(*map(F.col, names)).alias("__made")))
    for name, columns in sides.items():
        own = table.select(*[F.col(k).alias(f"{k}_{name}") for k in names], F.col("__made").alias(name))
        same: Column = F.lit(True)
        for k, column in zip(names, columns):
            same = same & F.col(f"{k}_{name}").eqNullSafe(F.col(column))
        df = df.join(F.broadcast(own), same, "left").drop(*[f"{k}_{name}" for k in names])
    return df
