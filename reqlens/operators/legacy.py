"""The baseline check: trigger-word requirements of a source against chunks of targets by token Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens import lexicon as L
from reqlens.functions import extract as E, score as S, text as X


def requirements(chunks: DataFrame) -> DataFrame:
    """REQ-8: chunks (package_id, pos, text) with a trigger word, numbered TZ-RQ-00001, ... in order."""
    rows = chunks.withColumn("text", F.trim("text")).where(E.is_legacy_requirement(F.col("text")))
    n = F.row_number().over(Window.partitionBy("package_id").orderBy("pos"))
    return rows.select("package_id", F.format_string("TZ-RQ-%05d", n).alias("req_key"), "text")


def overlaps(reqs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of a requirement and a chunk of its package with a common token, and their Jaccard score.

    By an index of tokens: a pair is counted up from its common tokens, and pairs without any are never formed.
    """
    r = reqs.select("package_id", "req_key", X.tokens(F.col("text"), L.LEGACY_TOKEN).alias("t")).withColumn("rn", F.size("t"))
    k = chunks.select("package_id", "doc_type", "chunk_id", "pos", X.tokens(F.col("text"), L.LEGACY_TOKEN).alias("t")).withColumn("kn", F.size("t"))
    left, right = (x.withColumn("token", F.explode("t")).drop("t") for x in (r, k))
    both = left.join(right, ["package_id", "token"]).groupBy("package_id", "req_key", "doc_type", "chunk_id", "pos").agg(F.count(F.lit(1)).alias("common"), F.first("rn").alias("rn"), F.first("kn").alias("kn"))
    return both.select("package_id", "req_key", "doc_type", "chunk_id", "pos", (F.col("common") / (F.col("rn") + F.col("kn") - F.col("common"))).alias("score"))


def match(reqs: DataFrame, chunks: DataFrame, targets: DataFrame | None = None, ok: float = 0.72, partial: float = 0.62) -> DataFrame:
    """JOIN-3, WIN-8, AGG-22: best chunk of each requirement and target type, with OK, PARTIAL or MISSING.

    chunks: package_id, doc_type, chunk_id, pos, text. targets: package_id and doc_type of the target documents; without
    it, those that have chunks. Every requirement has a row for every target of its package: without a chunk that shares a
    token it is MISSING with score 0. Of equal scores the first chunk counts.
    """
    targets = (chunks if targets is None else targets).select("package_id", "doc_type").distinct()
    best = overlaps(reqs, chunks).groupBy("package_id", "req_key", "doc_type").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "chunk_id")).alias("b"))
    grid = reqs.select("package_id", "req_key").join(targets, "package_id")
    out = grid.join(best, ["package_id", "req_key", "doc_type"], "left").select("package_id", "req_key", "doc_type", F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("score"), F.col("b.chunk_id").alias("chunk_id"))
    status = F.when(F.col("score") >= ok, "OK").when(F.col("score") >= partial, "PARTIAL").otherwise("MISSING")
    return out.withColumn("status", status).withColumn("chunk_id", F.when(F.col("status") != "MISSING", F.col("chunk_id")))


def labelling_pairs(reqs: DataFrame, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """WIN-9: the top_k chunks of each requirement and target type by score, ties in order, for people to label.

    Where fewer chunks share a token, the first chunks of the target fill up, with score 0: of its first top_k chunks as
    many are still free as are needed.
    """
    scored = overlaps(reqs, chunks)
    place = F.row_number().over(Window.partitionBy("package_id", "doc_type").orderBy("pos", "chunk_id"))
    heads = chunks.select("package_id", "doc_type", "chunk_id", "pos").withColumn("n", place).where(F.col("n") <= top_k).drop("n")
    free = reqs.select("package_id", "req_key").join(heads, "package_id").join(scored.select("package_id", "req_key", "doc_type", "chunk_id"), ["package_id", "req_key", "doc_type", "chunk_id"], "left_anti")
    both = scored.unionByName(free.withColumn("score", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("package_id", "req_key", "doc_type").orderBy(F.desc("score"), "pos", "chunk_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top_k)


def stats(matches: DataFrame) -> DataFrame:
    """AGG-22: requirements and missing ones of each package by target type."""
    return matches.groupBy("package_id").agg(F.count_distinct("req_key").alias("tz_requirements"), F.count_if((F.col("doc_type") == "PZ") & (F.col("status") == "MISSING")).alias("missing_in_pz"), F.count_if((F.col("doc_type") == "PMI") & (F.col("status") == "MISSING")).alias("missing_in_pmi"))


def defects(matches: DataFrame) -> DataFrame:
    return matches.where("status = 'MISSING'").select("package_id", "req_key", "doc_type", F.lit("C1_MISSING").alias("defect_type"), F.lit("MEDIUM").alias("severity"), "score")
