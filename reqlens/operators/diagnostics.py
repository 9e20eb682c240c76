"""Health of a run: strengths, confidence, subcodes, actions, and comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reqlens.functions import score as S


def strengths(results: DataFrame, score: str = "score") -> DataFrame:
    """AGG-23: rows by the strength of their best evidence; no score is no evidence."""
    return results.groupBy(S.strength(F.coalesce(F.col(score), F.lit(0.0))).alias("strength")).agg(F.count(F.lit(1)).alias("n"))


def low_confidence(results: DataFrame) -> DataFrame:
    """AGG-23: share of applicable rows with low confidence."""
    rows = results.where("applicability = 'APPLICABLE'")
    n, low = F.count(F.lit(1)), F.count_if("any_low_confidence")
    return rows.agg(n.alias("applicable_total"), low.alias("low_confidence_count"), F.when(n > 0, low / n).otherwise(0.0).alias("low_confidence_pct"))


def subcodes(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("subcode", F.lit("(none)")).alias("subcode")).agg(F.count(F.lit(1)).alias("n"))


def by_role(results: DataFrame) -> DataFrame:
    """AGG-23: statuses of each role, one column a status."""
    return results.groupBy(F.lower("role").alias("role")).pivot("status", ["COVERED", "PARTIAL", "MISSING", "CONFLICT", "UNKNOWN"]).count().fillna(0)


def actions(judgments: DataFrame) -> DataFrame:
    """AGG-24: how often each verifier action was taken."""
    return judgments.select(F.explode("actions").alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def selected_histogram(candidates: DataFrame) -> DataFrame:
    """AGG-24: (requirement, target) pairs by the number of candidates selected."""
    each = candidates.groupBy("package_id", "req_id", "target_doc_id").agg(F.max("selected_k").alias("selected_k"))
    return each.groupBy("selected_k").agg(F.count(F.lit(1)).alias("n"))


def compare(runs: dict[str, DataFrame]) -> DataFrame:
    """MSC-15: status counts of several runs side by side."""
    out = None
    for name, results in runs.items():
        rows = results.select(F.lit(name).alias("run"), "status")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("status").pivot("run", list(runs)).count().fillna(0)


def demo_report(results: DataFrame) -> DataFrame:
    """AGG-28: score of each package, and of all (null package)."""
    n = F.count(F.lit(1))
    out = results.where("applicability = 'APPLICABLE'").rollup("package_id").agg(n.alias("n"), F.count_if(F.col("status") == "COVERED").alias("covered"), F.count_if(F.col("status") == "PARTIAL").alias("partial"))
    return out.withColumn("score", (F.col("covered") + 0.5 * F.col("partial")) / F.col("n"))
