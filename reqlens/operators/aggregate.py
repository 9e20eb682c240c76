"""From judged pairs to one verdict for each (requirement, target), and rollups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from reqlens import lexicon as L
from reqlens.functions import extract as E, text as X
from reqlens.operators import routing

KEY = ("package_id", "req_id", "target_doc_id")


@dataclass(frozen=True)
class AggregateConfig:
    covered: float = 0.65
    conflict: float = 0.70
    partial: float = 0.65
    medium: float = 0.30
    medium_relaxed: float = 0.20


def clean_aspects(aspects):
    """DED-6: without punctuation at the ends, short ones, internal tags, mixed scripts, repeats (any case) and parts of others."""
    edge = f"(?U)^[{L.ASPECT_EDGE}]+|[{L.ASPECT_EDGE}]+$"
    bare = F.filter(F.transform(aspects, lambda a: F.regexp_replace(X.text_of(a), edge, "")), lambda a: (F.length(a) >= 3) & ~E.is_aspect_noise(a))
    firsts = X.let(bare, lambda all_: X.let(F.transform(all_, F.lower), lambda low: F.filter(all_, lambda a, i: F.array_position(low, F.lower(a)) == i + 1)))
    return X.let(firsts, lambda all_: F.filter(all_, lambda a: ~F.exists(all_, lambda b: (F.lower(a) != F.lower(b)) & F.contains(F.lower(b), F.lower(a)))))


def aggregate_verdicts(grid: DataFrame, judgments: DataFrame, cfg: AggregateConfig = AggregateConfig()) -> DataFrame:
    """AGG-1 to AGG-11: status, subcode, level, severity and criticality of every row of the grid.

    grid: package_id, req_id, target_doc_id, role, req_type. judgments: the key, unit_id, label, confidence, score,
    low_confidence, grounding_failed, actions (of the verifier) and missing_aspects. Judgments are scanned from the
    worst status and the highest confidence down; the first one that passes its gates decides, and if none does the last
    rejection names the subcode.
    """
    c = F.col
    relaxed = c("req_type").isin(*L.CRITICAL_TYPES)
    medium = F.when(relaxed, F.least(F.lit(cfg.medium_relaxed), F.lit(cfg.medium))).otherwise(cfg.medium)
    j = grid.select(*KEY, "req_type").join(judgments, list(KEY))
    unjudged = (c("label") == "NOT_JUDGED") & F.exists("actions", lambda a: a.startswith(L.UNJUDGED))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.STATUS_RANK.items() for x in kv]), F.when(c("label") == "IRRELEVANT", "MISSING").otherwise(c("label"))), F.lit(0))
    j = j.withColumn("unjudged", unjudged).withColumn("place", F.struct((-rank).alias("r"), (-c("confidence")).alias("c"), "unit_id"))
    sound = ~c("low_confidence") & ~c("grounding_failed")
    strong = j.where(~c("unjudged") & (c("label") == "COVERED") & sound & (c("confidence") >= cfg.covered)).groupBy(*KEY).agg(F.max("confidence").alias("strong"))
    j = j.join(strong, list(KEY), "left")
    confirmed = (F.size("actions") == 0) | F.exists("actions", lambda a: a.startswith("conflict_"))
    conflict_gates = (F.coalesce(c("confidence") >= c("strong"), F.lit(True))) & (c("confidence") >= cfg.conflict) & ~c("grounding_failed") & (c("score") >= medium)
    least = F.when(c("label") == "COVERED", cfg.covered).otherwise(cfg.partial)
    positive = c("label").isin("COVERED", "PARTIAL")
    gate = F.when(c("confidence") < least, "MISSING_LOW_CONFIDENCE").when(c("grounding_failed"), "MISSING_LOW_GROUNDING").when(c("score") < medium, "MISSING_LOW_CONFIDENCE")
    accepted = F.when(c("label") == "CONFLICT", conflict_gates & confirmed).when(positive, gate.isNull()).otherwise(False)
    rejected = F.when((c("label") == "CONFLICT") & conflict_gates & ~confirmed, "CONFLICT_UNVERIFIED").when(positive, gate)
    live = ~c("unjudged")
    j = j.withColumn("accepted", accepted & live).withColumn("rejected", F.when(live, rejected))
    folded = j.groupBy(*KEY).agg(
        F.min(F.when(c("accepted"), F.struct("place", "label", "confidence", "unit_id"))).alias("win"), F.max(F.when(c("rejected").isNotNull(), F.struct("place", "rejected", "unit_id"))).alias("last"),
        F.count(F.lit(1)).alias("n"), F.count_if("unjudged").alias("unjudged_pair_count"), F.flatten(F.array_sort(F.collect_list(F.when(live, F.struct("place", "missing_aspects"))))["missing_aspects"]).alias("missing"),
        F.max("low_confidence").alias("any_low_confidence"), F.max("grounding_failed").alias("any_grounding_failed"),
    )
    out = grid.join(folded, list(KEY), "left").withColumn("uncovered", clean_aspects(F.coalesce("missing", F.array().cast("array<string>")))).withColumn("applicability", routing.applicability(c("req_type"), c("role")))
    out = out.withColumn("level", routing.level(c("req_type"), c("role")))
    off = c("applicability") != "APPLICABLE"
    all_unjudged = c("n").isNotNull() & (c("n") == c("unjudged_pair_count"))
    downgraded = (c("win.label") == "COVERED") & (F.size("uncovered") > 0)
    status = F.when(off, "MISSING").when(c("n").isNull(), "MISSING").when(all_unjudged, "UNKNOWN").when(downgraded, "PARTIAL").otherwise(F.coalesce("win.label", F.lit("MISSING")))
    empty = F.when(c("level") == "OPTIONAL", "OPTIONAL_NOT_FOUND").otherwise("MISSING_NO_EVIDENCE")
    subcode = (
        F.when(c("applicability") == "OUT_OF_SCOPE", "OUT_OF_SCOPE").when(off, "NOT_APPLICABLE").when(c("n").isNull(), empty).when(all_unjudged, "UNKNOWN_LLM_UNAVAILABLE")
        .when(downgraded, "PARTIAL_DOWNGRADED_FROM_COVERED").when(c("win").isNull(), F.coalesce("last.rejected", empty))
        .when(c("win.label") == "CONFLICT", "CONFLICT_VERIFIED").otherwise(c("win.label"))
    )
    out = out.withColumn("status", status).withColumn("subcode", subcode)
    seen = F.when(c("level") == "OPTIONAL", F.when(c("status") == "MISSING", "COVERED").otherwise(c("status"))).otherwise(c("status"))
    return out.select(
        *KEY, "role", "req_type", "applicability", "level", "status", "subcode", F.coalesce("win.unit_id", "last.unit_id").alias("unit_id"), F.round(F.coalesce("win.confidence", F.lit(0.0)), 4).alias("confidence"), "uncovered",
        routing.severity(c("req_type"), c("role"), c("status"), c("subcode")).alias("severity"), F.coalesce(routing.critical(c("req_type"), c("role"), seen), F.lit(False)).alias("is_critical"),
        F.coalesce("any_low_confidence", F.lit(False)).alias("any_low_confidence"), F.coalesce("any_grounding_failed", F.lit(False)).alias("any_grounding_failed"), F.coalesce("unjudged_pair_count", F.lit(0)).cast("long").alias("unjudged_pair_count"),
    )


def rollup(results: DataFrame) -> DataFrame:
    """AGG-12, AGG-13: tallies of each package and of each of its targets (null target: the package); out-of-scope rows don't count.

    UNKNOWN counts as missing, and is given beside it.
    """
    rows = results.where("applicability = 'APPLICABLE'")
    out = rows.groupingSets([["package_id"], ["package_id", "target_doc_id"]], "package_id", "target_doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "COVERED").alias("covered"), F.count_if(F.col("status") == "PARTIAL").alias("partial"), F.count_if(F.col("status") == "CONFLICT").alias("conflict"),
        F.count_if(F.col("status").isin("MISSING", "UNKNOWN")).alias("missing"), F.count_if(F.col("status") == "UNKNOWN").alias("unknown"),
    )
    return out.withColumn("coverage_rate", F.when(F.col("total") > 0, (F.col("covered") + 0.5 * F.col("partial")) / F.col("total")).otherwise(0.0))


def one_per_pair(results: DataFrame, order: str) -> DataFrame:
    """DED-1: of several results of a (requirement, target) the worst status, then one with evidence, then the first."""
    from pyspark.sql.window import Window

    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.STATUS_RANK.items() for x in kv]), F.col("status")), F.lit(0))
    w = Window.partitionBy(*KEY).orderBy(F.desc(rank), F.desc(F.col("unit_id").isNotNull()), order)
    return results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
