"""Coverage analysis from packages to verdicts, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from reqlens.functions import text as X
from reqlens.lineage import stage
from reqlens.operators import aggregate, judge, report, requirements, retrieve, units, verify
from reqlens.sources import packages


@dataclass(frozen=True)
class CoverageConfig:
    retrieval: retrieve.RetrievalConfig = field(default_factory=retrieve.RetrievalConfig)
    aggregation: aggregate.AggregateConfig = field(default_factory=aggregate.AggregateConfig)
    verification: bool = True
    extraction: str = "auto"  # candidates, fragments, sections, or the first of these that gives any
    boost: bool = True  # sentences of requirement sections that no requirement states yet are requirements too


def extract_requirements(source: DataFrame, given: DataFrame, mode: str = "auto", boost: bool = False, classifier=None) -> DataFrame:
    """REQ-1, SET-1, SET-3: for each document the first source of requirements that is not empty, and the boost pass.

    mode 'model' takes what a classifier (a plug-in) picks, or without one the sections.
    """
    if mode == "model":
        if classifier is not None:
            from reqlens import plugins

            return stage(plugins.from_model(source, classifier).select(*COLUMNS))
        mode = "sections"
    out = _primary(source, given, mode)
    if boost:
        more = requirements.from_sections(source).where("relevant").select(*COLUMNS, "relevant", "pos")
        out = stage(requirements.with_boost(out, more).select(*COLUMNS))
    return out


COLUMNS = ["package_id", "doc_id", "req_id", "text", "section_id", "section_title", "normalized_text", "requirement_type", "modality", "entities", "constraints"]


def _primary(source: DataFrame, given: DataFrame, mode: str) -> DataFrame:
    ways = {"candidates": lambda: requirements.from_candidates(given), "fragments": lambda: requirements.from_fragments(source), "sections": lambda: requirements.from_sections(source)}
    columns = COLUMNS
    if mode != "auto":
        return stage(ways[mode]().select(*columns))
    out = None
    for make in ways.values():
        rows = make().select(*columns)
        out = stage(rows if out is None else out.unionByName(rows.join(out.select("package_id", "doc_id").distinct(), ["package_id", "doc_id"], "left_anti")))
    return out


def judged_pairs(reqs: DataFrame, coverage_units: DataFrame, cfg: CoverageConfig = CoverageConfig(), encoder=None) -> tuple[DataFrame, DataFrame]:
    """Selected candidates, and the verified verdict of the rule judge on each selected pair."""
    chosen = stage(retrieve.select(retrieve.shortlist(retrieve.score_pairs(reqs, coverage_units, cfg.retrieval, encoder), cfg.retrieval), cfg.retrieval))

    def side(df: DataFrame, name: str, key: str) -> DataFrame:
        made = judge.signals(name, F.col("normalized_text"), F.col("entities"), F.col("constraints"), F.col("section_id"))
        given = {"text": F.col("text"), "norm": F.col("normalized_text"), "tokens": X.content_tokens(F.col("normalized_text")), "entities": F.col("entities"), "constraints": F.col("constraints")}
        return df.select("package_id", key, *[v.alias(k) for k, v in made.items()], *[v.alias(f"{name}_{k}") for k, v in given.items()])

    picked = chosen.where("selected").select("package_id", "req_id", "target_doc_id", "unit_id", "score", "below_floor", "role", "req_type")
    picked_reqs, picked_units = picked.select("package_id", "req_id").distinct(), picked.select("package_id", "unit_id").distinct()
    left = stage(side(reqs.join(picked_reqs, ["package_id", "req_id"], "left_semi"), "req", "req_id"))
    right = stage(side(coverage_units.join(picked_units, ["package_id", "unit_id"], "left_semi"), "unit", "unit_id"))
    pairs = picked.join(left, ["package_id", "req_id"]).join(right, ["package_id", "unit_id"])
    verdicts = stage(judge.judge(pairs))
    if cfg.verification:
        verdicts = verify.verify(verdicts).withColumn("label", F.col("adjusted"))
    else:
        verdicts = verdicts.withColumn("actions", X.strings([]))
    return chosen, stage(verdicts.select(
        "package_id", "req_id", "target_doc_id", "unit_id", "label", "confidence", "score", F.col("below_floor").alias("low_confidence"), F.lit(False).alias("grounding_failed"), "actions", "missing_aspects", "rule"
    ))


def analyze(requests: DataFrame, cfg: CoverageConfig = CoverageConfig(), encoder=None, classifier=None) -> dict[str, DataFrame]:
    """Requirements, units, candidates, judgments, results (one row for each requirement and target), rollup, evidence
    traces, extraction diagnostics and warnings of all packages."""
    docs = packages.documents(requests)
    pieces = stage(packages.fragments(docs))
    source = pieces.where("side = 'source'")
    reqs = extract_requirements(source, packages.candidates(docs.where("side = 'source'")), cfg.extraction, cfg.boost, classifier)
    made = stage(units.build_units(pieces.where("side = 'target'")))
    chosen, judgments = judged_pairs(reqs, made, cfg, encoder)
    targets = docs.where("side = 'target'").select("package_id", F.col("doc_id").alias("target_doc_id"), F.col("doc_role").alias("role"))
    grid = reqs.select("package_id", "req_id", F.col("requirement_type").alias("req_type")).join(targets, "package_id")
    every = stage(aggregate.aggregate_verdicts(grid, judgments, cfg.aggregation))
    results = aggregate.one_per_pair(every, "req_type")
    twice = every.groupBy("package_id", "req_id", "target_doc_id").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy("package_id").agg(F.sum("n").alias("n"))
    diagnostics = stage(requirements.diagnostics(source, reqs))
    told = report.warnings(requests, docs, reqs, made, judgments, results, diagnostics, twice)
    return {
        "requirements": reqs, "units": made, "candidates": chosen, "judgments": judgments, "results": results, "rollup": aggregate.rollup(results), "traces": report.evidence_trace(chosen, judgments),
        "diagnostics": diagnostics, "warnings": told,
    }
