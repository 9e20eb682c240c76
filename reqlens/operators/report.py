"""Reports of a run: warnings, evidence traces, findings, causes, buckets, review samples, and sheets and pages made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens import lexicon as L
from reqlens.functions import score as S, text as X

KEY = ("package_id", "req_id", "target_doc_id")


def out_of_scope(results: DataFrame) -> DataFrame:
    """AGG-14."""
    return results.where("applicability = 'OUT_OF_SCOPE'")


def trace_buckets(findings: DataFrame) -> DataFrame:
    """AGG-21: accepted, conflicting or uncovered, by a requirement's best link."""
    status = F.col("final_status")
    bucket = F.when(F.col("test_id").isNull() | (status == "MISSING"), "uncovered").when(status == "CONFLICT", "conflicting").otherwise("accepted")
    return findings.withColumn("bucket", bucket)


def status_order(status: Column) -> Column:
    """MSC-14: the most alarming first."""
    return F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(L.STATUS_ORDER) for x in (F.lit(s), F.lit(i))]), X.text_of(status)), F.lit(99))


def top_evidence(judgments: DataFrame, n: int = 2, keys=KEY) -> DataFrame:
    """MSC-14, MSC-16: of each row the n judgments of highest confidence, in order, as an array `evidence`.

    judgments: the keys, unit_id, label, confidence, score. Ties by unit.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "unit_id"))
    best = judgments.withColumn("rank", rank).where(F.col("rank") <= n)
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "label", "confidence", "score"))).alias("evidence"))


def package_sheet(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """SNK-4: one line a result, the most alarming first, with its two best pieces of evidence."""
    e = lambda i: F.get("evidence", F.lit(i))
    told = lambda i: F.when(e(i).isNotNull(), F.format_string("%s · conf=%.2f · retr=%.2f", e(i)["label"], e(i)["confidence"], e(i)["score"]))
    rows = results.join(top_evidence(judgments), list(KEY), "left").withColumn("place", status_order(F.col("status")))
    n = F.row_number().over(Window.partitionBy("package_id").orderBy("place", "req_id", "target_doc_id"))
    return rows.select("package_id", n.alias("line"), "status", "req_id", "target_doc_id", told(0).alias("evidence_1"), told(1).alias("evidence_2"))


def write_sheets(folder: str, **sheets: DataFrame) -> None:
    """SNK-4: each sheet as CSV with a header, in a folder of its name."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").csv(f"{folder}/{name}", header=True, escape='"')


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """SNK-5: a Markdown table of a report's rows, `most` at most: a page for people."""
    shown = rows.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *[list(map(cell, r)) for r in shown]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def findings(results: DataFrame, judgments: DataFrame, sure: float = 0.9, weak: float = 0.5) -> DataFrame:
    """AGG-29: conflicts, missing requirements of which the classifier was sure, and weak matches.

    results may have classifier_score; without it no MISSING row is a finding.
    """
    p = F.coalesce(F.col("classifier_score") if "classifier_score" in results.columns else F.lit(None).cast("double"), F.lit(0.0))
    rows = results.withColumn("p", p).join(top_evidence(judgments, 1), list(KEY), "left").withColumn("top", F.get("evidence", F.lit(0)))
    conf = F.col("top.confidence")
    reason = (
        F.when(F.col("status") == "CONFLICT", "conflict")
        .when((F.col("status") == "MISSING") & (F.col("p") >= sure), "sure_requirement_missing")
        .when((F.col("status") == "COVERED") & (conf < weak), "weak_match")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(*KEY, "status", "reason", F.col("top.unit_id").alias("unit_id"), conf.alias("evidence_confidence"))


def root_cause(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """AGG-30, JOIN-15: a likely cause of each row for the reviewer; of conflicts by what the verifier did to the winning unit."""
    won = judgments.select(*KEY, "unit_id", F.col("actions").alias("__actions")).dropDuplicates([*KEY, "unit_id"])
    rows = results.join(won, [*KEY, "unit_id"], "left")
    did = lambda tag: F.coalesce(F.exists("__actions", lambda a: a.startswith(tag)), F.lit(False))
    s, none = F.col("subcode"), F.col("unit_id").isNull()
    cause = (
        F.when(s.isin("OUT_OF_SCOPE", "NOT_APPLICABLE"), "applicability_matrix")
        .when(s.isin("OPTIONAL_NOT_FOUND", "MISSING_NO_EVIDENCE") & none, "retrieval_miss_or_truly_missing")
        .when(s == "MISSING_LOW_GROUNDING", "llm_hallucinated_citation")
        .when(s == "MISSING_LOW_CONFIDENCE", "llm_unsure_or_threshold_too_strict")
        .when((s == "CONFLICT_VERIFIED") & did("conflict_confirmed_numeric"), "verifier_numeric_conflict")
        .when((s == "CONFLICT_VERIFIED") & did("conflict_confirmed_negation"), "verifier_negation_conflict")
        .when(s == "CONFLICT_VERIFIED", "verifier_unknown_conflict_kind")
        .when(s == "COVERED", "llm_covered_grounded")
        .when(s == "PARTIAL", "llm_partial_or_verifier_demote")
        .otherwise("unclassified")
    )
    return rows.withColumn("root_cause", cause).drop("__actions")


REVIEW_QUOTAS = {"conflict": 10, "missing": 10, "covered_or_partial": 10, "not_applicable_or_optional": 5}


def review_bucket(status: Column, subcode: Column) -> Column:
    return (
        F.when((subcode == "CONFLICT_VERIFIED") | (status == "CONFLICT"), "conflict")
        .when(subcode.isin("MISSING_NO_EVIDENCE", "MISSING_LOW_GROUNDING", "MISSING_LOW_CONFIDENCE") | (status == "MISSING"), "missing")
        .when(subcode.isin("NOT_APPLICABLE", "OUT_OF_SCOPE", "OPTIONAL_NOT_FOUND"), "not_applicable_or_optional")
        .when(status.isin("COVERED", "PARTIAL"), "covered_or_partial")
    )


def review_sample(results: DataFrame, judgments: DataFrame, n_evidence: int = 3) -> DataFrame:
    """WIN-14, MSC-16: a sample of each review bucket, with the likely cause and the best evidence of each row."""
    from reqlens.operators.dataset import stratified

    named = results.withColumn("bucket", F.coalesce(review_bucket(F.col("status"), X.text_of(F.col("subcode"))), F.lit("other"))).where("bucket != 'other'").withColumn("rid", F.concat_ws("\u001f", *KEY))
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in REVIEW_QUOTAS.items() for x in kv]), F.col("bucket"))
    picked = stratified(named, "bucket", quota, "rid")
    return root_cause(picked, judgments).join(top_evidence(judgments, n_evidence), list(KEY), "left").drop("rid")


def legacy_recount(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """AGG-27: statuses as they are, and as the labels before any demotion would give them: view, status, n.

    judgments: the keys and original_label. A row without judgments is MISSING in both.
    """
    label = F.col("original_label")
    old = F.when(label.isin("COVERED", "PARTIAL", "CONFLICT"), label).otherwise("MISSING")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in L.STATUS_RANK.items() for x in kv]), old)
    best = judgments.groupBy(*KEY).agg(F.max_by(old, rank).alias("old"))
    rows = results.join(best, list(KEY), "left").select(F.explode(F.array(F.struct(F.lit("new").alias("view"), F.col("status")), F.struct(F.lit("legacy").alias("view"), F.coalesce("old", F.lit("MISSING")).alias("status")))).alias("v"))
    return rows.groupBy("v.view", "v.status").agg(F.count(F.lit(1)).alias("n"))


def agreement(labels: DataFrame) -> DataFrame:
    """JOIN-13: for each two models the pairs that both judged and the share on which they agree. labels: model, the pair's keys, label."""
    left = labels.select(F.col("model").alias("a"), "req_id", "target_doc_id", F.col("label").alias("x"))
    right = labels.select(F.col("model").alias("b"), "req_id", "target_doc_id", F.col("label").alias("y"))
    both = left.join(right, ["req_id", "target_doc_id"])
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("x") == F.col("y")) / F.count(F.lit(1))).alias("agreement"))


def disagreements(labels: DataFrame, most: int = 10) -> DataFrame:
    """WIN-13: the pairs that models judge most variously: labels given, then judgments, then the pair's order."""
    rows = labels.groupBy("req_id", "target_doc_id").agg(F.count_distinct("label").alias("n_labels"), F.count("label").alias("n"))
    return rows.where("n_labels >= 2").orderBy(F.desc("n_labels"), F.desc("n"), "req_id", "target_doc_id").limit(most)


def hints(results: DataFrame, score: str = "score") -> DataFrame:
    """MSC-13: what a package's numbers point to: package_id, hint, share. results: package_id, role, applicability, status, any_low_confidence and the best evidence's score."""
    n = F.count(F.lit(1))
    strength = S.strength(F.coalesce(F.col(score), F.lit(0.0)))
    pz, open_ = F.lower("role") == "pz", F.col("applicability") == "APPLICABLE"
    rows = results.groupBy("package_id").agg(
        (F.count_if(strength == "NO_EVIDENCE") / n).alias("none"), (F.count_if(strength.isin("WEAK", "NO_EVIDENCE")) / n).alias("weak"),
        F.when(F.count_if(open_) > 0, F.count_if(open_ & F.col("any_low_confidence")) / F.count_if(open_)).otherwise(0.0).alias("low"),
        F.when(F.count_if(pz) > 0, F.count_if(pz & (F.col("status") == "MISSING")) / F.count_if(pz)).otherwise(0.0).alias("pz"),
    )
    tests = {
        "no_evidence_over_30": ("none", F.col("none") > 0.30), "weak_over_50": ("weak", (F.col("weak") > 0.50) & (F.col("none") <= 0.30)), "low_confidence_over_40": ("low", F.col("low") > 0.40),
        "try_an_encoder": ("none", F.col("none") > 0.20), "try_a_reranker": ("weak", F.col("weak") > 0.40), "pz_missing_over_70": ("pz", F.col("pz") > 0.70),
    }
    told = F.filter(F.array(*[F.when(t, F.struct(F.lit(k).alias("hint"), F.col(v).alias("share"))) for k, (v, t) in tests.items()]), lambda x: x.isNotNull())
    return rows.select("package_id", F.explode(told).alias("h")).select("package_id", "h.hint", "h.share")


def evidence_trace(candidates: DataFrame, judgments: DataFrame, debug: bool = True, most: int = 5, discarded: bool = False) -> DataFrame:
    """SNK-7: for each row of the grid how it came about: the selection and up to `most` candidates with their judgments.

    candidates: shortlisted and selected ones (pick, selected, selected_k, skip_reason, score and its parts). Selected
    candidates come first; others only if `discarded`. Without debug the trace is null.
    """
    judged = judgments.select(*KEY, "unit_id", F.struct("label", "confidence", "actions", "missing_aspects", (~F.col("grounding_failed")).alias("grounding_passed"), (F.col("low_confidence") & ~F.col("grounding_failed")).alias("below_evidence_floor")).alias("judgment"))
    rows = candidates if discarded else candidates.where("selected")
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("selected"), "pick"))
    rows = rows.withColumn("__n", rank).where(F.col("__n") <= max(1, most)).join(judged, [*KEY, "unit_id"], "left")
    item = F.struct(F.col("__n").alias("n"), "unit_id", "score", "lex", "sem", "con", "sec", "strength", "selected", "judgment")
    traces = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    chosen = candidates.groupBy(*KEY).agg(F.max("selected_k").alias("selected_k"), F.max("skip_reason").alias("skip_reason"))
    empty = F.array().cast(traces.schema["candidates"].dataType)
    out = chosen.join(traces, list(KEY), "left").withColumn("trace", F.struct("selected_k", F.col("skip_reason").isNotNull().alias("skip_llm"), "skip_reason", F.coalesce("candidates", empty).alias("candidates")))
    return out.select(*KEY, (F.col("trace") if debug else F.lit(None).cast(out.schema["trace"].dataType)).alias("trace"))


def warnings(requests: DataFrame, documents: DataFrame, requirements: DataFrame, units: DataFrame, judgments: DataFrame, results: DataFrame, diagnostics: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """AGG-15: package_id, code and detail of everything that makes a package's report incomplete.

    requests: as read. documents: with side. diagnostics: of requirements.diagnostics. duplicates: package_id and n of
    results collapsed. A failing task fails the job in Spark, so that no rows are ever left out silently.
    """
    source_role, targets = F.coalesce("source_doc_role", F.lit("tz")), F.coalesce("target_doc_roles", F.array(F.lit("pmi"), F.lit("pz")))
    each = requests.select("package_id", source_role.alias("source_role"), targets.alias("targets"), F.posexplode("documents").alias("pos", "d"))
    role = F.lower(F.trim(X.text_of(F.col("d.doc_role"))))
    each = each.select("package_id", "pos", F.col("d.document_id").alias("doc_id"), role.alias("role"), (role == F.col("source_role")).alias("is_source"), F.array_contains("targets", role).alias("is_target"))
    told = lambda df, code, detail: df.select("package_id", F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    of = lambda side: documents.where(F.col("side") == side)
    packages = requests.select("package_id").distinct()
    lacking = lambda df: packages.join(df.select("package_id").distinct(), "package_id", "left_anti")
    source = of("source").select("package_id", F.col("doc_id").alias("source_id"))
    same = each.where("is_target AND NOT is_source").join(source, "package_id").where("doc_id = source_id")
    built = units.groupBy("package_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    empty = of("target").join(built, ["package_id", "doc_id"], "left_anti")
    gates = results.groupBy("package_id").agg(F.count_if(F.col("subcode").isin("MISSING_NO_EVIDENCE", "OPTIONAL_NOT_FOUND")).alias("retrieval"), F.count_if(F.col("subcode").isin("NOT_APPLICABLE", "OUT_OF_SCOPE")).alias("matrix")).where("retrieval + matrix > 0")
    lost = judgments.where("label = 'NOT_JUDGED'").groupBy("package_id").agg(F.count(F.lit(1)).alias("n"))
    have = of("source").select("package_id").distinct()
    out = [
        told(each.where((F.col("role") != "") & ~F.col("role").isin("tz", "pmi", "pz", "unknown")), "INVALID_DOC_ROLE", F.concat_ws("=", "doc_id", "role")),
        told(lacking(of("source")), "NO_SOURCE", F.lit(None)),
        told(same, "SELF_COMPARISON_SKIPPED", F.col("doc_id")),
        told(lacking(of("target")).join(have, "package_id", "left_semi"), "NO_TARGETS", F.lit(None)),
        told(lacking(requirements).join(have, "package_id", "left_semi"), "NO_REQUIREMENTS", F.lit(None)),
        told(diagnostics.where("low_coverage"), "LOW_REQUIREMENT_EXTRACTION_COVERAGE", F.format_string("%d of %d", "extracted", "markers")),
        told(empty, "NO_UNITS", F.col("doc_id")),
        told(gates, "LLM_CALL_BUDGET", F.format_string("retrieval %d, matrix %d", "retrieval", "matrix")),
        told(lost, "LLM_UNAVAILABLE", F.col("n")),
        told(results.select("package_id").distinct().join(judgments.select("package_id").distinct(), "package_id", "left_anti"), "NO_CANDIDATES", F.lit(None)),
    ]
    if duplicates is not None:
        out.append(told(duplicates.where("n > 0"), "DUPLICATE_PAIRS", F.col("n")))
    all_ = out[0]
    for w in out[1:]:
        all_ = all_.unionByName(w)
    return all_
