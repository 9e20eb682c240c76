"""Reports of the whole plan: boost, warnings, traces, sheets and hints."""

import json

from reqlens.operators import report
from reqlens.plans.coverage import CoverageConfig, analyze
from reqlens.sources.packages import REQUEST


def requests(spark, tmp_path, *packages):
    (tmp_path / "r").mkdir()
    for p in packages:
        (tmp_path / "r" / f"{p['package_id']}.json").write_text(json.dumps(p, ensure_ascii=False))
    return spark.read.schema(REQUEST).option("multiLine", True).json(str(tmp_path / "r"))


def doc(doc_id, role, fragments, **more):
    return {"document_id": doc_id, "doc_role": role, "prepared_artifact": {"fragments": [{"fragment_id": f"f{i}", "kind": "paragraph", **f} for i, f in enumerate(fragments)], **more}}


def codes(out):
    return sorted((r["package_id"], r["code"], r["detail"]) for r in out["warnings"].collect())


def test_warnings(spark, tmp_path):
    text = lambda *ts: [{"text": t} for t in ts]
    good = text("Система должна хранить журнал событий не менее 90 дней.")
    many = text(*[f"должен должна необходимо {i}" for i in range(6)], "Система должна хранить журнал событий не менее 90 дней.")
    out = analyze(requests(
        spark, tmp_path, {"package_id": "a", "documents": [doc("t", "tz", good), doc("t", "pmi", good), doc("u", "pz", text("Кр.")), doc("w", "boss", good)]}, {"package_id": "b", "documents": [doc("u", "pmi", good)]},
        {"package_id": "c", "documents": [doc("t", "tz", many)]}, {"package_id": "d", "documents": [doc("t", "tz", text("Кратко")), doc("u", "pmi", good)]},
    ))
    got = codes(out)
    assert ("a", "INVALID_DOC_ROLE", "w=boss") in got and ("a", "SELF_COMPARISON_SKIPPED", "t") in got and ("a", "NO_UNITS", "u") in got and ("b", "NO_SOURCE", None) in got and ("c", "NO_TARGETS", None) in got and ("d", "NO_REQUIREMENTS", None) in got
    assert ("c", "LOW_REQUIREMENT_EXTRACTION_COVERAGE", "1 of 19") in got and not [x for x in got if x[0] == "d" and x[1] == "NO_UNITS"]


def test_boost_adds_what_no_requirement_states(spark, tmp_path):
    sections = [{"section_id": "4.1", "title": "Требования к функциям"}]
    fragments = [{"text": "Система должна хранить журнал событий не менее 90 дней.", "section_id": "4.1"}, {"text": "Пароль обязан меняться каждый календарный месяц года.", "section_id": "4.1"}]
    given = [{"req_id": "c1", "text": fragments[0]["text"], "section_id": "4.1", "metadata": {"isRequirementLikeForConsistency": "true"}}]
    package = {"package_id": "a", "documents": [doc("t", "tz", fragments, sections=sections, requirement_candidates=given), doc("u", "pmi", [{"text": "Проверить журнал событий"}])]}
    rows = requests(spark, tmp_path, package)
    texts = lambda cfg: sorted(r["text"] for r in analyze(rows, cfg)["requirements"].collect())
    assert texts(CoverageConfig(boost=False)) == [fragments[0]["text"]]
    assert texts(CoverageConfig()) == sorted(f["text"] for f in fragments)
    out = analyze(rows)
    trace = {r["req_id"]: r["trace"] for r in out["traces"].collect()}
    assert trace and all(len(t["candidates"]) <= 5 and (t["skip_llm"] or t["candidates"][0]["judgment"] is not None) for t in trace.values())
    assert {r["trace"] for r in report.evidence_trace(out["candidates"], out["judgments"], debug=False).collect()} == {None}
    sheet = report.package_sheet(out["results"], out["judgments"]).orderBy("line").collect()
    assert [r["line"] for r in sheet] == [1, 2] and sheet[0]["status"] == "MISSING"
    assert report.review_sample(out["results"], out["judgments"]).count() == 2


def test_hints(spark):
    rows = spark.createDataFrame([("p", "pz", "APPLICABLE", "MISSING", True, 0.05)] * 8 + [("p", "pmi", "APPLICABLE", "COVERED", False, 0.9)] * 2 + [("q", "pmi", "APPLICABLE", "COVERED", False, 0.9)], "package_id string, role string, applicability string, status string, any_low_confidence boolean, score double")
    got = {(r["package_id"], r["hint"]): r["share"] for r in report.hints(rows).collect()}
    assert got == {("p", "no_evidence_over_30"): 0.8, ("p", "low_confidence_over_40"): 0.8, ("p", "try_an_encoder"): 0.8, ("p", "try_a_reranker"): 0.8, ("p", "pz_missing_over_70"): 1.0}
