"""The coverage plan on canonical packages, and its parts."""

import json

import pytest

from reqlens.operators import aggregate, retrieve
from reqlens.plans.coverage import analyze
from reqlens.sources.packages import REQUEST


def package(spark, tmp_path, source, target, name="p1"):
    fragment = lambda i, t: {"fragment_id": f"f{i}", "text": t, "kind": "paragraph"}
    docs = [
        {"document_id": "tz1", "doc_role": " TZ ", "prepared_artifact": {"fragments": [fragment(i, t) for i, t in enumerate(source)]}},
        {"document_id": "pmi1", "doc_role": "pmi", "prepared_artifact": {"fragments": [fragment(i, t) for i, t in enumerate(target)]}},
    ]
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps({"package_id": name, "documents": docs}, ensure_ascii=False))
    return spark.read.schema(REQUEST).option("multiLine", True).json(str(path))


@pytest.mark.parametrize("source, target, expected", [
    ("Система должна хранить журнал событий не менее 90 дней.", "Проверить, что журнал событий хранится не менее 90 суток.", "COVERED"),
    ("Система должна обеспечивать время ответа не более 2 секунд.", "Проверить время ответа системы при различных нагрузках.", "PARTIAL"),
    # without an encoder or a lemma dictionary, texts that share no token stay below the retrieval gate
    ("Система должна хранить журнал событий не менее 90 дней.", "Проверить, что журнал событий хранится не менее 30 суток.", "CONFLICT"),
    ("Система должна хранить журнал не менее 90 дней.", "Интерфейс пользователя должен содержать кнопку выхода.", "MISSING"),
])
def test_canonical(spark, tmp_path, source, target, expected):
    out = analyze(package(spark, tmp_path, [source], [target]))
    rows = out["results"].collect()
    assert [r["status"] for r in rows] == [expected]


def test_rollup_and_empty_target(spark, tmp_path):
    out = analyze(package(spark, tmp_path, ["Система должна хранить журнал событий не менее 90 дней."], []))
    assert [r["subcode"] for r in out["results"].collect()] == ["MISSING_NO_EVIDENCE"]
    total = [r for r in out["rollup"].collect() if r["target_doc_id"] is None][0]
    assert (total["total"], total["missing"], total["coverage_rate"]) == (1, 1, 0.0)


def verdicts(spark, judgments, req_type="functional"):
    grid = spark.createDataFrame([("p", "r", "d", "pmi", req_type)], "package_id string, req_id string, target_doc_id string, role string, req_type string")
    rows = spark.createDataFrame(
        [("p", "r", "d", f"u{i}", *j) for i, j in enumerate(judgments)],
        "package_id string, req_id string, target_doc_id string, unit_id string, label string, confidence double, score double, low_confidence boolean, grounding_failed boolean, actions array<string>, missing_aspects array<string>",
    )
    return aggregate.aggregate_verdicts(grid, rows).first()


def test_aggregate_gates(spark):
    ok = (0.5, False, False, [], [])
    assert verdicts(spark, [("COVERED", 0.9, *ok)])["status"] == "COVERED"
    assert verdicts(spark, [("COVERED", 0.6, *ok)])["subcode"] == "MISSING_LOW_CONFIDENCE"
    assert verdicts(spark, [("COVERED", 0.9, 0.5, False, True, [], [])])["subcode"] == "MISSING_LOW_GROUNDING"
    assert verdicts(spark, [("COVERED", 0.9, 0.25, False, False, [], [])])["subcode"] == "MISSING_LOW_CONFIDENCE"
    assert verdicts(spark, [("COVERED", 0.9, 0.25, False, False, [], [])], "security")["status"] == "COVERED"
    assert verdicts(spark, [("CONFLICT", 0.8, 0.5, False, False, ["no_op_x"], [])])["subcode"] == "CONFLICT_UNVERIFIED"
    assert verdicts(spark, [("CONFLICT", 0.8, 0.5, False, False, ["conflict_confirmed_numeric"], [])])["status"] == "CONFLICT"
    assert verdicts(spark, [("CONFLICT", 0.75, *ok), ("COVERED", 0.9, *ok)])["status"] == "COVERED"
    mixed = verdicts(spark, [("COVERED", 0.9, *ok), ("PARTIAL", 0.7, 0.5, False, False, [], ["нет журнала"])])
    assert (mixed["status"], mixed["subcode"]) == ("PARTIAL", "PARTIAL_DOWNGRADED_FROM_COVERED")
    assert verdicts(spark, [("NOT_JUDGED", 0.0, 0.5, False, False, ["llm_unavailable:timeout"], [])])["status"] == "UNKNOWN"
    assert verdicts(spark, [], "delivery")["subcode"] == "OUT_OF_SCOPE"


def listed(spark, scores, req_type="functional"):
    rows = [("p", "r", "d", f"u{i}", s, "paragraph", i + 1, req_type, []) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "package_id string, req_id string, target_doc_id string, unit_id string, score double, unit_type string, rank int, req_type string, req_constraints array<struct<kind:string,operator:string,value:double,unit:string>>")
    return retrieve.select(df)


def test_selector(spark):
    picked = lambda rows: sum(r["selected"] for r in rows.collect())
    assert picked(listed(spark, [0.05])) == 0
    assert picked(listed(spark, [0.20])) == 0
    assert picked(listed(spark, [0.60, 0.30, 0.25, 0.2])) == 1
    assert picked(listed(spark, [0.60, 0.59, 0.25, 0.2])) == 3
    assert picked(listed(spark, [0.60, 0.59, 0.55, 0.5, 0.4, 0.4], "security")) == 5
