"""Requirement against test cases: the canonical cases."""

from reqlens.operators import traceability as T

REQ = "id string, text string, section string"
TEST = "id string, text string, expected_result string, section string"


def run(spark, reqs, tests, cfg=T.TraceConfig()):
    out = T.evaluate(spark.createDataFrame(reqs, REQ), spark.createDataFrame(tests, TEST), cfg)
    return {k: v.collect() for k, v in out.items() if k != "links"}


def test_adequate(spark):
    got = run(spark, [("R1", "Login must lock the account after 3 attempts", "auth")], [("T1", "Verify login must lock the account after 3 attempts", "account locked after 3 attempts", "auth")])
    assert got["findings"][0]["final_status"] == "ADEQUATE" and got["summary"][0]["score_c"] == 1.0 and not got["orphans"]


def test_conflict_by_numbers(spark):
    got = run(spark, [("R1", "Upload limit for report files equals 100 МБ", "files")], [("T1", "Check upload limit for report files equals 200 МБ", "limit is 200 МБ", "files")])
    assert got["findings"][0]["final_status"] == "CONFLICT" and "NUMERIC_MISMATCH" in got["findings"][0]["rule_flags"]


def test_missing_and_orphan(spark):
    got = run(spark, [("R1", "Export data to archive", "export")], [("T1", "Painting walls green", "walls", "house")])
    assert got["findings"][0]["final_status"] == "MISSING" and [o["test_id"] for o in got["orphans"]] == ["T1"] and got["summary"][0]["score_c"] == 0.0


def test_expected_result_missing(spark):
    got = run(spark, [("R1", "System shows user profile page details", "ui")], [("T1", "verify system shows user profile page details", None, "ui")])
    assert got["findings"][0]["final_status"] == "PARTIAL" and "EXPECTED_RESULT_MISSING" in got["findings"][0]["rule_flags"]


def test_packages_apart_equal_packages_together(spark):
    reqs = [("a", "R1", "alpha beta gamma", ""), ("b", "R1", "delta epsilon zeta", "")]
    tests = [("a", "T1", "alpha beta gamma", "x", ""), ("b", "T1", "delta epsilon", "x", "")]
    both = T.evaluate(spark.createDataFrame(reqs, "package_id string, " + REQ), spark.createDataFrame(tests, "package_id string, " + TEST))["findings"].collect()
    apart = [T.evaluate(spark.createDataFrame([r], "package_id string, " + REQ), spark.createDataFrame([t], "package_id string, " + TEST))["findings"].first() for r, t in zip(reqs, tests)]
    assert sorted(map(tuple, both), key=str) == sorted(map(tuple, apart), key=str)
