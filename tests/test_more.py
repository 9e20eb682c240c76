"""Response parsing, compound requirements, diagnostics and file sources."""

import json
import zipfile

from pyspark.sql import functions as F

from reqlens.functions import extract as E
from reqlens.operators import diagnostics, responses
from reqlens.sources import files


def test_responses(spark):
    ok = {"label": "covered", "confidence": 0.9, "matched_aspects": ["a"], "cited_phrases": ["Журнал  событий"]}
    rows = [
        (1, json.dumps(ok, ensure_ascii=False), "хранится журнал событий"), (2, "text before " + json.dumps(ok, ensure_ascii=False), "нет такого"), (3, "no json", "x"), (4, None, None),
        (5, json.dumps({"label": "CONFLICT", "matched_aspects": ["m"], "cited_phrases": ["x"]}), "x"), (6, json.dumps({"label": "NOT_JUDGED"}), "x"),
    ]
    got = {r["id"]: r for r in responses.parse(spark.createDataFrame(rows, "id int, raw string, evidence string")).collect()}
    assert [got[i]["label"] for i in range(1, 7)] == ["COVERED", "IRRELEVANT", "IRRELEVANT", "IRRELEVANT", "PARTIAL", "IRRELEVANT"]
    assert got[2]["grounding_failed"] and got[2]["confidence"] == 0.3 and got[2]["matched_aspects"] == [] and not got[1]["grounding_failed"]


def test_compound(spark):
    texts = [
        (1, "Система должна обеспечивать: 1) поиск публикаций по автору 2) загрузку файлов на сервер"), (2, "Система должна хранить журнал событий"), (3, "Программа должна уметь (см: п. 1): поиск по автору; загрузку файлов"), (4, ""), (5, None), (6, "Итог: да"),
    ]
    got = {r["id"]: r["x"] for r in spark.createDataFrame(texts, "id int, t string").select("id", E.split_compound(F.col("t")).alias("x")).collect()}
    assert got[1] == ["Система должна обеспечивать: поиск публикаций по автору", "Система должна обеспечивать: загрузку файлов на сервер"]
    assert got[2] == ["Система должна хранить журнал событий"] and got[4] == [""] and got[5] == [""] and got[6] == ["Итог: да"]
    assert got[3] == ["Программа должна уметь (см: п. 1): поиск по автору", "Программа должна уметь (см: п. 1): загрузку файлов"]


def test_diagnostics(spark):
    rows = spark.createDataFrame(
        [("p", "pmi", "APPLICABLE", "COVERED", None, 0.5, False), ("p", "pz", "APPLICABLE", "PARTIAL", "X", 0.2, True), ("q", "pz", "OUT_OF_SCOPE", "MISSING", "OUT_OF_SCOPE", None, True)],
        "package_id string, role string, applicability string, status string, subcode string, score double, any_low_confidence boolean",
    )
    assert {r["strength"]: r["n"] for r in diagnostics.strengths(rows).collect()} == {"STRONG": 1, "WEAK": 1, "NO_EVIDENCE": 1}
    assert tuple(diagnostics.low_confidence(rows).first()) == (2, 1, 0.5)
    assert {r["subcode"]: r["n"] for r in diagnostics.subcodes(rows).collect()} == {"(none)": 1, "X": 1, "OUT_OF_SCOPE": 1}
    assert {r["role"]: (r["COVERED"], r["PARTIAL"], r["MISSING"]) for r in diagnostics.by_role(rows).collect()} == {"pmi": (1, 0, 0), "pz": (0, 1, 1)}
    assert {r["package_id"]: r["score"] for r in diagnostics.demo_report(rows).collect()} == {"p": 0.75, None: 0.75}
    assert {r["status"]: (r["a"], r["b"]) for r in diagnostics.compare({"a": rows, "b": rows.limit(1)}).collect()} == {"COVERED": (1, 1), "PARTIAL": (1, 0), "MISSING": (1, 0)}


def test_docx(spark, tmp_path):
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Один</w:t></w:r><w:r><w:t> два</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Три</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = [(r["pos"], r["text"]) for r in files.read_docx(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, "Один два"), (1, "Три")]
    pages = spark.createDataFrame([("d", 1, "a b\n \nc\n\n\n d ")], "doc_id string, page int, text string")
    assert [r["text"] for r in files.page_paragraphs(pages).orderBy("i").collect()] == ["a b", "c", "d"]
