"""Plug-ins with fakes: encoder, reranker, classifier and judges."""

import json
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reqlens import plugins as P, prompts
from reqlens.functions import text as X
from reqlens.operators import requirements, retrieve, units

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import this module

CONSTRAINTS = "array<struct<kind:string,operator:string,value:double,unit:string>>"


def fake_encoder():
    groups = {"хранить": 0, "хранение": 0, "экран": 1}
    return lambda texts: [[float(sum(w in t for w, g in groups.items() if g == k)) for k in (0, 1)] for t in texts]


def test_encoder_meets_what_words_miss(spark):
    row = lambda i, t: ("p", i, 0, t, None, None)
    reqs = requirements.with_features(spark.createDataFrame([row("r", "Система должна хранить журнал")], "package_id string, req_id string, pos int, text string, section_id string, section_title string"))
    made = units.build_units(
        spark.createDataFrame([("p", "d", "pmi", i, f"u{i}", None, "paragraph", t, None) for i, t in enumerate(["хранение сведений проверяется", "экран и кнопка"])], "package_id string, doc_id string, doc_role string, pos int, fragment_id string, section_id string, kind string, text string, section_title string")
    )
    plain = {r["unit_pos"]: r["sem"] for r in retrieve.score_pairs(reqs, made).collect()}
    dense = {r["unit_pos"]: r["sem"] for r in retrieve.score_pairs(reqs, made, encoder=fake_encoder, part_units=1).collect()}
    assert plain.get(0, 0.0) == 0.0 and dense[0] == 1.0 and dense.get(1, 0.0) == 0.0


def test_mean_pool():
    hidden = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [[1.0, 1.0]] * 3])
    got = P.mean_pool(hidden, np.array([[1, 1, 0], [0, 0, 0]]))
    assert np.allclose(got, [[0.6, 0.8], [0.0, 0.0]])


def listed(spark, rows):
    df = spark.createDataFrame(rows, "req_id string, unit_id string, score double, req_text string, unit_text string, exact double, topic double")
    return df.select(F.lit("p").alias("package_id"), "*", F.lit("d").alias("target_doc_id"), F.lit("pmi").alias("role"), F.lit("functional").alias("req_type"), F.array().cast(CONSTRAINTS).alias("req_constraints"), F.lit(0.1).alias("sem"), F.lit(0.5).alias("lex"), F.lit(0).alias("unit_pos"))


def test_rerank(spark):
    rows = [("weak", "a", 0.40, "x", "one", 0.0, 0.0), ("weak", "b", 0.30, "x", "seven!", 0.5, 0.0), ("weak", "c", 0.20, "x", "four", 0.0, 1.0), ("sure", "a", 0.9, "x", "one", 0.0, 0.0), ("sure", "b", 0.1, "x", "two", 0.0, 0.0)]
    model = lambda: lambda a, b: [len(t) / 10 for t in b]
    got = {(r["req_id"], r["unit_id"]): (r["score"], r["reranker_used"]) for r in P.rerank(listed(spark, rows), model).collect()}
    assert got == {("weak", "a"): (0.3, True), ("weak", "b"): (0.68, True), ("weak", "c"): (0.46, True), ("sure", "a"): (0.9, False), ("sure", "b"): (0.1, False)}
    first = P.rerank(listed(spark, rows), model, retrieve.RetrievalConfig(before_rerank=1), conditional=False).collect()
    assert {(r["req_id"], r["unit_id"]) for r in first} == {("weak", "a"), ("sure", "a")}


def test_classifier_path(spark):
    rows = [("p", "d", 0, "4.1", "Требования", "Система должна обеспечивать: 1) поиск публикаций по автору 2) загрузку файлов на сервер."), ("p", "d", 1, "4.1", "Требования", "Просто длинное описание без всякого долга."), ("p", "d", 2, "4.2", "Требования", "Подп. Дата и прочие реквизиты должны стоять")]
    source = spark.createDataFrame(rows, "package_id string, doc_id string, pos int, section_id string, section_title string, text string")
    model = lambda: lambda texts: [0.9 if "долж" in t else 0.1 for t in texts]
    got = P.from_model(source, model).orderBy("req_id").collect()
    assert [r["text"] for r in got] == ["Система должна обеспечивать: поиск публикаций по автору", "Система должна обеспечивать: загрузку файлов на сервер"]
    assert {r["classifier_score"] for r in got} == {0.9} and len({r["req_id"] for r in got}) == 2


def pairs(spark, n=4):
    rows = [("r1", f"u{i}", i, "Хранить журнал событий 90 дней", f"журнал событий хранится {i}0 дней") for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "req_id string, unit_id string, rank int, req_text string, unit_text string")
    one = F.array(F.struct(F.lit("retention_period").alias("kind"), F.lit(">=").alias("operator"), F.lit(90.0).alias("value"), F.lit("days").alias("unit")))
    return df.select(F.lit("p").alias("package_id"), "*", F.lit("d").alias("target_doc_id"), F.lit("pmi").alias("role"), F.lit("logging").alias("req_type"), one.alias("req_constraints"))


def scripted():
    def answer(system, prompt):
        unit = prompt.split("ФРАГМЕНТ ===\n")[1]
        if "20" in unit:
            raise TimeoutError
        return json.dumps({"label": "COVERED", "confidence": 0.9, "cited_phrases": ["журнал событий" if "10" in unit else "чужая цитата"]}, ensure_ascii=False)

    return answer


def test_llm_judge(spark):
    got = {r["unit_id"]: r for r in P.llm_judge(pairs(spark), scripted, "big-model", concurrency=2).collect()}
    assert (got["u1"]["label"], got["u1"]["confidence"], got["u1"]["actions"]) == ("COVERED", 0.9, [])
    assert (got["u2"]["label"], got["u2"]["actions"]) == ("NOT_JUDGED", ["llm_unavailable:TimeoutError"])
    assert got["u3"]["label"] == "IRRELEVANT" and got["u3"]["grounding_failed"]
    cached = spark.createDataFrame([(got["u3"]["key"], json.dumps({"label": "PARTIAL", "cited_phrases": ["журнал событий"]}, ensure_ascii=False))], "key string, payload string")
    again = {r["unit_id"]: r["label"] for r in P.llm_judge(pairs(spark), scripted, "big-model", cached).collect()}
    assert again == {"u1": "COVERED", "u2": "NOT_JUDGED", "u3": "PARTIAL", "u4": "IRRELEVANT"}


def batched():
    def answer(system, prompt):
        return json.dumps({"results": [{"index": 1, "label": "PARTIAL", "cited_phrases": ["журнал событий"]}, {"index": 0, "label": "COVERED", "cited_phrases": ["журнал"]}, {"index": 9, "label": "COVERED"}]}, ensure_ascii=False)

    return answer


def test_llm_judge_batches(spark):
    got = {r["unit_id"]: (r["label"], r["actions"]) for r in P.llm_judge_batches(pairs(spark, 3), batched).collect()}
    assert got == {"u1": ("COVERED", []), "u2": ("PARTIAL", []), "u3": ("NOT_JUDGED", ["llm_unavailable:no_answer"])}


def test_cross_encoder_and_trace_judge(spark):
    model = lambda: lambda a, b: [float(len(t)) - 25 for t in b]
    rows = [("x", "у" * 27), ("x", "у" * 25), ("x", "у")]
    got = [r["label"] for r in P.cross_encoder_judge(spark.createDataFrame(rows, "req_text string, unit_text string"), model).collect()]
    assert got == ["COVERED", "PARTIAL", "IRRELEVANT"]
    links = spark.createDataFrame(rows, "req_text string, test_text string")
    assert {r["judge_score"] for r in P.trace_judge(links).collect()} == {None} and P.trace_judge(links, model).first()["judge_score"] == 2.0


def test_backends_fall_back():
    def broken():
        raise OSError

    registry = {"bow": fake_encoder, "big": broken}
    assert P.backend("big", registry, "bow") is fake_encoder and P.backend("bow", registry, "none") is fake_encoder
    assert P.backend("nothing", registry, "none") is None and P.backend(None, registry, "bow") is fake_encoder


def test_prompts(spark):
    row = pairs(spark, 1).select(
        prompts.prompt("qwen:3b", F.col("req_text"), F.col("unit_text"), F.col("role"), F.col("req_type"), F.col("req_constraints")).alias("small"),
        prompts.prompt("large", F.col("req_text"), F.col("unit_text"), F.col("role"), F.lit("delivery"), F.col("req_constraints")).alias("full"),
        prompts.batch(F.col("req_text"), F.array("unit_text", "unit_text"), F.col("role"), X.let(F.col("req_constraints"), lambda c: c)).alias("batch"),
    ).first()
    assert "Применимость" not in row["small"] and "retention_period >= 90.0 days" in row["small"]
    assert "OUT_OF_SCOPE" in row["full"] and "при сомнении IRRELEVANT" in row["full"] and "--- index=1 ---" in row["batch"]
