"""Column functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from reqlens.functions import extract as E, score as S, text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()
    return row["x"]


@pytest.mark.parametrize("text, expected", [
    ("Система не должна передавать данные.", "must_not"), ("Система должна выполнять операцию.", "must"), ("Рекомендуется вести журнал", "should"), ("Оператор может выйти", "may"), ("Просто текст", "unknown"), (None, "unknown"),
])
def test_modality(spark, text, expected):
    assert one(spark, E.modality(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [
    ("Хранить журнал не менее 90 дней.", [("retention_period", ">=", 90.0, "days")]), ("Время ответа не более 2 секунд.", [("response_time", "<=", 2.0, "sec")]), ("Хранить 30 суток.", [("retention_period", "=", 30.0, "days")]),
    ("Без чисел", []), ("", []), (None, []), ("согласно ГОСТ 19", []), ("размер >= 5 МБ и 2,5 Гб", [("size", ">=", 5.0, "mb"), ("size", "=", 2.5, "гб")]),
])
def test_constraints(spark, text, expected):
    assert [tuple(c) for c in one(spark, E.constraints(F.col("t")), t=text)] == expected


@pytest.mark.parametrize("text, expected", [
    ("ГОСТ 19.101-77 Виды программ и программных документов.", True), ("– М.: Изд-во стандартов, 1997", True), ("Система должна хранить журнал событий не менее 90 дней.", False), ("", True), ("RU.17701729.04.01-01 ТЗ 01-1", True),
])
def test_boilerplate(spark, text, expected):
    assert one(spark, E.is_boilerplate(F.col("t")), t=text) is expected


def test_requirement_type(spark):
    assert one(spark, E.requirement_type(F.col("t")), t="Хранить журнал событий 90 дней.") == "logging"
    assert one(spark, E.requirement_type(F.col("t")), t="Время ответа не более 2 секунд.") == "performance"
    assert one(spark, E.requirement_type(F.col("t"), F.col("s")), t="текст", s="Требования к надежности") == "reliability"
    assert one(spark, E.requirement_type(F.col("t"), F.col("s")), t="текст", s="") == "other"


def test_sentences(spark):
    assert one(spark, X.sentences(F.col("t")), t="Первое предложение. Второе! см. рис. 5 далее") == ["Первое предложение.", "Второе! см. рис. 5 далее"]
    assert one(spark, X.sentences(F.col("t")), t="") == [] and one(spark, X.sentences(F.col("t")), t=None) == []


def test_tokens_and_sections(spark):
    assert one(spark, X.content_tokens(F.col("t")), t="Система должна хранить ёлка Журнал журнал") == ["хранить", "лка", "журнал"]
    assert one(spark, E.section_is_requirement(F.col("a"), F.col("b")), a="4.1", b="") is True
    assert one(spark, E.section_is_requirement(F.col("a"), F.col("b")), a="2", b="Требования") is False
    assert one(spark, E.section_is_requirement(F.col("a"), F.col("b")), a="7", b="Введение") is False
    assert one(spark, E.section_is_requirement(F.col("a"), F.col("b")), a=None, b="прочее") is None


def test_cut_at_sentence(spark):
    assert one(spark, X.cut_at_sentence(F.col("t"), 12), t="Один. Два три четыре") == "Один."
    assert one(spark, X.cut_at_sentence(F.col("t"), 9), t="один два три") == "один два"
    assert one(spark, X.cut_at_sentence(F.col("t"), 50), t="один") == "один"


def test_entities(spark):
    assert one(spark, E.entities(F.col("t")), t="Модуль Поиска использует REST API и Система") == ["Модуль Поиска использует", "REST API", "REST", "API"]


def test_subject_action_artifacts(spark):
    assert one(spark, E.subject_head(F.col("t")), t="требования к функциям. клиентская часть приложения должна") == "client_part"
    got = one(spark, E.action(F.col("t")), t="система должна хранить журнал событий, а также данные")
    assert (got["verb"], got["phrase"], got["tokens"]) == ("хранить", "журнал событий", ["журнал", "событий"])
    assert one(spark, E.artifacts(F.col("t")), t="текст программы и руководство оператора") == ["operator_manual", "program_text"]


def test_scores(spark):
    arr = lambda x: F.split(F.col(x), " ")
    assert one(spark, S.jaccard(arr("a"), arr("b")), a="x y z", b="y z w") == 0.5
    assert one(spark, S.containment(arr("a"), arr("b")), a="x y", b="y z w") == 0.5
    assert one(spark, S.strength(F.lit(0.25))  , a="") == "MEDIUM"
    cons = lambda x: E.constraints(F.col(x))
    assert one(spark, S.constraint_overlap(cons("a"), cons("b")), a="хранить 90 дней", b="хранить 90 суток") == 1.0
    assert one(spark, S.constraint_overlap(cons("a"), cons("b")), a="хранить 90 дней", b="хранить 30 суток") == 0.5
    assert one(spark, S.numeric_conflict(cons("a"), cons("b")), a="хранить 90 дней", b="хранить 30 суток") is True
    assert one(spark, S.numeric_conflict(cons("a"), cons("b")), a="хранить 24 часа", b="хранить 1 сут") is False
    assert one(spark, S.text_match(F.col("a"), F.col("b")), a="один два три четыре пять", b="ноль один два три четыре пять шесть") == "contained"
