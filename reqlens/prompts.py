"""Prompts for a language model that judges pairs, as Column expressions (JDG-10). The answer's keys are those of `responses`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqlens.functions import extract as E, text as X
from reqlens.operators import routing

VERSION = "1"
_ANSWER = '{"label": "COVERED|PARTIAL|CONFLICT|IRRELEVANT", "confidence": 0.0-1.0, "matched_aspects": [], "missing_aspects": [], "conflict_aspects": [], "cited_phrases": [], "explanation": ""}'
_RULES = (
    "COVERED: фрагмент отвечает на всё требование, все числа совпадают. PARTIAL: предмет тот же, но чего-то не хватает. CONFLICT: фрагмент противоречит требованию, назовите чем. "
    "IRRELEVANT: фрагмент о другом. В cited_phrases только дословные выдержки из фрагмента; без них вердикт не засчитывается."
)
SYSTEM = f"Вы сверяете требование технического задания с фрагментом другого документа. Методика испытаний покрывает требование проверкой, пояснительная записка — описанием решения. {_RULES} Ответ — один объект JSON: {_ANSWER}"
SYSTEM_COMPACT = f"Сверьте требование и фрагмент. {_RULES} Только JSON: {_ANSWER}"
SYSTEM_BATCH = f"Сверьте одно требование с каждым из фрагментов. {_RULES} Ответ — массив JSON, по объекту на фрагмент, с его номером в поле index: [{_ANSWER}]"


def limits(constraints: Column) -> Column:
    """Numeric bounds of a requirement in one line; '' without any."""
    return F.array_join(F.transform(constraints, lambda c: F.concat_ws(" ", c["kind"], c["operator"], c["value"].cast("string"), c["unit"])), ", ")


def _line(head: str, value: Column) -> Column:
    return F.when(X.text_of(value) != "", F.concat(F.lit(head), value))


def full(req_text: Column, unit_text: Column, role: Column, req_type: Column, constraints: Column) -> Column:
    applies, level = routing.applicability(req_type, role), routing.level(req_type, role)
    return F.concat_ws(
        "\n", F.lit(f"[prompt {VERSION}]"), _line("Документ: ", F.upper(role)), _line("Тип требования: ", req_type), _line("Применимость: ", applies), _line("Уровень: ", level),
        F.when(applies != "APPLICABLE", F.lit("В этом документе требование не проверяется: при сомнении IRRELEVANT.")), F.when(level == "OPTIONAL", F.lit("Покрытие необязательно: при сомнении IRRELEVANT.")),
        _line("Числовые границы: ", limits(constraints)), F.lit("=== ТРЕБОВАНИЕ ==="), req_text, F.lit("=== ФРАГМЕНТ ==="), unit_text,
    )


def compact(req_text: Column, unit_text: Column, constraints: Column) -> Column:
    return F.concat_ws("\n", F.lit("Требование:"), req_text, F.lit("Фрагмент:"), unit_text, _line("Границы: ", limits(constraints)))


def prompt(model: str, req_text: Column, unit_text: Column, role: Column, req_type: Column, constraints: Column) -> Column:
    """EXT-41: the compact prompt for small models, else the full one."""
    return F.when(E.is_small_model(F.lit(model)), compact(req_text, unit_text, constraints)).otherwise(full(req_text, unit_text, role, req_type, constraints))


def batch(req_text: Column, unit_texts: Column, role: Column, constraints: Column) -> Column:
    """One prompt for all fragments (an array of texts) of a requirement."""
    each = F.transform(unit_texts, lambda t, i: F.concat(F.lit("--- index="), i.cast("string"), F.lit(" ---\n"), t))
    return F.concat_ws("\n", _line("Документ: ", F.upper(role)), _line("Границы: ", limits(constraints)), F.lit("=== ТРЕБОВАНИЕ ==="), req_text, F.format_string("=== ФРАГМЕНТЫ: %d ===", F.size(unit_texts)), F.array_join(each, "\n"))
