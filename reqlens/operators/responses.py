"""Raw answers of a language model to judgments: parsing, label validation and the grounding gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens import lexicon as L
from reqlens.functions import extract as E, text as X

ANSWER = f"struct<{E.ANSWER_FIELDS}>"
LABELS = ("COVERED", "PARTIAL", "CONFLICT", "IRRELEVANT")


def grounded(cited: Column, evidence: Column) -> Column:
    """A cited phrase stands in the evidence, or the phrases share three tokens of four letters with it."""
    norm = X.normalize(evidence)
    phrases = F.filter(F.transform(cited, X.normalize), lambda p: p != "")
    long_words = lambda words: F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))
    shared = F.size(F.array_intersect(long_words(F.flatten(F.transform(phrases, lambda p: F.split(p, " ")))), long_words(F.split(norm, " "))))
    return X.let(norm, lambda e: F.exists(phrases, lambda p: F.contains(e, p))) | (shared >= 3)


def parse(rows: DataFrame, raw: str = "raw", evidence: str = "evidence") -> DataFrame:
    """JDG-7, EXT-37: adds label, confidence, the aspect arrays, cited_phrases, low_confidence, grounding_failed, explanation.

    Unknown labels and unreadable answers are IRRELEVANT. A CONFLICT without aspects is PARTIAL if something matched, else
    IRRELEVANT. A label without grounding in a non-empty evidence becomes IRRELEVANT, with no aspects and a confidence
    of 0.3 at most.
    """
    a = F.col("__a")
    rows = rows.withColumn("__a", E.json_object(F.col(raw), ANSWER))
    list_ = lambda k: F.coalesce(a[k], X.strings([]))
    given = F.upper(F.coalesce(a["label"], F.lit("IRRELEVANT")))
    label = F.when(given.isin(*LABELS), given).otherwise("IRRELEVANT")
    label = F.when((label == "CONFLICT") & (F.size(list_("conflict_aspects")) == 0), F.when(F.size(list_("matched_aspects")) > 0, "PARTIAL").otherwise("IRRELEVANT")).otherwise(label)
    rows = rows.withColumn("__label", label)
    failed = (F.col("__label") != "IRRELEVANT") & (X.text_of(F.col(evidence)) != "") & ~grounded(list_("cited_phrases"), F.col(evidence))
    rows = rows.withColumn("grounding_failed", failed)
    bad, conf = F.col("grounding_failed"), F.coalesce(a["confidence"], F.lit(0.5))
    kept = {k: F.when(bad, X.strings([])).otherwise(list_(k)) for k in ("matched_aspects", "missing_aspects", "conflict_aspects", "cited_phrases")}
    told = F.concat(F.when(bad, F.lit("[ungrounded] ")).otherwise(F.lit("")), X.text_of(a["explanation"]))
    out = rows.withColumns({"label": F.when(bad, "IRRELEVANT").otherwise(F.col("__label")), "confidence": F.when(bad, F.least(conf, F.lit(0.3))).otherwise(conf), "low_confidence": bad, "explanation": told, **kept})
    return out.drop("__a", "__label")


def verdict(c: Column) -> Column:
    """EXT-38: the first known verdict word of an answer, else MISSING."""
    word = F.regexp_extract(F.upper(X.text_of(c)), "(?U)" + L.any_of(L.VERDICTS), 1)
    return F.when(word != "", word).otherwise("MISSING")


def parse_batch(rows: DataFrame, raw: str = "raw", expected: str = "expected") -> DataFrame:
    """JDG-8: one row for each answer of a batch: the columns of rows, `index` and `answer`.

    The batch is an array, or an object that holds one as results, result, verdicts, items or data. An answer without a
    valid index has that of its place; of several with one index the first counts; those past `expected` go.
    """
    item = E.ANSWER_ITEM
    wrapped = ", ".join(f"{k}:array<{item}>" for k in ("results", "result", "verdicts", "items", "data"))
    text = F.trim(X.text_of(F.col(raw)))
    array = F.from_json(F.when(text.startswith("["), text), f"array<{item}>")
    inner = E.json_object(F.when(~text.startswith("["), text), f"struct<{wrapped}>")
    found = F.coalesce(array, inner["results"], inner["result"], inner["verdicts"], inner["items"], inner["data"])
    each = rows.withColumn("__row", F.monotonically_increasing_id()).select("*", F.posexplode(found).alias("__pos", "answer")).where("answer IS NOT NULL")
    each = each.withColumn("index", F.when(F.col("answer.index") >= 0, F.col("answer.index")).otherwise(F.col("__pos")))
    first = F.row_number().over(Window.partitionBy("__row", "index").orderBy("__pos"))
    return each.where(F.col("index") < F.col(expected)).withColumn("__n", first).where("__n = 1").drop("__n", "__pos", "__row")


def retry_after(c: Column) -> Column:
    """EXT-39: seconds that an error message asks to wait, or null."""
    return F.regexp_extract(X.text_of(c), r"(?i)(?:retry|try again)[^0-9]{0,20}([0-9]+(?:\.[0-9]+)?)\s*s", 1).try_cast("double")
