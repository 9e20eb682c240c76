"""Models beside Spark: encoders, rerankers, classifiers and judges.

A plug-in is a function without arguments that makes the model: it is called once for each task, and the model sees whole
batches. None is needed: without an encoder the bag of words stands in, without a reranker the hybrid score,
without a classifier the sections, and without a judge the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens import lexicon as L, prompts
from reqlens.functions import extract as E, score as S, text as X
from reqlens.lineage import stage
from reqlens.operators import cache, requirements, responses, retrieve

Make = Callable[[], Any]

def backend(name: str | None, registry: dict[str, Make], fallback: str) -> Make | None:
    """MSC-3: the plug-in of a name, or the fallback's where there is no such name or it can't be made; None for 'none'."""
    for n in ((name or fallback).lower(), fallback):
        make = registry.get(n)
        if n == "none":
            return None
        try:
            if make is not None:
                make()
                return make
        except Exception:  # noqa: BLE001  a model that can't be loaded is what the fallback is for
            continue
    return None


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """MSC-9: mean of the token vectors that the mask keeps, of length 1 (texts without tokens: 0)."""
    weight = mask[..., None].astype(np.float64)
    mean = (hidden * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def encoded(rows: DataFrame, text: str, make: Make, out: str = "vector") -> DataFrame:
    """UDF-1: vectors of texts; make() gives a function from a list of texts to a list of vectors."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())])

    return rows.withColumn(out, encode(text))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where either has no direction, not below 0."""
    return F.when((S.dot(a, a) > 0) & (S.dot(b, b) > 0), F.greatest(S.dense_cosine(a, b), F.lit(0.0))).otherwise(0.0)


def pair_scores(pairs: DataFrame, left: str, right: str, make: Make, out: str) -> DataFrame:
    """UDF-2: a score for each pair of texts; make() gives a function from two lists of texts to a list of numbers."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for a, b in batches:
            yield pd.Series([float(x) for x in model(a.fillna("").tolist(), b.fillna("").tolist())])

    return pairs.withColumn(out, score(left, right))


def rerank(scored: DataFrame, make: Make, cfg: retrieve.RetrievalConfig = retrieve.RetrievalConfig(), conditional: bool = True) -> DataFrame:
    """UDF-2, WIN-2, SCO-15: the first `before_rerank` candidates of a shortlist scored anew by a model, lifted and clamped.

    scored: of retrieve.score_pairs, with req_text, unit_text, exact and topic. With conditional, only shortlists that
    `retrieve.rerank_reason` names meet the model; others keep their candidates and scores.
    """
    order = Window.partitionBy(*retrieve.PAIR).orderBy(F.desc("score"), "unit_pos", "unit_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    first = stage(ranked.where(F.col("rank") <= cfg.before_rerank))
    reasons = retrieve.rerank_reason(first, cfg) if conditional else first.select(*retrieve.PAIR).distinct().select("*", F.lit(True).alias("should_rerank"), F.lit("always").alias("reason"))
    chosen = reasons.where("should_rerank").select(*retrieve.PAIR)
    again = pair_scores(first.join(chosen, list(retrieve.PAIR), "left_semi"), "req_text", "unit_text", make, "reranker_score")
    lift = F.when(F.col("exact") >= 0.5, F.least(F.lit(0.12), 0.04 + 0.08 * F.col("exact"))).when(F.col("topic") > 0, F.least(F.lit(0.06), 0.02 + 0.04 * F.col("topic"))).otherwise(0.0)
    again = again.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.col("reranker_score") + lift, F.lit(0.9999))), 4)).withColumn("reranker_score", F.round("reranker_score", 4)).withColumn("reranker_used", F.lit(True))
    rest = ranked.join(chosen, list(retrieve.PAIR), "left_anti").withColumn("reranker_score", F.lit(None).cast("double")).withColumn("reranker_used", F.lit(False))
    return again.unionByName(rest).drop("rank")


def classified(sentences: DataFrame, make: Make, threshold: float = 0.5) -> DataFrame:
    """UDF-4, FLT-5: sentences that a classifier takes for requirements, with `classifier_score`.

    make() gives a function from a list of texts to a list of probabilities.
    """

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series([float(p) for p in model(texts.fillna("").tolist())])

    return sentences.withColumn("classifier_score", probability("text")).where(F.col("classifier_score") >= threshold).withColumn("classifier_score", F.round("classifier_score", 4))


def from_model(fragments: DataFrame, make: Make, threshold: float = 0.5) -> DataFrame:
    """REQ-6: sentences of sections that a classifier picks, without boilerplate, compound ones split into their items."""
    each = requirements.section_sentences(fragments)
    kept = classified(each, make, threshold).where(~E.is_boilerplate(F.col("text")))
    parts = kept.withColumn("parts", E.split_compound(F.col("text"))).withColumn("n_parts", F.size("parts")).select("*", F.posexplode("parts").alias("item", "part"))
    base = F.concat_ws("::", "doc_id", F.coalesce("section_id", F.lit("")), F.concat(F.lit("s"), F.col("i").cast("string")), F.when(F.col("n_parts") > 1, F.concat(F.lit("i"), F.col("item").cast("string"))))
    named = requirements.unique_ids(parts.withColumn("text", F.col("part")).withColumn("pos", F.col("pos") * 100000 + F.col("i") * 100 + F.col("item")).drop("part", "parts"), base)
    return requirements.with_features(named.drop("n_parts", "item"))


def cross_encoder_judge(pairs: DataFrame, make: Make, covered: float = 0.8, partial: float = 0.3) -> DataFrame:
    """JDG-4, SCO-24: label and confidence of pairs (req_text, unit_text) from a pair model's raw score, by its sigmoid."""
    rows = pair_scores(pairs, "req_text", "unit_text", make, "raw_score")
    p = 1 / (1 + F.exp(-F.col("raw_score")))
    return rows.withColumns({"label": S.sigmoid_label(F.col("raw_score"), covered, partial), "confidence": p, "missing_aspects": X.strings([]), "actions": X.strings([])})


def asked(rows: DataFrame, prompt: str, make: Make, system: str = prompts.SYSTEM, tries: int = 3, concurrency: int | None = None, out: str = "raw") -> DataFrame:
    """UDF-3, JDG-5, JDG-11, JDG-12: answers of a language model: `raw`, or null with `failure` after all tries.

    make() gives a function from (system, prompt) to a text; one client serves a partition, and `concurrency` partitions are
    the cap on calls at a time. A lost task asks again only for its own partition.
    """
    rows = rows.repartition(concurrency) if concurrency else rows

    @F.pandas_udf(f"{out} string, failure string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for texts in batches:
            got = []
            for t in texts:
                answer, failure = None, None
                for _ in range(max(1, tries)):
                    try:
                        answer, failure = model(system, t), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises, the pair is unjudged and says so
                        failure = type(e).__name__
                got.append((answer, failure))
            yield pd.DataFrame(got, columns=[out, "failure"])

    return rows.withColumn("__a", ask(prompt)).select("*", f"__a.{out}", "__a.failure").drop("__a")


def _unjudged(parsed: DataFrame) -> DataFrame:
    """JDG-9: pairs without an answer are NOT_JUDGED, with the reason as an action."""
    lost = F.col("failure").isNotNull()
    tag = F.array(F.concat(F.lit(L.UNJUDGED), F.col("failure")))
    return parsed.withColumn("actions", F.when(lost, tag).otherwise(X.strings([]))).withColumns(
        {"label": F.when(lost, "NOT_JUDGED").otherwise(F.col("label")), "confidence": F.when(lost, 0.0).otherwise(F.col("confidence"))}
    )


def llm_judge(pairs: DataFrame, make: Make, model: str, cached: DataFrame | None = None, tries: int = 3, concurrency: int | None = None) -> DataFrame:
    """JDG-5, JDG-7, SNK-6: pairs (req_text, unit_text, role, req_type, req_constraints) judged by a language model.

    Pairs of which `cached` (key, payload) has the answer are not asked for. Adds key, raw and the columns of responses.parse.
    """
    c = F.col
    keyed = pairs.withColumn("key", cache.cache_key(c("req_text"), c("unit_text"), F.lit(model), F.lit(prompts.VERSION), F.lit("llm")))
    todo = keyed if cached is None else cache.misses(keyed, cached)
    todo = todo.withColumn("__p", prompts.prompt(model, c("req_text"), c("unit_text"), c("role"), c("req_type"), c("req_constraints")))
    system = prompts.SYSTEM_COMPACT if any(s in model.lower() for s in L.SMALL_MODELS) else prompts.SYSTEM
    answered = asked(todo, "__p", make, system, tries, concurrency).drop("__p")
    if cached is not None:
        answered = answered.unionByName(cache.hits(keyed, cached).withColumnRenamed("payload", "raw").withColumn("failure", F.lit(None).cast("string")))
    return _unjudged(responses.parse(answered, "raw", "unit_text")).drop("failure")


def llm_judge_batches(pairs: DataFrame, make: Make, tries: int = 3, concurrency: int | None = None) -> DataFrame:
    """JDG-6, JDG-8, JDG-11: one call for all fragments of a requirement and target, answers dealt back by their index.

    pairs: the keys of retrieve.PAIR, unit_id, rank, req_text, unit_text, role, req_constraints; the selector keeps a
    group to a handful. Pairs that the answer leaves out are NOT_JUDGED.
    """
    c = F.col
    one = pairs.groupBy(*retrieve.PAIR).agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "unit_text"))).alias("u"), F.first("req_text").alias("req_text"), F.first("role").alias("role"), F.first("req_constraints").alias("req_constraints"))
    one = one.withColumn("expected", F.size("u")).withColumn("__p", prompts.batch(c("req_text"), F.transform("u", lambda x: x["unit_text"]), c("role"), c("req_constraints")))
    answered = stage(asked(one, "__p", make, prompts.SYSTEM_BATCH, tries, concurrency).drop("__p"))
    dealt = responses.parse_batch(answered).select(*retrieve.PAIR, c("index").alias("i"), F.to_json("answer").alias("raw"))
    units = answered.select(*retrieve.PAIR, "failure", F.posexplode("u").alias("i", "x")).select(*retrieve.PAIR, "failure", "i", "x.unit_id", "x.unit_text")
    rows = units.join(dealt, [*retrieve.PAIR, "i"], "left").withColumn("failure", F.coalesce("failure", F.when(c("raw").isNull(), "no_answer")))
    return _unjudged(responses.parse(rows, "raw", "unit_text")).drop("failure", "i")


def trace_judge(links: DataFrame, make: Make | None = None) -> DataFrame:
    """UDF-6, JDG-13: explanation and score of a (requirement, test) link by a model; without one the baseline's, and no score."""
    if make is None:
        return links.withColumn("explanation", F.lit("Rules only: no judge is configured.")).withColumn("judge_score", F.lit(None).cast("double"))
    return pair_scores(links, "req_text", "test_text", make, "judge_score").withColumn("explanation", F.format_string("model score %.3f", "judge_score"))
