"""The pair verifier: ordered rules that confirm, soften or overturn a judged label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqlens import lexicon as L
from reqlens.functions import score as S, text as X
from reqlens.lineage import once_each


def topics(c: Column) -> Column:
    """EXT-24."""
    return F.filter(F.array(*[F.when(X.text_of(c).rlike(L.flags(p)), F.lit(t)) for t, p in L.TOPICS]), lambda x: x.isNotNull())


def _named(hits: dict[str, Column]) -> Column:
    """Names of the conditions that hold."""
    return F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits.items()]), lambda x: x.isNotNull())


def tech_families(c: Column) -> Column:
    """EXT-25: families of which a text names a member."""
    return _named({name: X.contains_any(c, probes) for name, probes in L.TECH_FAMILIES.items()})


def entity_overlap(a: Column, b: Column) -> Column:
    """SCO-16: Jaccard of entities as sets of lower-case words."""
    # most entities are one word, which is its own bag
    bag = lambda e: F.when(e.rlike(r"(?U)\s"), F.array_join(F.array_sort(F.array_distinct(F.split(e, r"(?U)\s+"))), " ")).otherwise(e)
    bags = lambda x: F.array_distinct(F.transform(x, lambda e: bag(F.lower(e))))
    return S.jaccard(bags(a), bags(b))


def prohibits(normalized: Column) -> Column:
    """A12: a prohibition other than a bound on a number."""
    return X.text_of(normalized).rlike(L.flags(L.PROHIBITION + f"(?!{L.BOUND_FOLLOWS})"))


def text_signals(text: Column, normalized: Column) -> Column:
    """What the rules read off one text: bad and good outcomes, bound, prohibition, methodology, technologies, topics."""
    hit = lambda p: X.text_of(text).rlike(L.flags(p))
    outcomes = lambda at: _named({str(i): hit(pair[at]) for i, pair in enumerate(L.SAME_OUTCOMES)})
    return F.struct(
        outcomes(0).alias("bad"), outcomes(1).alias("good"), hit(L.UPPER_BOUND_PROHIBITION).alias("bound"), prohibits(normalized).alias("prohibits"),
        hit(L.METHODOLOGY).alias("method"), tech_families(normalized).alias("tech"), topics(text).alias("topics"),
    )


def same_outcome(a: Column, b: Column) -> Column:
    """One side (signals of both) prohibits a bad outcome, the other states the good one."""
    return F.arrays_overlap(a["bad"], b["good"]) | F.arrays_overlap(b["bad"], a["good"])


def topic_mismatch(a: Column, b: Column) -> Column:
    """The requirement's topic of the first mismatched pair, if the two share no topic."""
    pairs = [F.when(F.array_contains(a, r) & F.array_contains(b, u), F.lit(r)) for r, u in L.TOPIC_MISMATCHES]
    return F.when(~F.arrays_overlap(a, b), F.coalesce(*pairs))


def verify(pairs: DataFrame, outcome_similarity: Column | None = None, outcome_from: float = 0.65) -> DataFrame:
    """VER-0 to VER-11: adds adjusted label, actions; changes confidence and missing_aspects.

    pairs: label, confidence, missing_aspects, role, req_type, and for both sides (req_, unit_) text, norm, tokens,
    entities, constraints; they are read more than once, so stage them. What depends on one text only is found once for
    each distinct text; signals of a pair are made in one projection, the rules are one chain over them.
    outcome_similarity is an optional similarity of the two texts (a model's) that marks equal outcomes from `outcome_from` on.
    """
    c = F.col
    tokens = F.array_intersect("req_tokens", "unit_tokens")
    req, unit = c("__req"), c("__unit")
    p = once_each(pairs, {"__req": ["req_text", "req_norm"], "__unit": ["unit_text", "unit_norm"]}, text_signals).withColumns(
        {
            "__lex": S.jaccard(c("req_tokens"), c("unit_tokens")), "__ent": entity_overlap(c("req_entities"), c("unit_entities")), "__shared": F.size(tokens),
            "__anchor": F.exists(tokens, lambda t: (F.length(t) >= 5) & ~F.array_contains(X.strings(L.ANCHOR_STOP), t)), "__kinds": F.size(S.shared_kinds(c("req_constraints"), c("unit_constraints"))) > 0,
            "__num": S.numeric_conflict(c("req_constraints"), c("unit_constraints")), "__outcome": same_outcome(req, unit), "__bound": req["bound"] & unit["bound"],
            "__model": F.lit(False) if outcome_similarity is None else F.coalesce(outcome_similarity >= outcome_from, F.lit(False)), "__neg": req["prohibits"] != unit["prohibits"],
            "__method": unit["method"], "__tech": F.arrays_overlap(req["tech"], unit["tech"]), "__topic": topic_mismatch(req["topics"], unit["topics"]),
        }
    )
    label, conf, pmi = c("label"), c("confidence"), F.lower("role") == "pmi"
    excluded = c("req_type").isin(*L.NO_CONFLICT_TYPES)
    upgrade = (label == "CONFLICT") & (c("__model") | c("__outcome") | ((c("__outcome") | c("__bound")) & (c("__kinds") | (c("__shared") >= 4) | (c("__ent") >= 0.20))))
    copied = (label == "COVERED") & pmi & ~c("__method") & (c("__lex") >= 0.80)
    sure = (label == "COVERED") & (conf >= 0.80)
    numeric = c("__num") & ~sure & (c("__kinds") | (c("__ent") >= 0.15) | (c("__shared") >= 2) | (conf >= 0.4))
    negated = c("__neg") & (conf >= 0.25)
    linked = (c("__ent") >= 0.20) | (c("__shared") >= 2) | ((label != "CONFLICT") & (conf >= 0.50))
    positive = label.isin("COVERED", "PARTIAL") & (conf >= 0.70)
    unmet = (label == "COVERED") & (F.size("req_constraints") > 0) & (F.size("unit_constraints") == 0)
    apart = (label == "COVERED") & (F.size("req_entities") >= 3) & (F.size("unit_entities") >= 3) & (c("__ent") < 0.1)
    weak = (label == "COVERED") & pmi & (c("__lex") < 0.20) & (c("__ent") < 0.25)
    bare = (label == "PARTIAL") & (F.size("req_entities") >= 3) & (F.size("unit_entities") == 0) & (conf < 0.85)
    same = "__same"
    rules = [  # condition, label, tag
        (excluded & (label == "CONFLICT"), "PARTIAL", "demote_conflict_type_excluded"),
        (excluded, same, "no_op_type_excluded"),
        (upgrade, "COVERED", "upgrade_conflict_same_outcome_covered"),
        (copied, "PARTIAL", "demote_covered_pmi_no_methodology"),
        (numeric, "CONFLICT", "conflict_confirmed_numeric"),
        (label == "IRRELEVANT", "IRRELEVANT", "no_op_irrelevant"),
        (negated & c("__model"), same, "suppress_negation_embedding_same_outcome"),
        (negated & (c("__outcome") | c("__bound")), "PARTIAL", "suppress_negation_same_outcome"),
        (negated & ~linked & (label == "CONFLICT"), "IRRELEVANT", "demote_conflict_negation_no_topic"),
        (negated & linked & (label == "CONFLICT"), "CONFLICT", "conflict_confirmed_negation"),
        (negated & linked & ~positive, same, "no_op_negation_no_upgrade"),
        (unmet, "PARTIAL", "demote_covered_constraints_missing"),
        (apart, "PARTIAL", "demote_covered_low_entity_overlap"),
        (bare & (c("__lex") >= 0.20), same, "preserve_partial_low_entity_high_lex"),
        (bare & c("__anchor") & (conf >= 0.60), same, "preserve_partial_shared_anchor"),
        (bare & c("__tech") & (conf >= 0.60), same, "preserve_partial_tech_stack"),
        (bare, "IRRELEVANT", "demote_partial_zero_entity_overlap"),
        (label.isin("PARTIAL", "COVERED") & c("__topic").isNotNull(), "IRRELEVANT", "demote_topic_mismatch"),
        (label == "CONFLICT", same, "no_op_llm_conflict_unverified"),
    ]
    place = F.lit(len(rules))
    for i, (test, _, _) in reversed(list(enumerate(rules))):
        place = F.when(F.coalesce(test, F.lit(False)), F.lit(i)).otherwise(place)
    p = p.withColumn("__rule", place)
    number = {tag: i for i, (_, _, tag) in enumerate(rules)}
    adjusted, tag = label, F.lit("no_op_kept_label")
    for i, (_, to, name) in reversed(list(enumerate(rules))):
        adjusted = F.when(c("__rule") == i, label if to == same else F.lit(to)).otherwise(adjusted)
        tag = F.when(c("__rule") == i, F.concat(F.lit("demote_topic_mismatch_"), "__topic") if name == "demote_topic_mismatch" else F.lit(name)).otherwise(tag)
    past = lambda name: c("__rule") > number[name]
    weakly = weak & past("demote_covered_low_entity_overlap")
    # tags of rules that don't end the cascade come before the deciding one
    before = [
        F.when(c("__num") & sure & past("conflict_confirmed_numeric"), "suppress_numeric_judge_strong_covered"),
        F.when(c("__num") & ~numeric & past("conflict_confirmed_numeric"), "suppress_numeric_no_topic"),
        F.when(negated & ~linked & (c("__rule") >= number["demote_conflict_negation_no_topic"]), "suppress_negation_no_topic"),
        F.when(negated & linked & positive & past("no_op_negation_no_upgrade"), "suppress_negation_judge_positive"),
        F.when(weakly, "demote_covered_pmi_weak_link"),
    ]
    aspects = (
        F.when(c("__rule") == number["demote_covered_pmi_no_methodology"], F.array(F.lit("методика проверки требования не описана в фрагменте")))
        .when(c("__rule") == number["demote_covered_constraints_missing"], F.transform("req_constraints", lambda x: F.concat_ws(" ", F.lit("Numeric constraint not verified:"), x["value"].cast("string"), F.coalesce(x["unit"], F.lit("")))))
        .when(weakly, F.array(F.lit("ПМИ-фрагмент не ссылается на требование")))
        .otherwise(X.strings([]))
    )
    confirmed = (c("__rule") == number["conflict_confirmed_numeric"]) & ((label == "IRRELEVANT") | (conf < 0.85)) | (c("__rule") == number["conflict_confirmed_negation"]) & (conf < 0.85)
    out = p.withColumns(
        {
            "adjusted": adjusted, "actions": F.filter(F.array(*before, tag), lambda x: x.isNotNull()), "__aspects": F.concat("missing_aspects", aspects), "__conf": F.when(confirmed, 0.95).otherwise(conf),
        }
    )
    return out.withColumns({"missing_aspects": c("__aspects"), "confidence": c("__conf")}).drop(*[x for x in out.columns if x.startswith("__")])
