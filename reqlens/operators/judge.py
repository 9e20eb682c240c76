"""The rule judge: label and confidence of a (requirement, unit) pair by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqlens.functions import extract as E, score as S, text as X


def signals(side: str, normalized: Column, entities: Column, constraints: Column, section_id: Column) -> dict[str, Column]:
    """What the judge needs of one side, to be made once before pairs are formed."""
    return {
        f"{side}_tok": X.content_tokens(normalized), f"{side}_ent": entities, f"{side}_con": constraints, f"{side}_bare": X.strip_punctuation(normalized), f"{side}_act": E.action(normalized),
        f"{side}_art": E.artifacts(normalized), f"{side}_sec": E.section_number(section_id), f"{side}_subject": E.subject_head(normalized), f"{side}_modal": E.has_normative_modal(normalized), f"{side}_verify": E.is_verification_step(normalized),
    }


def judge(pairs: DataFrame) -> DataFrame:
    """JDG-1 to JDG-3 over pairs that carry `signals` of both sides (req, unit): label, confidence, rule."""
    c = F.col
    pairs = pairs.withColumns(
        {
            "lex": S.jaccard(c("req_tok"), c("unit_tok")), "ent": S.entity_overlap(c("req_ent"), c("unit_ent")), "kinds": S.shared_kinds(c("req_con"), c("unit_con")), "match": S.text_match(c("req_bare"), c("unit_bare")),
            "verb": F.coalesce(c("req_act.verb") == c("unit_act.verb"), F.lit(False)), "art": S.jaccard(c("req_art"), c("unit_art")), "plausible": F.coalesce((c("req_sec") == 4) & c("unit_sec").isin(3, 6), F.lit(False)),
            "shared": F.size(F.array_intersect("req_tok", "unit_tok")),
        }
    )
    pairs = pairs.withColumn("object", F.when(c("verb"), S.jaccard(c("req_act.tokens"), c("unit_act.tokens"))).otherwise(0.0))
    same_object = c("verb") & (c("req_act.phrase") != "") & (c("req_act.phrase") == c("unit_act.phrase"))
    covers = c("verb") & (same_object | (c("object") >= 0.6))
    near = (c("lex") >= 0.80) & (F.size(F.array_union("req_act.tokens", "unit_act.tokens")) >= 2)
    rules = [
        ("constraint_kind", "COVERED", F.size("kinds") > 0),
        ("exact_text", "COVERED", c("match") == "exact"),
        ("text_containment", "COVERED", c("match") == "contained"),
        ("near_exact_lex", "COVERED", near),
        ("verb_object_section", "COVERED", covers & c("plausible") & (c("lex") >= 0.15)),
        ("verb_object", "COVERED", covers & (c("lex") >= 0.20)),
        ("artifact", "COVERED", c("art") >= 0.6),
        ("verb_partial_object", "PARTIAL", c("verb") & (c("object") >= 0.25)),
        ("lex_and_entities", "PARTIAL", (c("lex") >= 0.40) & (c("ent") >= 0.25)),
        ("topical", "PARTIAL", (c("lex") >= 0.20) | ((c("lex") >= 0.12) & (c("ent") >= 0.15))),
        ("artifact_family", "PARTIAL", c("art") > 0),
        ("verification_step", "PARTIAL", c("unit_verify")),
        ("shared_subject", "PARTIAL", (c("req_subject") == c("unit_subject")) & c("req_modal") & c("unit_modal") & (c("lex") >= 0.10)),
        ("weak_vocabulary", "PARTIAL", (c("shared") >= 3) & (c("lex") >= 0.12)),
    ]
    rule, label = F.lit("none"), F.lit("IRRELEVANT")
    for name, value, test in reversed(rules):
        hit = F.coalesce(test, F.lit(False))
        rule, label = F.when(hit, name).otherwise(rule), F.when(hit, value).otherwise(label)
    pairs = pairs.withColumn("rule", rule).withColumn("label", label)
    lex, r = c("lex"), c("rule")
    confidence = (
        F.when(r == "exact_text", 0.95).when(r == "text_containment", 0.90).when(r == "near_exact_lex", 0.85).when(r == "constraint_kind", F.greatest(lex, F.lit(0.7))).when(r == "artifact", 0.7)
        .when(c("label") == "COVERED", F.greatest(lex, F.lit(0.75))).when(c("label") == "PARTIAL", F.greatest(lex, F.when(lex >= 0.20, 0.65).otherwise(0.50))).otherwise(lex)
    )
    missing = {
        "verb_partial_object": ("exact_object_match", "need_object_overlap"), "lex_and_entities": ("object_phrase_match", "verb_object_coverage"), "topical": ("specific_object_match", "constraint_match", "exact_text_overlap"),
        "artifact_family": ("exact_artifact_identity", "full_artifact_coverage"), "verification_step": ("exact_requirement_text", "direct_functional_match"), "shared_subject": ("specific_object_match", "verb_object_coverage"),
        "weak_vocabulary": ("sufficient_lexical_density", "object_phrase_match", "verb_match"),
    }
    aspects = X.strings([])
    for name, tags in missing.items():
        aspects = F.when(r == name, X.strings(tags)).otherwise(aspects)
    return pairs.withColumn("confidence", F.round(confidence, 3)).withColumn("missing_aspects", aspects)
