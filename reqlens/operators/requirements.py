"""Requirement units of source documents: from candidates, fragments or sections, with a boost pass over sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens import lexicon as L
from reqlens.functions import extract as E, text as X

KEYS = ("package_id", "doc_id")


def with_features(rows: DataFrame) -> DataFrame:
    """Normalised text, type, modality, entities and constraints of rows with text and section_title."""
    return rows.withColumns(
        {
            "normalized_text": X.normalize(F.col("text")), "requirement_type": E.requirement_type(F.col("text"), F.col("section_title")), "modality": E.modality(F.col("text")),
            "entities": E.entities(F.col("text")), "constraints": E.constraints(F.col("text")),
        }
    )


def allowed(metadata: Column, section_id: Column, title: Column, text: Column) -> Column:
    """EXT-16: a true policy flag allows; else a section category decides; else the section's number or title; else modality."""
    flag = F.lower(F.coalesce(F.try_element_at(metadata, F.lit("isRequirementLikeForConsistency")), F.lit("")))
    category = F.lower(F.coalesce(F.try_element_at(metadata, F.lit("sectionCategory")), F.lit("")))
    section = E.section_is_requirement(F.coalesce(F.try_element_at(metadata, F.lit("number")), F.try_element_at(metadata, F.lit("sectionNumber")), F.try_element_at(metadata, F.lit("source_number")), section_id), title)
    return F.when(flag == "true", True).when(category.contains("requirement"), True).when(category != "", False).otherwise(F.coalesce(section, E.modality(text) != "unknown"))


def unique_ids(rows: DataFrame, base: Column, order: str = "pos") -> DataFrame:
    """WIN-15: a repeated id gets ::2, ::3, ... in order; rows dropped later keep theirs reserved."""
    n = F.row_number().over(Window.partitionBy(*KEYS, "__base").orderBy(order))
    return rows.withColumn("__base", base).withColumn("__n", n).withColumn("req_id", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("::", "__base", F.col("__n").cast("string")))).drop("__base", "__n")


def from_candidates(rows: DataFrame) -> DataFrame:
    """REQ-2, FLT-6: given candidates that are no boilerplate, are allowed by their section and are not about documentation to prepare."""
    base = F.coalesce(F.concat_ws("::", "doc_id", F.nullif(F.col("fragment_id"), F.lit(""))), F.nullif(F.col("raw_id"), F.lit("")))
    base = F.when(X.text_of(F.col("fragment_id")) != "", F.concat_ws("::", "doc_id", "fragment_id")).when(X.text_of(F.col("raw_id")) != "", F.col("raw_id")).otherwise(F.concat_ws("::", "doc_id", F.lit("cand"), F.col("pos").cast("string")))
    named = unique_ids(rows.withColumn("text", F.trim("text")).where("text != ''"), base)
    prepare = F.coalesce(F.try_element_at(F.col("metadata"), F.lit("prepareType")), F.lit(""))
    return with_features(named.where(~E.is_boilerplate(F.col("text")) & (prepare != "documentation_requirement") & allowed(F.col("metadata"), F.col("section_id"), F.col("section_title"), F.col("text"))))


def from_fragments(rows: DataFrame) -> DataFrame:
    """REQ-3: fragments with a trigger word and five words."""
    kept = rows.withColumn("text", F.trim("text")).where(E.is_requirement_fragment(F.col("text")) & ~E.is_boilerplate(F.col("text")) & allowed(F.col("metadata"), F.col("section_id"), F.col("section_title"), F.col("text")))
    return with_features(unique_ids(kept, F.concat_ws("::", "doc_id", F.coalesce(F.nullif(F.col("fragment_id"), F.lit("")), F.col("pos").cast("string")))))


def section_sentences(fragments: DataFrame) -> DataFrame:
    """Sentences of five words of each section's text, with the section's relevance (null: unknown), place and title."""
    texts = fragments.groupBy(*KEYS, "section_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n").alias("body"), F.min_by("section_title", "pos").alias("section_title"), F.min("pos").alias("pos")
    )
    relevant = E.section_is_requirement(F.col("section_id"), F.col("section_title"))
    each = texts.withColumn("relevant", relevant).select(*KEYS, "section_id", "section_title", "relevant", "pos", F.posexplode(X.sentences(F.col("body"))).alias("i", "text"))
    return each.where(X.word_count(F.col("text")) >= 5)


def from_sections(fragments: DataFrame) -> DataFrame:
    """REQ-4: sentences of five words in sections that are, or may be, about requirements."""
    each = section_sentences(fragments).withColumn("m", E.modality(F.col("text")))
    trigger = F.col("text").rlike(L.flags(L.any_of(L.REQUIREMENT_TRIGGERS)))
    kept = each.where(F.when(F.col("relevant"), trigger | (F.col("m") != "unknown")).when(F.col("relevant").isNull(), F.col("m").isin("must", "must_not", "should")).otherwise(False))
    named = kept.withColumn("pos", F.col("pos") * 100000 + F.col("i"))
    return with_features(unique_ids(named.drop("m"), F.concat_ws("::", "doc_id", F.coalesce("section_id", F.lit("")), F.col("i").cast("string"))))


def with_boost(primary: DataFrame, sections: DataFrame) -> DataFrame:
    """REQ-5, JOIN-11, SET-1: sentences of requirement sections that no primary requirement states yet."""
    first = F.row_number().over(Window.partitionBy(*KEYS, "normalized_text").orderBy("pos"))
    new = sections.where(F.col("relevant") & ~E.is_boilerplate(F.col("text"))).join(primary.select(*KEYS, "normalized_text").distinct(), [*KEYS, "normalized_text"], "left_anti")
    new = new.withColumn("__n", first).where("__n = 1").drop("__n")
    return primary.withColumn("boost", F.lit(False)).unionByName(new.withColumn("boost", F.lit(True)), allowMissingColumns=True)


def diagnostics(fragments: DataFrame, requirements: DataFrame) -> DataFrame:
    """REQ-7, EXT-33: modal markers in a document against requirements extracted; low when markers >= 10 and fewer than a quarter became one."""
    markers = E.marker_count(F.col("text"))
    seen = fragments.groupBy(*KEYS).agg(F.sum(markers).alias("markers"))
    made = requirements.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("extracted"))
    out = seen.join(made, list(KEYS), "left").withColumn("extracted", F.coalesce("extracted", F.lit(0)))
    return out.withColumn("low_coverage", (F.col("markers") >= 10) & (F.col("extracted") * 4 < F.col("markers")))
