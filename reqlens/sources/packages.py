"""Packages of documents: request files, legacy chunk files, pair tables; and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FRAGMENT = "struct<fragment_id:string,text:string,kind:string,section_id:string,page:int,metadata:map<string,string>>"
SECTION = "struct<section_id:string,title:string,level:int,number:string,category:string,text:string>"
CANDIDATE = "struct<req_id:string,text:string,section_id:string,fragment_id:string,metadata:map<string,string>>"
ARTIFACT = f"struct<document_id:string,package_id:string,doc_role:string,filename:string,sections:array<{SECTION}>,fragments:array<{FRAGMENT}>,requirement_candidates:array<{CANDIDATE}>,sentences:array<{FRAGMENT}>>"
REQUEST = f"job_id string, package_id string, source_doc_role string, target_doc_roles array<string>, documents array<struct<document_id:string,doc_role:string,prepared_artifact:{ARTIFACT}>>, options map<string,string>"
LEGACY = "package_id string, documents array<struct<doc_id:string,doc_type:string,chunks:array<struct<chunk_id:string,section_path:string,text:string,order:int,page:int>>>>"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: one package a file or a line."""
    return spark.read.schema(REQUEST).option("multiLine", True).json(path)


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3, SRC-6: chunks of packages: package_id, doc_id, doc_type, chunk_id, pos, text; blank chunks are left out."""
    rows = spark.read.schema(LEGACY).option("multiLine", True).json(path).select("package_id", F.explode("documents").alias("d"))
    each = rows.select("package_id", "d.doc_id", F.upper("d.doc_type").alias("doc_type"), F.posexplode("d.chunks").alias("pos", "c"))
    return each.select("package_id", "doc_id", "doc_type", "c.chunk_id", "pos", F.trim("c.text").alias("text")).where("text != ''")


def documents(requests: DataFrame) -> DataFrame:
    """FLT-1, FLT-2: one row a document, with role tz, pmi, pz or unknown; of several source documents the last one counts.

    A target with the id of its package's source is left out; where neither has an id, one with its file name and role.
    """
    rows = requests.select("package_id", F.coalesce("source_doc_role", F.lit("tz")).alias("source_role"), F.coalesce("target_doc_roles", F.array(F.lit("pmi"), F.lit("pz"))).alias("target_roles"), F.posexplode("documents").alias("doc_pos", "d"))
    role = F.lower(F.trim("d.doc_role"))
    rows = rows.select("package_id", "source_role", "target_roles", "doc_pos", F.col("d.document_id").alias("doc_id"), F.when(role.isin("tz", "pmi", "pz"), role).otherwise("unknown").alias("doc_role"), F.col("d.prepared_artifact").alias("a"))
    source = rows.where("doc_role = source_role").groupBy("package_id").agg(F.max_by("doc_id", "doc_pos").alias("source_id"), F.max_by("a", "doc_pos").alias("source_a"), F.max("doc_pos").alias("source_pos"))
    rows = rows.join(source, "package_id", "left")
    is_source = F.col("doc_pos") == F.col("source_pos")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = (text("a.filename") != "") & (text("a.filename") == text("source_a.filename")) & (F.lower(text("a.doc_role")) == F.lower(text("source_a.doc_role")))
    same = ((text("doc_id") != "") & (text("doc_id") == text("source_id"))) | ((text("doc_id") == "") & (text("source_id") == "") & named)
    is_target = F.array_contains("target_roles", F.col("doc_role")) & (F.col("doc_role") != F.col("source_role")) & ~same
    return rows.withColumn("side", F.when(is_source, "source").when(is_target, "target")).where("side IS NOT NULL").drop("source_id", "source_a", "source_pos", "target_roles", "source_role")


def fragments(docs: DataFrame) -> DataFrame:
    """SRC-5, JOIN-4: fragments, or sentences where there are none, in order and with their section's title."""
    from_ = F.when(F.size("a.fragments") > 0, F.col("a.fragments")).otherwise(F.col("a.sentences"))
    each = docs.select("package_id", "doc_id", "doc_role", "side", F.col("a.sections").alias("sections"), F.posexplode(from_).alias("pos", "f"))
    title = F.filter("sections", lambda s: s["section_id"] == F.col("f.section_id"))
    meta = lambda k: F.nullif(F.try_element_at(F.col("f.metadata"), F.lit(k)), F.lit(""))
    return each.select(
        "package_id", "doc_id", "doc_role", "side", "pos", "f.fragment_id", "f.section_id", "f.kind", "f.text", F.coalesce("f.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        F.coalesce(meta("section_title"), meta("sectionTitle"), F.try_element_at(title, F.lit(1))["title"]).alias("section_title"), F.lit(None).cast("string").alias("raw_id"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """Given requirement candidates, in the shape of fragments."""
    each = docs.select("package_id", "doc_id", "doc_role", "side", F.col("a.sections").alias("sections"), F.posexplode("a.requirement_candidates").alias("pos", "f"))
    title = F.filter("sections", lambda s: s["section_id"] == F.col("f.section_id"))
    return each.select(
        "package_id", "doc_id", "doc_role", "side", "pos", "f.fragment_id", "f.section_id", F.lit(None).cast("string").alias("kind"), "f.text", F.coalesce("f.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        F.try_element_at(title, F.lit(1))["title"].alias("section_title"), F.col("f.req_id").alias("raw_id"),
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: labelled pairs; rows with a blank text are left out."""
    rows = spark.read.schema("tz_req_text string, pmi_unit_text string, label int, pair_type string, pkg_id string").csv(path, header=True, multiLine=True, escape='"')
    return rows.where("trim(coalesce(tz_req_text, '')) != '' AND trim(coalesce(pmi_unit_text, '')) != ''")


def write_results(results: DataFrame, path: str) -> None:
    """SNK-1."""
    results.write.json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """SNK-2: JSON lines by split."""
    rows.write.partitionBy("split").json(path)


def write_pairs(rows: DataFrame, path: str) -> None:
    """SNK-3."""
    rows.write.csv(path, header=True, escape='"')
