"""Coverage units of target documents: fragments, section windows, and prefix deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from reqlens import lexicon as L
from reqlens.functions import extract as E, text as X

#: Fragments have package_id, doc_id, doc_role, pos, fragment_id, section_id, kind, text and section_title.
KEYS = ("package_id", "doc_id")


def usable_fragments(fragments: DataFrame) -> DataFrame:
    """FLT-3, EXT-19, EXT-20: at least two words, no list introduction, not the section's title."""
    return fragments.where((X.word_count(F.col("text")) >= L.MIN_UNIT_WORDS) & ~E.is_list_intro(F.col("text")) & ~E.is_heading_only(F.col("text"), F.col("section_title")))


def section_windows(fragments: DataFrame, size: int = L.WINDOW_SIZE, chars: int = L.WINDOW_CHARS) -> DataFrame:
    """UNT-2: consecutive fragments of a section in groups of at most `size`; a second self-contained sentence opens a new group.

    Where a group opens depends on all groups before it, which no window function says: the rows of each section, sorted
    by Spark, stream through one pass that holds the open group alone. Documents without any section give none.
    """
    named = F.nullif(X.text_of(F.col("section_id")), F.lit(""))
    title = F.nullif(X.text_of(F.col("section_title")), F.lit(""))
    section = [*KEYS, "doc_role", "__sid"]
    rows = usable_fragments(fragments).select(*KEYS, "doc_role", F.coalesce(named, F.lit("__no_section__")).alias("__sid"), "pos", F.trim("text").alias("text"), E.is_self_contained(F.col("text")).alias("__sc"), title.alias("__title"))
    known = fragments.groupBy(*KEYS).agg(F.max(named.isNotNull() | title.isNotNull()).alias("known")).where("known").select(*KEYS)
    ordered = Window.partitionBy(*section).orderBy("pos", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.join(known, list(KEYS), "left_semi").select(
        *section, F.min_by("__title", F.when(F.col("__title").isNotNull(), F.col("pos"))).over(ordered).alias("section_title"), F.min("pos").over(ordered).alias("first_pos"), "text", "__sc", "pos"
    )
    rows = rows.sortWithinPartitions(*section, "pos", "text").drop("pos")  # the window's own order, so that nothing is sorted again
    schema = T.StructType([*(rows.schema[c] for c in [*section, "section_title", "first_pos", "text"]), T.StructField("window_start", T.IntegerType()), T.StructField("window_size", T.IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, texts, own, start = None, [], 0, 0  # the open group: its section, fragments, self-contained ones and first place
        for batch in batches:
            out = []
            for *now, text, alone in zip(*(c.to_pylist() for c in batch.columns)):
                if now != head or len(texts) >= size or (alone and own):
                    if texts:
                        out.append((*head, " ".join(texts), start, len(texts)))
                    start = start + len(texts) if now == head else 0
                    head, texts, own = now, [], 0
                texts.append(text)
                own += bool(alone)
            yield _batch(out)
        if texts:
            yield _batch([(*head, " ".join(texts), start, len(texts))])

    shape = to_arrow_schema(schema)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(shape)], schema=shape)

    windows = rows.mapInArrow(fold, schema)
    return windows.select(
        *KEYS, "doc_role", F.when(F.col("__sid") != "__no_section__", F.col("__sid")).alias("section_id"), F.concat_ws("::", "__sid", F.lit("window"), F.col("window_start").cast("string")).alias("fragment_id"),
        F.lit("section_window").alias("unit_type"), X.cut_at_sentence(F.trim("text"), chars).alias("text"), "section_title", "first_pos", "window_start", "window_size",
    )


def prefix_dedup(units: DataFrame, order: list, keys=KEYS, chars: int = L.DEDUP_CHARS, growth: int = L.DEDUP_GROWTH) -> DataFrame:
    """DED-3: of units with the same first 400 normalised characters the first stays, and later ones with a new signal or real growth.

    What dropped units held counts as seen. Rows of a document with one prefix are compared, in order, with all before: the
    longest by a running maximum, the signals by the place of the first row that has each (one row a signal and prefix).
    """
    rows = units.withColumn("normalized_text", X.normalize(F.col("text"))).withColumn("__prefix", F.substring("normalized_text", 1, chars)).withColumn("__signals", E.coverage_signals(F.col("text")))
    rows = rows.withColumn("__at", F.struct(*order))
    group = [F.col(k) for k in keys]
    firsts = rows.where(F.size("__signals") > 0).select(*group, "__prefix", "__at", F.explode("__signals").alias("s")).groupBy(*keys, "__prefix", "s").agg(F.min("__at").alias("at"))
    firsts = firsts.groupBy(*keys, "__prefix").agg(F.collect_set("at").alias("__news"))  # as many as there are signals in the lexicon
    before = Window.partitionBy(*keys, "__prefix").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__longest", F.max(F.length("normalized_text")).over(before)).join(firsts, [*keys, "__prefix"], "left")
    keep = F.col("__longest").isNull() | F.coalesce(F.array_contains("__news", F.col("__at")), F.lit(False)) | (F.length("normalized_text") > F.col("__longest") + growth)
    return rows.where(keep).drop("__prefix", "__signals", "__longest", "__at", "__news")


def build_units(fragments: DataFrame) -> DataFrame:
    """UNT-1: units of all target documents: fragments first, then windows, deduplicated together; with entities and constraints."""
    single = usable_fragments(fragments).select(
        *KEYS, "doc_role", "section_id", "fragment_id", E.unit_type(F.col("kind")).alias("unit_type"), F.trim("text").alias("text"), "section_title", F.col("pos").alias("first_pos"), F.lit(None).cast("int").alias("window_start"), F.lit(None).cast("int").alias("window_size"), F.lit(0).alias("layer")
    )
    units = single.unionByName(section_windows(fragments).withColumn("layer", F.lit(1)))
    kept = prefix_dedup(units, ["layer", "first_pos", F.coalesce("window_start", F.lit(0)).alias("start")])
    identity = F.sha2(F.concat_ws("\u001f", "package_id", "doc_id", F.coalesce("fragment_id", F.lit("")), F.col("first_pos").cast("string"), "unit_type"), 256)
    return kept.withColumns({"unit_id": identity, "entities": E.entities(F.col("text")), "constraints": E.constraints(F.col("text"))})
