"""Building data sets: documents and roles of package folders, labelled sentences, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from reqlens import lexicon as L
from reqlens.functions import extract as E, text as X
from reqlens.lineage import stage
from reqlens.sources.packages import CANDIDATE, FRAGMENT, LEGACY, SECTION

SECTION_FILE = "array<struct<sectionId:string,num:string,title:string,text:string>>"
DUMP = "document_id string, sections array<struct<id:string,section_name:string,level:int,number:string>>, bq_candidates array<struct<candidate_id:string,candidate_type:string,text:string,source_section_id:string,source_section_name:string,section_category:string>>"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(X.text_of(c), r"(?U)\s+", " "))


def reasonable(c: Column, least: int = 5, most: int = 80) -> Column:
    """FLT-3: sentences of so many words."""
    return X.word_count(c).between(least, most)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: package files of either shape, with `format`: sections, chunks or unknown. One schema reads both."""
    schema = f"filename string, sections {SECTION_FILE}, {LEGACY}"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("format", package_format(F.col("sections"), F.col("documents")))


def package_format(sections: Column, documents: Column) -> Column:
    return F.when(documents.isNotNull(), "chunks").when(sections.isNotNull(), "sections").otherwise("unknown")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: a preparation service's dumps as documents with sections, fragments and requirement candidates."""
    return prepared(spark.read.schema(DUMP).option("multiLine", True).json(path))


def prepared(dump: DataFrame) -> DataFrame:
    """SRC-7: kinds of fragments and the candidates among them follow from the candidates' types."""
    kinds = F.create_map(*[F.lit(x) for kv in L.FRAGMENT_KINDS.items() for x in kv])

    def meta(c: Column) -> Column:
        names = {"sectionId": "source_section_id", "sectionTitle": "source_section_name", "fragmentId": "candidate_id", "candidateType": "candidate_type", "sectionCategory": "section_category"}
        return F.map_filter(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), c[v])]), lambda _, v: v.isNotNull())

    sections = F.transform("sections", lambda s: F.struct(s["id"].alias("section_id"), s["section_name"].alias("title"), s["level"].alias("level"), s["number"].alias("number"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("text")))
    fragment = lambda c: F.struct(c["candidate_id"].alias("fragment_id"), c["text"].alias("text"), F.coalesce(F.element_at(kinds, c["candidate_type"]), F.lit("paragraph")).alias("kind"), c["source_section_id"].alias("section_id"), F.lit(None).cast("int").alias("page"), meta(c).alias("metadata"))
    candidate = lambda c: F.struct(c["candidate_id"].alias("req_id"), c["text"].alias("text"), c["source_section_id"].alias("section_id"), c["candidate_id"].alias("fragment_id"), meta(c).alias("metadata"))
    wanted = F.filter("bq_candidates", lambda c: c["candidate_type"].isin(*L.CANDIDATE_TYPES))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return dump.select(
        "document_id", F.coalesce(sections, empty(SECTION)).alias("sections"), F.coalesce(F.transform("bq_candidates", fragment), empty(FRAGMENT)).alias("fragments"), F.coalesce(F.transform(wanted, candidate), empty(CANDIDATE)).alias("requirement_candidates")
    )


def chosen_files(files: DataFrame, least: int = 2) -> DataFrame:
    """MSC-10: for each folder the specification and the test programme among its files, by their heads.

    files: folder, file, head. A file of the type comes before any other, then the higher score, then the first name; one
    file can't be both, and a folder of one file has neither.
    """
    rows = files.withColumn("s", E.head_scores(F.col("head"))).withColumn("t", E.head_type(F.col("s"), least))
    best = lambda kind, score: F.min_by("file", F.struct((F.col("t") != kind).alias("other"), (-F.col(score)).alias("score"), "file"))
    picked = rows.groupBy("folder").agg(best("TZ", "s.tz").alias("tz_file"), best("PMI", "s.pmi").alias("pmi_file"), F.count(F.lit(1)).alias("n_files"))
    clear = (F.col("n_files") > 1) & (F.col("tz_file") != F.col("pmi_file"))
    return picked.select("folder", "n_files", F.when(clear, F.col("tz_file")).alias("tz_file"), F.when(clear, F.col("pmi_file")).alias("pmi_file"))


def folder_status(picked: DataFrame, chunks: DataFrame, least: int = 20) -> DataFrame:
    """FLT-8: OK, SKIP_SMALL (a chosen file has fewer chunks than `least`) or why a folder is ambiguous.

    chunks: folder, file and a row for each chunk.
    """
    n = chunks.groupBy("folder", "file").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind: n.select("folder", F.col("file").alias(f"{kind}_file"), F.col("n").alias(f"{kind}_chunks"))
    out = picked.join(of("tz"), ["folder", "tz_file"], "left").join(of("pmi"), ["folder", "pmi_file"], "left").fillna(0, ["tz_chunks", "pmi_chunks"])
    status = F.when(F.col("n_files") < 2, "AMBIGUOUS_TOO_FEW_FILES").when(F.col("tz_file").isNull(), "AMBIGUOUS_CLASSIFY").when(F.least("tz_chunks", "pmi_chunks") < least, "SKIP_SMALL").otherwise("OK")
    return out.select("folder", "tz_file", "pmi_file", "tz_chunks", "pmi_chunks", status.alias("status"))


def is_specification_file(name: Column) -> Column:
    """MSC-12."""
    return X.contains_any(name, L.TZ_FILENAMES)


def chunk_sentences(chunks: DataFrame) -> DataFrame:
    """WIN-12, EXT-36: sentences of chunks in order with the kind of the section they stand in.

    chunks: package_id, doc_id, pos, chunk_id, text. The last heading of a known kind before a chunk tells its kind; before
    the first one it is non_req, and so are headings themselves. Returns package_id, doc_id, pos, i, chunk_id, text, kind.
    """
    rows = chunks.withColumn("text", F.trim("text")).where(X.text_of(F.col("text")) != "").withColumn("h", E.heading(F.col("text")))
    own = E.section_kind(F.col("h.section_id"), F.col("h.title"))
    so_far = Window.partitionBy("package_id", "doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("kind", F.coalesce(F.last(F.when(F.col("h").isNotNull() & (own != "unknown"), own), ignorenulls=True).over(so_far), F.lit("non_req")))
    is_heading = F.col("h").isNotNull()
    parts = F.when(is_heading, F.array(F.col("text"))).otherwise(X.sentences(F.col("text")))
    each = rows.select("package_id", "doc_id", "pos", F.posexplode(parts).alias("i", "text"), "chunk_id", F.when(is_heading, "non_req").otherwise(F.col("kind")).alias("kind"), is_heading.alias("heading"))
    each = each.withColumn("text", squeezed(F.col("text"))).where(F.when(F.col("heading"), reasonable(F.col("text"), 1)).otherwise(reasonable(F.col("text"))))
    return each.select("package_id", "doc_id", "pos", "i", "chunk_id", "text", "kind")


def section_sentences(files: DataFrame) -> DataFrame:
    """MSC-12: sentences of files in sections of which the name is a specification's. files: package_id, filename, sections."""
    rows = files.where(is_specification_file(F.col("filename"))).select("package_id", F.posexplode("sections").alias("pos", "s"))
    title = F.trim(X.text_of(F.col("s.title")))
    section = F.coalesce(F.nullif(F.col("s.sectionId"), F.lit("")), F.nullif(F.col("s.num"), F.lit("")), title)
    each = rows.select("package_id", "pos", section.alias("chunk_id"), E.section_kind(section, title).alias("kind"), F.posexplode(X.sentences(F.col("s.text"))).alias("i", "text"))
    return each.withColumn("text", squeezed(F.col("text"))).where(reasonable(F.col("text"))).select("package_id", "pos", "i", "chunk_id", "text", "kind")


def distinct_positives(rows: DataFrame, order: str = "pos") -> DataFrame:
    """DED-4, SRC-10: texts (text, `order`) of three words or more, of those with one key the first: key, text."""
    named = rows.select(order, squeezed(F.col("text")).alias("text")).where(reasonable(F.col("text"), 3)).withColumn("key", label_key(F.col("text"))).where("key != ''")
    return named.groupBy("key").agg(F.min_by("text", order).alias("text"))


def label_key(c: Column) -> Column:
    """TXT-10 with the marks that end quotations and dashes too."""
    return F.regexp_replace(F.lower(squeezed(c)), "(?U)[\\s.,;:!?\\-–—«»\"']+$", "")


#: Most frequent tokens of the known texts of which `fuzzy_matches` knows the frequency, and bounds between its classes.
ORDERED_TOKENS, FREQUENCY_CLASSES = 10_000, (32, 8, 2)


def fuzzy_matches(rows: DataFrame, others: DataFrame, id_col: str, least: float = 0.85, ordered: int = ORDERED_TOKENS) -> DataFrame:
    """JOIN-12, SCO-23: ids of rows (id, text) with a text among others (text) of half to twice as many words and token Jaccard from `least` on."""
    low = F.greatest(F.lit(1), F.floor(F.col("w") / 2))
    common = F.size(F.array_intersect("t", "ot"))
    near = (F.col("ow") >= low) & (F.col("ow") <= F.col("w") * 2) & (common >= least * (F.size("t") + F.size("ot") - common))
    return fuzzy_candidates(rows, others, id_col, least, ordered).where(near).select(id_col).distinct()


def fuzzy_candidates(rows: DataFrame, others: DataFrame, id_col: str, least: float, ordered: int = ORDERED_TOKENS) -> DataFrame:
    """Pairs that `fuzzy_matches` verifies, with words (w, ow) and tokens (t, ot) of both; a pair may come several times.

    Prefix filter: with tokens in one fixed order, two sets that are similar enough share a token among the first
    n - ceil(least * n) + 1 of each, so that the join on these loses nothing; pairs are then verified. In the order, tokens
    that no other text has come first and meet nothing, frequent ones come last and seldom are in a prefix; of the tokens
    of `others` the `ordered` most frequent are known, and with more of them the rest count as rare. Rows of more or fewer
    words or tokens than any other text allows are not compared.
    """
    tokens = lambda c: X.tokens(c, L.LEGACY_TOKEN)
    theirs = stage(others.select("text").distinct().select(X.word_count(F.col("text")).alias("ow"), tokens(F.col("text")).alias("ot")).where(F.size("ot") > 0))
    known = theirs.select(F.explode("ot").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x").limit(ordered + 1).collect()
    whole, known = len(known) <= ordered, known[:ordered]
    least_w, most_w, least_n, most_n = theirs.agg(F.min("ow"), F.max("ow"), F.min(F.size("ot")), F.max(F.size("ot"))).first()
    bounds = [float("inf"), *FREQUENCY_CLASSES, 0]
    classes = [[r["x"] for r in known if low < r["n"] <= high] for high, low in zip(bounds, bounds[1:])]

    # as SQL text, since a call for each token would take longer than the join; tokens hold letters, digits and _ only
    sets = ["', '".join(words) for words in classes]
    place = "CASE " + " ".join(f"WHEN x IN ('{words}') THEN {len(sets) - i}" for i, words in enumerate(sets) if words) + " ELSE 0 END" if known else "0"

    def prefix(t: str) -> Column:
        placed = F.sort_array(F.expr(f"transform({t}, x -> named_struct('p', {place}, 'h', xxhash64(x), 'x', x))"))
        first = F.slice(placed, F.lit(1), F.size(t) - F.ceil(F.size(t) * least).cast("int") + 1)
        return F.transform(F.filter(first, lambda s: s["p"] > 0) if whole else first, lambda s: s["x"])

    near_size = (F.col("w") * 2 >= least_w) & (F.greatest(F.lit(1), F.floor(F.col("w") / 2)) <= most_w)
    left = rows.select(id_col, "text", X.word_count(F.col("text")).alias("w")).select(id_col, "w", F.when(near_size, tokens(F.col("text"))).alias("t"))
    comparable = (F.size("t") > 0) & (F.size("t") >= least * least_n) & (most_n >= least * F.size("t"))
    if whole and known:  # what is left after this is little, and only that is put in order
        listed = "', '".join(r["x"] for r in known)
        comparable = comparable & (F.expr(f"size(filter(t, x -> x IN ('{listed}')))") >= least * F.size("t"))
    # outer: for an inner one Spark would make the tokens a second time, to filter rows without any
    left = left.select(id_col, "w", "t", F.explode_outer(F.when(comparable, prefix("t"))).alias("token"))
    right = theirs.withColumn("token", F.explode(prefix("ot")))
    return left.join(right, "token")


def label_sentences(sentences: DataFrame, positives: DataFrame, least: float = 0.85) -> DataFrame:
    """FLT-7: label of every sentence (package_id, doc_id, pos, i, text, kind): 1, 0 or null, and why.

    non_req: negative, unless a word states a requirement. req: positive if it is near a known one, else left open.
    """
    keyed = sentences.withColumn("sid", F.sha2(F.concat_ws("\u001f", "package_id", F.col("pos").cast("string"), F.col("i").cast("string"), "text"), 256))
    near = fuzzy_matches(keyed.where("kind = 'req'").select("sid", "text"), positives.select("text"), "sid", least).withColumn("near", F.lit(True))
    rows = keyed.join(near, "sid", "left")
    modal = X.text_of(F.col("text")).rlike(L.flags(L.BODY_TRIGGER))
    kind = F.col("kind")
    reason = F.when((kind == "non_req") & modal, "modality_gated").when(kind == "non_req", "negative").when(kind == "unknown", "unknown_section").when(F.col("near"), "positive").otherwise("grey_zone")
    return rows.withColumn("reason", reason).withColumn("label", F.when(F.col("reason") == "positive", 1).when(F.col("reason") == "negative", 0)).drop("near", "sid")


def stratified(rows: DataFrame, bucket: str, quota: Column, id_col: str, seed: int = 42) -> DataFrame:
    """WIN-14: up to `quota` rows of each bucket, in order of a hash of seed and id."""
    order = F.row_number().over(Window.partitionBy(bucket).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col))
    return rows.withColumn("__n", order).where(F.col("__n") <= quota).drop("__n")
