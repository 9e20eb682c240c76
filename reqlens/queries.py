"""Queries over the driver's tables that apply the operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from reqlens import lexicon as L
from reqlens.functions import extract as E, score as S, text as X
from reqlens.lineage import stage
from reqlens.operators import aggregate, cache, evaluate, legacy, routing, traceability, units

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + "]"


def tokens_sql(c: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '{L.TOKEN}'), lambda t: lower(t)))"


def content_sql(c: str) -> str:
    return f"list_filter({tokens_sql(c)}, lambda t: NOT list_contains({STOPS_SQL}, t))"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0.0 END"


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS digest, length(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS n_chars FROM documents")
def text_normalize(spark, sf_dir):
    """TXT-1."""
    n = X.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n_chars"))


@query(f"SELECT item_id, array_to_string(list_sort({content_sql('text')}), ' ') AS tokens, len({content_sql('text')}) AS n_tokens FROM benchmark")
def tok_content(spark, sf_dir):
    """TXT-2."""
    t = X.content_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(t), " ").alias("tokens"), F.size(t).cast("long").alias("n_tokens"))


@query(r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?…])\s+([\p{Lu}\p{Nd}-])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s != '')) AS n_sentences FROM documents")
def sentence_split(spark, sf_dir):
    """TXT-8."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


TEXTS = (
    (1, "Система должна хранить журнал событий не менее 90 дней."), (2, "Время ответа не более 2 секунд."), (3, "Хранить 30 суток."), (4, "Система не должна передавать данные."),
    (5, "Рекомендуется использовать HTTPS."), (6, "Оператор может выйти."), (7, "Просто текст без чисел"), (8, "ГОСТ 19.101-77 Виды программ и программных документов."),
    (9, "Объём файла не превышает 200 МБ"), (10, "Система должна обеспечивать поиск публикаций по автору."),
)
TEXTS_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in TEXTS) + ") AS t(id, text)"
EDGE = "[^а-яёА-ЯЁa-zA-Z0-9_]"


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "id int, text string")


def bounded_sql(words) -> str:
    return f"regexp_matches(text, '(?i)(^|{EDGE})({'|'.join(words)})({EDGE}|$)')"


@query("SELECT id, CASE " + " ".join(f"WHEN {bounded_sql(ws)} THEN '{m}'" for m, ws in L.MODALITY) + f" ELSE 'unknown' END AS modality FROM {TEXTS_SQL}")
def modality(spark, sf_dir):
    """EXT-1 on literal rows."""
    return texts(spark).select("id", E.modality(F.col("text")).alias("modality"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {bounded_sql(ws)} THEN '{m}'" for m, ws in L.MODALITY) + " ELSE 'unknown' END AS modality FROM documents")
def modality_documents(spark, sf_dir):
    """EXT-1 on all texts of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", E.modality(F.col("text")).alias("modality"))


@query()
def constraints_documents(spark, sf_dir):
    """EXT-5 to EXT-8 on all texts of documents; without SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(E.constraints(F.col("text"))).alias("c")).select("doc_id", "c.kind", "c.operator", "c.value", "c.unit")


@query(
    "SELECT * FROM (VALUES (1, 'retention_period', '>=', 90.0::DOUBLE, 'days'), (2, 'response_time', '<=', 2.0, 'sec'), (3, 'retention_period', '=', 30.0, 'days'), (9, 'size', '<=', 200.0, 'mb')) AS t(id, kind, operator, value, unit)"
)
def constraints_extract(spark, sf_dir):
    """EXT-5 to EXT-8 on literal rows: the pinned constraints of each text; the standard's number is a reference."""
    return texts(spark).select("id", F.explode(E.constraints(F.col("text"))).alias("c")).select("id", "c.kind", "c.operator", "c.value", "c.unit")


ROUTES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in L.REQUIREMENT_TYPES) + ") a(req_type), (VALUES ('pmi'), ('pz'), ('other')) b(role), (VALUES " + ", ".join(f"('{s}')" for s in L.STATUSES) + ") c(status)) r"


@query(
    f"""SELECT req_type, role, status, ap AS applicability,
  CASE WHEN ap != 'APPLICABLE' THEN 'NOT_APPLICABLE' WHEN demoted THEN 'OPTIONAL' WHEN req_type IN ('functional', 'security', 'performance', 'reliability', 'data_io', 'architecture', 'storage', 'logging') THEN 'REQUIRED' ELSE 'OPTIONAL' END AS level,
  CASE WHEN ap != 'APPLICABLE' THEN false WHEN status = 'CONFLICT' THEN true WHEN status = 'COVERED' OR demoted THEN false ELSE status = 'MISSING' AND req_type IN ('functional', 'security', 'performance', 'reliability', 'data_io', 'architecture') END AS critical,
  CASE WHEN ap != 'APPLICABLE' OR status IN ('COVERED', 'UNKNOWN') THEN 'low' WHEN status = 'CONFLICT' THEN 'high' WHEN req_type = 'security' THEN 'high'
       WHEN req_type IN ('performance', 'functional', 'reliability') THEN CASE WHEN role = 'pmi' THEN 'high' ELSE 'medium' END WHEN req_type = 'architecture' THEN CASE WHEN role = 'pz' THEN 'high' ELSE 'low' END
       WHEN req_type IN ('data_io', 'documentation', 'interface') THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT *, role = 'pz' AND req_type IN ('functional', 'data_io', 'performance', 'storage', 'logging') AS demoted,
  CASE WHEN req_type IN ('delivery', 'process') THEN 'OUT_OF_SCOPE' WHEN req_type IN ('architecture', 'economic') AND role != 'pz' THEN 'NOT_APPLICABLE' WHEN req_type = 'documentation' AND role != 'pmi' THEN 'NOT_APPLICABLE' ELSE 'APPLICABLE' END AS ap FROM {ROUTES_SQL}) x"""
)
def routing_matrix(spark, sf_dir):
    """JOIN-9, AGG-10: every type, role and status."""
    rows = [(t, r, s) for t in L.REQUIREMENT_TYPES for r in ("pmi", "pz", "other") for s in L.STATUSES]
    t, r, s = F.col("req_type"), F.col("role"), F.col("status")
    return spark.createDataFrame(rows, "req_type string, role string, status string").select(
        "*", routing.applicability(t, r).alias("applicability"), routing.level(t, r).alias("level"), routing.critical(t, r, s).alias("critical"), routing.severity(t, r, s, F.lit(None).cast("string")).alias("severity")
    )


def turns(spark, sf_dir, role: str) -> DataFrame:
    """User turns stand for requirements and assistant turns for tests, a conversation being a package."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == role).select(F.col("conv_id").cast("string").alias("package_id"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("id"), "text")


TURNS_SQL = f"""
u AS (SELECT conv_id, turn, text, {content_sql('text')} AS tok FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text, {content_sql('text')} AS tok FROM conversations WHERE role = 'assistant')"""
LINKS_SQL = f"""WITH {TURNS_SQL},
p AS (SELECT u.conv_id, u.turn AS r, a.turn AS t, CASE WHEN len(u.tok) > 0 AND len(a.tok) > 0 THEN len(list_intersect(u.tok, a.tok))::DOUBLE / len(u.tok) ELSE 0.0 END AS lex FROM u JOIN a USING (conv_id)),
s AS (SELECT *, 0.7 * lex / 1.0 AS raw FROM p),
k AS (SELECT *, round(raw, 4) AS score, row_number() OVER (PARTITION BY conv_id, r ORDER BY round(raw, 4) DESC, t) AS rank FROM s WHERE raw >= 0.2)"""


@query(f"{LINKS_SQL} SELECT conv_id::VARCHAR AS package_id, r::VARCHAR AS req_id, t::VARCHAR AS test_id, score AS retrieval_score, rank::INTEGER AS rank FROM k WHERE rank <= 5")
def trace_candidates(spark, sf_dir):
    """JOIN-2, SCO-17, SCO-20, WIN-6: lexical candidates between the turns of a conversation."""
    cfg = traceability.TraceConfig()
    found = traceability.candidates(turns(spark, sf_dir, "user"), turns(spark, sf_dir, "assistant"), cfg)
    return found.select("package_id", "req_id", "test_id", "retrieval_score", "rank")


@query(f"{LINKS_SQL} SELECT a.conv_id::VARCHAR AS package_id, a.turn::VARCHAR AS test_id FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE rank <= 5 AND score >= 0.25 AND k.conv_id = a.conv_id AND k.t = a.turn)")
def orphan_tests(spark, sf_dir):
    """JOIN-14."""
    cfg = traceability.TraceConfig()
    tests = turns(spark, sf_dir, "assistant")
    return traceability.orphan_tests(tests, traceability.links(traceability.candidates(turns(spark, sf_dir, "user"), tests, cfg), cfg), cfg)


@query()
def trace_summary(spark, sf_dir):
    """AGG-16 to AGG-20: statuses and score C of each conversation."""
    return traceability.evaluate(turns(spark, sf_dir, "user"), turns(spark, sf_dir, "assistant"))["summary"]


LEGACY_TOKENS = L.LEGACY_TOKEN


def _legacy_sql(c: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '{LEGACY_TOKENS}'), lambda t: lower(t)))"


@query(
    f"""WITH u AS (SELECT conv_id, turn, {_legacy_sql('text')} AS tok FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, {_legacy_sql('text')} AS tok FROM conversations WHERE role = 'assistant'),
p AS (SELECT u.conv_id, u.turn AS r, a.turn AS t, {jaccard_sql('u.tok', 'a.tok')} AS s FROM u JOIN a USING (conv_id)),
b AS (SELECT conv_id, r, max(s) AS s, arg_min(t, {{'s': -s, 't': t}}) AS t FROM p GROUP BY ALL)
SELECT conv_id::VARCHAR AS package_id, r::VARCHAR AS req_key, 'PMI' AS doc_type, s AS score, CASE WHEN s >= 0.72 THEN 'OK' WHEN s >= 0.62 THEN 'PARTIAL' ELSE 'MISSING' END AS status, CASE WHEN s >= 0.62 THEN t::VARCHAR END AS chunk_id FROM b"""
)
def legacy_match(spark, sf_dir):
    """JOIN-3, WIN-8, AGG-22."""
    reqs = turns(spark, sf_dir, "user").withColumnRenamed("id", "req_key")
    return legacy.match(reqs, turns(spark, sf_dir, "assistant").withColumnRenamed("id", "chunk_id").withColumn("doc_type", F.lit("PMI")))


def item_grams(rows: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """Distinct hashes of runs of n words of a text without punctuation."""
    # words become rows once; a run is a word and its followers in the window of one text
    words = rows.select(id_col, F.posexplode(F.split("bare", " ")).alias("i", "w"))
    order = Window.partitionBy(id_col).orderBy("i")
    parts = [F.col("w"), *(F.lead("w", k).over(order) for k in range(1, n))]
    grams = words.select(id_col, F.when(parts[-1].isNotNull(), F.xxhash64(F.concat_ws(" ", *parts))).alias("gram"))
    return grams.where("gram IS NOT NULL").distinct()


@query(
    r"""WITH b AS (SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM benchmark),
d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM documents)
SELECT item_id, doc_id FROM b, d WHERE len(string_split(b.bare, ' ')) >= 5 AND contains(' ' || d.bare || ' ', ' ' || b.bare || ' ')"""
)
def containment_match(spark, sf_dir):
    """SCO-22 at corpus scale: items of five words or more that a document holds word for word.

    A document that holds an item holds the item's first five words; pairs are formed on these and then verified.
    """
    bare = X.strip_punctuation(X.normalize(F.col("text")))
    items = table(spark, sf_dir, "benchmark").select("item_id", bare.alias("bare")).where(F.size(F.split("bare", " ")) >= 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", bare.alias("bare"))
    first = items.select("item_id", F.col("bare").alias("item"), F.xxhash64(F.array_join(F.slice(F.split("bare", " "), 1, 5), " ")).alias("gram"))
    pairs = item_grams(docs, "doc_id").join(first, "gram").select("item_id", "doc_id", "item")
    held = pairs.join(docs, "doc_id").where(F.contains(F.concat(F.lit(" "), "bare", F.lit(" ")), F.concat(F.lit(" "), "item", F.lit(" "))))
    return held.select("item_id", "doc_id").distinct()


BOW_SQL = f"regexp_extract_all(coalesce(text, ''), '{L.TOKEN}')"


@query(
    f"""WITH bt AS (SELECT item_id, lower(t) AS t, count(*) AS n FROM (SELECT item_id, unnest({BOW_SQL}) AS t FROM benchmark) GROUP BY ALL), dt AS (SELECT doc_id, lower(t) AS t, count(*) AS n FROM (SELECT doc_id, unnest({BOW_SQL}) AS t FROM documents) GROUP BY ALL),
bn AS (SELECT item_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM bt GROUP BY ALL), dn AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM dt GROUP BY ALL),
p AS (SELECT item_id, doc_id, sum(bt.n * dt.n)::DOUBLE AS dot FROM bt JOIN dt USING (t) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(dot / (bn.norm * dn.norm), 6) AS score FROM p JOIN bn USING (item_id) JOIN dn USING (doc_id))
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 3"""
)
def bow_cosine_topk(spark, sf_dir):
    """SCO-2, WIN-1 at corpus scale: the three nearest documents of each item, by a join on tokens."""
    terms = lambda df, k: df.select(k, F.explode(F.transform(X.matches(F.col("text"), L.TOKEN), F.lower)).alias("t")).groupBy(k, "t").agg(F.count(F.lit(1)).alias("n"))
    norm = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"{k}_norm"))
    items, docs = terms(table(spark, sf_dir, "benchmark"), "item_id"), terms(table(spark, sf_dir, "documents"), "doc_id")
    dots = items.withColumnRenamed("n", "m").join(docs, "t").groupBy("item_id", "doc_id").agg(F.sum(F.col("m") * F.col("n")).alias("dot"))
    scored = dots.join(norm(items, "item_id"), "item_id").join(norm(docs, "doc_id"), "doc_id").select("item_id", "doc_id", F.round(F.col("dot") / (F.col("item_id_norm") * F.col("doc_id_norm")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where("rank <= 3")


LINES_SQL = r"(SELECT doc_id, source, pos, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL))"


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(
    rf"""WITH r AS (SELECT source, doc_id, pos, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM {LINES_SQL}),
w AS (SELECT *, max(length(norm)) OVER (PARTITION BY source, substring(norm, 1, 400) ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest FROM r)
SELECT source, doc_id, pos FROM w WHERE longest IS NULL OR length(norm) > longest + 160"""
)
def prefix_dedup(spark, sf_dir):
    """DED-3, WIN-10: lines of a source's documents; these texts hold none of the lexicon's signals."""
    rows = lines(spark, sf_dir).withColumnRenamed("line", "text")
    return units.prefix_dedup(rows, ["doc_id", "pos"], keys=("source",)).select("source", "doc_id", F.col("pos").cast("long").alias("pos"))


@query(
    rf"""WITH r AS (SELECT doc_id, pos, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM {LINES_SQL} WHERE len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w != '')) >= 2)
SELECT doc_id::VARCHAR AS doc_id, 's::window::' || min(n) AS fragment_id, count(*)::INTEGER AS window_size FROM r GROUP BY doc_id, n // 4"""
)
def section_windows(spark, sf_dir):
    """UNT-2: lines of a document as fragments of one section."""
    rows = lines(spark, sf_dir).select(
        F.lit("p").alias("package_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("pz").alias("doc_role"), "pos", F.lit("s").alias("section_id"), F.lit(None).cast("string").alias("section_title"), F.col("line").alias("text")
    )
    return units.section_windows(rows).select("doc_id", "fragment_id", "window_size")


@query(
    """WITH c AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL),
t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c), q AS (SELECT sum(x.n * y.n) AS s FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON x.a = y.b),
v AS (SELECT t.n, t.same::DOUBLE / t.n AS po, q.s::DOUBLE / (t.n::DOUBLE * t.n) AS pe FROM t, q)
SELECT n::BIGINT AS n, round(po, 9) AS agreement, round((po - pe) / (1 - pe), 9) AS kappa FROM v"""
)
def kappa(spark, sf_dir):
    """AGG-25 on the two label columns."""
    return evaluate.kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


THRESHOLDS = [0.1, 0.25, 0.5, 0.75]


@query(
    "WITH r AS (SELECT least(d.n_chars / 8000.0, 1.0)::DOUBLE AS s, l.quality AS y FROM labels l JOIN documents d USING (doc_id)), "
    + "t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75]::DOUBLE[]) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE s >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE s >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE s < threshold AND y = 1) AS fn, count(*) FILTER (WHERE s < threshold AND y = 0) AS tn FROM r, t GROUP BY ALL) "
    + "SELECT threshold, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)), 9) AS f1 FROM c"
)
def prf_sweep(spark, sf_dir):
    """AGG-26 with the text's length for a score."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    swept = evaluate.threshold_sweep(rows, F.least(F.col("n_chars") / 8000.0, F.lit(1.0)).cast("double"), F.col("quality"), THRESHOLDS)
    return swept.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    """WITH n AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) - 1 AS k, count(*) OVER () AS c FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
s AS (SELECT source, CASE WHEN k::DOUBLE / c < 0.8 THEN 'train' WHEN k::DOUBLE / c < 0.9 THEN 'val' ELSE 'test' END AS split FROM n)
SELECT split, count(*) AS n_docs, count(DISTINCT source) AS n_packages FROM documents JOIN s USING (source) GROUP BY split"""
)
def split_by_package(spark, sf_dir):
    """AGG-31: sources as packages."""
    rows = evaluate.split_by_package(table(spark, sf_dir, "documents").select("doc_id", "source").where("source IS NOT NULL"), "source")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("source").alias("n_packages"))


@query(
    """WITH r AS (SELECT d.lang, d.source, CASE WHEN l.doc_id IS NULL THEN 'UNKNOWN' WHEN l.toxic = 1 THEN 'CONFLICT' WHEN l.quality = 1 AND d.n_chars > 2000 THEN 'COVERED' WHEN l.quality = 1 THEN 'PARTIAL' ELSE 'MISSING' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang AS package_id, source AS target_doc_id, count(*) AS total, count(*) FILTER (WHERE status = 'COVERED') AS covered, count(*) FILTER (WHERE status = 'PARTIAL') AS partial, count(*) FILTER (WHERE status = 'CONFLICT') AS conflict,
  count(*) FILTER (WHERE status IN ('MISSING', 'UNKNOWN')) AS missing, count(*) FILTER (WHERE status = 'UNKNOWN') AS unknown, (count(*) FILTER (WHERE status = 'COVERED') + 0.5::DOUBLE * count(*) FILTER (WHERE status = 'PARTIAL')) / count(*) AS coverage_rate
FROM r GROUP BY GROUPING SETS ((lang), (lang, source))"""
)
def coverage_rollup(spark, sf_dir):
    """AGG-12, AGG-13: statuses drawn from the labels."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    status = F.when(F.col("quality").isNull(), "UNKNOWN").when(F.col("toxic") == 1, "CONFLICT").when((F.col("quality") == 1) & (F.col("n_chars") > 2000), "COVERED").when(F.col("quality") == 1, "PARTIAL").otherwise("MISSING")
    rows = docs.join(labels, "doc_id", "left").select(F.col("lang").alias("package_id"), F.col("source").alias("target_doc_id"), status.alias("status"), F.lit("APPLICABLE").alias("applicability"))
    return aggregate.rollup(rows)


@query(
    "WITH k AS (SELECT item_id, sha256(text || chr(31) || 'unit' || chr(31) || 'm' || chr(31) || 'v1' || chr(31) || 'rule') AS key FROM benchmark) SELECT item_id, key FROM k WHERE item_id % 3 != 0"
)
def cache_misses(spark, sf_dir):
    """SNK-6, JOIN-10: every third item is in the cache already."""
    keyed = table(spark, sf_dir, "benchmark").select("item_id", cache.cache_key(F.col("text"), F.lit("unit"), F.lit("m"), F.lit("v1"), F.lit("rule")).alias("key"))
    return cache.misses(keyed, keyed.where("item_id % 3 = 0")).select("item_id", "key")


@query(
    """WITH c AS (SELECT label, list_transform(list_zip(embedding::DOUBLE[]), lambda z: z[1]) AS v, vec_id FROM embeddings),
x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM c), m AS (SELECT label, i, avg(x) AS mean FROM x GROUP BY ALL), q AS (SELECT label, list(mean ORDER BY i) AS q FROM m GROUP BY label),
s AS (SELECT c.label, c.vec_id, round(list_cosine_similarity(c.v, q.q), 6) AS score FROM c JOIN q USING (label))
SELECT label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5"""
)
def dense_topk(spark, sf_dir):
    """SCO-3, WIN-16: the five vectors of each label nearest to its mean by cosine."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q"))
    scored = rows.join(means, "label").select("label", "vec_id", F.round(S.dense_cosine(F.col("v"), F.col("q")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("rank <= 5")


@query()
def coverage_turns(spark, sf_dir):
    """The whole coverage plan over conversations: user turns as requirements, assistant turns as units of one target."""
    from reqlens.operators import requirements
    from reqlens.plans.coverage import judged_pairs

    user = turns(spark, sf_dir, "user").withColumns({"section_title": F.lit(None).cast("string"), "section_id": F.lit(None).cast("string")})
    reqs = stage(requirements.with_features(user.select("package_id", F.col("id").alias("req_id"), "pos", "text", "section_id", "section_title")))
    made = stage(units.build_units(
        turns(spark, sf_dir, "assistant").select(
            "package_id", F.concat(F.lit("target-"), "package_id").alias("doc_id"), F.lit("pmi").alias("doc_role"), "pos", F.col("id").alias("fragment_id"), F.lit(None).cast("string").alias("section_id"), F.lit("paragraph").alias("kind"), "text", F.lit(None).cast("string").alias("section_title")
        )
    ))
    _, judgments = judged_pairs(reqs, made)
    grid = reqs.select("package_id", "req_id", F.col("requirement_type").alias("req_type"), F.concat(F.lit("target-"), "package_id").alias("target_doc_id"), F.lit("pmi").alias("role"))
    return aggregate.aggregate_verdicts(grid, judgments).select("package_id", "req_id", "target_doc_id", "status", "subcode", "level", "severity", "is_critical", "confidence")
