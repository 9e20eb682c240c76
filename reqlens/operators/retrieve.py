"""Candidate evidence for each requirement: hybrid score, shortlist, and adaptive selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens import lexicon as L
from reqlens.functions import extract as E, score as S, text as X
from reqlens.lineage import stage

PAIR = ("package_id", "req_id", "target_doc_id")


@dataclass(frozen=True)
class RetrievalConfig:
    lexical: float = 0.35
    semantic: float = 0.35
    constraint: float = 0.20
    section: float = 0.10
    min_score: float = 0.05
    top_k: int = 5
    initial_top_n: int = 10
    top_k_pz: int = 12
    initial_top_n_pz: int = 25
    before_rerank: int = 20
    evidence_floor: float = 0.30
    strong_margin: float = 0.08
    selector_max_k: int = 5
    skip_below_floor: bool = True
    rerank_top1: float = 0.45
    rerank_margin: float = 0.08


def requirement_signals(reqs: DataFrame) -> DataFrame:
    """What scoring needs of a requirement, made once before the join."""
    boost = X.strings(L.BOOSTABLE_ASPECTS)
    return reqs.select(
        "package_id", "req_id", F.col("requirement_type").alias("req_type"), F.col("constraints").alias("req_constraints"), X.content_tokens(F.col("normalized_text")).alias("req_tokens"),
        X.term_counts(F.col("normalized_text")).alias("req_terms"), E.aspects(F.col("text")).alias("req_aspects"),
    ).withColumn("req_boost", F.array_intersect("req_aspects", boost))


def unit_signals(units: DataFrame) -> DataFrame:
    title = F.col("section_title")
    boost = X.strings(L.BOOSTABLE_ASPECTS)
    return units.select(
        "package_id", "unit_id", F.col("doc_id").alias("target_doc_id"), F.lower("doc_role").alias("role"), "unit_type", F.col("constraints").alias("unit_constraints"), F.col("first_pos").alias("unit_pos"),
        X.content_tokens(F.col("normalized_text")).alias("unit_tokens"), X.term_counts(F.col("normalized_text")).alias("unit_terms"), E.aspects(F.col("text")).alias("unit_aspects"), title.alias("section_title"),
        S.topic_hits(title, F.col("text")).alias("topics"), S.noise_flags(title, F.col("text")).alias("noise"),
    ).withColumn("unit_boost", F.array_intersect("unit_aspects", boost))


#: Units of a package that one task meets: a larger package is dealt out, and its requirements go to each part.
PART_UNITS = 1000


def score_pairs(reqs: DataFrame, units: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), encoder=None, part_units: int = PART_UNITS) -> DataFrame:
    """JOIN-1, SCO-10, FLT-4: every requirement against every unit of its package's targets, above the least score.

    A pair without a common token can still pass by its section and topic, and one that shares only a stop-word by the
    cosine, so that an index of tokens would lose rows: the join is on the package. Units of a large package are dealt into
    parts of `part_units`, and a hot package so into many tasks; nothing of a text is computed after the join. encoder: a
    plug-in whose vectors' cosine takes the place of the bag of words'.
    """
    left, right = requirement_signals(reqs), unit_signals(units)
    if encoder is not None:
        from reqlens import plugins

        left = plugins.encoded(left.join(reqs.select("package_id", "req_id", "normalized_text"), ["package_id", "req_id"]), "normalized_text", encoder, "req_vector").drop("normalized_text")
        right = plugins.encoded(right.join(units.select("package_id", "unit_id", "normalized_text"), ["package_id", "unit_id"]), "normalized_text", encoder, "unit_vector").drop("normalized_text")
    left, right = stage(left), stage(right)
    parts = right.groupBy("package_id").agg(F.ceil(F.count(F.lit(1)) / part_units).cast("int").alias("__parts"))
    right = right.join(parts, "package_id").withColumn("__part", F.pmod(F.xxhash64("unit_id"), F.col("__parts")).cast("int")).drop("__parts")
    left = left.join(parts, "package_id").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    pairs = left.join(right, ["package_id", "__part"]).drop("__part")
    cosine = S.bow_cosine(F.col("req_terms"), F.col("unit_terms")) if encoder is None else plugins.similarity(F.col("req_vector"), F.col("unit_vector"))
    topic = S.topic_prior(F.col("role"), F.col("req_type"), F.col("topics"))
    pairs = pairs.withColumns(
        {
            "lex": S.jaccard(F.col("req_tokens"), F.col("unit_tokens")), "sem": cosine, "con": S.constraint_overlap(F.col("req_constraints"), F.col("unit_constraints")),
            "topic": topic, "exact": S.share_of(F.col("req_boost"), F.col("unit_boost")), "penalty": S.noise_penalty(F.col("noise"), F.col("req_type"), F.col("req_aspects"), F.col("unit_aspects")),
        }
    )
    # one row a pair, without texts: the filter on the score must not copy the score's expressions
    pairs = stage(pairs.withColumn("sec", F.greatest(S.section_prior(F.col("role"), F.col("section_title"), F.col("req_type")), "topic")).drop("req_tokens", "unit_tokens", "req_terms", "unit_terms", "topics", "noise", "req_aspects", "unit_aspects", "req_boost", "unit_boost", "req_vector", "unit_vector"))
    scored = pairs.withColumn("raw", hybrid(F.col("lex"), F.col("sem"), F.col("con"), F.col("sec"), F.col("exact"), F.col("topic"), F.col("penalty"), cfg)).where(F.col("raw") >= cfg.min_score)
    rounded = {k: F.round(k, 4) for k in ("lex", "sem", "con", "sec")}
    return scored.withColumns(rounded).withColumn("score", F.round("raw", 4)).drop("raw")


def hybrid(lex, sem, con, sec, exact, topic, penalty, cfg: RetrievalConfig = RetrievalConfig()):
    """SCO-10: weighted sum, lifted by shared aspects and by topic, at most 0.9999, less the noise penalty, at least 0."""
    base = cfg.lexical * lex + cfg.semantic * sem + cfg.constraint * con + cfg.section * sec
    lifted = base + F.when(exact > 0, F.least(F.lit(0.22), 0.06 + 0.16 * exact)).otherwise(0.0) + F.when(topic > 0, F.least(F.lit(0.14), 0.04 + 0.10 * topic)).otherwise(0.0)
    return F.greatest(F.least(lifted, F.lit(0.9999)) - penalty, F.lit(0.0))


def shortlist(scored: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """WIN-1, WIN-3, SCO-12: the best units of each (requirement, target), ties in unit order, with margin and strength."""
    order = Window.partitionBy(*PAIR).orderBy(F.desc("score"), "unit_pos", "unit_id")
    cap = F.when(F.col("role") == "pz", max(cfg.initial_top_n_pz, cfg.top_k_pz)).otherwise(max(cfg.initial_top_n, cfg.top_k))
    widest = max(cfg.initial_top_n_pz, cfg.top_k_pz, cfg.initial_top_n, cfg.top_k)
    # a constant bound first, so that the window stops early in each group
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= widest).where(F.col("rank") <= cap)
    return ranked.withColumn("strength", S.strength(F.col("score")))


def rerank_reason(listed: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """SCO-14: whether a model should rerank a shortlist, and the first rule that says so."""
    top = listed.groupBy(*PAIR).agg(
        F.max(F.when(F.col("rank") == 1, F.struct("score", "sem", "lex", "req_type", F.size("req_constraints").alias("n")))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b")
    )
    reason = (
        F.when(F.col("a.score") < cfg.rerank_top1, "weak_top1").when(F.col("a.score") - F.col("b") < cfg.rerank_margin, "close_call").when(F.col("a.req_type").isin(*L.CRITICAL_TYPES), "critical_type")
        .when(F.col("a.n") > 0, "numeric_constraints").when((F.col("a.sem") >= 0.55) & (F.col("a.lex") <= 0.20), "paraphrase")
    )
    return top.select(*PAIR, reason.isNotNull().alias("should_rerank"), reason.alias("reason"))


def select(listed: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """WIN-4, WIN-5, MSC-1: how many candidates go to the judge.

    Section windows stay only if they beat the best single unit less the margin and are strong. Then: no evidence, or
    below the floor without being critical: none; critical: up to 5; a strong leader by a margin: 1; else up to 3.
    """
    strong = dict(L.STRENGTH_BINS)["STRONG"]
    group = Window.partitionBy(*PAIR)
    is_window = F.col("unit_type") == "section_window"
    rows = listed.withColumn("__best", F.max(F.when(~is_window, F.col("score"))).over(group))
    rows = rows.where(~is_window | F.col("__best").isNull() | (F.col("score") >= F.greatest(F.lit(strong), F.col("__best") - cfg.strong_margin)))
    order = group.orderBy(F.desc("score"), is_window, "rank")
    rows = rows.withColumn("pick", F.row_number().over(order)).withColumn("__next", F.lead("score").over(order))
    rows = rows.withColumn("top1", F.max(F.when(F.col("pick") == 1, F.col("score"))).over(group)).withColumn("margin", F.max(F.when(F.col("pick") == 1, F.coalesce(F.col("score") - F.col("__next"), F.col("score")))).over(group))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(group))
    critical = F.col("req_type").isin(*L.CRITICAL_TYPES) | (F.size("req_constraints") > 0)
    skip = (F.when(S.strength(F.col("top1")) == "NO_EVIDENCE", "no_evidence").when(F.lit(cfg.skip_below_floor) & (F.col("top1") < cfg.evidence_floor) & ~critical, "below_floor"))
    k = F.when(critical, F.least(F.lit(cfg.selector_max_k), "n")).when((S.strength(F.col("top1")) == "STRONG") & (F.col("margin") >= cfg.strong_margin), 1).otherwise(F.least(F.lit(3), "n"))
    rows = rows.withColumn("skip_reason", skip).withColumn("selected_k", F.when(F.col("skip_reason").isNotNull(), 0).otherwise(k).cast("int"))
    return rows.withColumn("selected", F.col("pick") <= F.col("selected_k")).withColumn("below_floor", F.col("top1") < cfg.evidence_floor).drop("__best", "__next")
