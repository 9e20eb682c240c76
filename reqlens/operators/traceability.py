"""Requirements against test cases: candidates, rule flags, link status, findings, orphan tests and the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens import lexicon as L
from reqlens.functions import extract as E, score as S, text as X


@dataclass(frozen=True)
class TraceConfig:
    top_k: int = 5
    min_score: float = 0.2
    lexical: float = 0.7
    section: float = 0.1
    metadata: float = 0.05
    embedding: float = 0.15
    inadequate_score: float = 0.30
    adequate_overlap: float = 0.45
    minimal_overlap: float = 0.15
    orphan_support: float = 0.25
    weights: tuple = (("ADEQUATE", 1.0), ("PARTIAL", 0.5), ("INADEQUATE", 0.25), ("MISSING", 0.0), ("CONFLICT", 0.0))
    orphan_penalty: float = 0.2
    require_expected: bool = True


def _side(df: DataFrame, prefix: str, text: Column) -> DataFrame:
    names = set(df.columns)
    section = F.col("section") if "section" in names else F.lit(None).cast("string")
    metadata = F.col("metadata") if "metadata" in names else F.create_map().cast("map<string,string>")
    package = F.col("package_id") if "package_id" in names else F.lit("")
    order = F.col("pos") if "pos" in names else F.col("id")
    return df.select(
        package.alias("package_id"), F.col("id").alias(f"{prefix}_id"), order.alias(f"{prefix}_pos"), text.alias(f"{prefix}_text"), X.content_tokens(text).alias(f"{prefix}_tokens"),
        X.tokens(section).alias(f"{prefix}_section"), F.coalesce(metadata, F.create_map().cast("map<string,string>")).alias(f"{prefix}_meta"),
        E.numbers(text).alias(f"{prefix}_numbers"), E.timeouts(text).alias(f"{prefix}_timeouts"), E.attempts(text).alias(f"{prefix}_attempts"), E.roles(text).alias(f"{prefix}_roles"),
        X.contains_any(text, L.UPPER_BOUND).alias(f"{prefix}_upper"), X.contains_any(text, L.LOWER_BOUND).alias(f"{prefix}_lower"),
    )


def requirement_side(requirements: DataFrame) -> DataFrame:
    return _side(requirements, "req", X.text_of(F.col("text")))


def test_side(tests: DataFrame) -> DataFrame:
    """MSC-7: the text and the expected result are searched together."""
    expected = F.nullif(F.trim(X.text_of(F.col("expected_result"))), F.lit("")) if "expected_result" in tests.columns else F.lit(None).cast("string")
    full = F.concat_ws(" ", F.nullif(X.text_of(F.col("text")), F.lit("")), expected)
    side = tests.withColumn("__full", full).withColumn("__missing", X.contains_any(full, L.ASSERTIVE) & expected.isNull())
    return _side(side, "test", F.col("__full")).join(side.select(F.col("id").alias("test_id"), *( ["package_id"] if "package_id" in tests.columns else [F.lit("").alias("package_id")]), F.col("__missing").alias("expected_missing")), ["package_id", "test_id"])


def metadata_score(a: Column, b: Column) -> Column:
    """SCO-19: equal values over shared keys."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    equal = F.size(F.filter(shared, lambda k: F.element_at(a, k).eqNullSafe(F.element_at(b, k))))
    return F.when(F.size(shared) > 0, equal / F.size(shared)).otherwise(F.lit(0.0))


def sharing(left: DataFrame, right: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """(package_id, req_id, test_id) of all pairs that can reach the least score, by an index of what both sides share.

    A pair's keys are its common tokens; where section and metadata alone reach the least score, their tokens and values
    are keys too. What a pair's score can be at most follows from its count of common tokens and from whether the
    requirement has a section and metadata at all: the texts of other pairs never meet.
    """
    total = cfg.lexical + cfg.section + cfg.metadata + cfg.embedding
    alone = cfg.section + cfg.metadata >= cfg.min_score * total

    def keyed(side: DataFrame, p: str, *others: Column) -> DataFrame:
        key = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))
        keys = [F.transform(f"{p}_tokens", key("token"))]
        if alone:
            keys += [F.transform(F.array_distinct(f"{p}_section"), key("section")), F.transform(F.map_entries(f"{p}_meta"), lambda e: key("value")(F.to_json(e)))]
        return side.select("package_id", f"{p}_id", *others, F.explode(F.concat(*keys)).alias("k")).select("*", "k.kind", "k.key").drop("k")

    most = F.when(F.size("req_section") > 0, cfg.section).otherwise(0.0) + F.when(F.size("req_meta") > 0, cfg.metadata).otherwise(0.0)
    reqs = keyed(left, "req", F.size("req_tokens").alias("n"), most.alias("most"))
    both = reqs.join(keyed(right, "test"), ["package_id", "kind", "key"]).groupBy("package_id", "req_id", "test_id").agg(F.count_if(F.col("kind") == "token").alias("common"), F.max("n").alias("n"), F.max("most").alias("most"))
    bound = cfg.lexical * F.col("common") / F.greatest("n", F.lit(1)) + F.col("most")
    return both.where(bound >= cfg.min_score * total - 1e-9).select("package_id", "req_id", "test_id")  # less what adding up may lose


def candidates(requirements: DataFrame, tests: DataFrame, cfg: TraceConfig = TraceConfig(), embedding: Column | None = None) -> DataFrame:
    """JOIN-2, SCO-17 to SCO-20, FLT-4, WIN-6: the top_k tests of each requirement by score, ties in the tests' order.

    Pairs come from an index of what they share. With an embedding, or without a least score above 0, any pair can pass:
    then every requirement meets every test of its package. Ids are distinct in a package.
    """
    left, right = requirement_side(requirements), test_side(tests)
    if embedding is None and cfg.min_score > 0:
        pairs = left.join(sharing(left, right, cfg), ["package_id", "req_id"]).join(right, ["package_id", "test_id"])
    else:
        pairs = left.join(right, "package_id")
    lexical = S.containment(F.col("req_tokens"), F.col("test_tokens"))
    section = F.arrays_overlap("req_section", "test_section").cast("double")
    meta = metadata_score(F.col("req_meta"), F.col("test_meta"))
    dense = F.lit(0.0) if embedding is None else F.least(F.greatest(embedding, F.lit(0.0)), F.lit(1.0))
    total = cfg.lexical + cfg.section + cfg.metadata + cfg.embedding
    weighted = (cfg.lexical * F.col("lexical") + cfg.section * F.col("section") + cfg.metadata * F.col("meta") + cfg.embedding * F.col("dense")) / total
    scored = pairs.withColumns({"lexical": lexical, "section": F.coalesce(section, F.lit(0.0)), "meta": meta, "dense": dense}).withColumn("raw", weighted).where(F.col("raw") >= cfg.min_score)
    scored = scored.withColumn("retrieval_score", F.round("raw", 4))
    rank = F.row_number().over(Window.partitionBy("package_id", "req_id").orderBy(F.desc("retrieval_score"), "test_pos"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= cfg.top_k)


def links(found: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """AGG-16, AGG-17: rule flags and status of each candidate."""
    both = lambda k: (F.size(f"req_{k}") > 0) & (F.size(f"test_{k}") > 0)
    differ = lambda k: both(k) & (F.col(f"req_{k}") != F.col(f"test_{k}"))
    shared = F.arrays_overlap("req_numbers", "test_numbers")
    direction = (F.col("req_upper") & F.col("test_lower")) | (F.col("req_lower") & F.col("test_upper"))
    flags = {
        "NUMERIC_MISMATCH": differ("numbers") & ~shared, "NUMERIC_PARTIAL_MISMATCH": differ("numbers") & shared, "TIMEOUT_MISMATCH": differ("timeouts"),
        "ATTEMPT_MISMATCH": differ("attempts"), "ROLE_MISMATCH": differ("roles"), "RANGE_DIRECTION_CONFLICT": direction, "EXPECTED_RESULT_MISSING": F.col("expected_missing") & F.lit(cfg.require_expected),
    }
    out = found.withColumn("rule_flags", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull()))
    strong = F.arrays_overlap("rule_flags", X.strings([n for n in flags if n not in ("NUMERIC_PARTIAL_MISMATCH", "EXPECTED_RESULT_MISSING")]))
    overlap = F.col("lexical")
    partly = F.arrays_overlap("rule_flags", X.strings(["NUMERIC_PARTIAL_MISMATCH", "EXPECTED_RESULT_MISSING"]))
    status = (
        F.when(strong, "CONFLICT")
        .when(partly & (overlap >= cfg.minimal_overlap), "PARTIAL")
        .when((F.col("retrieval_score") < cfg.inadequate_score) | (overlap < cfg.minimal_overlap), "INADEQUATE")
        .when(F.size(F.array_except("req_numbers", "test_numbers")) > 0, "PARTIAL")
        .when(overlap < cfg.adequate_overlap, "PARTIAL")
        .otherwise("ADEQUATE")
    )
    out = out.withColumn("link_status", status).withColumn("matched_keywords", F.array_sort(F.array_intersect("req_tokens", "test_tokens")))
    return out.withColumn("link_rank", F.element_at(F.create_map(*[F.lit(x) for kv in L.LINK_RANK.items() for x in kv]), F.col("link_status")))


def findings(requirements: DataFrame, found: DataFrame) -> DataFrame:
    """WIN-7, AGG-18: the best link of each requirement by status, then score, then order; MISSING without candidates."""
    best = found.groupBy("package_id", "req_id").agg(
        F.min(F.struct((-F.col("link_rank")).alias("r"), (-F.col("retrieval_score")).alias("s"), "rank", "test_id", "link_status", "retrieval_score", "rule_flags")).alias("b"), F.count(F.lit(1)).alias("n_candidates")
    )
    package = F.col("package_id") if "package_id" in requirements.columns else F.lit("").alias("package_id")
    ids = requirements.select(package, F.col("id").alias("req_id"))
    return ids.join(best, ["package_id", "req_id"], "left").select(
        "package_id", "req_id", F.coalesce("b.link_status", F.lit("MISSING")).alias("final_status"), F.col("b.test_id").alias("test_id"), F.col("b.retrieval_score").alias("retrieval_score"),
        F.coalesce("b.rule_flags", F.array().cast("array<string>")).alias("rule_flags"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
    )


def orphan_tests(tests: DataFrame, found: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """JOIN-14: tests without a link of enough score."""
    package = F.col("package_id") if "package_id" in tests.columns else F.lit("").alias("package_id")
    supported = found.where(F.col("retrieval_score") >= cfg.orphan_support).select("package_id", "test_id").distinct()
    return tests.select(package, F.col("id").alias("test_id")).join(supported, ["package_id", "test_id"], "left_anti")


def summary(found: DataFrame, orphans: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """AGG-19, AGG-20: counts, rates and score C of each package."""
    counts = found.groupBy("package_id").agg(F.count(F.lit(1)).alias("total_requirements"), *[F.count_if(F.col("final_status") == s).alias(f"{s.lower()}_count") for s, _ in cfg.weights])
    lost = orphans.groupBy("package_id").agg(F.count(F.lit(1)).alias("orphans"))
    out = counts.join(lost, "package_id", "full").fillna(0)
    total, n = F.greatest("total_requirements", F.lit(1)), F.col("orphans")
    base = F.greatest(F.col("total_requirements") + n, F.lit(1))
    score = F.lit(0.0)
    for s, w in cfg.weights:
        score = score + F.col(f"{s.lower()}_count") * w
    c = F.least(F.greatest(score / total - cfg.orphan_penalty * (n / base), F.lit(0.0)), F.lit(1.0))
    return out.select("*", *[(F.col(f"{s}_count") / total).alias(f"{s}_rate") for s in ("adequate", "partial", "missing", "conflict")], (n / base).alias("orphan_rate"), c.alias("score_c"))


def evaluate(requirements: DataFrame, tests: DataFrame, cfg: TraceConfig = TraceConfig()) -> dict[str, DataFrame]:
    """The whole report: links, findings, orphan tests and summary."""
    linked = links(candidates(requirements, tests, cfg), cfg)
    found = findings(requirements, linked)
    orphans = orphan_tests(tests, linked, cfg)
    return {"links": linked, "findings": found, "orphans": orphans, "summary": summary(found, orphans, cfg)}
