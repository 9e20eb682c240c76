"""Queries that apply the rule operators to signals and sentences drawn from whole tables, each with the SQL for the same rows.

The tables hold no specifications. Signals (labels, scores, flags, token sets) are drawn from the digits of MD5 of each row's
key, which both engines compute alike, so that every order or line item is one random case of a rule; sentences come from
templates filled with each part's numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqlens import lexicon as L
from reqlens.functions import extract as E, score as S, text as X
from reqlens.lineage import dealt, once_each, stage
from reqlens.operators import aggregate, dataset, diagnostics, judge, legacy, report, responses, retrieve, traceability, verify
from reqlens.queries import LINES_SQL, _legacy_sql, jaccard_sql, lines, query, table, turns

def digit(at: int, n: int = 1) -> Column:
    return F.conv(F.substring(F.col("h"), at, n), 16, 10).cast("int")


def digit_sql(at: int, n: int = 1) -> str:
    return f"CAST('0x' || substr(h, {at}, {n}) AS INTEGER)"


def pick(values, i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i)


def pick_sql(values, i: str) -> str:
    shown = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"[{', '.join(map(shown, values))}][({i}) + 1]"


def chars(at, n) -> Column:
    """The distinct characters of a run of the hash: a small random set."""
    at, n = (x if isinstance(x, Column) else F.lit(x) for x in (at, n))
    return F.array_distinct(F.filter(F.split(F.substring(F.col("h"), at, n), ""), lambda x: x != ""))


def chars_sql(at, n) -> str:
    return f"list_distinct(list_filter(string_split(substr(h, {at}, {n}), ''), lambda x: x != ''))"


def orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("h"))


ORDERS_SQL = "(SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders)"
NONE = "CAST([] AS VARCHAR[])"


def union_size_sql(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat({a}, {b})))"


VERBS = ("v1", "v2", None)
KINDS = ("generic", "size", "timeout", "attempts")
JUDGED_SQL = f"""
s AS (SELECT o_orderkey, {chars_sql(1, 6)} AS rt, {chars_sql(pick_sql([1, 4, 20], digit_sql(30) + ' % 3'), 6)} AS ut, {chars_sql(9, 3)} AS re, CASE WHEN {digit_sql(31)} < 12 THEN {chars_sql(10, 3)} ELSE {NONE} END AS ue,
  CASE WHEN {digit_sql(13)} < 6 THEN {pick_sql(KINDS, digit_sql(12) + ' % 4')} END AS rk, CASE WHEN {digit_sql(15)} < 8 THEN {pick_sql(KINDS, digit_sql(14) + ' % 4')} END AS uk,
  'a ' || substr(h, 1, 2) || ' ' || substr(h, 3, 2) || ' ' || substr(h, 5, 2) || CASE WHEN {digit_sql(16)} < 8 THEN ' z' ELSE '' END AS rb, {digit_sql(17)} % 4 AS form,
  {pick_sql(VERBS, digit_sql(18) + ' % 3')} AS rv, {pick_sql(VERBS, digit_sql(19) + ' % 3')} AS uv, CASE WHEN {digit_sql(20)} = 0 THEN '' ELSE 'p' || {digit_sql(20)} % 3 END AS rp, 'p' || {digit_sql(21)} % 3 AS up,
  {chars_sql(22, 3)} AS ra, {chars_sql(23, 3)} AS ua, CASE WHEN {digit_sql(26)} < 5 THEN {chars_sql(25, 1)} ELSE {NONE} END AS rf, CASE WHEN {digit_sql(27)} < 5 THEN {chars_sql(25, 2)} ELSE {NONE} END AS uf,
  {digit_sql(28)} % 8 AS rs, {digit_sql(29)} % 8 AS us, CASE WHEN {digit_sql(2)} > 0 THEN 's' || {digit_sql(2)} % 3 END AS rj, CASE WHEN {digit_sql(3)} > 0 THEN 's' || {digit_sql(3)} % 3 END AS uj,
  {digit_sql(4)} < 8 AS rm, {digit_sql(5)} < 8 AS um, {digit_sql(6)} = 0 AS step FROM {ORDERS_SQL}),
b AS (SELECT *, CASE form WHEN 0 THEN rb WHEN 1 THEN 'x ' || rb || ' y' WHEN 2 THEN 'x' || rb ELSE 'other words entirely here now' END AS ub FROM s),
g AS (SELECT *, {jaccard_sql('rt', 'ut')} AS lex, {jaccard_sql('re', 'ue')} AS ent, coalesce(rk = uk AND rk != 'generic', false) AS kinds, coalesce(rv = uv, false) AS verb, {jaccard_sql('rf', 'uf')} AS art, rs = 4 AND us IN (3, 6) AS plausible,
  len(list_intersect(rt, ut)) AS shared, rb = ub AS exact, (len(string_split(rb, ' ')) >= 5 AND contains(' ' || ub || ' ', ' ' || rb || ' ')) OR (len(string_split(ub, ' ')) >= 5 AND contains(' ' || rb || ' ', ' ' || ub || ' ')) AS inside FROM b),
o AS (SELECT *, CASE WHEN verb THEN {jaccard_sql('ra', 'ua')} ELSE 0.0 END AS obj FROM g),
v AS (SELECT *, verb AND ((rp != '' AND rp = up) OR obj >= 0.6) AS covers FROM o),
r AS (SELECT *, CASE WHEN kinds THEN 'constraint_kind' WHEN exact THEN 'exact_text' WHEN inside THEN 'text_containment' WHEN lex >= 0.8 AND {union_size_sql('ra', 'ua')} >= 2 THEN 'near_exact_lex'
  WHEN covers AND plausible AND lex >= 0.15 THEN 'verb_object_section' WHEN covers AND lex >= 0.2 THEN 'verb_object' WHEN art >= 0.6 THEN 'artifact' WHEN verb AND obj >= 0.25 THEN 'verb_partial_object' WHEN lex >= 0.4 AND ent >= 0.25 THEN 'lex_and_entities'
  WHEN lex >= 0.2 OR (lex >= 0.12 AND ent >= 0.15) THEN 'topical' WHEN art > 0 THEN 'artifact_family' WHEN step THEN 'verification_step' WHEN coalesce(rj = uj, false) AND rm AND um AND lex >= 0.1 THEN 'shared_subject' WHEN shared >= 3 AND lex >= 0.12 THEN 'weak_vocabulary' ELSE 'none' END AS rule FROM v),
l AS (SELECT *, CASE WHEN rule IN ('constraint_kind', 'exact_text', 'text_containment', 'near_exact_lex', 'verb_object_section', 'verb_object', 'artifact') THEN 'COVERED' WHEN rule = 'none' THEN 'IRRELEVANT' ELSE 'PARTIAL' END AS label FROM r)"""


@query(
    f"""WITH {JUDGED_SQL} SELECT o_orderkey, rule, label, round(CASE rule WHEN 'exact_text' THEN 0.95 WHEN 'text_containment' THEN 0.90 WHEN 'near_exact_lex' THEN 0.85 WHEN 'constraint_kind' THEN greatest(lex, 0.7) WHEN 'artifact' THEN 0.7
  ELSE CASE label WHEN 'COVERED' THEN greatest(lex, 0.75) WHEN 'PARTIAL' THEN greatest(lex, CASE WHEN lex >= 0.2 THEN 0.65 ELSE 0.5 END) ELSE lex END END::DOUBLE, 3) AS confidence FROM l"""
)
def rule_judge(spark, sf_dir):
    """JDG-1 to JDG-3, MSC-5, SCO-1, SCO-16, SCO-21, SCO-22: the rule judge on a random pair for each order."""
    kind = lambda cond, i: F.when(cond, F.array(F.struct(pick(KINDS, i).alias("kind")))).otherwise(F.array().cast("array<struct<kind:string>>"))
    none = X.strings([])
    bare = F.concat(F.lit("a "), F.substring(F.col("h"), 1, 2), F.lit(" "), F.substring(F.col("h"), 3, 2), F.lit(" "), F.substring(F.col("h"), 5, 2), F.when(digit(16) < 8, F.lit(" z")).otherwise(F.lit("")))
    act = lambda v, p, t: F.struct(pick(VERBS, v % 3).alias("verb"), p.alias("phrase"), t.alias("tokens"))
    p = lambda at: F.concat(F.lit("p"), (digit(at) % 3).cast("string"))
    subject = lambda at: F.when(digit(at) > 0, F.concat(F.lit("s"), (digit(at) % 3).cast("string")))
    form = digit(17) % 4
    rows = orders(spark, sf_dir).select(
        "o_orderkey", chars(1, 6).alias("req_tok"), chars(pick([1, 4, 20], digit(30) % 3), 6).alias("unit_tok"), chars(9, 3).alias("req_ent"), F.when(digit(31) < 12, chars(10, 3)).otherwise(none).alias("unit_ent"),
        kind(digit(13) < 6, digit(12) % 4).alias("req_con"), kind(digit(15) < 8, digit(14) % 4).alias("unit_con"), bare.alias("req_bare"),
        F.when(form == 0, bare).when(form == 1, F.concat(F.lit("x "), bare, F.lit(" y"))).when(form == 2, F.concat(F.lit("x"), bare)).otherwise("other words entirely here now").alias("unit_bare"),
        act(digit(18), F.when(digit(20) == 0, F.lit("")).otherwise(p(20)), chars(22, 3)).alias("req_act"), act(digit(19), p(21), chars(23, 3)).alias("unit_act"),
        F.when(digit(26) < 5, chars(25, 1)).otherwise(none).alias("req_art"), F.when(digit(27) < 5, chars(25, 2)).otherwise(none).alias("unit_art"), (digit(28) % 8).alias("req_sec"), (digit(29) % 8).alias("unit_sec"),
        subject(2).alias("req_subject"), subject(3).alias("unit_subject"), (digit(4) < 8).alias("req_modal"), (digit(5) < 8).alias("unit_modal"), (digit(6) == 0).alias("unit_verify"),
    )
    return judge.judge(stage(rows)).select("o_orderkey", "rule", "label", "confidence")


#: Snippets of which the verifier's texts are made, and what each holds: prohibition, bound, bad and good outcome, methodology, technology, topic.
SNIPPETS = (
    ("", False, False, False, False, False, None, None),
    ("Система не должна передавать данные", True, False, False, False, False, None, None),
    ("не должно превышать 5 секунд", False, True, False, False, False, None, "response_time"),
    ("время восстановления после отказа", False, False, False, False, False, None, "recovery_time"),
    ("процессор intel", False, False, False, False, False, None, "hardware_specs"),
    ("внедрение кода", False, False, False, False, False, None, "code_injection"),
    ("разграничение доступа", False, False, False, False, False, None, "access_control"),
    ("Проверка проводится тестом", False, False, False, False, True, None, None),
    ("написано на typescript", False, False, False, False, False, "client_lang", None),
    ("построено на angular", False, False, False, False, False, "client_lang", None),
    ("работает в docker", False, False, False, False, False, "container", None),
    ("система не должна аварийно завершаться", True, False, True, False, False, None, None),
    ("система должна продолжать работу", False, False, False, True, False, None, None),
)
LABELS = ("COVERED", "PARTIAL", "CONFLICT", "IRRELEVANT")
CONFIDENCES = (0.2, 0.35, 0.45, 0.55, 0.65, 0.72, 0.82, 0.9)
TYPES = ("functional", "delivery", "security", "performance", "economic", "storage", "process", "interface")
_N = len(SNIPPETS)


def _snippets_sql() -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(shown, s[1:]))})" for i, s in enumerate(SNIPPETS)) + ") AS {0}(i, neg, bound, bad, good, method, tech, topic)"


def _side_sql(a: str, b: str, side: str) -> str:
    flags = ", ".join(f"{a}.{k} OR {b}.{k} AS {side}_{k}" for k in ("neg", "bound", "bad", "good", "method"))
    return f"{flags}, list_filter([{a}.tech, {b}.tech], lambda x: x IS NOT NULL) AS {side}_tech, list_filter([{a}.topic, {b}.topic], lambda x: x IS NOT NULL) AS {side}_topics"


_MISMATCH_SQL = "CASE WHEN len(list_intersect(r_topics, u_topics)) > 0 THEN NULL " + " ".join(f"WHEN list_contains(r_topics, '{a}') AND list_contains(u_topics, '{b}') THEN '{a}'" for a, b in L.TOPIC_MISMATCHES) + " END"
VERIFY_SQL = f"""
k AS (SELECT o_orderkey, h, {digit_sql(1, 2)} % {_N} AS r1, {digit_sql(3, 2)} % {_N} AS r2, {digit_sql(5, 2)} % {_N} AS u1, {digit_sql(7, 2)} % {_N} AS u2, {pick_sql(LABELS, digit_sql(9) + ' % 4')} AS label, {pick_sql(CONFIDENCES, digit_sql(10) + ' % 8')} AS conf,
  {digit_sql(11)} < 8 AS pmi, {pick_sql(TYPES, digit_sql(12) + ' % 8')} AS type, {digit_sql(13)} < 8 AS long, {chars_sql(14, 5)} AS rc, {chars_sql(pick_sql([14, 17, 25], digit_sql(30) + ' % 3'), 5)} AS uc, {chars_sql(20, digit_sql(31) + ' % 5')} AS re, {chars_sql(21, digit_sql(32) + ' % 5')} AS ue,
  CASE WHEN {digit_sql(25)} < 8 THEN {pick_sql(KINDS, digit_sql(26) + ' % 4')} END AS rk, 10 + 10 * ({digit_sql(27)} % 2) AS rv, CASE WHEN {digit_sql(28)} < 8 THEN {pick_sql(KINDS, digit_sql(29) + ' % 4')} END AS uk, 10 + 10 * ({digit_sql(30)} % 2) AS uv FROM {ORDERS_SQL}),
f AS (SELECT k.*, {_side_sql('a', 'b', 'r')}, {_side_sql('c', 'd', 'u')} FROM k JOIN {_snippets_sql().format('a')} ON a.i = r1 JOIN {_snippets_sql().format('b')} ON b.i = r2 JOIN {_snippets_sql().format('c')} ON c.i = u1 JOIN {_snippets_sql().format('d')} ON d.i = u2),
g AS (SELECT *, {jaccard_sql('rc', 'uc')} AS lex, {jaccard_sql('re', 'ue')} AS ent, len(list_intersect(rc, uc)) AS shared, long AND len(list_intersect(rc, uc)) > 0 AS anchor, coalesce(rk = uk AND rk != 'generic', false) AS kinds, coalesce(rk = uk AND rv != uv, false) AS num,
  (r_bad AND u_good) OR (u_bad AND r_good) AS outcome, r_bound AND u_bound AS bounds, r_neg != u_neg AS neg, len(list_intersect(r_tech, u_tech)) > 0 AS tech, {_MISMATCH_SQL} AS mismatch FROM f),
x AS (SELECT *, type IN ('delivery', 'process', 'economic') AS excluded, label = 'CONFLICT' AND (outcome OR (bounds AND (kinds OR shared >= 4 OR ent >= 0.2))) AS upgrade, label = 'COVERED' AND pmi AND NOT u_method AND lex >= 0.8 AS copied, label = 'COVERED' AND conf >= 0.8 AS sure,
  neg AND conf >= 0.25 AS negated, ent >= 0.2 OR shared >= 2 OR (label != 'CONFLICT' AND conf >= 0.5) AS linked, label IN ('COVERED', 'PARTIAL') AND conf >= 0.7 AS positive, label = 'COVERED' AND pmi AND lex < 0.2 AND ent < 0.25 AS weak,
  label = 'PARTIAL' AND len(re) >= 3 AND len(ue) = 0 AND conf < 0.85 AS bare FROM g),
y AS (SELECT *, num AND NOT sure AND (kinds OR ent >= 0.15 OR shared >= 2 OR conf >= 0.4) AS numeric FROM x),
z AS (SELECT *, CASE WHEN excluded AND label = 'CONFLICT' THEN 0 WHEN excluded THEN 1 WHEN upgrade THEN 2 WHEN copied THEN 3 WHEN numeric THEN 4 WHEN label = 'IRRELEVANT' THEN 5 WHEN negated AND (outcome OR bounds) THEN 7
  WHEN negated AND NOT linked AND label = 'CONFLICT' THEN 8 WHEN negated AND linked AND label = 'CONFLICT' THEN 9 WHEN negated AND linked AND NOT positive THEN 10 WHEN label = 'COVERED' AND rk IS NOT NULL AND uk IS NULL THEN 11
  WHEN label = 'COVERED' AND len(re) >= 3 AND len(ue) >= 3 AND ent < 0.1 THEN 12 WHEN bare AND lex >= 0.2 THEN 13 WHEN bare AND anchor AND conf >= 0.6 THEN 14 WHEN bare AND tech AND conf >= 0.6 THEN 15 WHEN bare THEN 16
  WHEN label IN ('PARTIAL', 'COVERED') AND mismatch IS NOT NULL THEN 17 WHEN label = 'CONFLICT' THEN 18 ELSE 19 END AS rule FROM y)"""
_TAGS = (
    "demote_conflict_type_excluded", "no_op_type_excluded", "upgrade_conflict_same_outcome_covered", "demote_covered_pmi_no_methodology", "conflict_confirmed_numeric", "no_op_irrelevant", "suppress_negation_embedding_same_outcome",
    "suppress_negation_same_outcome", "demote_conflict_negation_no_topic", "conflict_confirmed_negation", "no_op_negation_no_upgrade", "demote_covered_constraints_missing", "demote_covered_low_entity_overlap",
    "preserve_partial_low_entity_high_lex", "preserve_partial_shared_anchor", "preserve_partial_tech_stack", "demote_partial_zero_entity_overlap", "demote_topic_mismatch_", "no_op_llm_conflict_unverified", "no_op_kept_label",
)


@query(
    f"""WITH {VERIFY_SQL} SELECT o_orderkey, CASE WHEN rule IN (0, 3, 7, 11, 12) THEN 'PARTIAL' WHEN rule = 2 THEN 'COVERED' WHEN rule IN (4, 9) THEN 'CONFLICT' WHEN rule IN (5, 8, 16, 17) THEN 'IRRELEVANT' ELSE label END AS adjusted,
  array_to_string(list_filter([CASE WHEN num AND sure AND rule > 4 THEN 'suppress_numeric_judge_strong_covered' END, CASE WHEN num AND NOT numeric AND rule > 4 THEN 'suppress_numeric_no_topic' END, CASE WHEN negated AND NOT linked AND rule >= 8 THEN 'suppress_negation_no_topic' END,
    CASE WHEN negated AND linked AND positive AND rule > 10 THEN 'suppress_negation_judge_positive' END, CASE WHEN weak AND rule > 12 THEN 'demote_covered_pmi_weak_link' END, {pick_sql(_TAGS, 'rule')} || CASE WHEN rule = 17 THEN mismatch ELSE '' END], lambda a: a IS NOT NULL), ' ') AS actions,
  CASE WHEN (rule = 4 AND (label = 'IRRELEVANT' OR conf < 0.85)) OR (rule = 9 AND conf < 0.85) THEN 0.95 ELSE conf END AS confidence,
  CASE WHEN rule = 3 THEN 'методика проверки требования не описана в фрагменте' WHEN rule = 11 THEN 'Numeric constraint not verified: ' || rv || '.0 sec' WHEN weak AND rule > 12 THEN 'ПМИ-фрагмент не ссылается на требование' ELSE '' END AS missing FROM z"""
)
def verify_rules(spark, sf_dir):
    """VER-0 to VER-11, EXT-24, EXT-25, EXT-31, SCO-16: the verifier on a random judged pair for each order, its texts made of snippets."""
    texts = [s[0] for s in SNIPPETS]
    side = lambda a, b: F.concat_ws(". ", pick(texts, digit(a, 2) % _N), pick(texts, digit(b, 2) % _N))
    tokens = lambda c: F.transform(c, lambda x: F.when(digit(13) < 8, F.concat(x, F.lit("token"))).otherwise(x))
    one = lambda cond, k, v: F.when(cond, F.array(F.struct(pick(KINDS, k % 4).alias("kind"), F.lit("<=").alias("operator"), (10 + 10 * (v % 2)).cast("double").alias("value"), F.lit("sec").alias("unit")))).otherwise(F.array().cast(E.CONSTRAINTS))
    rows = dealt(orders(spark, sf_dir)).select(
        "o_orderkey", side(1, 3).alias("req_text"), side(5, 7).alias("unit_text"), pick(LABELS, digit(9) % 4).alias("label"), pick(CONFIDENCES, digit(10) % 8).alias("confidence"), F.when(digit(11) < 8, "pmi").otherwise("pz").alias("role"),
        pick(TYPES, digit(12) % 8).alias("req_type"), tokens(chars(14, 5)).alias("req_tokens"), tokens(chars(pick([14, 17, 25], digit(30) % 3), 5)).alias("unit_tokens"), chars(20, digit(31) % 5).alias("req_entities"), chars(21, digit(32) % 5).alias("unit_entities"),
        one(digit(25) < 8, digit(26), digit(27)).alias("req_constraints"), one(digit(28) < 8, digit(29), digit(30)).alias("unit_constraints"), X.strings([]).alias("missing_aspects"),
    )
    rows = rows.withColumns({"req_norm": X.normalize(F.col("req_text")), "unit_norm": X.normalize(F.col("unit_text"))})
    out = verify.verify(stage(rows))
    return out.select("o_orderkey", "adjusted", F.array_join("actions", " ").alias("actions"), "confidence", F.array_join("missing_aspects", "; ").alias("missing"))


SEVERITY_SQL = """CASE WHEN ap != 'APPLICABLE' OR status IN ('COVERED', 'UNKNOWN') THEN 'low' WHEN status = 'CONFLICT' THEN 'high' ELSE CASE WHEN subcode IN ('PARTIAL_DOWNGRADED_FROM_COVERED', 'MISSING_LOW_CONFIDENCE', 'MISSING_LOW_GROUNDING', 'OPTIONAL_NOT_FOUND') THEN CASE base WHEN 'high' THEN 'medium' ELSE 'low' END ELSE base END END"""
JUDGMENTS_SQL = f"""
q AS (SELECT l_orderkey, l_linenumber, md5(l_orderkey || '|' || l_linenumber) AS h FROM lineitem),
j AS (SELECT l_orderkey AS k, l_linenumber::VARCHAR AS unit, {pick_sql(('COVERED', 'PARTIAL', 'CONFLICT', 'IRRELEVANT', 'NOT_JUDGED'), digit_sql(1, 2) + ' % 5')} AS label, {pick_sql((0.3, 0.6, 0.66, 0.72, 0.8, 0.95), digit_sql(3, 2) + ' % 6')} AS conf, {pick_sql((0.1, 0.22, 0.31, 0.5), digit_sql(5) + ' % 4')} AS score,
  {digit_sql(6)} < 3 AS low, {digit_sql(7)} < 3 AS bad, {digit_sql(8)} % 3 AS act, {digit_sql(9)} % 6 AS asp FROM q)"""
VERDICT_SQL = f"""WITH {JUDGMENTS_SQL},
o AS (SELECT o_orderkey AS k, {pick_sql(L.REQUIREMENT_TYPES, digit_sql(10))} AS type0, CASE WHEN {digit_sql(11)} < 8 THEN 'pmi' ELSE 'pz' END AS role FROM {ORDERS_SQL}),
g AS (SELECT k, coalesce(type0, 'other') AS type, role, CASE WHEN coalesce(type0, 'other') IN ('security', 'performance', 'reliability') THEN 0.2 ELSE 0.3 END AS medium FROM o),
a AS (SELECT j.*, g.medium, CASE label WHEN 'CONFLICT' THEN 4 WHEN 'COVERED' THEN 3 WHEN 'PARTIAL' THEN 2 WHEN 'IRRELEVANT' THEN 1 ELSE 0 END AS rank, label = 'NOT_JUDGED' AS lost FROM j JOIN g USING (k)),
t AS (SELECT k, max(conf) AS strong FROM a WHERE label = 'COVERED' AND NOT low AND NOT bad AND conf >= 0.65 GROUP BY k),
b AS (SELECT a.*, coalesce(conf >= strong, true) AND conf >= 0.7 AND NOT bad AND score >= medium AS gates, act != 1 AS confirmed, CASE WHEN conf < 0.65 THEN 'MISSING_LOW_CONFIDENCE' WHEN bad THEN 'MISSING_LOW_GROUNDING' WHEN score < medium THEN 'MISSING_LOW_CONFIDENCE' END AS gate FROM a LEFT JOIN t USING (k)),
c AS (SELECT *, CASE WHEN label = 'CONFLICT' THEN gates AND confirmed WHEN label IN ('COVERED', 'PARTIAL') THEN gate IS NULL ELSE false END AS accepted, CASE WHEN label = 'CONFLICT' AND gates AND NOT confirmed THEN 'CONFLICT_UNVERIFIED' WHEN label IN ('COVERED', 'PARTIAL') THEN gate END AS rejected, {{'r': -rank, 'c': -conf, 'u': unit}} AS place FROM b),
f AS (SELECT k, arg_min({{'label': label, 'conf': conf, 'unit': unit}}, place) FILTER (WHERE accepted) AS win, arg_max({{'code': rejected, 'unit': unit}}, place) FILTER (WHERE rejected IS NOT NULL) AS last, count(*) AS n, count(*) FILTER (WHERE lost) AS lost,
  bool_or(NOT lost AND asp < 3) AS open, bool_or(low) AS any_low, bool_or(bad) AS any_bad FROM c GROUP BY k),
d AS (SELECT g.*, f.*, CASE WHEN type IN ('delivery', 'process') THEN 'OUT_OF_SCOPE' WHEN (type IN ('architecture', 'economic') AND role != 'pz') OR (type = 'documentation' AND role != 'pmi') THEN 'NOT_APPLICABLE' ELSE 'APPLICABLE' END AS ap, role = 'pz' AND type IN ('functional', 'data_io', 'performance', 'storage', 'logging') AS demoted FROM g LEFT JOIN f ON g.k = f.k),
e AS (SELECT *, CASE WHEN ap != 'APPLICABLE' THEN 'NOT_APPLICABLE' WHEN demoted THEN 'OPTIONAL' WHEN type IN ('functional', 'security', 'performance', 'reliability', 'data_io', 'architecture', 'storage', 'logging') THEN 'REQUIRED' ELSE 'OPTIONAL' END AS level, coalesce(win.label = 'COVERED' AND open, false) AS down FROM d),
h AS (SELECT *, CASE WHEN ap != 'APPLICABLE' OR n IS NULL THEN 'MISSING' WHEN n = lost THEN 'UNKNOWN' WHEN down THEN 'PARTIAL' ELSE coalesce(win.label, 'MISSING') END AS status, CASE WHEN level = 'OPTIONAL' THEN 'OPTIONAL_NOT_FOUND' ELSE 'MISSING_NO_EVIDENCE' END AS nothing,
  CASE WHEN type = 'security' THEN 'high' WHEN type IN ('performance', 'functional', 'reliability') THEN CASE role WHEN 'pmi' THEN 'high' ELSE 'medium' END WHEN type = 'architecture' THEN CASE role WHEN 'pz' THEN 'high' ELSE 'low' END WHEN type IN ('data_io', 'documentation', 'interface') THEN 'medium' ELSE 'low' END AS base FROM e),
i AS (SELECT *, CASE WHEN ap = 'OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' WHEN ap != 'APPLICABLE' THEN 'NOT_APPLICABLE' WHEN n IS NULL THEN nothing WHEN n = lost THEN 'UNKNOWN_LLM_UNAVAILABLE' WHEN down THEN 'PARTIAL_DOWNGRADED_FROM_COVERED' WHEN win IS NULL THEN coalesce(last.code, nothing) WHEN win.label = 'CONFLICT' THEN 'CONFLICT_VERIFIED' ELSE win.label END AS subcode FROM h),
verdicts AS (SELECT k, role, type, ap, level, status, subcode, coalesce(win.unit, last.unit) AS unit, round(coalesce(win.conf, 0.0)::DOUBLE, 4) AS confidence, {SEVERITY_SQL} AS severity, coalesce(any_low, false) AS any_low, coalesce(any_bad, false) AS any_bad, coalesce(lost, 0) AS lost,
  CASE WHEN ap != 'APPLICABLE' THEN false WHEN (CASE WHEN level = 'OPTIONAL' AND status = 'MISSING' THEN 'COVERED' ELSE status END) = 'CONFLICT' THEN true WHEN (CASE WHEN level = 'OPTIONAL' AND status = 'MISSING' THEN 'COVERED' ELSE status END) = 'COVERED' OR demoted THEN false ELSE status = 'MISSING' AND level != 'OPTIONAL' AND type IN ('functional', 'security', 'performance', 'reliability', 'data_io', 'architecture') END AS critical FROM i)"""


def judgments(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.md5(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("h"))
    label = pick(("COVERED", "PARTIAL", "CONFLICT", "IRRELEVANT", "NOT_JUDGED"), digit(1, 2) % 5)
    act, asp = digit(8) % 3, digit(9) % 6
    actions = F.when(label == "NOT_JUDGED", X.strings(["llm_unavailable:timeout"])).when(act == 0, X.strings([])).when(act == 1, X.strings(["no_op_kept_label"])).otherwise(X.strings(["conflict_confirmed_numeric"]))
    missing = F.when(asp == 0, X.strings(["log"])).when(asp == 1, X.strings(["«logging api»"])).when(asp == 2, X.strings(["Log ", "verb_match"])).when(asp == 3, X.strings(["ab", "регISTRATION"])).otherwise(X.strings([]))
    return rows.select(
        F.lit("p").alias("package_id"), F.col("l_orderkey").cast("string").alias("req_id"), F.lit("d").alias("target_doc_id"), F.col("l_linenumber").cast("string").alias("unit_id"), label.alias("label"), pick((0.3, 0.6, 0.66, 0.72, 0.8, 0.95), digit(3, 2) % 6).alias("confidence"),
        pick((0.1, 0.22, 0.31, 0.5), digit(5) % 4).alias("score"), (digit(6) < 3).alias("low_confidence"), (digit(7) < 3).alias("grounding_failed"), actions.alias("actions"), missing.alias("missing_aspects"),
    )


def verdicts(spark, sf_dir) -> DataFrame:
    req_type = F.coalesce(pick(L.REQUIREMENT_TYPES, digit(10)), F.lit("other"))
    grid = orders(spark, sf_dir).select(F.lit("p").alias("package_id"), F.col("o_orderkey").cast("string").alias("req_id"), F.lit("d").alias("target_doc_id"), F.when(digit(11) < 8, "pmi").otherwise("pz").alias("role"), req_type.alias("req_type"))
    return aggregate.aggregate_verdicts(grid, judgments(spark, sf_dir))


@query(f"{VERDICT_SQL} SELECT k::VARCHAR AS req_id, role, type AS req_type, ap AS applicability, level, status, subcode, unit AS unit_id, confidence, severity, critical AS is_critical, any_low AS any_low_confidence, any_bad AS any_grounding_failed, lost::BIGINT AS unjudged_pair_count FROM verdicts")
def verdict_rows(spark, sf_dir):
    """AGG-1 to AGG-9, DED-6, EXT-40, JOIN-7, MSC-2, MSC-21, WIN-11: verdicts of every order from random judgments of its line items."""
    return verdicts(spark, sf_dir).select("req_id", "role", "req_type", "applicability", "level", "status", "subcode", "unit_id", "confidence", "severity", "is_critical", "any_low_confidence", "any_grounding_failed", "unjudged_pair_count")


@query(
    f"""{VERDICT_SQL}, n AS (SELECT j.*, row_number() OVER (PARTITION BY j.k ORDER BY conf DESC, unit) AS r FROM j), won AS (SELECT DISTINCT k, unit, act, label AS jl FROM j),
s AS (SELECT v.*, won.act, won.jl, n.unit AS top_unit, n.conf AS top_conf FROM verdicts v LEFT JOIN won ON won.k = v.k AND won.unit = v.unit LEFT JOIN n ON n.k = v.k AND n.r = 1)
SELECT k::VARCHAR AS req_id, CASE WHEN subcode IN ('OUT_OF_SCOPE', 'NOT_APPLICABLE') THEN 'applicability_matrix' WHEN subcode IN ('OPTIONAL_NOT_FOUND', 'MISSING_NO_EVIDENCE') AND unit IS NULL THEN 'retrieval_miss_or_truly_missing' WHEN subcode = 'MISSING_LOW_GROUNDING' THEN 'llm_hallucinated_citation'
  WHEN subcode = 'MISSING_LOW_CONFIDENCE' THEN 'llm_unsure_or_threshold_too_strict' WHEN subcode = 'CONFLICT_VERIFIED' AND act = 2 AND jl != 'NOT_JUDGED' THEN 'verifier_numeric_conflict' WHEN subcode = 'CONFLICT_VERIFIED' THEN 'verifier_unknown_conflict_kind' WHEN subcode = 'COVERED' THEN 'llm_covered_grounded' WHEN subcode = 'PARTIAL' THEN 'llm_partial_or_verifier_demote' ELSE 'unclassified' END AS root_cause,
  CASE WHEN status = 'CONFLICT' THEN 'conflict' WHEN status = 'COVERED' AND top_conf < 0.7 THEN 'weak_match' END AS finding, top_unit AS top_unit, ap = 'OUT_OF_SCOPE' AS out_of_scope FROM s"""
)
def causes_and_findings(spark, sf_dir):
    """AGG-14, AGG-29, AGG-30, JOIN-15, MSC-14: cause, finding and best evidence of every verdict."""
    made, rows = stage(judgments(spark, sf_dir)), stage(verdicts(spark, sf_dir))
    found = report.findings(rows, made, weak=0.7).select("req_id", F.col("reason").alias("finding"))
    top = report.top_evidence(made, 1).select("req_id", F.get("evidence", F.lit(0))["unit_id"].alias("top_unit"))
    off = report.out_of_scope(rows).select("req_id", F.lit(True).alias("out"))
    out = report.root_cause(rows, made).join(found, "req_id", "left").join(top, "req_id", "left").join(off, "req_id", "left")
    return out.select("req_id", "root_cause", "finding", "top_unit", F.coalesce("out", F.lit(False)).alias("out_of_scope"))


@query(
    f"""{VERDICT_SQL}, bu AS (SELECT k, CASE WHEN subcode = 'CONFLICT_VERIFIED' OR status = 'CONFLICT' THEN 'conflict' WHEN subcode IN ('MISSING_NO_EVIDENCE', 'MISSING_LOW_GROUNDING', 'MISSING_LOW_CONFIDENCE') OR status = 'MISSING' THEN 'missing' WHEN subcode IN ('NOT_APPLICABLE', 'OUT_OF_SCOPE', 'OPTIONAL_NOT_FOUND') THEN 'not_applicable_or_optional' WHEN status IN ('COVERED', 'PARTIAL') THEN 'covered_or_partial' END AS bucket FROM verdicts),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42|p' || chr(31) || k || chr(31) || 'd'), k::VARCHAR) AS n FROM bu WHERE bucket IS NOT NULL) SELECT k::VARCHAR AS req_id, bucket FROM r WHERE n <= CASE bucket WHEN 'not_applicable_or_optional' THEN 5 ELSE 10 END"""
)
def review_sample(spark, sf_dir):
    """WIN-14, MSC-16: the rows of each bucket that go to a reviewer; a bounded sample is the feature."""
    return report.review_sample(stage(verdicts(spark, sf_dir)), stage(judgments(spark, sf_dir))).select("req_id", "bucket")


@query(
    f"""{VERDICT_SQL}, o1 AS (SELECT k, max(CASE label WHEN 'CONFLICT' THEN 4 WHEN 'COVERED' THEN 3 WHEN 'PARTIAL' THEN 2 ELSE 1 END) AS r FROM j GROUP BY k),
u AS (SELECT 'new' AS "view", status FROM verdicts UNION ALL SELECT 'legacy', CASE coalesce(r, 1) WHEN 4 THEN 'CONFLICT' WHEN 3 THEN 'COVERED' WHEN 2 THEN 'PARTIAL' ELSE 'MISSING' END FROM verdicts LEFT JOIN o1 USING (k)) SELECT "view", status, count(*) AS n FROM u GROUP BY ALL"""
)
def legacy_recount(spark, sf_dir):
    """AGG-27: statuses by the verdicts and by the labels alone."""
    return report.legacy_recount(verdicts(spark, sf_dir), judgments(spark, sf_dir).withColumnRenamed("label", "original_label"))


@query(
    f"""{VERDICT_SQL}, s1 AS (SELECT v.*, (SELECT max(score) FROM j WHERE j.k = v.k) AS best, CASE WHEN k % 5 = 0 THEN 'a' ELSE 'b' END AS pkg FROM verdicts v), t1 AS (SELECT *, CASE WHEN coalesce(best, 0) >= 0.45 THEN 'STRONG' WHEN coalesce(best, 0) >= 0.25 THEN 'MEDIUM' WHEN coalesce(best, 0) >= 0.12 THEN 'WEAK' ELSE 'NO_EVIDENCE' END AS strength FROM s1)
SELECT 'strength' AS what, strength AS name, count(*) AS n FROM t1 GROUP BY ALL UNION ALL SELECT 'subcode', subcode, count(*) FROM t1 GROUP BY ALL UNION ALL SELECT 'low', 'low', count(*) FILTER (WHERE any_low) FROM t1 WHERE ap = 'APPLICABLE'
UNION ALL SELECT 'role', role || '|' || status, count(*) FROM t1 GROUP BY ALL UNION ALL SELECT 'demo', coalesce(pkg, 'TOTAL'), round(1e6 * (count(*) FILTER (WHERE status = 'COVERED') + 0.5 * count(*) FILTER (WHERE status = 'PARTIAL')) / count(*))::BIGINT FROM t1 WHERE ap = 'APPLICABLE' GROUP BY ROLLUP (pkg)
UNION ALL SELECT 'run', 'x|' || status, count(*) FROM t1 GROUP BY ALL UNION ALL SELECT 'run', 'y|' || status, count(*) FROM t1 WHERE pkg = 'a' GROUP BY ALL"""
)
def run_diagnostics(spark, sf_dir):
    """AGG-23, AGG-28, MSC-15, SCO-12: strengths, subcodes, low confidence, roles, demo score and two runs side by side."""
    best = judgments(spark, sf_dir).groupBy("req_id").agg(F.max("score").alias("score"))
    rows = stage(verdicts(spark, sf_dir).join(best, "req_id", "left").withColumn("package_id", F.when(F.col("req_id").cast("long") % 5 == 0, "a").otherwise("b")))
    named = lambda what, df, name, n="n": df.select(F.lit(what).alias("what"), name.alias("name"), F.col(n).cast("long").alias("n"))
    wide = lambda df, keys, value: df.unpivot(keys, [c for c in df.columns if c not in keys], "k", value).where(F.col(value) > 0)
    demo = diagnostics.demo_report(rows).withColumn("n", F.round(F.col("score") * 1e6))
    out = named("strength", diagnostics.strengths(rows), F.col("strength")).unionByName(named("subcode", diagnostics.subcodes(rows), F.col("subcode"))).unionByName(named("low", diagnostics.low_confidence(rows), F.lit("low"), "low_confidence_count"))
    out = out.unionByName(named("role", wide(diagnostics.by_role(rows), ["role"], "n"), F.concat_ws("|", "role", "k"))).unionByName(named("demo", demo, F.coalesce("package_id", F.lit("TOTAL"))))
    return out.unionByName(named("run", wide(diagnostics.compare({"x": rows, "y": rows.where("package_id = 'a'")}), ["status"], "n"), F.concat_ws("|", "k", "status")))


@query(
    f"""WITH {JUDGMENTS_SQL}, a AS (SELECT label, unnest(CASE WHEN label = 'NOT_JUDGED' THEN ['llm_unavailable:timeout'] WHEN act = 0 THEN CAST([] AS VARCHAR[]) WHEN act = 1 THEN ['no_op_kept_label'] ELSE ['conflict_confirmed_numeric'] END) AS action FROM j) SELECT action, count(*) AS n FROM a GROUP BY ALL"""
)
def action_counts(spark, sf_dir):
    """AGG-24."""
    return diagnostics.actions(judgments(spark, sf_dir))


@query(
    f"""WITH {JUDGMENTS_SQL}, m AS (SELECT 'm' || (act + 1) AS model, k AS pair, label FROM j WHERE unit = '1' UNION ALL SELECT 'n', k, label FROM j WHERE unit = '2'),
p AS (SELECT x.model AS a, y.model AS b, count(*) AS n, count(*) FILTER (WHERE x.label = y.label) AS same FROM m x JOIN m y USING (pair) GROUP BY ALL) SELECT a, b, n, round(same::DOUBLE / n, 9) AS agreement FROM p"""
)
def model_agreement(spark, sf_dir):
    """JOIN-13: models' labels of the same pairs side by side."""
    return report.agreement(_models(spark, sf_dir)).select("a", "b", "n", F.round("agreement", 9).alias("agreement"))


def _models(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", F.md5(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("h"))
    model = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("m"), (digit(8) % 3 + 1).cast("string"))).otherwise("n")
    return rows.select(model.alias("model"), F.col("l_orderkey").cast("string").alias("req_id"), F.lit("d").alias("target_doc_id"), pick(("COVERED", "PARTIAL", "CONFLICT", "IRRELEVANT", "NOT_JUDGED"), digit(1, 2) % 5).alias("label"))


@query(
    f"""WITH {JUDGMENTS_SQL}, d AS (SELECT k::VARCHAR AS req_id, count(DISTINCT label) AS n_labels, count(*) AS n FROM j WHERE unit IN ('1', '2') GROUP BY k) SELECT req_id, n_labels, n FROM d WHERE n_labels >= 2 ORDER BY n_labels DESC, n DESC, req_id LIMIT 10"""
)
def disagreements(spark, sf_dir):
    """WIN-13: a top list is the feature."""
    return report.disagreements(_models(spark, sf_dir)).select("req_id", "n_labels", "n")


SCORED_SQL = f"""
q AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS unit, md5(l_orderkey || '|' || l_linenumber || '|s') AS h FROM lineitem),
s AS (SELECT *, ({digit_sql(1, 2)} % 101) / 100.0::DOUBLE AS lex, ({digit_sql(3, 2)} % 101) / 100.0::DOUBLE AS sem, CASE WHEN {digit_sql(5)} < 4 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS con, {pick_sql((0.0, 1.0, 0.55), digit_sql(6) + ' % 3')} AS topic, {pick_sql((0.0, 0.25, 0.5, 1.0), digit_sql(7) + ' % 4')} AS exact, {pick_sql((0.0, 0.35, 0.75), digit_sql(8) + ' % 3')} AS penalty,
  CASE WHEN {digit_sql(9)} < 8 THEN 'pmi' ELSE 'pz' END AS role, CASE WHEN {digit_sql(10)} < 4 THEN 'section_window' ELSE 'paragraph' END AS unit_type FROM q),
t AS (SELECT *, greatest(least(0.35::DOUBLE * lex + 0.35::DOUBLE * sem + 0.2::DOUBLE * con + 0.1::DOUBLE * topic + CASE WHEN exact > 0 THEN least(0.22::DOUBLE, 0.06::DOUBLE + 0.16::DOUBLE * exact) ELSE 0.0::DOUBLE END + CASE WHEN topic > 0 THEN least(0.14::DOUBLE, 0.04::DOUBLE + 0.1::DOUBLE * topic) ELSE 0.0::DOUBLE END, 0.9999::DOUBLE) - penalty, 0.0::DOUBLE) AS raw FROM s),
scored AS (SELECT l_suppkey::VARCHAR AS req_id, role, unit, unit_type, lex, sem, round(raw, 4) AS score, l_suppkey % 3 AS kind FROM t WHERE raw >= 0.05)"""


def scored_units(spark, sf_dir) -> DataFrame:
    """A random score for each line item: suppliers stand for requirements, their line items for units of one target a role."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_pos"), F.md5(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit("s"))).alias("h"))
    rows = rows.select(
        F.lit("p").alias("package_id"), F.col("l_suppkey").cast("string").alias("req_id"), "unit_pos", F.format_string("%020d", F.col("unit_pos").cast("long")).alias("unit_id"), ((digit(1, 2) % 101) / F.lit(100.0)).alias("lex"), ((digit(3, 2) % 101) / F.lit(100.0)).alias("sem"), F.when(digit(5) < 4, 0.5).otherwise(0.0).alias("con"),
        pick((0.0, 1.0, 0.55), digit(6) % 3).alias("topic"), pick((0.0, 0.25, 0.5, 1.0), digit(7) % 4).alias("exact"), pick((0.0, 0.35, 0.75), digit(8) % 3).alias("penalty"), F.when(digit(9) < 8, "pmi").otherwise("pz").alias("role"),
        F.when(digit(10) < 4, "section_window").otherwise("paragraph").alias("unit_type"), pick(("functional", "security", "storage"), (F.col("l_suppkey") % 3).cast("int")).alias("req_type"),
    )
    raw = retrieve.hybrid(*(F.col(c) for c in ("lex", "sem", "con", "topic", "exact", "topic", "penalty")))
    held = F.when(F.col("req_type") == "storage", F.array(F.struct(F.lit("size").alias("kind")))).otherwise(F.array().cast("array<struct<kind:string>>"))
    rows = rows.withColumn("raw", raw).where(F.col("raw") >= retrieve.RetrievalConfig().min_score).withColumn("score", F.round("raw", 4))
    return rows.withColumn("target_doc_id", F.col("role")).withColumn("req_constraints", held)


@query(f"WITH {SCORED_SQL} SELECT req_id, role, unit::BIGINT AS unit, score, CASE WHEN score >= 0.45 THEN 'STRONG' WHEN score >= 0.25 THEN 'MEDIUM' WHEN score >= 0.12 THEN 'WEAK' ELSE 'NO_EVIDENCE' END AS strength FROM scored")
def hybrid_scores(spark, sf_dir):
    """SCO-10, SCO-11, SCO-12, FLT-4: the hybrid score of random components for each line item."""
    return scored_units(spark, sf_dir).select("req_id", "role", F.col("unit_pos").cast("long").alias("unit"), "score", S.strength(F.col("score")).alias("strength"))


SELECT_SQL = f"""WITH {SCORED_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id, role ORDER BY score DESC, unit) AS rank FROM scored), listed AS (SELECT * FROM ranked WHERE rank <= CASE role WHEN 'pz' THEN 25 ELSE 10 END),
m AS (SELECT *, max(CASE WHEN unit_type != 'section_window' THEN score END) OVER (PARTITION BY req_id, role) AS best FROM listed), w AS (SELECT * FROM m WHERE unit_type != 'section_window' OR best IS NULL OR score >= greatest(0.45::DOUBLE, best - 0.08::DOUBLE)),
p AS (SELECT *, row_number() OVER o AS pick, lead(score) OVER o AS next, count(*) OVER (PARTITION BY req_id, role) AS n FROM w WINDOW o AS (PARTITION BY req_id, role ORDER BY score DESC, unit_type = 'section_window', rank)),
g AS (SELECT *, max(CASE WHEN pick = 1 THEN score END) OVER (PARTITION BY req_id, role) AS top1, max(CASE WHEN pick = 1 THEN coalesce(score - next, score) END) OVER (PARTITION BY req_id, role) AS margin FROM p),
k AS (SELECT *, CASE WHEN top1 < 0.12 THEN 'no_evidence' WHEN top1 < 0.3 AND kind = 0 THEN 'below_floor' END AS skip_reason, CASE WHEN kind != 0 THEN least(5, n) WHEN top1 >= 0.45 AND margin >= 0.08::DOUBLE THEN 1 ELSE least(3, n) END AS k FROM g)"""


@query(f"{SELECT_SQL} SELECT req_id, role, unit::BIGINT AS unit, pick::INTEGER AS pick, skip_reason, CASE WHEN skip_reason IS NULL THEN k ELSE 0 END::INTEGER AS selected_k, pick <= CASE WHEN skip_reason IS NULL THEN k ELSE 0 END AS selected, top1 < 0.3 AS below_floor FROM k")
def adaptive_select(spark, sf_dir):
    """WIN-1, WIN-3, WIN-4, WIN-5, AGG-11, MSC-1: shortlists of random scores, and how many of each go to the judge."""
    chosen = retrieve.select(retrieve.shortlist(scored_units(spark, sf_dir)))
    return chosen.select("req_id", "role", F.col("unit_pos").cast("long").alias("unit"), "pick", "skip_reason", "selected_k", "selected", "below_floor")


@query(
    f"""WITH {SCORED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id, role ORDER BY score DESC, unit) AS rank FROM scored),
t1 AS (SELECT req_id, role, any_value(kind) AS kind, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b, max(CASE WHEN rank = 1 THEN sem END) AS sem, max(CASE WHEN rank = 1 THEN lex END) AS lex FROM ranked GROUP BY req_id, role)
SELECT req_id, role, CASE WHEN a < 0.45 THEN 'weak_top1' WHEN a - b < 0.08::DOUBLE THEN 'close_call' WHEN kind = 1 THEN 'critical_type' WHEN kind = 2 THEN 'numeric_constraints' WHEN sem >= 0.55 AND lex <= 0.2 THEN 'paraphrase' END AS reason FROM t1"""
)
def rerank_reasons(spark, sf_dir):
    """SCO-14, WIN-3."""
    return retrieve.rerank_reason(retrieve.shortlist(scored_units(spark, sf_dir))).select("req_id", F.col("target_doc_id").alias("role"), "reason")


UNITS = ("ms", "sec", "min", "hours", "days", "kb", "mb", "gb", "rps", "rpm", "%", None)
_FACTOR_SQL = "CASE {0} " + " ".join(f"WHEN '{u}' THEN {f!r}::DOUBLE" for u, f in L.UNIT_FACTOR.items()) + " END"
_CLASS_SQL = "CASE {0} " + " ".join(f"WHEN '{u}' THEN '{c}'" for u, c in L.UNIT_CLASS.items()) + " END"
_AGREE_SQL = f"CASE WHEN {_FACTOR_SQL.format('ru')} IS NOT NULL AND {_FACTOR_SQL.format('uu')} IS NOT NULL THEN abs(rv * {_FACTOR_SQL.format('ru')} - uv * {_FACTOR_SQL.format('uu')}) <= greatest(greatest(abs(rv * {_FACTOR_SQL.format('ru')}), abs(uv * {_FACTOR_SQL.format('uu')})) * 1e-3::DOUBLE, 1e-6::DOUBLE) ELSE abs(rv - uv) < 1e-6::DOUBLE END"
_SAME_SQL = f"CASE WHEN {_CLASS_SQL.format('ru')} IS NOT NULL AND {_CLASS_SQL.format('uu')} IS NOT NULL THEN {_CLASS_SQL.format('ru')} = {_CLASS_SQL.format('uu')} ELSE ru IS NOT DISTINCT FROM uu END"


@query(
    f"""WITH c AS (SELECT o_orderkey, {digit_sql(1, 2)} % 60 + 1.0::DOUBLE AS rv, {pick_sql(UNITS, digit_sql(3, 2) + ' % 12')} AS ru, {pick_sql(KINDS, digit_sql(5) + ' % 4')} AS rk, h FROM {ORDERS_SQL}),
u AS (SELECT o_orderkey, rv, ru, rk, rv * {pick_sql((1.0, 60.0, 1.0005, 2.0), digit_sql(6) + ' % 4')} AS uv, {pick_sql(UNITS, digit_sql(7, 2) + ' % 12')} AS uu, {pick_sql(KINDS, digit_sql(9) + ' % 4')} AS uk FROM c UNION ALL SELECT o_orderkey, rv, ru, rk, rv, ru, {pick_sql(KINDS, digit_sql(10) + ' % 4')} FROM c WHERE {digit_sql(11)} < 6),
p AS (SELECT *, {_SAME_SQL} AS same, {_AGREE_SQL} AS agree FROM u)
SELECT o_orderkey, least(sum(CASE WHEN NOT same THEN 0.0::DOUBLE WHEN agree THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 1.0::DOUBLE) AS overlap, bool_or(same AND NOT (ru IS NULL AND uu IS NULL) AND rk = uk AND NOT agree) AS conflict, bool_or(rk = uk AND rk != 'generic') AS shared FROM p GROUP BY o_orderkey"""
)
def constraint_pairs(spark, sf_dir):
    """SCO-4, SCO-5, JOIN-8, MSC-5, VER-3's predicate: constraints of random units and values, each order's pair."""
    one = lambda v, u, k: F.struct(k.alias("kind"), F.lit("<=").alias("operator"), v.alias("value"), u.alias("unit"))
    value, unit = (digit(1, 2) % 60 + 1).cast("double"), pick(UNITS, digit(3, 2) % 12)
    other = one(value * pick((1.0, 60.0, 1.0005, 2.0), digit(6) % 4), pick(UNITS, digit(7, 2) % 12), pick(KINDS, digit(9) % 4))
    rows = orders(spark, sf_dir).select("o_orderkey", F.array(one(value, unit, pick(KINDS, digit(5) % 4))).alias("r"), F.when(digit(11) < 6, F.array(other, one(value, unit, pick(KINDS, digit(10) % 4)))).otherwise(F.array(other)).alias("u"))
    rows = stage(rows)
    r, u = F.col("r"), F.col("u")
    return rows.select("o_orderkey", S.constraint_overlap(r, u).alias("overlap"), S.numeric_conflict(r, u).alias("conflict"), (F.size(S.shared_kinds(r, u)) > 0).alias("shared"))


_TF_SQL = f"SELECT conv_id, turn, lower(t) AS t, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '{L.TOKEN}')) AS t FROM conversations WHERE role = '{{0}}') GROUP BY ALL"


@query(
    f"""WITH ut AS ({_TF_SQL.format('user')}), ast AS ({_TF_SQL.format('assistant')}), un AS (SELECT conv_id, turn, sqrt(sum(n * n)::DOUBLE) AS norm, count(*) AS k FROM ut GROUP BY ALL), an AS (SELECT conv_id, turn, sqrt(sum(n * n)::DOUBLE) AS norm, count(*) AS k FROM ast GROUP BY ALL),
d AS (SELECT ut.conv_id, ut.turn AS r, ast.turn AS t, sum(ut.n * ast.n)::DOUBLE AS dot, count(*) AS common FROM ut JOIN ast ON ut.conv_id = ast.conv_id AND ut.t = ast.t GROUP BY ALL),
p AS (SELECT u.conv_id, u.turn AS r, a.turn AS t FROM conversations u JOIN conversations a USING (conv_id) WHERE u.role = 'user' AND a.role = 'assistant')
SELECT p.conv_id::VARCHAR AS package_id, p.r::VARCHAR AS req_id, p.t::VARCHAR AS unit_id, round(coalesce(dot / (un.norm * an.norm), 0.0)::DOUBLE, 6) AS cosine, coalesce(un.k, 0) AS req_terms, coalesce(common, 0) AS common FROM p LEFT JOIN d USING (conv_id, r, t) LEFT JOIN un ON un.conv_id = p.conv_id AND un.turn = p.r LEFT JOIN an ON an.conv_id = p.conv_id AND an.turn = p.t"""
)
def text_pairs(spark, sf_dir):
    """TXT-3, TXT-4, SCO-2: bag-of-words cosine and common tokens of every user turn with every assistant turn of its conversation."""
    side = lambda role, p: stage(turns(spark, sf_dir, role).select("package_id", F.col("id").alias(f"{p}_id"), X.term_counts(F.col("text")).alias(f"{p}_terms"), X.tokens(F.col("text")).alias(f"{p}_tokens")))
    pairs = side("user", "req").join(side("assistant", "unit"), "package_id")
    cosine = F.round(S.bow_cosine(F.col("req_terms"), F.col("unit_terms")), 6)
    return pairs.select("package_id", "req_id", "unit_id", cosine.alias("cosine"), F.size("req_terms").cast("long").alias("req_terms"), F.size(F.array_intersect("req_tokens", "unit_tokens")).cast("long").alias("common"))


@query(
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT *, substring(t, 1, 200) AS head FROM t), b AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?»])', 1) AS b FROM h),
k AS (SELECT *, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS n FROM b)
SELECT doc_id, md5(CASE WHEN length(t) <= 200 THEN t ELSE trim(CASE WHEN length(b) > 1 THEN b WHEN contains(head, ' ') THEN regexp_extract(head, '(?s)^(.*) ', 1) ELSE head END) END) AS cut, md5(regexp_replace(n, '[\s.,;:!?]+$', '')) AS key, length(CASE WHEN length(t) > 50 THEN rtrim(substring(t, 1, 49)) || '…' ELSE t END) AS shown FROM k"""
)
def text_cuts(spark, sf_dir):
    """TXT-9, TXT-10, TXT-12 on all documents."""
    t = X.text_of(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.cut_at_sentence(t, 200)).alias("cut"), F.md5(X.label_key(t)).alias("key"), F.length(X.ellipsis(t, 50)).cast("long").alias("shown"))


REPORT_SQL = f"""WITH q AS (SELECT o_orderkey AS k, md5(o_orderkey::VARCHAR) AS h FROM orders),
t AS (SELECT k // 4 AS pkg, k, 'R' || k AS rid, {pick_sql(('login', 'export', 'report', 'upload'), digit_sql(1) + ' % 4')} AS topic, {digit_sql(2)} % 3 + 1 AS n, {digit_sql(3)} % 3 + 1 AS m, {digit_sql(4)} < 4 AS expected, {digit_sql(5)} % 3 AS bound, {digit_sql(6)} % 3 AS other, {digit_sql(7)} < 8 AS same_section FROM q),
a AS (SELECT *, ['must', topic, 'page', 'handles'] || CASE WHEN bound = 1 THEN ['at', 'most'] WHEN bound = 2 THEN ['at', 'least'] ELSE CAST([] AS VARCHAR[]) END || [n::VARCHAR, 'items'] AS rt,
  ['check', topic] || CASE WHEN other = 1 THEN ['at', 'most'] WHEN other = 2 THEN ['at', 'least'] ELSE CAST([] AS VARCHAR[]) END || [m::VARCHAR, 'items'] || CASE WHEN expected THEN ['handles', 'result'] ELSE ['verify'] END AS tt FROM t),
p AS (SELECT r.pkg, r.k AS rk, u.k AS tk, len(list_intersect(list_distinct(r.rt), list_distinct(u.tt)))::DOUBLE / len(list_distinct(r.rt)) AS lex, CASE WHEN (r.same_section AND u.same_section) OR r.k = u.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sec, r.n, u.m, r.bound, u.other, u.expected FROM a r JOIN a u USING (pkg)),
c AS (SELECT *, (0.7::DOUBLE * lex + 0.1::DOUBLE * sec + 0.05::DOUBLE * 0.0::DOUBLE + 0.15::DOUBLE * 0.0::DOUBLE) / (0.7::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE + 0.15::DOUBLE) AS raw FROM p),
s AS (SELECT *, round(raw, 4) AS score, row_number() OVER (PARTITION BY rk ORDER BY round(raw, 4) DESC, tk) AS rank FROM c WHERE raw >= 0.2),
l AS (SELECT *, CASE WHEN n != m OR (bound = 1 AND other = 2) OR (bound = 2 AND other = 1) THEN 'CONFLICT' WHEN NOT expected AND lex >= 0.15 THEN 'PARTIAL' WHEN score < 0.3 OR lex < 0.15 THEN 'INADEQUATE' WHEN lex < 0.45 THEN 'PARTIAL' ELSE 'ADEQUATE' END AS status FROM s WHERE rank <= 5),
b AS (SELECT rk, arg_min({{'s': status, 't': tk}}, {{'r': CASE status WHEN 'ADEQUATE' THEN -5 WHEN 'CONFLICT' THEN -4 WHEN 'PARTIAL' THEN -3 WHEN 'INADEQUATE' THEN -2 ELSE -1 END, 's': -score, 'k': rank}}) AS b, count(*) AS n FROM l GROUP BY rk),
f AS (SELECT a.pkg, a.k, coalesce(b.b.s, 'MISSING') AS final_status, b.b.t AS tk, coalesce(b.n, 0) AS n_candidates FROM a LEFT JOIN b ON b.rk = a.k), x AS (SELECT a.pkg, count(*) AS orphans FROM a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tk = a.k AND score >= 0.25) GROUP BY a.pkg)"""


def _trace_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    rows = orders(spark, sf_dir).select("h", (k / 4).cast("long").cast("string").alias("package_id"), k.alias("pos"), k.cast("string").alias("id"), F.when(digit(7) < 8, F.lit("ui")).otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("section"))
    topic = pick(("login", "export", "report", "upload"), digit(1) % 4)
    bound = lambda at: pick(("", "at most", "at least"), digit(at) % 3)
    req = F.concat_ws(" ", F.lit("must"), topic, F.lit("page handles"), bound(5), (digit(2) % 3 + 1).cast("string"), F.lit("items"))
    test = F.concat_ws(" ", F.lit("check"), topic, bound(6), (digit(3) % 3 + 1).cast("string"), F.lit("items"), F.when(digit(4) < 4, F.lit("")).otherwise(F.lit("verify")))
    return rows.select("package_id", "pos", "id", "section", req.alias("text")), rows.select("package_id", "pos", "id", "section", test.alias("text"), F.when(digit(4) < 4, "handles result").alias("expected_result"))


@query(f"{REPORT_SQL} SELECT pkg::VARCHAR AS package_id, k::VARCHAR AS req_id, final_status, tk::VARCHAR AS test_id, n_candidates, CASE WHEN tk IS NULL OR final_status = 'MISSING' THEN 'uncovered' WHEN final_status = 'CONFLICT' THEN 'conflicting' ELSE 'accepted' END AS bucket FROM f")
def trace_findings(spark, sf_dir):
    """AGG-16, AGG-17, AGG-18, AGG-21, EXT-32, SCO-17 to SCO-20, WIN-6, WIN-7, MSC-7: the best link of a requirement made of each order."""
    found = traceability.evaluate(*_trace_sides(spark, sf_dir))["findings"]
    return report.trace_buckets(found).select("package_id", "req_id", "final_status", "test_id", "n_candidates", "bucket")


_COUNTS_SQL = ", ".join(f"count(*) FILTER (WHERE final_status = '{s}') AS {s.lower()}_count" for s in ("ADEQUATE", "PARTIAL", "INADEQUATE", "MISSING", "CONFLICT"))


@query(
    f"""{REPORT_SQL}, y AS (SELECT pkg, count(*) AS total, {_COUNTS_SQL} FROM f GROUP BY pkg) SELECT y.pkg::VARCHAR AS package_id, total AS total_requirements, adequate_count, partial_count, inadequate_count, missing_count, conflict_count, coalesce(orphans, 0) AS orphans,
round(least(greatest((adequate_count + 0.5::DOUBLE * partial_count + 0.25::DOUBLE * inadequate_count) / greatest(total, 1) - 0.2::DOUBLE * (coalesce(orphans, 0)::DOUBLE / greatest(total + coalesce(orphans, 0), 1)), 0.0::DOUBLE), 1.0::DOUBLE), 9) AS score_c FROM y LEFT JOIN x USING (pkg)"""
)
def trace_scores(spark, sf_dir):
    """AGG-19, AGG-20, JOIN-14: counts and score C of each package of four orders."""
    out = traceability.evaluate(*_trace_sides(spark, sf_dir))["summary"]
    return out.select("package_id", "total_requirements", "adequate_count", "partial_count", "inadequate_count", "missing_count", "conflict_count", "orphans", F.round("score_c", 9).alias("score_c"))


@query(
    f"""WITH s AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM {LINES_SQL}), p AS (SELECT doc_id, pos, t, {_legacy_sql('t')} AS tok, len(list_filter(string_split(t, ' '), lambda w: w != '')) AS w FROM s),
b AS (SELECT {_legacy_sql('text')} AS tok, len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w != '')) AS w FROM benchmark)
SELECT DISTINCT p.doc_id, p.pos::BIGINT AS pos FROM p JOIN b ON b.w >= greatest(1, p.w // 2) AND b.w <= 2 * p.w WHERE len(p.tok) > 0 AND len(b.tok) > 0 AND len(list_intersect(p.tok, b.tok)) >= 0.6::DOUBLE * (len(p.tok) + len(b.tok) - len(list_intersect(p.tok, b.tok)))"""
)
def fuzzy_lines(spark, sf_dir):
    """JOIN-12, SCO-23: lines of documents near a benchmark text, by words and tokens, at a looser similarity than the default."""
    rows = lines(spark, sf_dir).select(F.struct("doc_id", "pos").alias("id"), dataset.squeezed(F.col("line")).alias("text"))
    return dataset.fuzzy_matches(rows, table(spark, sf_dir, "benchmark").select("text"), "id", 0.6).select("id.doc_id", F.col("id.pos").cast("long").alias("pos"))


@query(
    r"""WITH r AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark UNION ALL SELECT item_id + 1000000, trim(regexp_replace(text, '\s+', ' ', 'g')) || ' !' FROM benchmark),
k AS (SELECT *, regexp_replace(lower(t), '[\s.,;:!?\-–—«»"'']+$', '') AS key FROM r WHERE len(list_filter(string_split(t, ' '), lambda w: w != '')) BETWEEN 3 AND 80) SELECT md5(key) AS key, md5(arg_min(t, item_id)) AS text FROM k WHERE key != '' GROUP BY k.key"""
)
def distinct_positives(spark, sf_dir):
    """DED-4, SRC-10, FLT-3: of texts with one key the first."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    twice = items.unionByName(items.select((F.col("item_id") + 1000000).alias("item_id"), F.concat("text", F.lit(" !")).alias("text")))
    return dataset.distinct_positives(twice, "item_id").select(F.md5("key").alias("key"), F.md5("text").alias("text"))


@query(
    f"""WITH u AS (SELECT conv_id, turn, {_legacy_sql('text')} AS tok FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, {_legacy_sql('text')} AS tok FROM conversations WHERE role = 'assistant'),
p AS (SELECT u.conv_id, u.turn AS r, a.turn AS t, {jaccard_sql('u.tok', 'a.tok')} AS s FROM u JOIN a USING (conv_id)) SELECT conv_id::VARCHAR AS package_id, r::VARCHAR AS req_key, t::VARCHAR AS chunk_id, s AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, r ORDER BY s DESC, t)::INTEGER AS rank FROM p) WHERE rank <= 5"""
)
def labelling_pairs(spark, sf_dir):
    """WIN-9, SNK-3: the five chunks of each requirement that go to a labeller."""
    reqs = turns(spark, sf_dir, "user").withColumnRenamed("id", "req_key")
    chunks = turns(spark, sf_dir, "assistant").withColumnRenamed("id", "chunk_id").withColumn("doc_type", F.lit("PMI"))
    return legacy.labelling_pairs(reqs, chunks).select("package_id", "req_key", "chunk_id", "score", "rank")


ANSWERS_SQL = f"""(SELECT o_orderkey, h, {pick_sql(('covered', 'PARTIAL', 'CONFLICT', 'IRRELEVANT', 'NOT_JUDGED', ''), digit_sql(1, 2) + ' % 6')} AS label, {digit_sql(3)} < 8 AS cited, {digit_sql(4)} < 8 AS matched, {digit_sql(5)} < 8 AS against, {digit_sql(6)} < 14 AS json, {digit_sql(7)} < 14 AS evidence FROM {ORDERS_SQL})"""


@query(
    f"""WITH a AS (SELECT *, CASE WHEN json AND upper(label) IN ('COVERED', 'PARTIAL', 'CONFLICT', 'IRRELEVANT') THEN upper(label) ELSE 'IRRELEVANT' END AS l0 FROM {ANSWERS_SQL}),
b AS (SELECT *, CASE WHEN l0 = 'CONFLICT' AND NOT against THEN CASE WHEN matched THEN 'PARTIAL' ELSE 'IRRELEVANT' END ELSE l0 END AS l1 FROM a), c AS (SELECT *, l1 != 'IRRELEVANT' AND evidence AND NOT cited AS bad FROM b)
SELECT o_orderkey, CASE WHEN bad THEN 'IRRELEVANT' ELSE l1 END AS label, CASE WHEN bad THEN least(CASE WHEN json THEN 0.9 ELSE 0.5 END, 0.3) WHEN json THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, bad AS grounding_failed, CASE WHEN bad OR NOT json OR NOT matched THEN 0 ELSE 1 END::INTEGER AS n_matched FROM c"""
)
def parsed_answers(spark, sf_dir):
    """JDG-7, EXT-37, TXT-11: a model's raw answer for each order, parsed and grounded."""
    list_ = lambda cond, v: F.when(cond, F.lit(f'["{v}"]')).otherwise(F.lit("[]"))
    label = pick(("covered", "PARTIAL", "CONFLICT", "IRRELEVANT", "NOT_JUDGED", ""), digit(1, 2) % 6)
    body = F.concat(F.lit('Ответ: {"label": "'), label, F.lit('", "confidence": 0.9, "matched_aspects": '), list_(digit(4) < 8, "m"), F.lit(', "conflict_aspects": '), list_(digit(5) < 8, "c"), F.lit(', "cited_phrases": '), F.when(digit(3) < 8, F.lit('["Журнал  событий"]')).otherwise(F.lit('["нет такого"]')), F.lit("} конец"))
    rows = orders(spark, sf_dir).select("o_orderkey", F.when(digit(6) < 14, body).otherwise("no json").alias("raw"), F.when(digit(7) < 14, F.lit("хранится журнал событий")).otherwise("").alias("evidence"))
    return responses.parse(stage(rows)).select("o_orderkey", "label", "confidence", "grounding_failed", F.size("matched_aspects").alias("n_matched"))


@query(
    f"""WITH t AS (SELECT o_orderkey, {digit_sql(1)} % 4 AS a, {digit_sql(2)} % 4 AS b, {digit_sql(3)} < 12 AS indexed FROM {ORDERS_SQL}), u AS (SELECT o_orderkey, 0 AS pos, CASE WHEN indexed THEN a ELSE 0 END AS i, 'COVERED' AS label FROM t UNION ALL SELECT o_orderkey, 1, b, 'PARTIAL' FROM t UNION ALL SELECT o_orderkey, 2, 2, 'IRRELEVANT' FROM t)
SELECT o_orderkey, i::INTEGER AS index, arg_min(label, pos) AS label FROM u WHERE i < 3 GROUP BY o_orderkey, i"""
)
def batch_answers(spark, sf_dir):
    """JDG-8: answers to a batch of three with missing, repeated and impossible indexes, in an array or an object."""
    item = lambda i, label: F.concat(F.lit("{"), i, F.lit(f'"label": "{label}"}}'))
    index = lambda d: F.concat(F.lit('"index": '), d.cast("string"), F.lit(", "))
    array = F.concat(F.lit("["), item(F.when(digit(3) < 12, index(digit(1) % 4)).otherwise(F.lit("")), "COVERED"), F.lit(", "), item(index(digit(2) % 4), "PARTIAL"), F.lit(", "), item(F.lit(""), "IRRELEVANT"), F.lit("]"))
    rows = orders(spark, sf_dir).select("o_orderkey", F.when(digit(4) < 8, array).otherwise(F.concat(F.lit('here: {"verdicts": '), array, F.lit("}"))).alias("raw"), F.lit(3).alias("expected"))
    return responses.parse_batch(stage(rows)).select("o_orderkey", "index", F.col("answer.label").alias("label"))


@query(
    f"""WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n, {pick_sql(('CONFLICT', 'COVERED', 'PARTIAL', 'MISSING', 'UNKNOWN'), digit_sql(1, 2) + ' % 5')} AS status, {digit_sql(3)} < 8 AS has FROM (SELECT *, md5(l_orderkey || '|' || l_linenumber) AS h FROM lineitem)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE status WHEN 'CONFLICT' THEN 4 WHEN 'COVERED' THEN 3 WHEN 'PARTIAL' THEN 2 WHEN 'MISSING' THEN 1 ELSE 0 END DESC, has DESC, n) AS o FROM v) SELECT k::VARCHAR AS req_id, n::INTEGER AS n, status FROM r WHERE o = 1"""
)
def one_per_pair(spark, sf_dir):
    """DED-1: several results of one requirement and target, of which one stays."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.md5(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("h"))
    rows = rows.select(F.lit("p").alias("package_id"), F.col("l_orderkey").cast("string").alias("req_id"), F.lit("d").alias("target_doc_id"), F.col("l_linenumber").cast("int").alias("n"), pick(("CONFLICT", "COVERED", "PARTIAL", "MISSING", "UNKNOWN"), digit(1, 2) % 5).alias("status"), F.when(digit(3) < 8, F.lit("u")).alias("unit_id"))
    return aggregate.one_per_pair(rows, "n").select("req_id", "n", "status")


#: Sentences that are filled with each part's size in turn.
SENTENCES = (
    "Система должна хранить журнал событий не менее {n} дней.", "Время ответа сервера не более {n} секунд.", "Программа не должна передавать пароль более {n} раз.", "ГОСТ 19.{n}-77 Виды программ и программных документов.",
    "4.{n} Требования к интерфейсу", "ВВЕДЕНИЕ", "Техническое задание на разработку, ТЗ {n}", "Программа и методика испытаний {n}", "Система должна обеспечивать: 1) поиск публикаций по автору 2) загрузку файлов на сервер {n}",
    "Проверка выполняется оператором: timeout {n} sec, {n} попыток", "клиентская часть должна использовать Angular и REST API", "Следует подготовить руководство оператора и текст программы", "try again in {n} s: COVERED", "Система включает перечисленные ниже:",
)


def sentences(spark, sf_dir) -> DataFrame:
    i = (F.col("p_partkey") % len(SENTENCES)).cast("int")
    text = F.replace(pick(SENTENCES, i), F.lit("{n}"), F.col("p_size").cast("string"))
    return stage(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", i.alias("i"), F.col("p_size").alias("n"), text.alias("text")))


def features(t: Column) -> dict[str, Column]:
    act, head, scores = E.action(X.normalize(t)), E.heading(t), E.head_scores(t)
    join = lambda c: F.array_join(c, "|")
    return {
        "modality": E.modality(t), "req_type": E.requirement_type(t), "legacy_type": E.legacy_type(t), "fragment": E.is_requirement_fragment(t), "boilerplate": E.is_boilerplate(t), "self_contained": E.is_self_contained(t), "list_intro": E.is_list_intro(t),
        "step": E.is_verification_step(t), "modal": E.has_normative_modal(t), "legacy_req": E.is_legacy_requirement(t), "subject": E.subject_head(X.normalize(t)), "verb": act["verb"], "object": act["phrase"], "artifacts": join(E.artifacts(X.normalize(t))), "topics": join(verify.topics(t)),
        "heading": head["section_id"], "title": head["title"], "kind": X.let(head, lambda h: E.section_kind(h["section_id"], h["title"])), "markers": E.marker_count(t).cast("long"), "head_type": X.let(scores, E.head_type), "tz_score": scores["tz"].cast("long"), "pmi_score": scores["pmi"].cast("long"),
        "signals": join(F.array_sort(E.coverage_signals(t))), "aspects": join(F.array_sort(E.aspects(t))), "entities": join(E.entities(t)), "timeouts": join(E.timeouts(t)), "attempts": join(E.attempts(t)), "roles": join(E.roles(t)), "n_items": F.size(E.split_compound(t)).cast("long"),
        "verdict": responses.verdict(t), "retry_after": responses.retry_after(t), "n_constraints": F.size(E.constraints(t)).cast("long"), "con": F.get(E.constraints(t), F.lit(0)), "unit_type": E.unit_type(F.lit("test_step")), "compact": E.is_small_model(t),
    }


#: What each sentence holds, read off the lexicon by hand: modality, type, legacy type, flags (fragment, boilerplate, self-contained, list
#: introduction, verification step, normative modal), subject, verb, object, artifacts, topics, section, title, kind, markers, head type, signals,
#: entities, timeouts, attempts, items, verdict, and the first constraint.
HELD = (
    ("must", "logging", "logging", "10100 1", "system", "хранить", "журнал событий не менее {n} дней", "", "", None, None, "unknown", 1, "OTHER", "", "Система должна хранить", "", "", 1, "MISSING", "retention_period >= days"),
    ("unknown", "performance", "performance", "00000 0", None, None, "", "", "response_time|data_from_server", None, None, "unknown", 0, "OTHER", "сервер", "Время ответа сервера", "{n}", "", 1, "MISSING", "response_time <= sec"),
    ("must_not", "other", "security", "10100 1", "program", "передавать", "пароль более {n} раз", "", "", None, None, "unknown", 1, "OTHER", "", "Программа не должна", "", "", 1, "MISSING", "generic > times"),
    ("unknown", "documentation", "other", "01000 0", None, None, "", "", "", None, None, "unknown", 0, "OTHER", "", "Виды программ и", "", "", 1, "MISSING", None),
    ("unknown", "other", "interface", "00000 0", None, None, "", "", "", "4.{n}", "Требования к интерфейсу", "req", 0, "OTHER", "интерфейс", "Требования к интерфейсу", "", "", 1, "MISSING", "generic = -"),
    ("unknown", "other", "other", "00000 0", None, None, "", "", "", "", "ВВЕДЕНИЕ", "non_req", 0, "OTHER", "", "ВВЕДЕНИЕ", "", "", 1, "MISSING", None),
    ("unknown", "other", "other", "00000 0", None, None, "", "tech_spec", "", None, None, "unknown", 0, "TZ", "", "Техническое задание на", "", "", 1, "MISSING", "generic >= -"),
    ("unknown", "other", "other", "00000 0", "program", None, "", "pmi_doc", "", None, None, "unknown", 0, "PMI", "", "Программа и методика", "", "", 1, "MISSING", "generic = -"),
    ("must", "functional", "functional", "10100 1", "system", "обеспечивать", "", "", "", None, None, "unknown", 2, "OTHER", "загруз|сервер|файл", "Система должна обеспечивать", "", "", 2, "MISSING", "generic <= -"),
    ("unknown", "other", "other", "00001 0", None, None, "", "", "", None, None, "unknown", 0, "OTHER", "", "Проверка выполняется оператором", "{n}", "{n}", 1, "MISSING", "timeout = -"),
    ("must", "architecture", "interface", "10000 1", "client_part", None, "", "", "", None, None, "unknown", 1, "OTHER", "angular|rest api", "Angular|REST API|REST|API", "", "", 1, "MISSING", None),
    ("should", "documentation", "other", "10000 1", None, None, "", "operator_manual|program_text", "", None, None, "unknown", 1, "OTHER", "", "Следует подготовить руководство", "", "", 1, "MISSING", None),
    ("unknown", "other", "other", "00000 0", None, None, "", "", "", None, None, "unknown", 0, "OTHER", "", "COVERED", "{n}", "", 1, "COVERED", "response_time = sec"),
    ("unknown", "other", "security", "00010 0", "system", None, "", "", "", None, None, "unknown", 0, "OTHER", "", "Система включает перечисленные", "", "", 1, "MISSING", None),
)
NAMES = ("modality", "req_type", "legacy_type", "flags", "subject", "verb", "object", "artifacts", "topics", "heading", "title", "kind", "markers", "head_type", "signals", "entities", "timeouts", "attempts", "n_items", "verdict", "con")


def _held_sql() -> str:
    shown = lambda v: "NULL::VARCHAR" if v is None else f"{v}::BIGINT" if isinstance(v, int) else f"'{v}'"
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(shown, r))})" for i, r in enumerate(HELD)) + f") AS h(i, {', '.join(NAMES)})"


@query(
    f"""SELECT p_partkey, {', '.join(c if c in ('markers', 'n_items') else f"replace({c}, '{{n}}', p_size::VARCHAR) AS {c}" for c in NAMES)}, CASE WHEN con IS NOT NULL THEN CASE h.i WHEN 8 THEN 1.0::DOUBLE WHEN 4 THEN CAST('4.' || p_size AS DOUBLE) ELSE p_size::DOUBLE END END AS con_value FROM part JOIN {_held_sql()} ON h.i = p_partkey % {len(SENTENCES)}"""
)
def sentence_features(spark, sf_dir):
    """EXT-1 to EXT-9, EXT-11, EXT-12, EXT-17, EXT-19, EXT-21, EXT-22, EXT-24, EXT-26 to EXT-30, EXT-32 to EXT-34, EXT-36, EXT-38, EXT-42, MSC-18: a sentence for each part."""
    def made(t: Column) -> Column:
        f = features(t)
        flags = F.concat_ws("", *[f[k].cast("int").cast("string") for k in ("fragment", "boilerplate", "self_contained", "list_intro", "step")], F.lit(" "), f["modal"].cast("int").cast("string"))
        con = X.let(f["con"], lambda c: F.struct(F.when(c.isNotNull(), F.concat_ws(" ", c["kind"], c["operator"], F.coalesce(c["unit"], F.lit("-")))).alias("con"), c["value"].alias("con_value")))
        return F.struct(*[f[k].alias(k) for k in NAMES if k not in ("flags", "con")], flags.alias("flags"), con.alias("shown"))

    plain = [F.col(f"f.{k}") for k in NAMES if k not in ("flags", "con")]
    return once_each(sentences(spark, sf_dir), {"f": ["text"]}, made).select("p_partkey", *plain, "f.flags", "f.shown.con", "f.shown.con_value")
