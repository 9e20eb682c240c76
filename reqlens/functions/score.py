"""Pairwise scores, as Column expressions over token arrays and constraint arrays made once for each side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqlens import lexicon as L
from reqlens.functions import text as X


def jaccard(a: Column, b: Column) -> Column:
    """SCO-1: 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """SCO-17: share of a's tokens that b has."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def bow_cosine(a: Column, b: Column) -> Column:
    """SCO-2: cosine of token counts; a and b are arrays of (token, n)."""
    table = lambda x: F.map_from_arrays(x["token"], x["n"])
    dot = X.let(table(b), lambda theirs: F.aggregate(a, F.lit(0.0), lambda s, t: s + t["n"] * F.coalesce(F.try_element_at(theirs, t["token"]), F.lit(0))))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, t: s + t["n"] * t["n"]))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_cosine(a: Column, b: Column) -> Column:
    """SCO-3."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit("")))


def same_unit_class(a: Column, b: Column) -> Column:
    """Both in one class of units, or the very same unit (two without a unit agree)."""
    ca, cb = _lookup(L.UNIT_CLASS, a), _lookup(L.UNIT_CLASS, b)
    return F.when(ca.isNotNull() & cb.isNotNull(), ca == cb).otherwise(a.eqNullSafe(b))


def canonical(value: Column, unit: Column) -> Column:
    """SCO-5: seconds, bytes or requests a second; other units as they are."""
    return value * F.coalesce(_lookup(L.UNIT_FACTOR, unit), F.lit(1.0))


def values_agree(a: Column, b: Column) -> Column:
    x, y = canonical(a["value"], a["unit"]), canonical(b["value"], b["unit"])
    convertible = _lookup(L.UNIT_FACTOR, a["unit"]).isNotNull() & _lookup(L.UNIT_FACTOR, b["unit"]).isNotNull()
    return F.when(convertible, F.abs(x - y) <= F.greatest(F.greatest(F.abs(x), F.abs(y)) * 1e-3, F.lit(1e-6))).otherwise(F.abs(a["value"] - b["value"]) < 1e-6)


def constraint_overlap(req: Column, unit: Column) -> Column:
    """SCO-4: 1 for each pair that agrees, 0.5 for each that only shares the unit class; over the requirement's number, at most 1."""
    pair = lambda r, u: F.when(~same_unit_class(r["unit"], u["unit"]), 0.0).when(values_agree(r, u), 1.0).otherwise(0.5)
    total = F.aggregate(req, F.lit(0.0), lambda s, r: s + F.aggregate(unit, F.lit(0.0), lambda t, u: t + pair(r, u)))
    return F.when((F.size(req) > 0) & (F.size(unit) > 0), F.least(total / F.size(req), F.lit(1.0))).otherwise(F.lit(0.0))


def numeric_conflict(req: Column, unit: Column) -> Column:
    """A pair of constraints of one unit class, not both without a unit, of equal kind if both have one, whose values differ."""
    return F.exists(
        req,
        lambda r: F.exists(
            unit,
            lambda u: same_unit_class(r["unit"], u["unit"]) & ~(r["unit"].isNull() & u["unit"].isNull()) & (r["kind"].isNull() | u["kind"].isNull() | (r["kind"] == u["kind"])) & ~values_agree(r, u),
        ),
    )


def shared_kinds(req: Column, unit: Column) -> Column:
    """MSC-5: constraint kinds on both sides, but 'generic'."""
    kinds = lambda x: F.filter(x["kind"], lambda k: k != "generic")
    return F.array_sort(F.array_intersect(kinds(req), kinds(unit)))


def section_prior(role: Column, title: Column, req_type: Column) -> Column:
    """SCO-6."""
    hit = lambda p: X.text_of(title).rlike(L.flags(p))
    pmi = hit(L.PMI_TEST_SECTION) | req_type.isin(*L.PMI_PREFERRED)
    pz = hit(L.PZ_NARRATIVE_SECTION) | req_type.isin(*L.PZ_PREFERRED)
    return F.when((F.lower(role) == "pmi") & pmi, 1.0).when((F.lower(role) == "pz") & pz, 1.0).otherwise(0.0)


def topic_hits(title: Column, text: Column) -> Column:
    """Topic priors (SCO-7) of a unit for each requirement type: 1 by title, 0.55 by text, for (pmi, pz).

    A title hit is a hit in title and text at once, as the title is part of the text searched.
    """
    whole = F.concat_ws("\n", X.text_of(title), X.text_of(text))

    def table(topics: dict) -> Column:
        return F.create_map(*[x for t, needles in topics.items() for x in (F.lit(t), F.when(X.contains_any(title, needles), 1.0).when(X.contains_any(whole, needles), 0.55).otherwise(0.0))])

    return F.struct(table(L.PMI_TOPICS).alias("pmi"), table(L.PZ_TOPICS).alias("pz"))


def topic_prior(role: Column, req_type: Column, hits: Column) -> Column:
    return F.coalesce(F.when(F.lower(role) == "pmi", F.try_element_at(hits["pmi"], req_type)).when(F.lower(role) == "pz", F.try_element_at(hits["pz"], req_type)), F.lit(0.0))


def noise_flags(title: Column, text: Column) -> Column:
    """The four kinds of texts that SCO-9 demotes, found once for each unit."""
    hit = lambda c, p: X.text_of(c).rlike(L.flags(p))
    return F.struct((hit(title, L.NOISE_SECTION) | hit(text, L.NOISE_TEXT)).alias("section"), hit(text, L.NOISE_FILES).alias("files"), hit(text, L.NOISE_ADMIN).alias("admin"), hit(text, L.NOISE_REPAIR).alias("repair"))


def noise_penalty(flags: Column, req_type: Column, req_aspects: Column, unit_aspects: Column) -> Column:
    """SCO-9: at most 0.75."""
    both = F.array_intersect(req_aspects, unit_aspects)
    files = F.when((req_type == "architecture") & F.arrays_overlap(both, X.strings(["typescript_angular", "github"])), 0.12).otherwise(0.30)
    admin = F.when(F.arrays_overlap(both, X.strings(["authorization", "authentication"])), 0.10).otherwise(0.20)
    on = lambda f, v: F.when(f, v).otherwise(0.0)
    return F.least(on(flags["section"], F.lit(0.35)) + on(flags["files"], files) + on(flags["admin"], admin) + on(flags["repair"], F.lit(0.25)), F.lit(0.75))


def share_of(req: Column, unit: Column) -> Column:
    """SCO-8: share of the requirement's aspects that the unit has."""
    return F.when((F.size(req) > 0) & (F.size(unit) > 0), F.size(F.array_intersect(req, unit)) / F.size(req)).otherwise(F.lit(0.0))


def entity_overlap(a: Column, b: Column) -> Column:
    """SCO-16, lower-case variant: Jaccard of lower-cased entities."""
    lower = lambda x: F.array_distinct(F.transform(x, F.lower))
    return jaccard(lower(a), lower(b))


def strength(score: Column) -> Column:
    """SCO-12."""
    out = F.lit("NO_EVIDENCE")
    for name, least in reversed(L.STRENGTH_BINS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score_reason(lex: Column, sem: Column, con: Column, sec: Column, total: Column, exact: Column) -> Column:
    """SCO-13: which components come within 70 % of the largest."""
    parts = [("lexical", lex), ("semantic", sem), ("constraint", con), ("section", sec), ("exact-aspect", exact)]
    most = F.greatest(*[c for _, c in parts])
    leaders = F.filter(F.array(*[F.when((c >= 0.7 * most) & (c > 0), F.lit(n)) for n, c in parts]), lambda x: x.isNotNull())
    head = F.when(F.size(leaders) == 1, F.concat(leaders[0], F.lit(" dominant"))).otherwise(F.concat(F.array_join(leaders, "+"), F.lit(" co-leading")))
    tail = F.format_string("lex=%.2f sem=%.2f con=%.2f sec=%.2f ⇒ %.2f", lex, sem, con, sec, total)
    return F.when(most <= 0, F.format_string("all signals near zero (score=%.2f)", total)).otherwise(F.concat_ws(" | ", head, tail))


def text_match(a: Column, b: Column) -> Column:
    """SCO-22: 'exact', 'contained' or null, on normalised texts without punctuation; containment needs five words."""
    inside = lambda x, y: (F.size(F.split(x, " ")) >= 5) & F.contains(F.concat(F.lit(" "), y, F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")))
    return F.when(a == b, "exact").when(inside(a, b) | inside(b, a), "contained")


def sigmoid_label(score: Column, covered: float = 0.8, partial: float = 0.3) -> Column:
    """SCO-24."""
    p = 1 / (1 + F.exp(-score))
    return F.when(p >= covered, "COVERED").when(p >= partial, "PARTIAL").otherwise("IRRELEVANT")
