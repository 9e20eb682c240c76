"""Which requirement types count in which documents, and how much: applicability, level, criticality and severity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqlens import lexicon as L


def applicability(req_type: Column, role: Column) -> Column:
    """A1."""
    out = F.when(req_type.isin(*L.OUT_OF_SCOPE_TYPES), "OUT_OF_SCOPE")
    for t, r in L.ROLE_BOUND_TYPES.items():
        out = out.when((req_type == t) & (role != r), "NOT_APPLICABLE")
    return out.otherwise("APPLICABLE")


def level(req_type: Column, role: Column) -> Column:
    """A2."""
    return (
        F.when(applicability(req_type, role) != "APPLICABLE", "NOT_APPLICABLE")
        .when((role == "pz") & req_type.isin(*L.PZ_OPTIONAL_TYPES), "OPTIONAL")
        .when(req_type.isin(*L.REQUIRED_TYPES), "REQUIRED")
        .otherwise("OPTIONAL")
    )


def critical(req_type: Column, role: Column, status: Column) -> Column:
    """A3."""
    return (
        F.when(applicability(req_type, role) != "APPLICABLE", False)
        .when(status == "CONFLICT", True)
        .when(status == "COVERED", False)
        .when((role == "pz") & req_type.isin(*L.PZ_OPTIONAL_TYPES), False)
        .otherwise((status == "MISSING") & req_type.isin(*L.CRITICAL_WHEN_MISSING))
    )


def severity(req_type: Column, role: Column, status: Column, subcode: Column) -> Column:
    """A4."""
    base = (
        F.when(req_type == "security", "high")
        .when(req_type.isin("performance", "functional", "reliability"), F.when(role == "pmi", "high").otherwise("medium"))
        .when(req_type == "architecture", F.when(role == "pz", "high").otherwise("low"))
        .when(req_type.isin("data_io", "documentation", "interface"), "medium")
        .otherwise("low")
    )
    softer = F.when(base == "high", "medium").otherwise("low")
    return (
        F.when((applicability(req_type, role) != "APPLICABLE") | status.isin("COVERED", "UNKNOWN"), "low")
        .when(status == "CONFLICT", F.when(subcode == "CONFLICT_UNVERIFIED", "medium").otherwise("high"))
        .otherwise(F.when(F.coalesce(subcode, F.lit("")).isin(*L.SOFT_SUBCODES), softer).otherwise(base))
    )
