"""Derived labels: asset location, health band, maturity tier, gap severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gap severity keywords, checked case-insensitively in this
# order, first match wins; anything else is Medium.
GAP_SEVERITY_RULES = [
    ("steward", "Critical"),
    ("pii", "Critical"),
    ("sensitivity", "Critical"),
    ("quality", "High"),
    ("security", "High"),
    ("classification", "High"),
    ("domain", "Medium"),
    ("description", "Medium"),
    ("term", "Medium"),
]
GAP_SEVERITY_DEFAULT = "Medium"


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def asset_location(db="database_name", schema="schema_name", table="table_name") -> Column:
    """``database.schema.table``; NULL parts are skipped."""
    return F.concat_ws(".", _c(db), _c(schema), _c(table))


def health_band(score="table_governance_score") -> Column:
    """High >= 80, Medium >= 50, else Low (NULL score is Low)."""
    s = _c(score)
    return F.when(s >= 80, "High").when(s >= 50, "Medium").otherwise("Low")


def maturity_tier(pct="completeness_pct") -> Column:
    """Maturity tier of completeness: High >= 90, Medium >= 50, Low below (NULL stays NULL)."""
    p = _c(pct)
    return F.when(p >= 90, "High").when(p >= 50, "Medium").when(p.isNotNull(), "Low")


def gap_severity(reason="gap_reason", rules=GAP_SEVERITY_RULES,
                 default=GAP_SEVERITY_DEFAULT) -> Column:
    """Severity of a gap text by ordered keyword match."""
    r = F.lower(F.coalesce(_c(reason), F.lit("")))
    out = None
    for keyword, sev in rules:
        cond = r.contains(keyword)
        out = F.when(cond, sev) if out is None else out.when(cond, sev)
    return out.otherwise(default)
