"""Independent DuckDB SQL for every registered query (the correctness oracle).

The oracle rebuilds bronze -> silver -> gold in plain SQL over the driver's
parquet views, with its own formulations where engines differ: a window for
the keep-best dedup, explicit boolean parsing, truncation before BIGINT casts,
``||`` for NULL-propagating concatenation, ``NULLS FIRST`` spelled out, and
Spark's half-up rounding of a double's decimal text (``sround``).
"""

from __future__ import annotations

from types import SimpleNamespace

# Inputs, shared on purpose: the adapter that makes raw rows of lineitem, the region policy,
# the synthetic users and the query log's constants.
from govlens.sources.raw import LINEITEM_RAW_EXPRS
from govlens.sources.reference import LOG_VERSION, REGION_ASSIGNMENT, TS_BASE, USERS

# Fixed values, stated here once more so that the oracle does not follow the code it checks.
RAW_COLUMNS = [
    "column_id", "column_name", "column_desc", "term_name", "term_description", "security_classification",
    "critical_data_element_flag", "pii_flag", "term_subdomain", "data_steward", "table_id", "table_name",
    "table_desc", "table_owner_in_source", "schema_id", "schema_name", "database_id", "database_name",
    "system_id", "system_name", "location", "total_record_count", "invalid_record_count", "tag_name",
    "tag_value", "certification_level"]
NULL_TOKENS = ["", "nan", "NaN", "NAN", "null", "NULL", "None", "none", "NA", "N/A", "#N/A", "#N/A N/A", "#NA",
               "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "n/a"]
GAP_REASONS = [
    ("column_description_present", "Missing column description"),
    ("business_term_linked", "Missing business term"),
    ("security_classification_present", "Missing or invalid security classification"),
    ("data_steward_assigned", "Missing data steward"),
    ("domain_tag_present", "Missing domain tag"),
    ("sensitivity_flags_set", "PII or CDE flag is null"),
    ("certification_level_populated", "Missing or invalid certification level"),
    ("schema_assignment_valid", "Invalid schema assignment"),
    ("invalid_record_ratio_within_threshold", "Data quality failed: invalid record ratio exceeds 5%"),
]
GAP_SEVERITY_RULES = [("steward", "Critical"), ("pii", "Critical"), ("sensitivity", "Critical"), ("quality", "High"),
                      ("security", "High"), ("classification", "High"), ("domain", "Medium"),
                      ("description", "Medium"), ("term", "Medium")]
GAP_SEVERITY_DEFAULT = "Medium"
ST = SimpleNamespace(
    TOLERANCE=0.30, TOO_FEW="Outlier: too few columns", TOO_MANY="Outlier: too many columns", COMPLIANT="Compliant",
    ACTION_FEW=". Verify no columns were dropped during ingestion and that all source fields are catalogued.",
    ACTION_MANY=". Review for redundant, duplicated, or mis-assigned columns and consider normalizing.",
    ACTION_NONE="No action required; table is within the structural standard.")
A = SimpleNamespace(
    DEFAULT_POLICY={
        "asset_region": "UNRESTRICTED", "required_access_group": "ALL_EMPLOYEES", "allowed_region": "Any",
        "policy_rationale": "No explicit region policy for this database; defaulted to UNRESTRICTED. "
                            "Governance should add a rule."},
    REASON_OPEN="Asset is unrestricted; available to all employees.",
    REASON_MATCH="User's region and access group match the asset's data-residency policy.",
    REASON_DENY="Asset is restricted to its region; user's region or access group does not match.")
AL = SimpleNamespace(
    SQL_ALERTS=[("Data Quality Below 95%",), ("Metadata Completeness Below 90%",), ("Structural Consistency Below 85%",)],
    DEFAULT_OWNER="governance-team@example.com")

WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def exact_avg(expr: str) -> str:
    """Average of doubles from their exact sum: whole units of 2^-64 in 128-bit integers, rounded once."""
    units = f"sum(CAST(({expr}) * pow(2, 64) AS HUGEINT))"
    return (f"(CAST({units} // 1099511627776 AS DOUBLE) * 1099511627776 + CAST({units} % 1099511627776 AS DOUBLE)) "
            f"/ pow(2, 64) / count({expr})")


def sround(expr: str, d: int) -> str:
    """Spark's round(double, d): half-up on the shortest decimal text."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,12)), {d}) AS DOUBLE)"


def spct(num: str, den: str, d: int = 1) -> str:
    return sround(f"CASE WHEN ({den}) = 0 THEN NULL ELSE ({num}) / ({den}) END * 100", d)


def xavg(col: str, scale: int, digits: int) -> str:
    """Exact half-up round(avg(col), digits) for values with ``scale`` decimals."""
    S = f"sum(CAST(round(({col}) * {10 ** scale}) AS BIGINT)) * {10 ** (digits - scale)}"
    n = f"count({col})"
    return (f"CASE WHEN {n} > 0 THEN sign({S}) * ((2 * abs({S}) + {n}) // (2 * {n})) "
            f"/ {float(10 ** digits)} END")


def xavg_completeness(digits: int) -> str:
    S = f"sum(checks_passed) * {100 * 10 ** digits}"
    d = "(count(checks_passed) * 11)"
    return f"CASE WHEN {d} > 0 THEN ((2 * {S} + {d}) // (2 * {d})) / {float(10 ** digits)} END"


def to_bool(c: str) -> str:
    t = f"lower(trim({c}, {WS}))"
    return (f"CASE WHEN {t} IN ('t','true','y','yes','1') THEN TRUE "
            f"WHEN {t} IN ('f','false','n','no','0') THEN FALSE END")


def clean(c: str) -> str:
    toks = ", ".join(q(t) for t in NULL_TOKENS)
    t = f"trim({c}, {WS})"
    return f"CASE WHEN {t} IN ({toks}) THEN NULL ELSE {t} END"


def key(*parts: str) -> str:
    return "sha256(" + " || '||' || ".join(f"lower({p})" for p in parts) + ")"


CHECKS = [  # (column, SQL)
    ("check_column_id_present", "column_id IS NOT NULL"),
    ("check_column_name_present", "column_name IS NOT NULL"),
    ("check_schema_assignment_valid", "schema_name IN ('bronze','silver','gold')"),
    ("check_column_description_present", "column_desc IS NOT NULL"),
    ("check_business_term_linked", "term_name IS NOT NULL"),
    ("check_data_steward_assigned", "data_steward IS NOT NULL"),
    ("check_security_classification_present",
     "security_classification IN ('Internal','Public','Confidential')"),
    ("check_sensitivity_flags_set",
     "pii_flag IS NOT NULL AND critical_data_element_flag IS NOT NULL"),
    ("check_invalid_record_ratio_within_threshold",
     "CASE WHEN total_record_count > 0 THEN invalid_record_count / total_record_count < 0.05 END"),
    ("check_certification_level_populated",
     "certification_level IN ('Registered','Documented','Certified')"),
    ("check_domain_tag_present",
     "tag_name IS NOT NULL AND tag_value IS NOT NULL AND tag_name = 'domain'"),
]


def ok(col: str) -> str:
    return f"coalesce({col}, FALSE)"


def ck(name: str) -> str:
    return ok("check_" + name)


_gate = lambda idx: " AND ".join(ok(CHECKS[i][0]) for i in idx)

BRONZE_COLS = [c for c in RAW_COLUMNS]
RENAMED = {"column_id": "source_column_id", "table_id": "source_table_id",
           "schema_id": "source_schema_id", "database_id": "source_database_id"}
SILVER_COLS = ([RENAMED.get(c, c) for c in BRONZE_COLS]
               + ["database_id", "schema_id", "table_id", "column_id"]
               + [c for c, _ in CHECKS]
               + ["checks_passed", "checks_total", "completeness_pct", "dq_invalid_pct",
                  "achieved_cert_level"])


def _typed_select() -> str:
    out = []
    for c in BRONZE_COLS:
        if c in ("pii_flag", "critical_data_element_flag"):
            e = to_bool(c)
        elif c in ("total_record_count", "invalid_record_count"):
            e = f"TRY_CAST(trunc(TRY_CAST({c} AS DOUBLE)) AS BIGINT)"
        elif c == "security_classification":
            e = f"CASE WHEN {c} = 'Conf' THEN 'Confidential' ELSE {c} END"
        elif c == "certification_level":
            e = f"upper({c}[1]) || lower({c}[2:])"
        else:
            e = c
        out.append(f"{e} AS {RENAMED.get(c, c)}")
    out += [f"{key('system_name', 'database_name')} AS database_id",
            f"{key('system_name', 'database_name', 'schema_name')} AS schema_id",
            f"{key('system_name', 'database_name', 'schema_name', 'table_name')} AS table_id",
            f"{key('system_name', 'database_name', 'schema_name', 'table_name', 'column_name')} AS column_id"]
    return ",\n  ".join(out)


_raw = ",\n  ".join(f"CAST({e} AS VARCHAR) AS {c}" for c, e in LINEITEM_RAW_EXPRS.items())
_bronze = ",\n  ".join(f"{clean(c)} AS {c}" for c in BRONZE_COLS)
_compl = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in
                    ("column_desc", "term_name", "data_steward", "security_classification",
                     "pii_flag", "critical_data_element_flag", "tag_value"))
_checks = ",\n  ".join(f"({e}) AS {c}" for c, e in CHECKS)
_passed = " + ".join(f"coalesce(CAST({c} AS INTEGER), 0)" for c, _ in CHECKS)
_level = (f"CASE WHEN {_gate(range(11))} THEN 'Certified' WHEN {_gate(range(6))} THEN 'Documented' "
          f"WHEN {_gate(range(3))} THEN 'Registered' ELSE 'None' END")
_quality = "(100 - coalesce(dq_invalid_pct, 0.0))"
_classified = f"CASE WHEN {ck('security_classification_present')} THEN 100 ELSE 0 END"
_gap = ("concat_ws(', ', " + ", ".join(
    f"CASE WHEN NOT {ck(n)} THEN {q(t)} END" for n, t in GAP_REASONS) + ")")
_domain = "coalesce(tag_value, term_subdomain, 'Unassigned')"
_region_rows = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in REGION_ASSIGNMENT)
_user_rows = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in USERS)
_dp = A.DEFAULT_POLICY
_sev = ("CASE " + " ".join(f"WHEN contains(lower(coalesce(reason, '')), {q(k)}) THEN {q(s)}"
                           for k, s in GAP_SEVERITY_RULES) + f" ELSE {q(GAP_SEVERITY_DEFAULT)} END")


def _levels_sum(prefix: str = "") -> str:
    return ", ".join(
        f"CAST(sum(CASE WHEN achieved_cert_level = {q(lv)} THEN 1 ELSE 0 END) AS BIGINT) AS {lab}_columns"
        for lv, lab in (("Certified", "certified"), ("Documented", "documented"),
                        ("Registered", "registered"), ("None", "unclassified")))


def _structural(standard: str | None) -> str:
    std = standard if standard is not None else "(SELECT column_count FROM modal)"
    tol = ST.TOLERANCE
    head = "'Table ''' || table_name || ''' has ' || CAST(column_count AS VARCHAR) || ' columns vs the standard of ' || CAST(standard_column_count AS VARCHAR)"
    return f"""
  SELECT *, CASE WHEN column_count < lower_bound THEN {q(ST.TOO_FEW)}
                 WHEN column_count > upper_bound THEN {q(ST.TOO_MANY)} ELSE {q(ST.COMPLIANT)} END AS structural_status,
            NOT (column_count >= lower_bound AND column_count <= upper_bound) AS is_outlier,
            CASE WHEN column_count < lower_bound THEN {head} || {q(ST.ACTION_FEW)}
                 WHEN column_count > upper_bound THEN {head} || {q(ST.ACTION_MANY)}
                 ELSE {q(ST.ACTION_NONE)} END AS corrective_action
  FROM (SELECT *, {sround(f'standard_column_count * {1 - tol}', 0)} AS lower_bound,
                  {sround(f'standard_column_count * {1 + tol}', 0)} AS upper_bound
        FROM (SELECT *, {std} AS standard_column_count FROM per_table))"""


BASE = f"""
raw AS (SELECT
  {_raw}
FROM lineitem),
bronze AS (SELECT
  {_bronze}
FROM raw),
typed AS (SELECT
  {_typed_select()}
FROM bronze),
valid AS (SELECT *, {_compl} AS _compl FROM typed
          WHERE column_id IS NOT NULL AND column_name IS NOT NULL AND table_id IS NOT NULL),
dedup AS (SELECT * EXCLUDE (_rn, _compl) FROM (
  SELECT *, row_number() OVER (PARTITION BY column_id
                               ORDER BY _compl DESC, source_column_id ASC NULLS FIRST) AS _rn
  FROM valid) WHERE _rn = 1),
checked AS (SELECT *,
  {_checks}
FROM dedup),
silver AS (SELECT *,
  CASE WHEN total_record_count > 0 THEN invalid_record_count / total_record_count * 100 END AS dq_invalid_pct,
  {_level} AS achieved_cert_level
FROM (SELECT *, checks_passed / 11 * 100 AS completeness_pct
      FROM (SELECT *, ({_passed}) AS checks_passed, 11 AS checks_total FROM checked))),
scores AS (SELECT *,
  {sround('completeness_pct', 2)} AS documentation_score,
  {sround(_quality, 2)} AS quality_score,
  {_classified} AS classification_score,
  {sround(f'completeness_pct * 0.5 + {_quality} * 0.3 + {_classified} * 0.2', 2)} AS overall_governance_score
FROM silver),
table_governance AS (SELECT system_name, database_name, schema_name, table_id, table_name, table_desc, data_steward,
  count(DISTINCT column_id) AS column_count,
  {xavg('overall_governance_score', 2, 2)} AS table_governance_score,
  {xavg('documentation_score', 2, 2)} AS avg_documentation_score,
  {xavg('quality_score', 2, 2)} AS avg_quality_score,
  CAST(sum(CAST(pii_flag AS INTEGER)) AS BIGINT) AS pii_column_count,
  CAST(sum(CAST(critical_data_element_flag AS INTEGER)) AS BIGINT) AS critical_column_count
FROM scores GROUP BY ALL),
table_structure AS (SELECT database_id, database_name, system_name, location, schema_id, schema_name,
  table_id, table_name, table_desc, column_id, column_name, column_desc FROM silver),
profile AS (SELECT system_name, database_name, schema_name, table_name, column_id, column_name,
  pii_flag, critical_data_element_flag, security_classification, certification_level,
  achieved_cert_level, term_name, term_description, term_subdomain, data_steward, tag_value,
  total_record_count, invalid_record_count, dq_invalid_pct, completeness_pct FROM silver),
dlt_summary AS (SELECT count(*) AS silver_valid_rows,
  CAST(sum(CASE WHEN {ck('invalid_record_ratio_within_threshold')} THEN 1 ELSE 0 END) AS BIGINT) AS dq_pass_rows,
  CAST(sum(CASE WHEN NOT {ck('invalid_record_ratio_within_threshold')} THEN 1 ELSE 0 END) AS BIGINT) AS dq_failed_rows,
  CAST(sum(CASE WHEN {ck('sensitivity_flags_set')} THEN 1 ELSE 0 END) AS BIGINT) AS pii_consistent_rows,
  CAST(sum(CASE WHEN NOT {ck('sensitivity_flags_set')} THEN 1 ELSE 0 END) AS BIGINT) AS pii_inconsistent_rows
FROM silver),
kpi_base AS (SELECT count(*) AS total_columns, count(DISTINCT table_id) AS total_tables,
  count(DISTINCT schema_id) AS total_schemas, count(DISTINCT database_id) AS total_databases,
  {xavg_completeness(2)} AS avg_completeness_pct,
  {sround(exact_avg('dq_invalid_pct'), 2)} AS avg_dq_invalid_pct,
  CAST(sum(CAST(pii_flag AS INTEGER)) AS BIGINT) AS pii_columns,
  CAST(sum(CAST(critical_data_element_flag AS INTEGER)) AS BIGINT) AS critical_columns,
  {_levels_sum()}
FROM silver),
kpi_summary AS (SELECT *,
  {sround('CASE WHEN total_tables = 0 THEN NULL ELSE total_columns / total_tables END', 1)} AS avg_columns_per_table,
  {spct('certified_columns', 'total_columns')} AS certified_pct,
  {spct('documented_columns', 'total_columns')} AS documented_pct,
  {spct('registered_columns', 'total_columns')} AS registered_pct,
  {spct('unclassified_columns', 'total_columns')} AS unclassified_pct
FROM kpi_base),
cert_level_summary AS (SELECT *,
  {spct('certified_columns', 'column_count')} AS certified_pct,
  {spct('documented_columns', 'column_count')} AS documented_pct,
  {spct('registered_columns', 'column_count')} AS registered_pct,
  {spct('unclassified_columns', 'column_count')} AS unclassified_pct
FROM (SELECT system_name, database_name, schema_name, table_id, table_name, count(*) AS column_count, {_levels_sum()}
      FROM silver GROUP BY ALL)),
pii_classification_summary AS (SELECT *,
  {spct('column_count', '(SELECT count(*) FROM silver)')} AS pct_of_catalog,
  {spct('sensitivity_set_columns', 'column_count')} AS sensitivity_coverage_pct
FROM (SELECT coalesce(security_classification, 'Unclassified') AS classification, count(*) AS column_count,
  CAST(sum(CAST(pii_flag AS INTEGER)) AS BIGINT) AS pii_columns,
  CAST(sum(CAST(critical_data_element_flag AS INTEGER)) AS BIGINT) AS critical_columns,
  CAST(sum(CASE WHEN {ck('sensitivity_flags_set')} THEN 1 ELSE 0 END) AS BIGINT) AS sensitivity_set_columns
  FROM silver GROUP BY 1)),
domain_summary AS (SELECT *, {spct('certified_columns', 'column_count')} AS certified_pct
FROM (SELECT {_domain} AS domain, count(*) AS column_count, count(DISTINCT table_id) AS table_count,
  {xavg('overall_governance_score', 2, 2)} AS avg_governance_score, {_levels_sum()}
  FROM scores GROUP BY 1)),
per_table AS (SELECT system_name, database_id, schema_id, table_id, database_name, schema_name, table_name,
  count(DISTINCT column_id) AS column_count FROM silver GROUP BY ALL),
modal AS (SELECT column_count FROM per_table GROUP BY column_count
          ORDER BY count(*) DESC, column_count ASC LIMIT 1),
structural_consistency AS ({_structural(None)}),
structural_summary AS (SELECT *, {spct('compliant_tables', 'total_tables')} AS structural_consistency_pct
FROM (SELECT count(*) AS total_tables, max(standard_column_count) AS standard_column_count,
  {xavg('column_count', 0, 1)} AS avg_columns_per_table,
  CAST(sum(CASE WHEN NOT is_outlier THEN 1 ELSE 0 END) AS BIGINT) AS compliant_tables,
  CAST(sum(CASE WHEN is_outlier THEN 1 ELSE 0 END) AS BIGINT) AS outlier_tables
  FROM structural_consistency)),
gaps_all AS (SELECT *, {_gap} AS gap_reason FROM silver),
governance_gaps AS (SELECT database_name, schema_name, table_name, column_id, column_name, data_steward,
  security_classification, achieved_cert_level, completeness_pct, dq_invalid_pct, gap_reason
  FROM gaps_all WHERE gap_reason <> ''),
region_assignment AS (SELECT * FROM (VALUES {_region_rows})
  AS t(database_name, asset_region, required_access_group, allowed_region, policy_rationale)),
user_profile AS (SELECT * FROM (VALUES {_user_rows})
  AS t(user_email, user_country, user_region, employee_location, department, access_group)),
tables_distinct AS (SELECT table_id, database_name, schema_name, table_name FROM (
  SELECT table_id, database_name, schema_name, table_name, row_number() OVER (PARTITION BY table_id
    ORDER BY database_name, schema_name, table_name) AS rn FROM silver) WHERE rn = 1),
asset_access_policy AS (SELECT t.table_id, t.database_name, t.schema_name, t.table_name,
  coalesce(r.asset_region, {q(_dp['asset_region'])}) AS asset_region,
  coalesce(r.required_access_group, {q(_dp['required_access_group'])}) AS required_access_group,
  coalesce(r.allowed_region, {q(_dp['allowed_region'])}) AS allowed_region,
  coalesce(r.policy_rationale, {q(_dp['policy_rationale'])}) AS policy_rationale,
  r.asset_region IS NULL AS is_default_policy
  FROM tables_distinct t LEFT JOIN region_assignment r ON t.database_name = r.database_name),
asset_access_check AS (SELECT concat_ws('.', a.database_name, a.schema_name, a.table_name) AS asset_location,
  a.table_id, a.table_name, a.asset_region, u.user_email, u.user_region, u.department,
  a.required_access_group, u.access_group AS user_access_group, a.allowed_region, a.policy_rationale,
  a.is_default_policy,
  CASE WHEN a.asset_region = 'UNRESTRICTED' THEN 'Eligible'
       WHEN u.user_region = a.allowed_region AND u.access_group = a.required_access_group THEN 'Eligible'
       ELSE 'Not Eligible' END AS access_decision,
  CASE WHEN a.asset_region = 'UNRESTRICTED' THEN {q(A.REASON_OPEN)}
       WHEN u.user_region = a.allowed_region AND u.access_group = a.required_access_group THEN {q(A.REASON_MATCH)}
       ELSE {q(A.REASON_DENY)} END AS access_reason
  FROM asset_access_policy a, user_profile u),
query_log AS (SELECT c.conv_id * 1000 + c.turn AS id, c.text AS question, n.text AS answer,
  CASE (c.conv_id + c.turn) % 3 WHEN 0 THEN 'helpful' WHEN 1 THEN 'not_helpful' END AS feedback,
  {TS_BASE} + c.conv_id * 60 + c.turn AS ts,
  coalesce(strlen(n.text), 0) / 200.0 + 1.0 AS response_time_s, {q(LOG_VERSION)} AS version
  FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
  WHERE c.role = 'user')
"""

def with_base(select: str) -> str:
    return "WITH " + BASE.strip() + "\n" + select


def _sql_queries() -> dict[str, str]:
    s: dict[str, str] = {}
    s["raw_scan"] = "SELECT * FROM raw"
    s["null_tokens"] = "SELECT * FROM bronze"
    key = "CAST(split_part(column_id, '-', 1) AS BIGINT)"
    damaged = f"{key} % 3 = 2 AND {key} % 50 IN (7, 9)"
    s["csv_scan"] = f"SELECT * FROM bronze WHERE NOT ({damaged})"
    cells = ["coalesce('\"' || " + c + " || '\"', '')" for c in RAW_COLUMNS]
    s["csv_corrupt_rows"] = (
        f"SELECT CASE {key} % 50 WHEN 7 THEN {' || chr(44) || '.join(cells[:20])} "
        f"ELSE {' || chr(44) || '.join(cells)} || ',more' END AS _raw_text, 'corrupt_record' AS _failed_expectations "
        f"FROM raw WHERE {damaged}")
    s["approx_distinct_by_domain"] = (
        f"SELECT {_domain} AS domain, count(DISTINCT table_id) AS total_tables, count(DISTINCT schema_id) AS total_schemas, "
        "count(DISTINCT database_id) AS total_databases, TRUE AS within_bound FROM silver GROUP BY 1")
    s["csv_row_counts"] = f"SELECT count_if(NOT ({damaged})) AS good_rows, count_if({damaged}) AS corrupt_rows FROM raw"
    s["kpi_rollup"] = " UNION ALL ".join(
        f"SELECT {q(level)} AS level, "
        + ", ".join(f"{k + '_id' if n > i else 'CAST(NULL AS VARCHAR)'} AS {k}_id, "
                    f"{f'min({k}_name)' if n > i else 'CAST(NULL AS VARCHAR)'} AS {k}_name"
                    for i, k in enumerate(("database", "schema", "table")))
        + ", count(*) AS total_columns, count(DISTINCT table_id) AS total_tables, count(DISTINCT schema_id) AS total_schemas, "
          "count(DISTINCT database_id) AS total_databases, "
        + f"{xavg_completeness(2)} AS avg_completeness_pct, {sround(exact_avg('dq_invalid_pct'), 2)} AS avg_dq_invalid_pct, "
          "CAST(sum(CAST(pii_flag AS INTEGER)) AS BIGINT) AS pii_columns, "
          "CAST(sum(CAST(critical_data_element_flag AS INTEGER)) AS BIGINT) AS critical_columns, "
        + f"{_levels_sum()} FROM silver" + (" GROUP BY " + ", ".join(f"{k}_id" for k in ("database", "schema", "table")[:n]) if n else "")
        for n, level in enumerate(("estate", "database", "schema", "table")))
    s["typed_flags"] = ("SELECT source_column_id, pii_flag, critical_data_element_flag, "
                        "total_record_count, invalid_record_count FROM typed")
    s["standardized"] = "SELECT * FROM typed"
    s["surrogate_keys"] = ("SELECT source_column_id, database_id, schema_id, table_id, column_id "
                           "FROM typed")
    s["quarantine"] = ("SELECT *, concat_ws(', ', CASE WHEN column_id IS NULL THEN 'valid_column_id' END, "
                       "CASE WHEN column_name IS NULL THEN 'valid_column_name' END, "
                       "CASE WHEN table_id IS NULL THEN 'valid_table_id' END) AS _failed_expectations "
                       "FROM typed WHERE NOT (column_id IS NOT NULL AND column_name IS NOT NULL "
                       "AND table_id IS NOT NULL)")
    s["expectation_counts"] = " UNION ALL ".join(
        f"SELECT {q(n)} AS expectation, count_if({c} IS NOT NULL) AS passed_rows, "
        f"count_if({c} IS NULL) AS failed_rows FROM typed"
        for n, c in (("valid_column_id", "column_id"), ("valid_column_name", "column_name"),
                     ("valid_table_id", "table_id")))
    s["dedup_best"] = "SELECT * EXCLUDE (_compl) FROM (SELECT *, " + _compl + " AS _compl FROM typed) QUALIFY row_number() OVER (PARTITION BY column_id ORDER BY _compl DESC, source_column_id ASC NULLS FIRST) = 1"
    s["silver"] = "SELECT * FROM silver"
    s["asset_completeness"] = f"SELECT column_id, {_compl} AS completeness FROM silver"
    s["check_scores"] = ("SELECT column_id, checks_passed, checks_total, completeness_pct, dq_invalid_pct "
                         "FROM silver")
    s["achieved_cert_level"] = "SELECT column_id, achieved_cert_level FROM silver"
    for t in ("scores_pre", "table_governance", "table_structure", "profile", "dlt_summary",
              "kpi_summary", "cert_level_summary", "pii_classification_summary", "domain_summary",
              "structural_consistency", "structural_summary", "governance_gaps",
              "asset_access_policy", "asset_access_check"):
        s[t] = f"SELECT * FROM {'scores' if t == 'scores_pre' else t}"
    s["region_assignment"] = ("SELECT * FROM region_assignment WHERE database_name IN "
                              "(SELECT database_name FROM silver)")
    s["user_access_summary"] = ("SELECT user_email, user_region, user_access_group, "
                                "count_if(access_decision = 'Eligible') AS eligible_tables, "
                                "count_if(access_decision = 'Not Eligible') AS restricted_tables "
                                "FROM asset_access_check GROUP BY ALL")
    s["typed_counts"] = "SELECT source_column_id, total_record_count, invalid_record_count FROM typed"
    casts = []
    for c in BRONZE_COLS:
        if c in ("pii_flag", "critical_data_element_flag"):
            casts.append(f"{to_bool(f'trim({c}, {WS})')} AS {c}")
        elif c in ("total_record_count", "invalid_record_count"):
            casts.append(f"TRY_CAST(trunc(TRY_CAST({c} AS DOUBLE)) AS BIGINT) AS {c}")
        else:
            casts.append(f"nullif(trim({c}, {WS}), '') AS {c}")
    s["normalized_strings"] = "SELECT " + ", ".join(casts) + " FROM raw"
    s["silver_valid"] = "SELECT * FROM dedup"
    s["rubric_checks"] = "SELECT column_id, " + ", ".join(c for c, _ in CHECKS) + " FROM silver"
    rule_sql = {"not_null": "data_steward IS NOT NULL",
                "not_null_all": dict(CHECKS)["check_domain_tag_present"],
                "allowed_values": dict(CHECKS)["check_security_classification_present"],
                "ratio": dict(CHECKS)["check_invalid_record_ratio_within_threshold"]}
    for r, e in rule_sql.items():
        s[f"rule_{r}"] = f"SELECT column_id, ({e}) AS passed FROM dedup"
    s["modal_standard"] = "SELECT column_count AS standard_column_count FROM modal"
    s["structural_override"] = "SELECT * FROM (" + _structural("8") + ")"
    s.update(_more_sql())
    return s


def _gates_sql() -> str:
    from govlens.functions.rubric import production_rubric
    rub = production_rubric()
    by_id = rub.by_id()
    nxt, miss = [], []
    for lv in reversed(rub.levels_by_rank()):
        gate = " AND ".join(ok(by_id[c].column) for c in lv.gate_checks)
        ids = "concat_ws(', ', " + ", ".join(
            f"CASE WHEN NOT {ok(by_id[c].column)} THEN {q(c)} END" for c in lv.gate_checks) + ")"
        nxt.append(f"WHEN NOT ({gate}) THEN {q(lv.name)}")
        miss.append(f"WHEN NOT ({gate}) THEN {ids}")
    return (f"SELECT column_id, table_id, table_name, column_name, achieved_cert_level, "
            f"CASE {' '.join(nxt)} END AS next_level, "
            f"coalesce(CASE {' '.join(miss)} END, '') AS missing_checks FROM silver")


def _check_results_sql() -> str:
    from govlens.functions.rubric import production_rubric
    parts = []
    for c in production_rubric().checks:
        parts.append(
            f"SELECT column_id, table_id, table_name, column_name, {q(c.id)} AS check_id, "
            f"{q(c.name)} AS check_name, {q(c.category)} AS category, {q(c.severity)} AS severity, "
            f"CASE WHEN NOT {ok(c.column)} THEN {q(c.fail_message)} END AS fail_message, "
            f"{ok(c.column)} AS passed FROM silver")
    return " UNION ALL ".join(parts)


def _band(c: str = "table_governance_score") -> str:
    return f"CASE WHEN {c} >= 80 THEN 'High' WHEN {c} >= 50 THEN 'Medium' ELSE 'Low' END"


_TG_TIE = ("table_id ASC NULLS FIRST, system_name ASC NULLS FIRST, database_name ASC NULLS FIRST, "
           "schema_name ASC NULLS FIRST, table_name ASC NULLS FIRST, table_desc ASC NULLS FIRST, data_steward ASC NULLS FIRST")
_SEV_REASON = _sev
_SEV_GAP = _sev.replace("coalesce(reason, '')", "coalesce(gap_reason, '')")
_DOMAIN_REASONS = (f"SELECT {_domain} AS domain, data_steward, unnest(string_split(gap_reason, ', ')) AS reason "
                   f"FROM gaps_all WHERE gap_reason <> ''")
_CHECKLIST = [
    ("table_name_present", "table_name IS NOT NULL"),
    ("table_description_present", "table_desc IS NOT NULL"),
    ("column_description_present", ck("column_description_present")),
    ("data_steward_assigned", ck("data_steward_assigned")),
    ("business_term_linked", ck("business_term_linked")),
    ("security_classification_present", ck("security_classification_present")),
    ("pii_flag_set", "pii_flag IS NOT NULL"),
    ("certification_level_populated", ck("certification_level_populated")),
    ("domain_tag_present", ck("domain_tag_present")),
    ("data_quality_within_threshold", "coalesce(dq_invalid_pct <= 5, FALSE)"),
]
_RULE_VALUES = """(SELECT coalesce(dq_failed_rows, 0) AS f, coalesce(dq_pass_rows, 0) AS p,
  coalesce(pii_inconsistent_rows, 0) AS pii FROM dlt_summary) d,
 (SELECT coalesce(outlier_tables, 0) AS o FROM structural_summary) s,
 (SELECT coalesce(bool_or(contains(lower(gap_reason), 'security')), FALSE) AS sec FROM governance_gaps) g"""


def _more_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["check_results"] = _check_results_sql()
    s["gates_to_next_level"] = _gates_sql()
    s["gap_reasons"] = (f"SELECT *, {_SEV_REASON} AS severity FROM (SELECT column_id, table_name, column_name, "
                        f"data_steward, unnest(string_split(gap_reason, ', ')) AS reason FROM governance_gaps)")
    s["top_gaps_by_domain"] = (
        f"SELECT *, {_SEV_REASON} AS severity FROM (SELECT domain, reason, gap_count, "
        f"row_number() OVER (PARTITION BY domain ORDER BY gap_count DESC, reason ASC) AS rank "
        f"FROM (SELECT domain, reason, count(*) AS gap_count FROM ({_DOMAIN_REASONS}) GROUP BY 1, 2)) "
        f"WHERE rank <= 3")
    s["gaps_by_steward"] = (
        f"SELECT *, {_SEV_REASON} AS severity FROM (SELECT coalesce(data_steward, 'Unassigned') AS data_steward, "
        f"reason, count(*) AS gap_count FROM ({_DOMAIN_REASONS}) GROUP BY 1, 2)")
    items = ", ".join(f"bool_and({e}) AS {n}" for n, e in _CHECKLIST)
    failed = "concat_ws(', ', " + ", ".join(f"CASE WHEN NOT {n} THEN {q(n)} END" for n, _ in _CHECKLIST) + ")"
    nfail = " + ".join(f"CASE WHEN NOT {n} THEN 1 ELSE 0 END" for n, _ in _CHECKLIST)
    s["cert_checklist"] = (f"SELECT *, {nfail} AS failed_items, {failed} AS what_to_fix FROM ("
                           f"SELECT system_name, database_name, schema_name, table_id, table_name, {items} "
                           f"FROM silver GROUP BY ALL)")
    s["unclassified_pii"] = (f"SELECT system_name, database_name, schema_name, table_id, table_name, "
                             f"count(*) AS unclassified_pii_columns FROM silver WHERE pii_flag = TRUE AND NOT "
                             f"{ck('security_classification_present')} GROUP BY ALL")
    s["field_asset_location"] = ("SELECT column_id, concat_ws('.', database_name, schema_name, table_name) "
                                 "AS asset_location FROM table_structure")
    s["field_health_band"] = ("SELECT table_id, data_steward, table_desc, system_name, database_name, schema_name, "
                              f"table_governance_score, {_band()} AS health_band FROM table_governance")
    s["maturity_tier"] = ("SELECT column_id, completeness_pct, CASE WHEN completeness_pct >= 90 THEN 'High' "
                          "WHEN completeness_pct >= 50 THEN 'Medium' WHEN completeness_pct IS NOT NULL THEN 'Low' "
                          "END AS maturity_tier FROM silver")
    s["gap_severity"] = f"SELECT column_id, gap_reason, {_SEV_GAP} AS gap_severity FROM governance_gaps"
    filters = {
        "pii": ("profile", "pii_flag = TRUE"),
        "cde": ("profile", "critical_data_element_flag = TRUE"),
        "dq_fail": ("profile", "dq_invalid_pct > 5"),
        "uncertified": ("profile", "achieved_cert_level = 'None'"),
        "no_steward": ("profile", "data_steward IS NULL"),
        "outliers": ("structural_consistency", "is_outlier = TRUE"),
        "restricted": ("asset_access_policy", "asset_region <> 'UNRESTRICTED'"),
    }
    for n, (t, w) in filters.items():
        s[f"filter_{n}"] = f"SELECT * FROM {t} WHERE {w}"
    measures = {
        "governance_score": ("table_governance", "CAST(sum(CAST(round(table_governance_score * 100) AS BIGINT)) AS BIGINT) / count(table_governance_score) / 100"),
        "completeness": ("silver", "CAST(sum(checks_passed) AS BIGINT) * 100 / (count(checks_passed) * 11)"),
        "quality": ("profile", exact_avg("100 - dq_invalid_pct")),
        "gap_count": ("governance_gaps", "count(column_id)"),
        "registered": ("profile", "count(CASE WHEN achieved_cert_level = 'Registered' THEN 1 END)"),
        "documented": ("profile", "count(CASE WHEN achieved_cert_level = 'Documented' THEN 1 END)"),
        "certified": ("profile", "count(CASE WHEN achieved_cert_level = 'Certified' THEN 1 END)"),
        "unclassified": ("profile", "count(CASE WHEN achieved_cert_level = 'None' THEN 1 END)"),
        "pii": ("profile", "count(CASE WHEN pii_flag = TRUE THEN 1 END)"),
        "cde": ("profile", "count(CASE WHEN critical_data_element_flag = TRUE THEN 1 END)"),
        "avg_invalid": ("profile", exact_avg("dq_invalid_pct")),
        "tables": ("table_governance", "count(DISTINCT table_id)"),
        "schemas": ("table_structure", "count(DISTINCT schema_id)"),
        "databases": ("table_structure", "count(DISTINCT database_id)"),
        "structural_rate": ("structural_consistency",
                            "avg(CASE WHEN is_outlier = FALSE THEN 100 ELSE 0 END)"),
    }
    for n, (t, e) in measures.items():
        s[f"measure_{n}"] = f"SELECT {e} AS measure_{n} FROM {t}"
    keys = ["system_name", "database_name", "schema_name", "table_name", "data_steward", "table_id", "table_desc"]
    on = " AND ".join(f"p.{k} IS NOT DISTINCT FROM g.{k}" for k in keys)
    s["join_profile_governance"] = (
        f"SELECT p.*, g.column_count, g.table_governance_score, "
        f"g.avg_documentation_score, g.avg_quality_score, g.pii_column_count, g.critical_column_count "
        f"FROM (SELECT f.*, t.table_id, t.table_desc FROM profile f JOIN table_structure t USING (column_id)) p "
        f"LEFT JOIN table_governance g ON {on}")
    s["join_profile_governance_declared"] = (
        "SELECT p.*, g.table_id AS governance_table_id, g.table_governance_score, g.avg_documentation_score, "
        "g.avg_quality_score FROM profile p JOIN table_governance g ON p.table_name = g.table_name")
    s["measure_certified_by_domain"] = (
        "SELECT coalesce(tag_value, term_subdomain, 'Unassigned') AS domain, "
        "count(CASE WHEN achieved_cert_level = 'Certified' THEN 1 END) AS measure_certified FROM profile GROUP BY ALL")
    s["measure_completeness_by_steward"] = (
        "SELECT data_steward, CAST(sum(checks_passed) AS BIGINT) * 100 / (count(checks_passed) * 11) "
        "AS measure_completeness FROM silver GROUP BY ALL")
    s["join_profile_structure"] = (
        "SELECT * FROM profile JOIN (SELECT column_id, database_id, schema_id, table_id, location, "
        "table_desc, column_desc FROM table_structure) USING (column_id)")
    s["join_profile_gaps"] = ("SELECT * FROM profile LEFT JOIN (SELECT column_id, gap_reason FROM "
                              "governance_gaps) USING (column_id)")
    s["join_access_user"] = ("SELECT * FROM asset_access_check JOIN (SELECT user_email, user_country, "
                             "employee_location FROM user_profile) USING (user_email)")
    s["join_access_policy"] = ("SELECT * FROM asset_access_check JOIN (SELECT table_id, database_name, "
                               "schema_name FROM asset_access_policy) USING (table_id)")
    s["q_lowest_scores"] = (
        f"SELECT concat_ws('.', database_name, schema_name, table_name) AS asset_location, {_band()} AS health_band, "
        f"table_name, table_governance_score FROM table_governance "
        f"ORDER BY table_governance_score ASC NULLS FIRST, {_TG_TIE} LIMIT 10")
    s["q_highest_scores"] = (f"SELECT table_name, table_governance_score FROM table_governance "
                             f"ORDER BY table_governance_score DESC NULLS LAST, {_TG_TIE} LIMIT 10")
    s["q_gaps"] = "SELECT table_name, column_name, gap_reason FROM governance_gaps"
    s["q_pii"] = "SELECT table_name, column_name, security_classification FROM profile WHERE pii_flag = TRUE"
    s["q_cde"] = "SELECT table_name, column_name FROM profile WHERE critical_data_element_flag = TRUE"
    s["q_levels"] = ("SELECT achieved_cert_level, count(*) AS asset_count FROM profile "
                     "GROUP BY achieved_cert_level ORDER BY asset_count DESC")
    s["q_stewards"] = ("SELECT data_steward, count(*) AS asset_count FROM profile WHERE data_steward IS NOT NULL "
                       "GROUP BY data_steward ORDER BY asset_count DESC")
    s["q_dq_issues"] = ("SELECT table_name, column_name, dq_invalid_pct FROM profile WHERE dq_invalid_pct > 5 "
                        "ORDER BY dq_invalid_pct DESC")
    s["q_completeness_by_table"] = (f"SELECT table_name, {xavg_completeness(2)} AS avg_completeness_pct "
                                    f"FROM silver GROUP BY table_name ORDER BY avg_completeness_pct DESC")
    s["q_kpis"] = "SELECT * FROM kpi_summary"
    s["q_validation"] = "SELECT * FROM dlt_summary"
    s["q_owners"] = "SELECT table_name, data_steward FROM profile WHERE data_steward IS NOT NULL"
    s["q_access"] = ("SELECT asset_location, access_decision, access_reason, asset_region, policy_rationale "
                     "FROM asset_access_check WHERE table_name = 'tbl_1' AND user_email = 'u1@example.com' "
                     "ORDER BY asset_location, table_id LIMIT 1")
    s["q_restricted"] = ("SELECT table_name, asset_region, allowed_region, required_access_group, policy_rationale "
                         "FROM asset_access_policy WHERE asset_region <> 'UNRESTRICTED' ORDER BY asset_region, table_name")
    s["q_cert_by_table"] = ("SELECT table_name, column_count, certified_columns, documented_columns, "
                            "registered_columns, unclassified_columns, certified_pct FROM cert_level_summary "
                            "ORDER BY certified_pct DESC")
    s["q_domains"] = ("SELECT domain, table_count, column_count, avg_governance_score, certified_pct "
                      "FROM domain_summary ORDER BY avg_governance_score DESC")
    s["q_classification"] = ("SELECT classification, column_count, pii_columns, critical_columns, pct_of_catalog, "
                             "sensitivity_coverage_pct FROM pii_classification_summary ORDER BY column_count DESC")
    s["q_structural_issues"] = ("SELECT table_name, column_count, standard_column_count, structural_status, "
                                "corrective_action FROM structural_consistency WHERE is_outlier = TRUE ORDER BY table_name")
    s["q_structural_rate"] = ("SELECT total_tables, compliant_tables, outlier_tables, structural_consistency_pct, "
                              "standard_column_count FROM structural_summary")
    s["q_why_restricted"] = ("SELECT DISTINCT database_name, asset_region, required_access_group, allowed_region, "
                             "policy_rationale FROM asset_access_policy WHERE database_name = 'crm'")
    s["q_glossary"] = ("SELECT term_name, term_description, term_subdomain, count(*) AS linked_columns, "
                       "count(DISTINCT (system_name, database_name, schema_name, table_name)) AS linked_tables "
                       "FROM profile WHERE term_name IS NOT NULL GROUP BY ALL")
    s["q_table_health"] = (
        f"SELECT tg.system_name, tg.database_name, tg.schema_name, tg.table_id, tg.table_name, tg.data_steward, "
        f"tg.table_governance_score, {_band('tg.table_governance_score')} AS health_band, "
        f"coalesce(gt.gap_columns, 0) AS gap_columns FROM table_governance tg LEFT JOIN "
        f"(SELECT table_id, count(*) AS gap_columns FROM governance_gaps JOIN table_structure USING (column_id) "
        f"GROUP BY table_id) gt ON tg.table_id = gt.table_id")
    s["q_tables_missing_steward"] = (
        "SELECT system_name, database_name, schema_name, table_name, count(*) AS columns_without_steward "
        "FROM profile WHERE data_steward IS NULL GROUP BY ALL")
    s["q_table_certification"] = (
        "SELECT system_name, database_name, schema_name, table_name, column_count, certified_columns, "
        "documented_columns, registered_columns, unclassified_columns, certified_pct "
        "FROM cert_level_summary WHERE table_name = 'tbl_1'")
    s["catalog_search"] = (
        "SELECT database_name, schema_name, table_name, column_name FROM table_structure WHERE "
        "contains(lower(database_name), 'col_1') OR contains(lower(schema_name), 'col_1') OR "
        "contains(lower(table_name), 'col_1') OR contains(lower(column_name), 'col_1')")
    s["catalog_search_indexed"] = s["catalog_search"]
    s["app_top_tables"] = (
        f"SELECT system_name, database_name, schema_name, table_name, table_desc, data_steward, column_count, "
        f"{sround('table_governance_score', 1)} AS governance_score, "
        f"{sround('avg_documentation_score', 1)} AS documentation_score, "
        f"{sround('avg_quality_score', 1)} AS quality_score, pii_column_count, critical_column_count "
        f"FROM table_governance ORDER BY table_governance_score DESC NULLS LAST, {_TG_TIE} LIMIT 200")
    s["app_worst_gaps"] = (
        f"SELECT database_name, schema_name, table_name, column_name, data_steward, security_classification, "
        f"achieved_cert_level, {sround('completeness_pct', 1)} AS completeness_pct, "
        f"{sround('dq_invalid_pct', 2)} AS dq_invalid_pct, gap_reason, {_SEV_GAP} AS gap_severity "
        f"FROM governance_gaps ORDER BY completeness_pct ASC NULLS FIRST, column_id ASC LIMIT 300")
    s["app_domains"] = (
        f"SELECT domain, column_count, table_count, {sround('avg_governance_score', 1)} AS avg_governance_score, "
        f"certified_columns, documented_columns, certified_pct FROM domain_summary "
        f"WHERE domain NOT IN ('Unassigned', 'nan') ORDER BY avg_governance_score DESC")
    cards = ["total_databases", "total_schemas", "total_tables", "total_columns", "certified_columns",
             "documented_columns", "registered_columns", "unclassified_columns", "pii_columns",
             "critical_columns"]
    s["kpi_cards"] = ("SELECT " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in cards)
                      + f", coalesce({sround('avg_completeness_pct', 1)}, 0.0) AS avg_completeness_pct"
                      + f", coalesce({sround('100 - avg_dq_invalid_pct', 1)}, 0.0) AS dq_pass_pct"
                      + f", coalesce({sround('avg_dq_invalid_pct', 2)}, 0.0) AS avg_dq_invalid_pct"
                      + " FROM kpi_summary LIMIT 1")
    s["dq_ratio"] = (
        f"SELECT p AS dq_pass_rows, f AS dq_failed_rows, CASE WHEN p + f > 0 THEN {sround('f * 100.0 / (p + f)', 2)} "
        f"ELSE 0.0 END AS dq_invalid_ratio_pct FROM (SELECT coalesce(dq_pass_rows, 0) AS p, "
        f"coalesce(dq_failed_rows, 0) AS f FROM dlt_summary)")
    s["cert_distribution"] = " UNION ALL ".join(
        f"SELECT {q(lv)} AS level, coalesce({c}, 0) / greatest(coalesce(total_columns, 0), 1) * 100 AS pct FROM kpi_summary"
        for lv, c in (("Certified", "certified_columns"), ("Documented", "documented_columns"),
                      ("Registered", "registered_columns"), ("Unclassified", "unclassified_columns")))
    own = q(AL.DEFAULT_OWNER)
    sql_alerts = (
        f"SELECT {q(AL.SQL_ALERTS[0][0])} AS name, CASE WHEN {sround('100 - avg_dq_invalid_pct', 1)} < 95 "
        f"THEN 'triggered' ELSE 'ok' END AS status, {own} AS owner FROM kpi_summary UNION ALL "
        f"SELECT {q(AL.SQL_ALERTS[1][0])}, CASE WHEN avg_completeness_pct < 90 THEN 'triggered' ELSE 'ok' END, "
        f"{own} FROM kpi_summary UNION ALL "
        f"SELECT {q(AL.SQL_ALERTS[2][0])}, CASE WHEN structural_consistency_pct < 85 THEN 'triggered' ELSE 'ok' END, "
        f"{own} FROM structural_summary")
    s["sql_alerts"] = sql_alerts
    s["alert_counts"] = (f"SELECT count_if(lower(status) = 'triggered') AS triggered_alerts, count(*) AS total_alerts "
                         f"FROM ({sql_alerts})")
    rules = (
        f"SELECT 'dq_ratio_exceeded' AS rule_id, 'DQ invalid ratio exceeded' AS name, 'Critical' AS severity, "
        f"f * 100.0 / greatest(p + f, 1) > 5.0 AS triggered, "
        f"'DQ invalid ratio exceeded 5% threshold. Failed rows: ' || CAST(f AS VARCHAR) || '.' AS message FROM {_RULE_VALUES} "
        f"UNION ALL SELECT 'quarantine_spike', 'Quarantine spike', 'High', f > 50, "
        f"CAST(f AS VARCHAR) || ' rows quarantined — exceeds limit of 50.' FROM {_RULE_VALUES} "
        f"UNION ALL SELECT 'pii_inconsistent', 'PII flags inconsistent', 'High', pii > 0, "
        f"CAST(pii AS VARCHAR) || ' PII columns with inconsistent flags (CHK-08).' FROM {_RULE_VALUES} "
        f"UNION ALL SELECT 'structural_outliers', 'Structural outliers detected', 'High', o > 0, "
        f"CAST(o AS VARCHAR) || ' table(s) deviate from structural standard.' FROM {_RULE_VALUES} "
        f"UNION ALL SELECT 'pii_without_classification', 'PII without classification', 'High', sec, "
        f"'PII-flagged columns have no security_classification (CHK-07 fail).' FROM {_RULE_VALUES}")
    s["rule_alerts"] = rules
    s["alerts_new"] = (f"SELECT rule_id, name, severity, message FROM ({rules}) "
                       f"WHERE triggered AND rule_id <> 'pii_inconsistent'")
    fmt = "format('{:,}', p + f)"
    steps = [
        ("Bronze ingestion", "'ok'", f"{fmt} || ' rows ingested from lineitem'"),
        ("Silver validation", "CASE WHEN f > 0 THEN 'warn' ELSE 'ok' END",
         f"CASE WHEN f > 0 THEN CAST(f AS VARCHAR) || ' rows exceed DQ threshold · routed to quarantine' "
         f"ELSE 'All ' || {fmt} || ' rows pass DQ threshold' END"),
        ("Gold scoring", "'ok'", "'11 rubric checks applied · Gold tables written'"),
        ("KPI + gap tables", "'ok'", "'kpi_summary · governance_gaps · dlt_summary refreshed'"),
        ("Structural consistency", "CASE WHEN o > 0 THEN 'warn' ELSE 'ok' END",
         "CASE WHEN o > 0 THEN CAST(o AS VARCHAR) || ' structural outlier(s) detected' "
         "ELSE 'All tables match structural standard' END"),
        ("Sensitivity check", "CASE WHEN pii > 0 THEN 'warn' ELSE 'ok' END",
         "CASE WHEN pii > 0 THEN CAST(pii AS VARCHAR) || ' PII columns with inconsistent flags' "
         "ELSE 'All PII flags consistent' END"),
    ]
    s["pipeline_status"] = " UNION ALL ".join(
        f"SELECT {i + 1} AS step, {q(n)} AS name, {st} AS status, {d} AS detail FROM {_RULE_VALUES}"
        for i, (n, st, d) in enumerate(steps))
    s["pipeline_totals"] = (f"SELECT f AS quarantine_rows, p + f AS total_rows, "
                            f"(CASE WHEN f > 0 THEN 1 ELSE 0 END) + (CASE WHEN pii > 0 THEN 1 ELSE 0 END) + "
                            f"(CASE WHEN o > 0 THEN 1 ELSE 0 END) AS alerts_fired FROM {_RULE_VALUES}")
    s["feedback_stats"] = (
        "SELECT total, helpful, not_helpful, total - helpful - not_helpful AS pending, "
        "CAST(round_even(CAST(CAST(rt / greatest(total, 1) AS VARCHAR) AS DECIMAL(38,12)), 1) AS DOUBLE) AS avg_response_time_s, "
        "CAST(round_even(CAST(CAST(helpful / greatest(total, 1) * 100 AS VARCHAR) AS DECIMAL(38,12)), 0) AS BIGINT) AS helpful_pct, "
        "CAST(round_even(CAST(CAST(not_helpful / greatest(total, 1) * 100 AS VARCHAR) AS DECIMAL(38,12)), 0) AS BIGINT) AS not_helpful_pct "
        "FROM (SELECT count(*) AS total, count_if(feedback = 'helpful') AS helpful, "
        "count_if(feedback = 'not_helpful') AS not_helpful, coalesce(sum(response_time_s), 0.0) AS rt FROM query_log)")
    clicks = (
        f"SELECT o.conv_id * 1000 + u.turn AS id, CASE WHEN (o.conv_id + o.turn) % 2 = 0 THEN 'helpful' "
        f"ELSE 'not_helpful' END AS feedback, {TS_BASE} + o.conv_id * 60 + o.turn AS click_ts "
        f"FROM conversations o JOIN conversations u ON o.conv_id = u.conv_id "
        f"AND o.turn - u.turn IN (1, 2) WHERE o.role <> 'user' AND u.role = 'user'")
    s["feedback_latest"] = (
        f"SELECT l.id, l.question, l.answer, coalesce(c.feedback, l.feedback) AS feedback, l.ts, "
        f"l.response_time_s, l.version FROM query_log l LEFT JOIN (SELECT id, feedback FROM ({clicks}) "
        f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY click_ts DESC, feedback DESC) = 1) c ON l.id = c.id")
    return s


SQL = _sql_queries()


def oracle_sql() -> dict[str, str]:
    """Full SQL text (shared CTE chain + final SELECT) per query key."""
    return {k: with_base(v) for k, v in SQL.items()}
