"""Region-based access: per-table policy and per-user access decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.functions.labels import asset_location

# Defaults for databases without a policy, and decision texts.
DEFAULT_POLICY = {
    "asset_region": "UNRESTRICTED",
    "required_access_group": "ALL_EMPLOYEES",
    "allowed_region": "Any",
    "policy_rationale": ("No explicit region policy for this database; defaulted to "
                         "UNRESTRICTED. Governance should add a rule."),
}
ELIGIBLE, NOT_ELIGIBLE = "Eligible", "Not Eligible"
REASON_OPEN = "Asset is unrestricted; available to all employees."
REASON_MATCH = "User's region and access group match the asset's data-residency policy."
REASON_DENY = "Asset is restricted to its region; user's region or access group does not match."

POLICY_COLUMNS = ["table_id", "database_name", "schema_name", "table_name", "asset_region",
                  "required_access_group", "allowed_region", "policy_rationale",
                  "is_default_policy"]
CHECK_COLUMNS = ["asset_location", "table_id", "table_name", "asset_region", "user_email",
                 "user_region", "department", "required_access_group", "user_access_group",
                 "allowed_region", "policy_rationale", "is_default_policy", "access_decision",
                 "access_reason"]


def distinct_tables(silver: DataFrame) -> DataFrame:
    """One row per table_id with a deterministic display path (smallest)."""
    best = F.min(F.struct("database_name", "schema_name", "table_name")).alias("t")
    return silver.groupBy("table_id").agg(best).select(
        "table_id", "t.database_name", "t.schema_name", "t.table_name")


def _with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULT_POLICY.items()
                           if c in df.columns})


def asset_access_policy(silver: DataFrame, regions: DataFrame,
                        case_insensitive: bool = False) -> DataFrame:
    """Each table inherits its database's region rule; no rule -> UNRESTRICTED,
    flagged ``is_default_policy``. The match is case-sensitive by default, as in
    the source (so 'Finance_DW' misses the 'finance_dw' rule); pass
    ``case_insensitive=True`` to match on lower-cased names."""
    tables = distinct_tables(silver)
    rules = regions.select(*[F.col(c).alias(f"r_{c}") for c in regions.columns])
    if case_insensitive:
        cond = F.lower(tables["database_name"]) == F.lower(rules["r_database_name"])
    else:
        cond = tables["database_name"] == rules["r_database_name"]
    joined = tables.join(rules, cond, "left")
    out = joined.select(
        "table_id", "database_name", "schema_name", "table_name",
        *[F.col(f"r_{c}").alias(c) for c in DEFAULT_POLICY],
    ).withColumn("is_default_policy", F.col("asset_region").isNull())
    return _with_defaults(out).select(*POLICY_COLUMNS)


CELL_TABLES, CELL_USERS = 1024, 256  # rows of either side that meet under one join key


def _parts(rows: DataFrame, per_part: int) -> Column:
    """How many parts of ``per_part`` rows there are: counted by the query itself."""
    return rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_part)).cast("long")).scalar()


def access_pairs(policy: DataFrame, users: DataFrame, user_columns=(), policy_columns=(),
                 table_parts: int | None = None, user_parts: int | None = None) -> DataFrame:
    """Access decision for every (table, user) pair, with extra columns of either side.

    The output is tables x users by definition; it is stored nowhere by default (see
    ``pipeline.STORED_TABLES``) and meant to be filtered: filters on tables or users
    reach their side before the pairs are made. Pairs are made as an equi-join over a
    grid: each table copies into the parts of the users and each user into the parts of
    the tables, so every grid cell is one join key of even size, whatever the policy
    classes' sizes are. The grid grows with both sides: ``table_parts`` x ``user_parts`` cells, by
    default one part for each ``CELL_TABLES`` tables and ``CELL_USERS`` users.
    """
    t = F.lit(table_parts).cast("long") if table_parts else _parts(policy, CELL_TABLES)
    u = F.lit(user_parts).cast("long") if user_parts else _parts(users, CELL_USERS)
    zero = F.lit(0).cast("long")
    tables = policy.select(*dict.fromkeys([*POLICY_COLUMNS, *policy_columns])).withColumns({
        "__t": F.pmod(F.xxhash64("table_id"), t), "__u": F.explode(F.sequence(zero, u - 1))})
    people = users.select("user_email", "user_region", "department",
                          F.col("access_group").alias("user_access_group"), *user_columns).withColumns({
        "__u": F.pmod(F.xxhash64("user_email"), u), "__t": F.explode(F.sequence(zero, t - 1))})
    open_ = F.col("asset_region") == "UNRESTRICTED"
    match = ((F.col("user_region") == F.col("allowed_region"))
             & (F.col("user_access_group") == F.col("required_access_group")))
    return tables.join(people, ["__t", "__u"]).withColumns({
        "access_decision": F.when(open_ | match, ELIGIBLE).otherwise(NOT_ELIGIBLE),
        "access_reason": F.when(open_, REASON_OPEN).when(match, REASON_MATCH).otherwise(REASON_DENY),
        "asset_location": asset_location(),
    }).drop("__t", "__u")


def asset_access_check(policy: DataFrame, users: DataFrame) -> DataFrame:
    """Access decision for every (table, user) pair, as the gold table defines."""
    return access_pairs(policy, users).select(*CHECK_COLUMNS)


def access_for(policy: DataFrame, users: DataFrame, table_name: str | None = None,
               user_email: str | None = None) -> DataFrame:
    """Decisions for one table name and/or one user, filtered before the join; a side that is
    filtered is one part of the grid."""
    if table_name is not None:
        policy = policy.filter(F.col("table_name") == table_name)
    if user_email is not None:
        users = users.filter(F.col("user_email") == user_email)
    return access_pairs(policy, users, table_parts=1 if table_name is not None else None,
                        user_parts=1 if user_email is not None else None).select(*CHECK_COLUMNS)


def region_rules_in_use(silver: DataFrame, regions: DataFrame) -> DataFrame:
    """Region rules whose database occurs in the catalog (a semi join against the
    distinct database names, which a partial aggregation keeps small)."""
    dbs = silver.select("database_name").distinct()
    return regions.join(dbs, "database_name", "left_semi")


def user_access_summary(policy: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: how many tables they may and may not access.

    Tables are counted per policy class first (a handful of rows, combined before the
    shuffle); the counts reach the users as one scalar map, so users are neither
    shuffled nor paired with tables.
    """
    open_ = F.coalesce(F.col("asset_region") == "UNRESTRICTED", F.lit(False))
    classes = policy.select(F.when(open_, F.lit("open")).otherwise(
        _class_key("allowed_region", "required_access_group")).alias("class")).groupBy("class").agg(
        F.count("*").alias("n"))
    counts = classes.agg(F.map_from_entries(F.collect_list(F.struct("class", "n")))).scalar()
    total = policy.agg(F.count("*")).scalar()
    own = F.coalesce(F.try_element_at(counts, F.lit("open")), F.lit(0)) + F.coalesce(
        F.try_element_at(counts, _class_key("user_region", "user_access_group")), F.lit(0))
    out = users.select("user_email", "user_region", F.col("access_group").alias("user_access_group"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("__n")).select(
        *out.columns, (own * F.col("__n")).alias("eligible_tables"),
        ((total - own) * F.col("__n")).alias("restricted_tables"))


def _class_key(region: str, group: str):
    """A policy class as text; null parts match nothing, so they make a key that no user has."""
    return F.concat(F.lit("class:"), F.coalesce(F.to_json(F.array(region, group)), F.lit("none")))
