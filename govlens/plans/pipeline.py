"""Medallion pipeline: bronze -> silver -> the sixteen gold tables.

``gold_tables`` only declares plans; nothing runs until a table is written or
read. ``run_pipeline`` writes silver once to the shared output folder and reads
it back, so every gold table starts from files (a lost executor recomputes
from silver, not from the raw scan), then writes each gold table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession

from govlens.functions.rubric import Rubric, rubric_from_conf
from govlens.operators import access, gaps, rollups, scoring, structure
from govlens.operators.silver import build_silver, expectation_report, quarantine
from govlens.sources import reference
from govlens.sources.raw import bronze_from_lineitem

GOLD_TABLES = [
    "scores_pre", "table_governance", "table_structure", "profile", "dlt_summary",
    "kpi_summary", "cert_level_summary", "pii_classification_summary", "domain_summary",
    "structural_consistency", "structural_summary", "governance_gaps", "region_assignment",
    "user_profile", "asset_access_policy", "asset_access_check",
]


# Written by default: all but the table of all (table, user) pairs, which is expanded on demand.
STORED_TABLES = [t for t in GOLD_TABLES if t != "asset_access_check"]


# What each catalog table holds; set as the table's comment when tables are registered.
TABLE_COMMENTS = {
    "silver": "one row per column of the estate: typed, cleaned, checked and certified",
    "scores_pre": "silver with documentation, quality, classification and overall scores",
    "table_governance": "average scores per table, description and steward",
    "table_structure": "identity and place of every column",
    "profile": "descriptive attributes and results of every column",
    "dlt_summary": "rows that pass and fail the row-level validations",
    "kpi_summary": "the estate's key figures in one row",
    "cert_level_summary": "certification levels per table",
    "pii_classification_summary": "sensitivity coverage per security classification",
    "domain_summary": "size, score and certification per domain",
    "structural_consistency": "each table's width against the modal width",
    "structural_summary": "share of tables within the structural standard",
    "governance_gaps": "columns that fail a governance check, with the reasons",
    "region_assignment": "data-residency rule per database",
    "user_profile": "users with region and access group",
    "asset_access_policy": "the residency rule that each table inherits",
    "asset_access_check": "access decision for every table and user",
}


# Tables that are built from others, which are then read back rather than built again.
SIBLINGS = {
    "table_governance": ["scores_pre"], "domain_summary": ["scores_pre"], "structural_summary": ["structural_consistency"],
    "asset_access_check": ["asset_access_policy", "user_profile"],
}


class Gold(dict):
    """Lazily built gold tables: each plan is declared on first access."""

    def __init__(self, silver: DataFrame, regions: DataFrame, users: DataFrame,
                 tolerance: float = structure.TOLERANCE, standard: int | None = None):
        super().__init__()
        self.silver, self.regions, self.users = silver, regions, users
        self.tolerance, self.standard = tolerance, standard

    def _build(self, name: str) -> DataFrame:
        s = self.silver
        builders = {
            "scores_pre": lambda: scoring.scores_pre(s),
            "table_governance": lambda: scoring.table_governance(self["scores_pre"]),
            "table_structure": lambda: scoring.table_structure(s),
            "profile": lambda: scoring.profile(s),
            "dlt_summary": lambda: rollups.dlt_summary(s),
            "kpi_summary": lambda: rollups.kpi_summary(s),
            "cert_level_summary": lambda: rollups.cert_level_summary(s),
            "pii_classification_summary": lambda: rollups.pii_classification_summary(s),
            "domain_summary": lambda: rollups.domain_summary(self["scores_pre"]),
            "structural_consistency": lambda: structure.structural_consistency(
                s, self.tolerance, self.standard),
            "structural_summary": lambda: structure.structural_summary(
                self["structural_consistency"]),
            "governance_gaps": lambda: gaps.governance_gaps(s),
            "region_assignment": lambda: self.regions,
            "user_profile": lambda: self.users,
            "asset_access_policy": lambda: access.asset_access_policy(s, self.regions),
            "asset_access_check": lambda: access.asset_access_check(
                self["asset_access_policy"], self["user_profile"]),
        }
        if name not in builders:
            raise KeyError(name)
        return builders[name]()

    def __missing__(self, name: str) -> DataFrame:
        df = self._build(name)
        self[name] = df
        return df

    def all(self) -> dict[str, DataFrame]:
        return {n: self[n] for n in GOLD_TABLES}


def gold_tables(silver: DataFrame, regions: DataFrame, users: DataFrame,
                tolerance: float = structure.TOLERANCE, standard: int | None = None) -> Gold:
    return Gold(silver, regions, users, tolerance, standard)


def silver_from_sf(spark: SparkSession, sf_dir: str, rubric: Rubric | None = None) -> DataFrame:
    """Silver of one scale factor; the rubric defaults to ``spark.conf['rubric.path']``
    when set, else the production rubric."""
    return build_silver(bronze_from_lineitem(spark, sf_dir), rubric or rubric_from_conf(spark), stripped=True)


def gold_from_sf(spark: SparkSession, sf_dir: str, rubric: Rubric | None = None,
                 silver: DataFrame | None = None) -> Gold:
    """Gold plans over the lineitem-derived catalog of one scale factor."""
    silver = silver if silver is not None else silver_from_sf(spark, sf_dir, rubric)
    return gold_tables(silver, reference.region_assignment(spark), reference.user_profile(spark),
                       standard=structure.standard_from_conf(spark))


def write_table(df: DataFrame, path: str, partitions: int | None = None, table: str | None = None,
                comment: str | None = None) -> DataFrame:
    """Overwrite ``path`` with ``df`` as Parquet and return the re-read table; with ``table``
    it is registered in the catalog, with its comment."""
    out = (df.coalesce(partitions) if partitions else df).write.mode("overwrite").option("compression", "zstd")
    if table:
        out.option("path", path).saveAsTable(table)
        return commented(df.sparkSession, table, comment)
    out.parquet(path)
    return df.sparkSession.read.parquet(path)


def commented(spark: SparkSession, table: str, comment: str | None) -> DataFrame:
    if comment:
        spark.sql(f"COMMENT ON TABLE {table} IS '{comment.replace(chr(39), chr(92) + chr(39))}'")
    return spark.table(table)


def write_bucketed(df: DataFrame, table: str, key: str = "table_id", buckets: int = 64,
                   path: str | None = None) -> DataFrame:
    """Save ``df`` as a catalog table bucketed (and sorted) by ``key`` and return it.

    One shuffle at write time (one file per bucket); every later aggregation or
    join whose keys include ``key`` reads it without an exchange. Size buckets so
    one holds a few hundred MB (e.g. 4096 for a multi-TB silver). With ``path``
    the table's files live there (a shared folder), not in the warehouse."""
    w = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return commented(df.sparkSession, table, TABLE_COMMENTS["silver"] if key == "table_id" else None)


def write_gold(gold: Gold, out_dir: str, tables=STORED_TABLES, parallelism: int = 4,
               on_done=None, catalog_prefix: str | None = None) -> dict[str, DataFrame]:
    """Write gold tables as Parquet, several jobs at a time.

    A table that is built from another of ``tables`` (``SIBLINGS``) waits for it and reads the stored
    one, which also takes its place in ``gold``; the others are independent jobs over the
    same silver. Submitting jobs from a few threads lets small ones share the cluster instead
    of queueing (use the FAIR scheduler for even sharing). ``on_done(name, seconds)`` reports
    per-table times; with ``catalog_prefix`` the tables are also registered, as
    ``<prefix><name>`` with their comments."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    def one(name: str) -> tuple[str, DataFrame]:
        t = time.time()
        df = write_table(gold[name], f"{out_dir}/{name}",
                         table=catalog_prefix + name if catalog_prefix else None, comment=TABLE_COMMENTS[name])
        if on_done:
            on_done(name, time.time() - t)
        return name, df

    later = [t for t in tables if set(SIBLINGS.get(t, ())) & set(tables)]
    done: dict[str, DataFrame] = {}
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for wave in ([t for t in tables if t not in later], later):
            stored = dict(pool.map(one, wave))
            for name in later:
                gold.pop(name, None)  # declared anew, over what is stored by now
            gold.update(stored)
            done.update(stored)
    return {t: done[t] for t in tables}


def run_pipeline(spark: SparkSession, bronze: DataFrame, out_dir: str,
                 rubric: Rubric | None = None, regions: DataFrame | None = None,
                 users: DataFrame | None = None, tables=STORED_TABLES,
                 silver_table: str | None = None, buckets: int = 64,
                 stripped: bool = False, corrupt: DataFrame | None = None) -> dict[str, DataFrame]:
    """Write silver, the quarantined rows and the gold tables under ``out_dir`` (a shared
    folder); of the gold tables those of ``STORED_TABLES`` by default.

    ``corrupt``: rows of the source that could not be read as columns (``corrupt_csv_rows``), which
    join the quarantined ones. The rows that pass and fail each expectation are counted by the job
    that writes silver, and written to ``out_dir/expectations``.
    ``stripped``: the bronze strings come from ``to_bronze``, which strips them already.
    With ``silver_table``, silver is saved as a catalog table bucketed by
    table_id instead of a plain Parquet folder."""
    seen = Observation()
    built = build_silver(bronze, rubric or rubric_from_conf(spark), stripped=stripped, observation=seen)
    silver = (write_bucketed(built, silver_table, buckets=buckets, path=f"{out_dir}/silver")
              if silver_table else write_table(built, f"{out_dir}/silver"))
    gold = gold_tables(silver, regions if regions is not None else reference.region_assignment(spark),
                       users if users is not None else reference.user_profile(spark),
                       standard=structure.standard_from_conf(spark))
    rejected = quarantine(bronze)
    if corrupt is not None:
        rejected = rejected.unionByName(corrupt, allowMissingColumns=True)
    write_table(expectation_report(spark, seen), f"{out_dir}/expectations", partitions=1)
    written = {"silver": silver, "quarantine": write_table(rejected, f"{out_dir}/quarantine")}
    written.update(write_gold(gold, out_dir, tables))
    return written
