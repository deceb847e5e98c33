import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from govlens.plans.hints import ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[4]").appName("govlens-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.ansi.enabled", "true")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="govlens-wh-", dir="/tmp"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="govlens-ckpt-", dir="/tmp"))
    yield s


def raw_rows(spark, rows):
    """Raw frame (26 string columns) from dicts; missing keys are NULL."""
    from govlens.sources.raw import RAW_COLUMNS, raw_schema

    data = [tuple(r.get(c) for c in RAW_COLUMNS) for r in rows]
    return spark.createDataFrame(data, raw_schema())


def good_row(**overrides):
    """A raw row that passes every check of the production rubric."""
    base = {
        "column_id": "raw-7", "column_name": "net_weight", "column_desc": "Weight of the parcel without wrapping",
        "term_name": "Net weight", "term_description": "Mass of the goods alone",
        "security_classification": "Internal", "critical_data_element_flag": "false",
        "pii_flag": "false", "term_subdomain": "Logistics", "data_steward": "depot@example.org",
        "table_id": "raw-t7", "table_name": "parcels", "table_desc": "One row per parcel",
        "table_owner_in_source": "warehouse", "schema_id": "raw-s7", "schema_name": "gold",
        "database_id": "raw-d7", "database_name": "lakehouse", "system_id": "raw-y7", "system_name": "Depot",
        "location": "EU", "total_record_count": "2500", "invalid_record_count": "10",
        "tag_name": "domain", "tag_value": "Shipping", "certification_level": "Documented",
    }
    base.update(overrides)
    return base
