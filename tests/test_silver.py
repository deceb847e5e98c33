"""Silver behaviour on hand-written rows (casts, standardisation, keys, dedup, rubric)."""

import pytest

from conftest import good_row, raw_rows
from govlens.functions.rubric import RubricError, parse_rubric, production_rubric
from govlens.operators import silver as S
from govlens.sources.raw import to_bronze

# A rubric of its own: nine checks of all four rule kinds, three levels.
TEST_RUBRIC = {
    "rubric_version": "test",
    "checks": [
        {"id": "owner", "name": "has_owner", "rule": "not_null", "field": "data_steward"},
        {"id": "text", "name": "is_described", "rule": "not_null", "field": "column_desc"},
        {"id": "both", "name": "term_complete", "rule": "not_null_all", "fields": ["term_name", "term_description"]},
        {"id": "class", "name": "class_known", "rule": "allowed_values", "field": "security_classification",
         "allowed": ["Confidential", "Secret"]},
        {"id": "errors", "name": "few_errors", "rule": "ratio_below_threshold",
         "fields": ["invalid_record_count", "total_record_count"], "threshold": "0.10"},
        {"id": "flag", "name": "pii_known", "rule": "not_null", "field": "pii_flag"},
        {"id": "place", "name": "located", "rule": "not_null", "field": "location"},
        {"id": "tag", "name": "tagged", "rule": "not_null_all", "fields": ["tag_name", "tag_value"],
         "condition": "tag_name = 'domain'"},
        {"id": "where", "name": "has_schema", "rule": "not_null", "field": "schema_name"},
    ],
    "certification_levels": [
        {"name": "Seen", "gate_checks": ["where"]},
        {"name": "Owned", "gate_checks": ["where", "owner", "text"]},
        {"name": "Trusted", "gate_checks": ["where", "owner", "text", "class", "errors"]},
    ],
}


def silver(spark, rows, rubric=None):
    return S.build_silver(to_bronze(raw_rows(spark, rows), source="test"), rubric)


def one(spark, rubric=None, **overrides):
    rows = silver(spark, [good_row(**overrides)], rubric).collect()
    assert len(rows) == 1
    return rows[0]


def test_good_row_is_certified(spark):
    r = one(spark)
    assert r["achieved_cert_level"] == "Certified"
    assert r["checks_passed"] == 11 and r["checks_total"] == 11
    assert r["completeness_pct"] == 100.0
    assert r["dq_invalid_pct"] == pytest.approx(0.4)


def test_float_formatted_and_blank_counts(spark):
    r = one(spark, total_record_count="10000.0", invalid_record_count="12.9")
    assert r["total_record_count"] == 10000 and r["invalid_record_count"] == 12
    r = one(spark, total_record_count="", invalid_record_count="  ")
    assert r["total_record_count"] is None and r["dq_invalid_pct"] is None
    assert r["check_invalid_record_ratio_within_threshold"] is None
    assert r["achieved_cert_level"] == "Documented"


@pytest.mark.parametrize("bad", ["NaN", "Infinity", "1e30", "abc"])
def test_unparsable_counts_are_null(spark, bad):
    r = one(spark, total_record_count=bad)
    assert r["total_record_count"] is None


@pytest.mark.parametrize("text,expected", [("true", True), ("FALSE", False), ("yes", True),
                                           ("n", False), ("1", True), ("on", None), ("1.0", None)])
def test_boolean_parsing(spark, text, expected):
    assert one(spark, pii_flag=text)["pii_flag"] is expected


def test_conf_synonym_and_initcap(spark):
    r = one(spark, security_classification="Conf", certification_level="certified")
    assert r["security_classification"] == "Confidential"
    assert r["certification_level"] == "Certified"
    assert r["achieved_cert_level"] == "Certified"


def test_topsecret_fails_classification(spark):
    r = one(spark, security_classification="TopSecret")
    assert r["check_security_classification_present"] is False
    assert r["achieved_cert_level"] == "Documented"


def test_same_path_two_source_ids_keeps_one(spark):
    rows = [good_row(column_id="src_b"), good_row(column_id="src_a")]
    out = silver(spark, rows).collect()
    assert len(out) == 1 and out[0]["source_column_id"] == "src_a"


def test_more_complete_row_wins(spark):
    rows = [good_row(column_id="src_a", data_steward=None), good_row(column_id="src_b")]
    out = silver(spark, rows).collect()
    assert len(out) == 1 and out[0]["source_column_id"] == "src_b"


def test_same_names_two_systems_two_assets(spark):
    rows = [good_row(system_name="Snowflake"), good_row(column_id="src_002")]
    out = silver(spark, rows).collect()
    assert len({r["column_id"] for r in out}) == 2


def test_key_is_case_and_space_insensitive(spark):
    rows = [good_row(system_name=" DEPOT "), good_row(column_id="src_002")]
    assert silver(spark, rows).count() == 1


def test_missing_path_part_dropped_and_quarantined(spark):
    rows = [good_row(database_name=None), good_row(column_id="src_2", column_name="x")]
    assert silver(spark, rows).count() == 1
    q = S.quarantine(to_bronze(raw_rows(spark, rows), source="t")).collect()
    assert len(q) == 1 and q[0]["_failed_expectations"] == "valid_column_id, valid_table_id"


@pytest.mark.parametrize("field", ["data_steward", "tag_value", "term_name", "column_desc"])
def test_missing_documentation_caps_level(spark, field):
    r = one(spark, **{field: None})
    assert r["achieved_cert_level"] in ("Registered", "Documented")
    assert r["achieved_cert_level"] != "Certified"


def test_missing_steward_is_registered(spark):
    assert one(spark, data_steward=" ")["achieved_cert_level"] == "Registered"


def test_invalid_schema_is_none(spark):
    assert one(spark, schema_name="public")["achieved_cert_level"] == "None"


def test_twenty_percent_invalid_blocks_certified(spark):
    r = one(spark, total_record_count="1000", invalid_record_count="200")
    assert r["achieved_cert_level"] == "Documented"


def test_ratio_exactly_at_threshold_fails(spark):
    r = one(spark, total_record_count="1000", invalid_record_count="50")
    assert r["check_invalid_record_ratio_within_threshold"] is False
    r = one(spark, total_record_count="1000", invalid_record_count="49")
    assert r["check_invalid_record_ratio_within_threshold"] is True


def test_zero_total_is_unknown(spark):
    r = one(spark, total_record_count="0")
    assert r["check_invalid_record_ratio_within_threshold"] is None and r["dq_invalid_pct"] is None


def test_domain_condition(spark):
    assert one(spark, tag_name="team")["check_domain_tag_present"] is False
    assert one(spark, tag_name=None)["check_domain_tag_present"] is False


def test_other_rubric(spark):
    rub = parse_rubric(TEST_RUBRIC)
    r = one(spark, rubric=rub, security_classification="Secret", total_record_count="1000", invalid_record_count="99")
    assert r["achieved_cert_level"] == "Trusted" and r["checks_total"] == 9
    r = one(spark, rubric=rub, total_record_count="1000", invalid_record_count="100")
    assert r["achieved_cert_level"] == "Owned"
    r = one(spark, rubric=rub, data_steward=None)
    assert r["achieved_cert_level"] == "Seen" and r["checks_passed"] == 7


def test_silver_schema(spark):
    df = silver(spark, [good_row()])
    assert len(df.columns) == 48
    assert df.columns[-1] == "achieved_cert_level"
    assert "source_column_id" in df.columns and "column_id" in df.columns


def test_unknown_rule_rejected():
    bad = {"checks": [{"id": "X", "name": "x", "rule": "regex", "field": "a"}],
           "certification_levels": [{"name": "L", "gate_checks": ["X"]}]}
    with pytest.raises(RubricError):
        parse_rubric(bad)


def test_unknown_gate_rejected():
    bad = {"checks": [{"id": "X", "name": "x", "rule": "not_null", "field": "a"}],
           "certification_levels": [{"name": "L", "gate_checks": ["Y"]}]}
    with pytest.raises(RubricError):
        parse_rubric(bad)


def test_missing_rubric_field_rejected(spark):
    rub = parse_rubric({"checks": [{"id": "X", "name": "x", "rule": "not_null", "field": "nope"}],
                        "certification_levels": [{"name": "L", "gate_checks": ["X"]}]})
    with pytest.raises(RubricError):
        silver(spark, [good_row()], rub).collect()


def test_rubric_yaml_roundtrip(tmp_path):
    import yaml

    p = tmp_path / "rubric.yaml"
    p.write_text(yaml.safe_dump(TEST_RUBRIC))
    from govlens.functions.rubric import load_rubric

    assert load_rubric(str(p)).by_id()["errors"].threshold == 0.10
    assert len(production_rubric().checks) == 11


def test_idempotent_under_shuffle(spark):
    from govlens.sources.raw import bronze_from_lineitem

    b = bronze_from_lineitem(spark, "/root/testdata/sf0.001")
    a = S.build_silver(b).drop("_ingestion_timestamp")
    c = S.build_silver(b.repartition(7).orderBy("column_id", ascending=False)).drop("_ingestion_timestamp")
    assert a.count() == 1718
    assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0
    assert a.select("column_id").distinct().count() == a.count()
