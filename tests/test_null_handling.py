"""Whitespace / blank / token handling of the bronze and silver string steps."""

import pytest

from conftest import raw_rows
from govlens.functions.text import blank_to_null, strip_ws, token_to_null
from govlens.sources.raw import NULL_TOKENS


CASES = [
    (None, None), ("", None), ("   ", None), ("\t", None), ("\n", None), ("  \t\n  ", None),
    ("  customer_id  ", "customer_id"), ("Finance", "Finance"), ("0", "0"), ("false", "false"),
    ("42", "42"), ("Conf", "Conf"), ("\tcrm\n", "crm"),
]


@pytest.mark.parametrize("value,expected", CASES)
def test_blank_to_null(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(blank_to_null("v").alias("o")).first()["o"] == expected


@pytest.mark.parametrize("token", ["", "nan", "NaN", "NAN", "null", "NULL", "None", "none",
                                   "NA", "N/A", " nan ", "\tNULL\n", "#N/A", "n/a", "<NA>"])
def test_tokens_become_null(spark, token):
    df = spark.createDataFrame([(token,)], "v string")
    assert df.select(token_to_null("v", NULL_TOKENS).alias("o")).first()["o"] is None


@pytest.mark.parametrize("value", ["nanny", "Null value", "0", "none of these", "NA-1"])
def test_non_tokens_kept(spark, value):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(token_to_null("v", NULL_TOKENS).alias("o")).first()["o"] == value


def test_strip_keeps_inner_whitespace(spark):
    df = spark.createDataFrame([("  a \t b  ",)], "v string")
    assert df.select(strip_ws("v").alias("o")).first()["o"] == "a \t b"


def test_normalize_row_all_columns(spark):
    from govlens.operators.silver import normalize_strings

    row = {"column_id": "x", "column_name": "  cust  ", "column_desc": "", "data_steward": "   ",
           "term_name": "\t", "tag_value": "CRM"}
    out = normalize_strings(raw_rows(spark, [row])).first().asDict()
    assert out["column_name"] == "cust"
    assert out["column_desc"] is None and out["data_steward"] is None and out["term_name"] is None
    assert out["tag_value"] == "CRM"
    assert out["location"] is None


def test_csv_scan_by_header_name(spark, tmp_path):
    """Columns bind by header name (any order, extras dropped); a missing one fails."""
    from govlens.sources.raw import MissingColumnsError, RAW_COLUMNS, read_raw_csv

    cols = list(reversed(RAW_COLUMNS)) + ["extra"]
    row = {c: f"v_{c}" for c in cols}
    row["column_desc"] = "  N/A "
    row["pii_flag"] = ""
    lines = [",".join(cols), ",".join(row[c] for c in cols)]
    p = tmp_path / "raw.csv"
    p.write_text("\n".join(lines) + "\n")
    r = read_raw_csv(spark, str(p)).first().asDict()
    assert r["column_id"] == "v_column_id" and r["column_desc"] is None and r["pii_flag"] is None
    assert "extra" not in r and r["_source_file"].endswith("raw.csv")
    q = tmp_path / "bad.csv"
    q.write_text("column_id,column_name\na,b\n")
    with pytest.raises(MissingColumnsError):
        read_raw_csv(spark, str(q))
