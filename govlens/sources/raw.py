"""Raw catalog metadata: schema, CSV scan, null tokens, bronze audit columns,
and the adapter that derives raw rows from the driver's ``lineitem`` table.

Everything is a distributed scan plus built-in expressions: no pandas read on
the driver, no per-cell Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from govlens.functions.text import token_to_null
from govlens.sources.reference import REGION_ASSIGNMENT

# The 26 raw columns in source order.
RAW_COLUMNS = [
    "column_id", "column_name", "column_desc", "term_name", "term_description",
    "security_classification", "critical_data_element_flag", "pii_flag",
    "term_subdomain", "data_steward", "table_id", "table_name", "table_desc",
    "table_owner_in_source", "schema_id", "schema_name", "database_id",
    "database_name", "system_id", "system_name", "location",
    "total_record_count", "invalid_record_count", "tag_name", "tag_value",
    "certification_level",
]

# Text that means "missing" after stripping. The first line is
# the pipeline's own list; the second adds the NA strings a default pandas CSV
# read also treats as missing.
NULL_TOKENS = (
    "", "nan", "NaN", "NAN", "null", "NULL", "None", "none", "NA", "N/A",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "n/a",
)

AUDIT_COLUMNS = ["_ingestion_timestamp", "_source_file"]


def raw_schema() -> StructType:
    return StructType([StructField(c, StringType(), True) for c in RAW_COLUMNS])


class MissingColumnsError(ValueError):
    pass


def select_raw_columns(df: DataFrame, columns=RAW_COLUMNS) -> DataFrame:
    """Pick the raw columns by name (extras dropped); a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError("raw input lacks columns: " + ", ".join(missing))
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def apply_null_tokens(df: DataFrame, tokens=NULL_TOKENS, columns=None) -> DataFrame:
    """Strip every string column and turn null tokens into real NULLs (one projection)."""
    cols = columns or [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: token_to_null(c, tokens) for c in cols})


def with_audit_columns(df: DataFrame, source: str | None = None) -> DataFrame:
    """Add ``_ingestion_timestamp`` and ``_source_file`` (query string removed)."""
    src = F.lit(source) if source is not None else F.col("_metadata.file_path")
    return df.withColumns({
        "_ingestion_timestamp": F.current_timestamp(),
        "_source_file": F.regexp_replace(src, r"\?.*$", ""),
    })


def to_bronze(df: DataFrame, tokens=NULL_TOKENS, source: str | None = None) -> DataFrame:
    """Raw frame (any column order, extras allowed) -> bronze rows."""
    out = apply_null_tokens(select_raw_columns(df), tokens)
    if source is None and "_metadata" not in df.columns:
        source = "unknown"
    return with_audit_columns(out, source)


CORRUPT = "_corrupt_record"


def _csv_reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))


def csv_headers(spark: SparkSession, path: str, multi_line: bool = False, parallelism: int = 16) -> dict[tuple[str, ...], list[str]]:
    """Header -> files of every CSV file under ``path``; files without a line are left out.

    One small Spark job a file reads its first line, ``parallelism`` at a time."""
    from concurrent.futures import ThreadPoolExecutor

    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        headers = list(pool.map(lambda f: tuple(_csv_reader(spark, multi_line).csv(f).columns), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files, strict=True):
        if header:
            groups.setdefault(header, []).append(file)
    return groups


def scan_raw_csv(spark: SparkSession, path: str, multi_line: bool = False, columns=RAW_COLUMNS) -> DataFrame:
    """Every row of the CSV files under ``path``: the raw columns as text, ``_source_file``, and the
    row's own text in ``_corrupt_record`` where it has more or fewer values than its header.

    Values are bound by name: files are grouped by header, each group is one distributed scan with
    that header as its schema (extra columns dropped), and the scans are united by name. A
    file whose header lacks a raw column is an error that names the file and the column. Spark
    compares each file's header with the schema again (``enforceSchema`` off). Files are
    split unless ``multi_line`` (values with line ends) needs them whole."""
    groups = csv_headers(spark, path, multi_line)
    short = [f"{files[0]} lacks columns: {', '.join(c for c in columns if c not in header)}"
             for header, files in groups.items() if not set(columns) <= set(header)]
    if short or not groups:
        raise MissingColumnsError("; ".join(short) or f"no CSV file with a header under {path}")
    scans = []
    for header, files in groups.items():
        schema = StructType([StructField(c, StringType(), True) for c in (*header, CORRUPT)])
        df = _csv_reader(spark, multi_line).schema(schema).option("enforceSchema", False).csv(files)
        # Spark counts a row's values only where a query reads all columns, so the text refers to all
        every = F.concat_ws("", *[F.col(f"`{c}`") for c in header])
        text = F.when(F.col(CORRUPT).isNotNull(), F.concat(F.col(CORRUPT), F.left(every, F.lit(0))))
        scans.append(df.select(*[F.col(f"`{c}`") for c in columns], text.alias(CORRUPT), F.regexp_replace(
            F.col("_metadata.file_path"), r"\?.*$", "").alias("_source_file")))
    out = scans[0]
    for more in scans[1:]:
        out = out.unionByName(more)
    return out


def read_raw_csv(spark: SparkSession, path: str, tokens=NULL_TOKENS, multi_line: bool = False) -> DataFrame:
    """Bronze rows of the CSV files under ``path`` (see :func:`scan_raw_csv`), without corrupt rows,
    which :func:`corrupt_csv_rows` gives."""
    return _good(scan_raw_csv(spark, path, multi_line), tokens)


def _good(scan: DataFrame, tokens) -> DataFrame:
    rows = scan.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return apply_null_tokens(rows, tokens, RAW_COLUMNS).select(*RAW_COLUMNS, F.current_timestamp().alias("_ingestion_timestamp"), "_source_file")


CORRUPT_REASON = "corrupt_record"


def corrupt_csv_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The rows that do not have their header's number of values: file, text and reason."""
    return _corrupt(scan_raw_csv(spark, path, multi_line))


def _corrupt(scan: DataFrame) -> DataFrame:
    return scan.filter(F.col(CORRUPT).isNotNull()).select(
        "_source_file", F.col(CORRUPT).alias("_raw_text"), F.lit(CORRUPT_REASON).alias("_failed_expectations"))


def split_raw_csv(spark: SparkSession, path: str, tokens=NULL_TOKENS, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(bronze rows, corrupt rows) with the headers read once."""
    scan = scan_raw_csv(spark, path, multi_line)
    return _good(scan, tokens), _corrupt(scan)


def csv_row_counts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Good and corrupt rows in one scan."""
    corrupt = F.col(CORRUPT).isNotNull()
    return scan_raw_csv(spark, path, multi_line).agg(F.count_if(~corrupt).alias("good_rows"), F.count_if(corrupt).alias("corrupt_rows"))


# Raw columns derived from one lineitem row (expressions shared by Spark SQL
# and DuckDB; see FIXTURES.md). o/n/p/s/q are the order key, line number, part
# key, supplier key and quantity.
def _database_case() -> str:
    arms = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(r[0] for r in REGION_ASSIGNMENT))
    return (f"CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CASE l_partkey % 14 {arms} "
            f"WHEN 12 THEN 'sandbox' ELSE 'Finance_DW' END END")


LINEITEM_RAW_EXPRS = {
    "column_id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', "
                 "CAST(floor(l_extendedprice * 100) AS BIGINT))",
    "column_name": "concat('col_', (l_orderkey + l_linenumber) % "
                   "(CASE WHEN l_partkey % 10 < 6 THEN 8 ELSE 3 + l_partkey % 10 END))",
    "column_desc": "CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_orderkey % 13 = 0 THEN 'N/A' "
                   "ELSE concat(' desc ', l_linenumber) END",
    "term_name": "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE concat('term_', l_suppkey % 9) END",
    "term_description": "CASE WHEN l_orderkey % 4 = 0 THEN NULL "
                        "ELSE concat('about term ', l_suppkey % 9) END",
    "security_classification": "CASE l_suppkey % 6 WHEN 0 THEN 'Conf' WHEN 1 THEN 'Confidential' "
                               "WHEN 2 THEN 'Internal' WHEN 3 THEN 'Public' "
                               "WHEN 4 THEN 'TopSecret' ELSE '  ' END",
    "critical_data_element_flag": "CASE WHEN l_orderkey % 7 = 0 THEN 'nan' "
                                  "WHEN l_partkey % 11 = 0 THEN 'true' ELSE 'false' END",
    "pii_flag": "CASE l_linenumber % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' "
                "WHEN 2 THEN 'yes' ELSE '' END",
    "term_subdomain": "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat('sub_', l_suppkey % 4) END",
    "data_steward": "CASE WHEN l_orderkey % 6 = 0 THEN '   ' ELSE concat('steward_', l_partkey % 8) END",
    "table_id": "concat('t-', l_orderkey, '-', l_linenumber)",
    "table_name": "concat('tbl_', l_partkey)",
    "table_desc": "CASE WHEN l_partkey % 9 = 0 THEN '' ELSE concat('table ', l_partkey) END",
    "table_owner_in_source": "concat('owner_', l_partkey % 5)",
    "schema_id": "concat('s-', l_orderkey, '-', l_linenumber)",
    "schema_name": "CASE l_partkey % 5 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' "
                   "WHEN 4 THEN 'public' ELSE 'gold' END",
    "database_id": "concat('d-', l_orderkey, '-', l_linenumber)",
    "database_name": _database_case(),
    "system_id": "concat('y-', l_orderkey, '-', l_linenumber)",
    "system_name": "CASE WHEN l_orderkey % 11 = 0 THEN concat(' SYS_', l_partkey % 4) "
                   "ELSE concat('sys_', l_partkey % 4) END",
    "location": "CASE l_partkey % 3 WHEN 0 THEN 'EU' WHEN 1 THEN 'US' ELSE 'APAC' END",
    "total_record_count": "CASE WHEN l_quantity < 3 THEN '' "
                          "ELSE concat(CAST(floor(l_quantity * 100) AS BIGINT), '.0') END",
    "invalid_record_count": "concat(CAST(floor(l_quantity * l_discount * 60) AS BIGINT), '.0')",
    "tag_name": "CASE WHEN l_orderkey % 8 = 0 THEN 'team' ELSE 'domain' END",
    "tag_value": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE concat('dom_', l_partkey % 6) END",
    "certification_level": "CASE l_linenumber % 3 WHEN 0 THEN 'certified' "
                           "WHEN 1 THEN 'REGISTERED' ELSE 'draft' END",
}

LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount"]


def raw_from_lineitem(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Raw (untyped, uncleaned) catalog rows, one per lineitem row.

    ``partitions`` deals the narrow numeric scan first: for inputs of fewer splits than cores
    (one row group), or splits of many rows, which are far wider as text; by default the scan's own
    splits are used. Rows are dealt by all their values, which, unlike round robin, needs no sort."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_COLUMNS)
    li = li.repartition(partitions, *LINEITEM_COLUMNS) if partitions else li
    return li.selectExpr(*[f"CAST({e} AS STRING) AS {c}" for c, e in LINEITEM_RAW_EXPRS.items()])


def bronze_from_lineitem(spark: SparkSession, sf_dir: str, tokens=NULL_TOKENS,
                         partitions: int | None = None) -> DataFrame:
    """Bronze rows (null tokens applied, audit columns added) from lineitem."""
    raw = raw_from_lineitem(spark, sf_dir, partitions)
    return with_audit_columns(apply_null_tokens(raw, tokens), f"{sf_dir}/lineitem.parquet")


def _csv_line(columns: list[str], tail: str = "") -> str:
    cells = ", ',', ".join(f"coalesce(concat('\"', CAST({LINEITEM_RAW_EXPRS[c]} AS STRING), '\"'), '')" for c in columns)
    return f"concat({cells}{tail})"


ROWS_PER_FILE = 200_000  # a gzip file is read by one task


def lineitem_csv(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """CSV files of the raw rows under ``folder``, one folder per layout: the raw columns in order; in
    reverse order with one column more; and in order, but with rows cut short (order key
    mod 50 = 7) or with a value too many (mod 50 = 9). A row's order key picks its layout. Files are
    gzip files of bounded size, so that they are read by as many tasks as there are files."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_COLUMNS)
    backwards = RAW_COLUMNS[::-1]
    layouts = {
        "plain": ("l_orderkey % 3 = 0", RAW_COLUMNS, _csv_line(RAW_COLUMNS)),
        "backwards": ("l_orderkey % 3 = 1", ["comment", *backwards], _csv_line(backwards).replace("concat(", "concat('x,', ", 1)),
        "damaged": ("l_orderkey % 3 = 2", RAW_COLUMNS, f"CASE l_orderkey % 50 WHEN 7 THEN {_csv_line(RAW_COLUMNS[:20])} "
                    f"WHEN 9 THEN {_csv_line(RAW_COLUMNS, tail=chr(44) + ' ' + repr(',more'))} ELSE {_csv_line(RAW_COLUMNS)} END"),
    }
    for name, (rows, header, line) in layouts.items():
        # one cell a row under the layout's header; written as it is, without quoting
        (li.filter(rows).select(F.expr(line).alias(",".join(header))).write.mode("overwrite")
         .option("header", True).option("sep", "\x01").option("quote", "").option("escapeQuotes", False).option("ignoreLeadingWhiteSpace", False)
         .option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE)
         .option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}"))
    return f"{folder}/*"
