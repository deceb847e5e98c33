"""WARC archives of pages: writing, and reading with boundary-chain verification.

Writing: one record per page. Spark's text writer ends every value with the record
separator, so archives go to any file system that Spark writes to. Of equal payloads
of at least ``REVISIT_FROM`` bytes the page with the largest id is a response record,
the others are revisit records that name it.

Reading: tasks split the archives wherever the magic stands after a separator, also
inside payloads. Each such piece is a candidate record; its header gives the place of
its successor. Only candidates that the chain reaches from the file's start are
records: pieces linked to the very next piece are contracted into runs, and pointer
jumping (doubling) over the runs finds those reachable, in a number of rounds
logarithmic in the number of runs. A file without magic in payloads is a single run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlens.llm.common import marked, written

# Fixed values of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
END = CRLF + CRLF
MAGIC = END + VERSION + CRLF

REVISIT_FROM = 1000
RECORDS_PER_FILE = 50_000
DATE = "2000-01-01T00:00:00Z"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def records(pages: DataFrame, revisit_from: int = REVISIT_FROM, date: str = DATE) -> DataFrame:
    """One WARC record per page as column ``value``, without the separator after it.

    Columns page_id, url and html are read, others ignored. Null html: an empty payload;
    null url: an empty target. A null page_id is never referred to: such pages are
    responses unless a page with an id has the same payload. Repeated rows of the page
    with the largest id are responses alike. Line ends in a url are percent-encoded.

    Revisit records need no payload, so payloads are not shuffled but for pages that are
    revisits (and few others, see ``marked``), which the join tells apart.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("bytes"),
                       F.sha1(F.col("payload").cast("binary")).alias("digest"),
                       F.xxhash64("payload").alias("hash")).withColumn("row", F.xxhash64("page_id", "digest"))
    light = rows.drop("payload").filter(F.col("bytes") >= revisit_from)
    key = ["digest", "hash", "bytes"]
    keepers = (light.groupBy(*key).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
               .filter(F.col("keeper").isNotNull() & (F.col("n") > 1)).drop("n"))
    revisits = written(light.join(keepers.hint("merge"), key).filter(~F.col("page_id").eqNullSafe(F.col("keeper"))),
                       "revisits")
    gone = revisits.select(F.col("page_id").alias("g"), F.col("digest").alias("d")).distinct().hint("merge")
    split = marked(rows, "row", revisits)
    # an outer join: an anti join would be moved below the marking, and all payloads shuffled
    maybe = split.filter("marked").join(
        gone, F.col("page_id").eqNullSafe(F.col("g")) & (F.col("digest") == F.col("d")), "left").filter(
        F.col("d").isNull())
    response = split.filter("not marked").unionByName(maybe.drop("g", "d"))
    return _record(response, "response", F.col("payload"), date).unionByName(_record(revisits, "revisit", None, date))


def _record(rows: DataFrame, kind: str, payload: Column | None, date: str) -> DataFrame:
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = _text("HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF,
                 "Content-Length: ", F.col("bytes").cast("string"), END)
    refers = [] if payload is not None else [
        "WARC-Refers-To: ", _urn(F.col("keeper")), CRLF,
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", CRLF]
    length = F.octet_length(http) + (F.col("bytes") if payload is not None else F.lit(0))
    return rows.select(_text(
        VERSION, CRLF, "WARC-Type: ", kind, CRLF, "WARC-Record-ID: ", _urn(F.col("page_id")), CRLF,
        "WARC-Target-URI: ", uri, CRLF, "WARC-Date: ", date, CRLF,
        "WARC-Payload-Digest: sha1:", F.col("digest"), CRLF, *refers,
        "Content-Type: application/http; msgtype=response", CRLF,
        "Content-Length: ", length.cast("string"), END, http,
        *([payload] if payload is not None else [])).alias("value"))


def _urn(page_id: Column) -> Column:
    return _text("<urn:page:", F.coalesce(page_id.cast("string"), F.lit("")), ">")


def write_archives(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, date: str = DATE,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` as uncompressed archives under the new folder ``path``."""
    (records(pages, revisit_from, date).write.option("lineSep", END)
     .option("maxRecordsPerFile", records_per_file).text(path))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic: file (a hash of its path), split, ord (order within a
    split), value."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("ord"), "value")


def _header(head: Column, name: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*{pattern}[ \t]*$", 1), F.lit(""))


def _parsed(value: Column) -> dict[str, Column]:
    """What one piece, or a record put together from several, holds: its header's fields,
    and size and digest of its payload so far as the piece has it."""
    head = F.substring_index(value, END, 1)
    length = F.try_to_number(_header(head, "Content-Length", r"(\d{1,18})"), F.lit("9" * 18)).cast("long")
    rest = F.substr(value, F.length(head) + 5)
    # the last piece of a file still has its separator
    block = F.when(F.octet_length(rest) == length + 4, F.substr(rest, F.lit(1), F.length(rest) - 4)).otherwise(rest)
    http = F.substring_index(block, END, 1)
    payload = F.substr(block, F.length(http) + 5)
    revisit = _header(head, "WARC-Type", r"(\w+)") == "revisit"
    full = F.octet_length(block) == length
    said = _header(head, "WARC-Payload-Digest", r"sha1:([0-9a-f]+)")
    digest = F.when(revisit, said).otherwise(F.sha1(payload.cast("binary")))
    return {
        "head_bytes": F.octet_length(head).cast("long"), "length": length, "full": full,
        "record_type": _header(head, "WARC-Type", r"(\w+)"),
        "page_id": _header(head, "WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long"),
        "refers_to": _header(head, "WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long"),
        "payload_bytes": F.when(full, F.when(
            revisit, _header(http, "Content-Length", r"(\d{1,18})").cast("long")).otherwise(F.octet_length(payload))),
        "payload_digest": F.when(full, digest), "verified": full & (digest == said)}


def _placed(pieces: DataFrame, *columns: str) -> DataFrame:
    """Adds ``at``: the byte in the file where a piece begins (the first at 0, any other
    right behind its magic). Pieces are consecutive, so that is a running sum."""
    before = W.partitionBy("file").orderBy("split", "ord").rowsBetween(W.unboundedPreceding, -1)
    return pieces.select("file", F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(before), F.lit(0)).alias("at"),
                         *columns)


FIELDS = ["record_type", "page_id", "refers_to", "payload_bytes", "payload_digest", "verified"]


def _reached(pieces: DataFrame) -> DataFrame:
    """(file, at) of the pieces at which a record begins.

    ``pieces`` has file, at, next: next is the place of the successor's piece, if the
    piece can be read as a record at all."""
    order = W.partitionBy("file").orderBy("at")
    linked = pieces.select("file", "at", "next", F.lead("at").over(order).alias("after"),
                           F.lag("next").over(order).alias("before"))
    jumps = (linked.filter(F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("after")))
             .select("file", F.col("next").alias("at")).distinct().withColumn("aimed", F.lit(True)))
    heads = linked.join(jumps.hint("merge"), ["file", "at"], "left").select(
        "file", "at", "next",
        F.when(F.col("aimed") | ~F.col("before").eqNullSafe(F.col("at")), F.col("at")).alias("head"))
    runs = written(heads.select("file", "at", "next", F.last("head", ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, 0)).alias("run")), "warc-runs")
    jump = written(runs.groupBy("file", "run").agg(F.max_by("next", "at").alias("to")), "warc-jumps")
    jump = jump.join(jump.select("file", F.col("run").alias("to")).hint("merge"), ["file", "to"], "left_semi").select(
        "file", "run", "to")
    reached = runs.filter(F.col("at") == 0).select("file", "run")
    while True:
        more = written(reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run")).distinct()
                       .join(reached, ["file", "run"], "left_anti"), "warc-reached")
        if more.isEmpty():
            return runs.join(reached.hint("merge"), ["file", "run"], "left_semi").select("file", "at")
        reached = reached.union(more)
        jump = written(jump.join(jump.select("file", F.col("run").alias("to"), F.col("to").alias("on")),
                                 ["file", "to"]).select("file", "run", F.col("on").alias("to")), "warc-jumps")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``: record_type, page_id, refers_to
    (of revisits), payload_bytes, payload_digest (bare hex SHA-1, both of the full payload;
    of a revisit as its record states them) and verified (it is what the header says).

    Magic inside a payload yields no record. A record cut off at a file's end has null
    payload columns. An empty folder gives an empty result."""
    of = _parsed(F.col("value"))
    scanned = _pieces(spark, path).select("file", "split", "ord", F.octet_length("value").cast("long").alias("bytes"),
                                          *[c.alias(n) for n, c in of.items()])
    placed = written(_placed(scanned, "head_bytes", "length", *FIELDS, "full"), "warc-pieces")
    reached = written(_reached(placed.select(
        "file", "at", (F.col("at") + F.col("head_bytes") + F.col("length") + (4 + len(MAGIC))).alias("next"))),
        "warc-records")
    found = placed.join(reached.hint("merge"), ["file", "at"])
    whole = found.filter(F.coalesce("full", F.lit(False))).select(*FIELDS)
    cut = written(found.filter(~F.coalesce("full", F.lit(False))).select("file", "at"), "warc-cut")
    if cut.isEmpty():
        return whole
    return whole.unionByName(_rejoined(spark, path, reached, cut))


def _rejoined(spark: SparkSession, path: str, reached: DataFrame, cut: DataFrame) -> DataFrame:
    """The records ``cut`` at magic in their payloads, put together again. Only the files
    that have such records are read again."""
    files = cut.select("file").distinct()
    again = _pieces(spark, path).join(files, "file", "left_semi")
    pieces = _placed(again.withColumn("bytes", F.octet_length("value").cast("long")), "value")
    starts = reached.join(files, "file", "left_semi").withColumn("start", F.col("at"))
    owned = pieces.join(starts, ["file", "at"], "left").select("file", "at", "value", F.last(
        "start", ignorenulls=True).over(W.partitionBy("file").orderBy("at").rowsBetween(
            W.unboundedPreceding, 0)).alias("start"))
    joined = (owned.join(cut.select("file", F.col("at").alias("start")), ["file", "start"], "left_semi")
              .groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
              .select(F.array_join(F.col("parts.value"), MAGIC).alias("value")))
    return joined.select(*[c.alias(n) for n, c in _parsed(F.col("value")).items() if n in FIELDS])
