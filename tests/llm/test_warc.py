import hashlib

import pytest
from edge import LONG, rows_of

from govlens.llm import warc

FAKE = ("\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 45\r\n\r\n"
        "HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")


def brute(pages):
    best = {}
    for i, _, h in pages:
        h = h or ""
        if len(h.encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in pages:
        h = (h or "").encode()
        keeper = best.get(h.decode())
        revisit = keeper is not None and i != keeper
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response",
                    keeper if revisit else None, True))
    return sorted(map(str, out))


def round_trip(spark, pages, folder, **options):
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    warc.write_archives(df, str(folder), **options)
    return sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["verified"]))
                  for r in rows_of(warc.read_archives(spark, str(folder))))


PAGES = [(1, "http://a", None), (2, None, ""), (3, "u\r\nX: y", "<p>é</p>"), (4, "u", "z" * 1000), (5, "u", "z" * 1000),
         (5, "u", "z" * 1000), (6, "u", "z" * 999), (7, "u", "z" * 999), (None, "u", "z" * 1000), (None, None, "q"),
         (8, "u", FAKE), (9, "u", "a" + FAKE + "b" + FAKE), (10, "u", FAKE * 30), (11, "u", "WARC/1.1\r\n" + "t" * 50),
         (12, "u", "\r\n\r\nWARC/1.1\r\n"), (13, "u", LONG), (14, "u", "x\r\n\r\n"), (15, "WARC/1.1", "\r\n\r\n"), (16, "u", FAKE * 30)]


@pytest.mark.parametrize("partitions", [1, 3])
def test_round_trip_with_magic_in_payloads(spark, tmp_path, partitions):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # splits in the midst of records
    try:
        assert round_trip(spark, PAGES * partitions, tmp_path / "w") == brute(PAGES * partitions)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages(spark, tmp_path):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert round_trip(spark, pages, tmp_path / "w", records_per_file=7) == brute(pages)


def test_empty_and_cut_archives(spark, tmp_path):
    assert round_trip(spark, [], tmp_path / "none") == []
    df = spark.createDataFrame([(1, "u", "h" * 3000)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    part = max((tmp_path / "w").glob("part-*"), key=lambda p: p.stat().st_size)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "part-0.txt").write_bytes(part.read_bytes()[:1500])
    row = rows_of(warc.read_archives(spark, str(tmp_path / "cut")))
    assert len(row) == 1 and row[0]["payload_digest"] is None and row[0]["payload_bytes"] is None


def test_records_follow_the_format(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://x", "y" * 1200), (2, "http://z", "y" * 1200)], "page_id long, url string, html string")
    records = {r.value.split("\r\n")[1]: r.value for r in warc.records(df).collect()}
    for value in records.values():
        head, _, block = value.partition("\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        assert head.startswith("WARC/1.1\r\n") and int(fields["Content-Length"]) == len(block.encode())
    assert set(records) == {"WARC-Type: response", "WARC-Type: revisit"}
