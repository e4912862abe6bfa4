"""The archive as a data source, and the panel that follows a folder of archives."""

import http.server
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantloom.sources import bars, months
from quantloom.streaming.ingest import ingest_stream

from .test_runs import zipped_file

HELD = [("AAAUSDT", "2024-01"), ("AAAUSDT", "2024-02"), ("BBBUSDT", "2024-01"), ("CCCUSDT", "2024-02")]
FIRST = {"2024-01": 1704067200000, "2024-02": 1706745600000}


@pytest.fixture
def archive(tmp_path):
    """(url, paths asked for) of a web archive that has HELD, and a listing of its symbols."""
    for symbol, month in HELD:
        zipped_file(tmp_path / f"{symbol}-1m-{month}.zip", FIRST[month], 60_000, 90, month == "2024-01")
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            name = self.path.rpartition("/")[2]
            if "list-type=2" in self.path:
                folders = "".join(f"<CommonPrefixes><Prefix>data/spot/monthly/klines/{s}/</Prefix></CommonPrefixes>" for s in sorted({s for s, _ in HELD}))
                body, status = f"<ListBucketResult><IsTruncated>false</IsTruncated>{folders}</ListBucketResult>".encode(), 200
            elif (tmp_path / name).exists():
                body, status = (tmp_path / name).read_bytes(), 200
            else:
                body, status = b"", 404
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_months_between():
    assert months.months_between("2023-11", "2024-02") == ["2023-11", "2023-12", "2024-01", "2024-02"] and months.months_between("2024-02", "2024-01") == []


def test_a_scan_reads_all_months_that_there_are(spark, archive):
    url, asked = archive
    found = months.archive_minutes(spark, url, "2024-01", "2024-03", listing=f"{url}/list")
    assert {(r["symbol"], r["month"]): r["n"] for r in found.groupBy("symbol", "month").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(HELD, 90)
    assert sum("list-type" in a for a in asked) == 1 and sum(a.endswith(".zip") for a in asked) == 9
    hourly = bars.hourly(found).where("symbol = 'CCCUSDT'").orderBy("ts").collect()
    assert [r["n_minutes"] for r in hourly] == [60, 30] and hourly[0]["ts"].isoformat() == "2024-02-01T00:00:00"


@pytest.mark.parametrize(
    ("condition", "requests", "listed"),
    [
        ("symbol = 'AAAUSDT' and month = '2024-02'", ["AAAUSDT-1m-2024-02"], 0),
        ("symbol in ('BBBUSDT', 'CCCUSDT') and month <= '2024-01'", ["BBBUSDT-1m-2024-01", "CCCUSDT-1m-2024-01"], 0),
        ("month > '2024-01' and month < '2024-03' and close > 1.6", [f"{s}-1m-2024-02" for s in ("AAAUSDT", "BBBUSDT", "CCCUSDT")], 1),
        ("month = '1999-01'", [], 0),
    ],
)
def test_filters_decide_what_is_asked_for(spark, archive, condition, requests, listed):
    url, asked = archive
    found = months.archive_minutes(spark, url, "2024-01", "2024-03", listing=f"{url}/list").where(condition)
    whole = bars.minutes(spark.createDataFrame([(s, m) for s, m in HELD], "symbol string, month string").withColumn("content", F.lit(None).cast("binary")).limit(0))
    assert found.columns == whole.columns
    rows = found.collect()
    assert Counter(a.rpartition("/")[2].removesuffix(".zip") for a in asked if a.endswith(".zip")) == Counter(requests) and sum("list-type" in a for a in asked) == listed
    assert {(r["symbol"], r["month"]) for r in rows} == {tuple(r.split("-1m-")) for r in requests} & set(HELD)
    assert "close" not in condition or all(r["close"] > 1.6 for r in rows)


def test_named_symbols_need_no_listing(spark, archive):
    url, asked = archive
    found = months.archive_minutes(spark, url, "2024-01", "2024-01", symbols="BBBUSDT,ZZZUSDT").where("symbol >= 'A'")
    assert found.count() == 90 and len(asked) == 2


class Cut(Exception):
    pass


def test_a_restart_neither_loses_nor_doubles_a_month(spark, tmp_path):
    raw, panel, checkpoint = tmp_path / "raw", str(tmp_path / "panel"), str(tmp_path / "checkpoint")
    zipped_file(raw / "AAA" / "AAA-1m-2024-01.zip", FIRST["2024-01"], 60_000, 90, False)
    zipped_file(raw / "BBB" / "BBB-1m-2024-01.zip", FIRST["2024-01"], 60_000, 60, False)

    def run(built=bars.build):
        ingest_stream(spark, str(raw), panel, checkpoint, files_a_batch=2, built=built).awaitTermination()

    def cut(archives, path):
        bars.build(archives, path)
        raise Cut  # written, not committed

    with pytest.raises(Exception, match="Cut"):
        run(cut)
    run()
    months_of = lambda: {(r["symbol"], r["month"]): (r["n"], r["rows"]) for r in bars.read_panel(spark, panel).groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("n_minutes").alias("rows")).collect()}
    assert months_of() == {("AAA", "2024-01"): (2, 90), ("BBB", "2024-01"): (1, 60)}
    written = bars.built_months(spark, panel).collect()
    zipped_file(raw / "AAA" / "AAA-1m-2024-02.zip", FIRST["2024-02"], 60_000, 30, True)
    with pytest.raises(Exception, match="Cut"):
        run(cut)
    run()
    run()  # nothing is new
    assert months_of() == {("AAA", "2024-01"): (2, 90), ("AAA", "2024-02"): (1, 30), ("BBB", "2024-01"): (1, 60)}
    assert set(written) <= set(bars.built_months(spark, panel).collect())  # what was built stays as it is
