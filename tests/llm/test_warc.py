"""WARC: bytes of records, archives read back, damage, edge cases."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/%0A\r\nWARC-Type: x", ""),
    (5, "http://a/5", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "u", "x" * 300_000), (6, "u", "x" * 300_000), (None, "n", "<p>same</p>"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("body", F.lit(1))


def plain(rows, min_bytes=0):
    """(page_id, url, payload, digest, type, refers_to) of every row."""
    out = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, other in rows if (other or "") == (html or "") and p is not None]
        best = max(ids, default=None)
        revisit = len(data) >= min_bytes and page_id != best
        sha1 = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, url or "", data, sha1, "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def back(spark, folder):
    rows = warc.read_archive(spark, folder).collect()
    assert all(r["verified"] and r["payload_bytes"] == len(r["payload"]) for r in rows)
    return sorted([(r["page_id"], r["url"], bytes(r["payload"]), r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows], key=str)


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_round_trip(spark, tmp_path, min_bytes):
    folder = warc.write_archive(pages(spark).repartition(4), str(tmp_path / "a"), min_bytes)
    assert back(spark, folder) == plain(PAGES, min_bytes)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in PAGES})


def test_payloads_stay_where_they_are(spark, tmp_path, capsys, monkeypatch):
    """Payloads are stored once without a shuffle of them; the same ones with many repeated responses."""
    warc.write_warc(pages(spark).repartition(4), str(tmp_path / "w"), 100)
    records = warc.read_warc(spark, str(tmp_path / "w"))
    places = records.where(warc.header_field(F.col("header"), "WARC-Type") == "response").select("sha256", "file", "at")
    once = warc.payloads_once(records, places)
    once.explain()
    above = capsys.readouterr().out.split("BroadcastExchange")[0]
    assert "LeftAnti" in above and "Exchange" not in above
    expected = sorted((hashlib.sha256((h or "").encode()).hexdigest(), (h or "").encode()) for h in {h or "" for _, _, h in PAGES})
    assert sorted((r["digest"], bytes(r["payload"])) for r in once.collect()) == expected
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted((r["digest"], bytes(r["payload"])) for r in warc.payloads_once(records, places).collect()) == expected


def test_files_are_warc(spark, tmp_path):
    warc.write_warc(pages(spark), str(tmp_path / "w"))
    whole = [gzip.decompress(f.read_bytes()) for f in sorted(Path(tmp_path / "w").glob("part-*"))]
    found = [r for data in whole for r in warc.parse_warc(data)]
    assert len(found) == len(PAGES)
    for header, body in found:
        lines = header.decode().split("\r\n")
        names = [x.split(":")[0] for x in lines[1:-2]]
        assert lines[0] == "WARC/1.1" and lines[-2:] == ["", ""]
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(names)
        assert f"Content-Length: {len(body)}" in lines
    # Nothing stands between the records but their ends.
    assert all(b"".join(h + b + b"\r\n\r\n" for h, b in warc.parse_warc(data)) == data for data in whole)


def test_damage(spark, tmp_path):
    folder = warc.write_archive(pages(spark), str(tmp_path / "a"))
    stored = spark.read.parquet(f"{folder}/payloads")
    damaged = stored.withColumn("payload", F.when(F.octet_length("payload") > 1000, F.encode(F.lit("y"), "UTF-8")).otherwise(F.col("payload")))
    damaged.where(F.octet_length("payload") > 0).write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(f"{folder}/headers").write.parquet(str(tmp_path / "b" / "headers"))
    got = [(r["page_id"], r["verified"]) for r in warc.read_archive(spark, str(tmp_path / "b")).collect()]
    assert sorted(got, key=str) == sorted([(p, p not in (3, 4, 6)) for p, _, _ in PAGES], key=str)


def test_cut_files():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.parse_warc(good * 2)) == [(good[:-7], b"abc")] * 2 and list(warc.parse_warc(b"")) == []
    for bad in (good[:-6], good[:15], b"HTTP/1.1 200\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_warc(bad))


def test_empty(spark, tmp_path):
    assert back(spark, warc.write_archive(pages(spark, []), str(tmp_path / "a"))) == []
