import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inodelake.llm import warc
from inodelake.llm.queries import ORACLES, QUERIES
from inodelake.runtime import shared_folder

PAGES = "page_id long, url string, html string, digest string, row int, type string, payload string"


def test_equals_sql(same):
    same(QUERIES["op8_warc"], ORACLES["op8_warc"])


@pytest.fixture
def stored(spark, tmp_path):
    def run(rows, **how):
        folder = f"{shared_folder(spark)}/warc"
        pages = spark.createDataFrame([(*r, "d", 1, "t", "p") for r in rows], PAGES)
        pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
        manifest = warc.write_archives(spark.read.parquet(str(tmp_path / "pages")), folder, **how)
        return manifest, folder

    return run


def test_round_trip_of_odd_pages(spark, stored):
    big, small = "<p>é\r\n\r\n" * 20_000, "x" * 99
    rows = [(3, "http://a/\r\nWARC-Type: x", big), (2, None, big), (9, "u", big), (9, "u", big), (None, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u: v", "y" * 100), (None, None, None)]
    manifest, folder = stored(rows, size=1000)
    got = warc.captures(warc.read_records(manifest, folder, with_payload=True)).collect()
    assert len(got) == len(rows) == manifest.agg(F.sum("captures")).first()[0]
    seen = []
    for r in got:
        assert r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata"
        page, ref = (r["metadata"]["fields"].get(k) for k in ("pageId", "refersToPageId"))
        seen.append((page, r["main"]["type"], ref, r["main"]["payload_bytes"]))
        if r["main"]["type"] == "response":
            assert hashlib.sha256(bytes(r["main"]["payload"])).hexdigest() == r["main"]["digest"]
        else:
            assert r["main"]["payload"] is None and r["main"]["refers_to"] in {x["record_id"] for x in got}
    n = len(big.encode())
    want = [("2", "response", None, n), ("3", "revisit", "2", n), ("9", "revisit", "2", n), ("9", "revisit", "2", n), (None, "revisit", "2", n)]
    want += [("4", "response", None, 99), ("5", "response", None, 99), ("6", "response", None, 0), ("7", "response", None, 0), ("8", "response", None, 100), (None, "response", None, 0)]
    assert sorted(map(str, seen)) == sorted(map(str, want))


def test_repeated_rows_have_one_response(spark, stored):
    manifest, folder = stored([(1, "u", "z" * 200)] * 3)
    kinds = sorted(r["main"]["type"] for r in warc.captures(warc.read_records(manifest, folder)).collect())
    assert kinds == ["response", "revisit", "revisit"]


def test_damage_is_seen():
    raw = warc.capture(1, 1, "u", b"payload" * 50, hashlib.sha256(b"payload" * 50).hexdigest(), None, None)
    with pytest.raises((EOFError, Exception)):
        list(warc.members(raw[:-5]))
    one = next(warc.members(raw))
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(one.replace(b"payloadpayload", b"payloadPAYLOAD", 1), False)


def test_no_pages(spark, stored):
    manifest, folder = stored([])
    assert manifest.count() == 0 and warc.read_records(manifest, folder).count() == 0


def test_files_of_other_attempts_are_not_read(spark, stored):
    manifest, folder = stored([(k, "u", "z" * 200) for k in range(20)], size=1000)
    files = [r["file"] for r in manifest.collect()]
    assert len(files) > 1
    at = Path(files[0].removeprefix("file://"))
    (at.parent / "part-000000-0123456789abcdef.warc.gz").write_bytes(at.read_bytes())
    (at.parent / "part-000001-00000000000000ff.warc.gz").write_bytes(b"half a file")
    assert warc.captures(warc.read_records(manifest, folder)).count() == 20 and warc.read_records(manifest, folder).count() == 60


def test_many_revisits_are_merged(spark, stored, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", 2)
    manifest, folder = stored([(k, "u", "z" * 200) for k in range(9)])
    got = warc.captures(warc.read_records(manifest, folder)).collect()
    assert sorted((r["metadata"]["fields"]["pageId"], r["main"]["type"]) for r in got) == [("0", "response"), *((str(k), "revisit") for k in range(1, 9))]


def test_clashing_and_missing_identifiers(spark):
    row = lambda kind, own, of, uri: (kind, own, of, None, uri, "d", 1, None, {"x": uri})
    rows = [row("response", "m", None, "b"), row("response", "m", None, "a"), row("request", "q2", "m", "u"), row("request", "q1", "m", "u"), row("metadata", "x", "nobody", "u"), row("metadata", "y", None, "u"), row("revisit", None, None, "u"), row("revisit", "n", None, "u")]
    for some in (rows, rows[::-1]):
        got = {r["record_id"]: r for r in warc.captures(spark.createDataFrame(some, warc.RECORD)).collect()}
        assert sorted(got) == ["m", "n"]
        assert got["m"]["main"]["uri"] == "a" and got["m"]["request"]["record_id"] == "q1" and got["m"]["metadata"] is None and got["n"]["request"] is None
