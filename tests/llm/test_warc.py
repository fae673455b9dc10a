"""Archives against the pages they were written from."""

import gzip
import hashlib
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from adsift.llm import warc
from adsift.llm.common import stage

SCHEMA = "page_id long, url string, html string, file string, digest int, kind string"
LARGE, OTHER = "<p>é</p>\r\n\r\n" * 200, "WARC/1.1\r\n" * 300
ROWS = [
    (1, "http://a.net/é x", LARGE),
    (2, None, LARGE),
    (9, "http://b.org/\r\nX-Evil: 1", LARGE),
    (3, "u", OTHER),
    (4, "u", "x" * 999),
    (5, "u", "x" * 999),
    (6, "u", "y" * 1000),
    (7, "u", "y" * 1000),
    (8, "u", None),
    (10, "u", ""),
    (11, "u", "é" * 500),
    (12, "u", "é" * 500),
    (9, "http://b.org/", LARGE),
    (None, "u", OTHER),
    (None, "u", "only null ids" * 100),
    (None, "v", "only null ids" * 100),
    (20, "u", "long " * 400_000),
]


def brute(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    found = Counter()
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        digest = hashlib.sha1(payload).hexdigest()
        for k, page_id in enumerate(ids, 1):
            kept = len(payload) < 1000 or k == len(ids)
            kind, refers = ("response", None) if kept else ("revisit", ids[-1])
            found[page_id, len(payload), digest, kind, refers] += 1
    return found


def pages(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, "k") for r in rows], SCHEMA)


def test_pages_come_back(spark):
    got = Counter(tuple(r) for r in warc.page_records(pages(spark, ROWS)).collect())
    assert got == brute(ROWS)


def test_a_group_with_most_of_the_rows(spark):
    rows = [(i, f"u{i}", LARGE if i % 3 else f"{i} " * 400) for i in range(1500)]
    got = Counter(tuple(r) for r in warc.page_records(pages(spark, rows)).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert warc.page_records(pages(spark, [])).collect() == []


def test_files_are_plain_warc(spark, tmp_path):
    """Each record is a gzip member that any reader finds; whole files unpack as one."""
    archive = warc.write_archive(pages(spark, ROWS).coalesce(1), str(tmp_path), file_bytes=4000)
    index = archive.index.collect()
    assert len({r["file"] for r in index}) > 1
    assert {r["file"] for r in index} == set(os.listdir(tmp_path))
    for row in index:
        with open(tmp_path / row["file"], "rb") as f:
            f.seek(row["offset"])
            record = gzip.decompress(f.read(row["length"]))
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
        assert record.endswith(b"\r\n\r\n") and b"X-Evil" not in record.partition(b"\r\n\r\n")[0].replace(b"%0D%0AX-Evil", b"")
    read = warc.read_archive(archive, payloads=True).collect()
    assert Counter(r["payload"].decode() for r in read) == Counter(h or "" for _, _, h in ROWS)


def test_deduplicated_files(spark):
    first = warc.write_archive(pages(spark, ROWS))
    second = warc.deduplicate(first)
    records = {r["record_id"]: r for r in warc.read_archive(second, payloads=True).collect()}
    assert len(records) == len(ROWS)
    revisits = [r for r in records.values() if r["kind"] == "revisit"]
    assert len(revisits) == sum(n for (*_, kind, _), n in brute(ROWS).items() if kind == "revisit")
    for r in revisits:
        origin = records[r["refers_to"]]
        assert origin["kind"] == "response" and origin["digest"] == r["digest"]
        assert r["payload"] == b"" and origin["payload_bytes"] == r["payload_bytes"]
    # What stays is copied as it is.
    before = {r["record_id"] for r in first.index.collect()}
    assert {i for i, r in records.items() if r["kind"] == "response"} <= before
    assert not before & {r["record_id"] for r in revisits}


def test_revisits_that_are_there_already(spark):
    """Deduplicated again with a later copy, old revisits go to the new response; one
    whose response is not in the archive stays as it is."""
    once = warc.deduplicate(warc.write_archive(pages(spark, ROWS)))
    folder = once.folder
    later = warc.write_archive(pages(spark, [(30, "u", LARGE)]), folder)
    lost = once.index.where("digest <> '{}' or kind = 'revisit'".format(hashlib.sha1(OTHER.encode()).hexdigest()))
    both = warc.Archive(folder, stage(lost.unionAll(later.index), "both"))
    again = warc.read_archive(warc.deduplicate(both)).collect()
    ids = {r["record_id"]: r["page_id"] for r in again}
    digest = hashlib.sha1(LARGE.encode()).hexdigest()
    group = [r for r in again if r["digest"] == digest]
    assert [r["page_id"] for r in group if r["kind"] == "response"] == [30]
    assert all(ids[r["refers_to"]] == 30 for r in group if r["kind"] == "revisit") and len(group) == 5
    orphans = [r for r in again if r["digest"] == hashlib.sha1(OTHER.encode()).hexdigest()]
    assert [(r["kind"], r["refers_to"] in ids) for r in orphans] == [("revisit", False)]


def test_damaged_records_are_errors():
    record = gzip.decompress(warc.record_bytes({"WARC-Type": "response"}, b"block"))
    assert warc.parsed(record) == ({"warc-type": "response", "content-length": "5"}, b"block")
    with pytest.raises(ValueError):
        warc.parsed(record[:-1])
    with pytest.raises(ValueError):
        warc.parsed(b"HTTP/1.1 200 OK\r\n\r\n")


def test_index_holds_headers_only(spark):
    """What is shuffled to resolve revisits has no payload."""
    index = warc.write_archive(pages(spark, ROWS)).index
    assert "payload" not in index.columns
    assert index.agg(F.sum("payload_bytes")).first()[0] > 2_000_000
