import base64
import hashlib

import pytest

from arealens.llm import warc

PAGES = "page_id long, url string, html string, kind string"
ROWS = [
    (1, "http://a/ b\r\nX: y", "<p>one</p>", "k"), (2, None, "<p>one</p>", "k"), (3, "http://c", None, "k"), (4, "http://d", "", "k"),
    (5, "http://e", "x" * 300_000, "k"), (6, "http://f", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\0é", "k"),
    (7, "http://g", "<p>one</p>", "k"), (7, "http://g", "<p>one</p>", "k"), (None, "http://h", "<p>one</p>", "k"), (None, None, "alone", "k"),
]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    got = warc.round_trip(spark.createDataFrame(ROWS, PAGES).repartition(3), min_bytes=min_bytes).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(ROWS)
    name = lambda k: f"<urn:x-page:{'none' if k is None else k}>"
    want = []
    for key, _, html, _ in ROWS:
        same = [k for k, _, h, _ in ROWS if (h or "") == (html or "") and k is not None]
        last = max(same, default=None) if len((html or "").encode()) >= min_bytes else key
        kind = "response" if key == last or last is None else "revisit"
        want.append((name(key), len((html or "").encode()), sha(html), kind, name(last) if kind == "revisit" else None))
    assert sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "") for r in got) == sorted(
        (*w[:4], w[4] or "") for w in want
    )


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def record(i, body=b"<p>hello</p>" * 20):
    return warc.record_bytes(i, "http://x", body + str(i).encode(), "response", None)


def ids(rows):
    return [r["record_id"] for r in rows if r["kind"] == "record"]


def covers(rows, data):
    edges = [(r["start"], r["end"]) for r in rows]
    return edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_every_kind_of_damage(packed):
    parts = [warc.member(record(i)) if packed else record(i) for i in range(5)]
    whole = b"".join(parts)
    assert len(ids(warc.salvage(whole))) == 5
    start = len(parts[0]) + len(parts[1])
    flipped = bytearray(whole)
    flipped[start + len(parts[2]) // 2] ^= 0xFF
    cases = {
        "flipped byte": bytes(flipped),
        "missing bytes": whole[: start + 20] + whole[start + 40 :],
        "junk between": whole[:start] + b"\x1f\x8b\x08junk WARC/1.1\r\nno" + whole[start:],
        "cut end": whole[:-30],
        "broken start": whole[10:],
    }
    for name, data in cases.items():
        rows = list(warc.salvage(data))
        assert covers(rows, data), name
        assert sum(r["kind"] == "gap" for r in rows) == 1, name
        lost = 0 if name == "junk between" else 1
        assert len(ids(rows)) == 5 - lost, name
    assert list(warc.salvage(b"")) == []
    assert [r["kind"] for r in warc.salvage(b"nothing here")] == ["gap"]


def test_member_with_several_records_keeps_the_sound_ones():
    bad = record(2).replace(b"hello", b"hullo", 1)
    data = warc.member(record(0) + record(1) + bad) + warc.member(record(3))
    rows = list(warc.salvage(data))
    assert ids(rows) == ["<urn:x-page:0>", "<urn:x-page:1>", "<urn:x-page:3>"]
    assert [r["reason"] for r in rows if r["kind"] == "gap"] == ["later records of this member fail their checks"]


def test_reader_logs_gaps_of_damaged_files(spark, tmp_path):
    path = tmp_path / "a.warc"
    path.write_bytes(record(0) + b"garbage" + record(1))
    (tmp_path / "b.warc.gz").write_bytes(warc.member(record(2))[:-8])
    got = warc.read_archives(spark, [str(tmp_path)]).collect()
    assert sorted(r.record_id for r in got if r.kind == "record") == ["<urn:x-page:0>", "<urn:x-page:1>"]
    assert {(r.path.rsplit("/", 1)[1], r.end - r.start) for r in got if r.kind == "gap"} == {("a.warc", 7), ("b.warc.gz", len(warc.member(record(2))) - 8)}


def test_headers_of_any_length(spark):
    url = "http://x/" + " " * 70_000
    long = warc.record_bytes(1, url, b"<p>long</p>", "response", None)
    for whole in (long + record(2), warc.member(long) + warc.member(record(2))):
        assert len(ids(warc.salvage(whole))) == 2
    # a header without its end does not reach into the next record
    cut = long[: long.index(b"\r\n\r\n")] + b"\r\n" + record(2)
    rows = list(warc.salvage(cut))
    assert len(ids(rows)) == 1 and covers(rows, cut)
    got = warc.round_trip(spark.createDataFrame([(1, url, "<p>one</p>", "k"), (2, "http://y", "<p>two</p>", "k")], PAGES)).collect()
    assert [r.kind for r in got] == ["record"] * 2
