import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arealens.llm import syncmers, textbatch as tb
from tests.llm import helpers as H


def one(text, k=12, s=4):
    return syncmers.fingerprints(*tb.utf8(pa.array([text])), k, s)[0]


def test_anchors_are_the_closed_syncmers():
    text = "the quick brown fox jumps over the lazy dog and runs away from here " * 3
    data = np.frombuffer(text.encode(), np.uint8)
    inner = tb.mix(tb.fixed_hash(tb.rolling_prefix(tb.BYTE_CODE[data]), 4))
    want = [i for i in range(len(data) - 11) if min(inner[i : i + 9]) in (inner[i], inner[i + 8])]
    assert one(text)[1].tolist() == want


def test_anchors_do_not_depend_on_their_surroundings():
    body = "some passage that stands in two places, long enough to hold several anchors of its own"
    alone = dict(zip(one(body)[1].tolist(), one(body)[0].tolist()))
    for front in ("x", "another beginning é ", ""):
        shift = len(front.encode())
        inside = dict(zip((one(front + body + " end")[1] - shift).tolist(), one(front + body + " end")[0].tolist()))
        assert {p: h for p, h in inside.items() if 0 <= p <= len(body) - 12} == alone


def test_written_form_reads_back():
    mark = one("a longer text with words enough for anchors, written and read back again")
    back = syncmers.read(syncmers.written(mark))
    assert back[0].tolist() == mark[0].tolist() and back[1].tolist() == mark[1].tolist()
    assert syncmers.written(one("")) == "" and len(syncmers.read("")[0]) == 0


def test_likeness():
    a = one("first half of this text is shared by both of them, word for word and in order. " * 2)
    assert syncmers.likeness(a, a) == 1.0
    assert syncmers.likeness(one(""), one("")) == 1.0 and syncmers.likeness(one(""), a) == 0.0
    assert syncmers.likeness(one("short"), one("short")) == 1.0 and syncmers.likeness(one("short"), one("shirt")) == 0.0


def test_edited_texts_follow_the_next_document_across_partitions(spark):
    rows = H.awkward(n=60)
    got = syncmers.edit_resilience(H.with_clashes(H.table(spark, rows, 5))).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        own, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(own) // 2
        want.append((r[0], len(own), hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted(want, key=key)
    by_text = {}
    texts = {(r[0], len(r[1] or "")): r[1] or "" for r in rows}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(texts[(r.doc_id, r.n_chars)], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    for r, (a, after) in zip(sorted(got, key=lambda r: key((r.doc_id, r.n_chars, ""))), []):
        assert r


def test_one_row_and_no_rows(spark):
    got = syncmers.edit_resilience(H.table(spark, [(5, "abcdef", "en", "s", 6)])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in got] == [(5, 6, 1.0)]
    assert got[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert syncmers.edit_resilience(H.table(spark, [])).count() == 0


def test_table_of_fingerprints(spark):
    got = syncmers.fingerprint_table(H.table(spark, H.awkward())).withColumn("same", F.count("*").over(__import__("pyspark").sql.Window.partitionBy("fingerprint")))
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert rows[61].n_anchors == 0 and rows[62].fingerprint == "" and rows[60].same >= 2
