import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arealens.llm import tokens
from arealens.session import scratch_path
from tests.llm import helpers as H

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files")


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def changes(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_docs long, n_tokens long")


def test_batches_count_once_and_deltas_add_up(spark):
    store = tokens.Rollup(spark, scratch_path(spark, "rollup"))
    assert totals(store) == {} and store.batches() == []
    a, v = ("s", "en", "v1"), (None, None, "v1")
    assert store.commit("b1", changes(spark, [(*a, 1, 10), (*a, 1, 5), (*v, 1, 7)]))
    assert not store.commit("b1", changes(spark, [(*a, 1, 1000)]))
    assert totals(store) == {a: (2, 15), v: (1, 7)}
    assert store.commit("b2", changes(spark, [(*a, -1, -5), (*a, 1, 6), (*v, -1, -7)]))
    assert totals(store) == {a: (2, 16), v: (0, 0)}
    store.compact()
    assert totals(store) == {a: (2, 16), v: (0, 0)} and store.batches() == ["b1", "b2"]
    assert not store.commit("b2", changes(spark, [(*a, 1, 1000)]))
    assert store.commit("b3", changes(spark, []))
    store.compact()
    assert totals(store) == {a: (2, 16), v: (0, 0)} and store.batches() == ["b1", "b2", "b3"]
    with pytest.raises(ValueError):
        store.commit("../x", changes(spark, []))


def test_unfinished_batches_do_not_count(spark, tmp_path):
    store = tokens.Rollup(spark, str(tmp_path / "store"))
    store.commit("b1", changes(spark, [("s", "en", "v1", 1, 10)]))
    os.remove(tmp_path / "store" / "batch=b1" / "_SUCCESS")
    assert totals(store) == {} and store.batches() == []
    assert store.commit("b1", changes(spark, [("s", "en", "v1", 1, 10)]))
    assert totals(store) == {("s", "en", "v1"): (1, 10)}


@needs_ranks
def test_counts_are_those_of_the_encoder(spark):
    import tiktoken  # noqa: F401

    rows = H.awkward()
    got = tokens.count_tokens(H.table(spark, rows).withColumn("n_words", F.lit(-1)), {"bpe": RANKS, "words": "words"}).collect()
    count = tokens.encoder(RANKS)
    want = Counter((r[0], count(r[1] or ""), len((r[1] or "").encode().split())) for r in rows)
    assert Counter((r.doc_id, r.n_bpe, r.n_words) for r in got) == want


@needs_ranks
def test_maintained_totals_equal_a_recount_of_what_is_left(spark):
    rows = H.awkward() + [(900, "two  blanks\t\there", "en", "b", 1)]
    store = tokens.maintain(H.table(spark, rows), scratch_path(spark, "rollup"), {"bpe": RANKS, "words": "words"})
    order = lambda r: (r[0] is None, r[0] or 0, r[3] is not None, r[3] or "", r[2] is not None, r[2] or "")
    left, seen = [], set()
    for r in sorted(rows, key=order):
        if r[1] is None or r[1] not in seen:
            left.append(r)
            seen.add(r[1])
    count, want = tokens.encoder(RANKS), Counter()
    import re

    for _, text, lang, source, _ in left:
        neat = re.sub(r"[ \t]+", " ", (text or "").strip(" "))
        for v, n in (("bpe", count(neat)), ("words", len(neat.split()))):
            want[(source, lang, v, "d")] += 1
            want[(source, lang, v, "t")] += n
    got = {k: v for k, v in totals(store).items() if v != (0, 0)}
    assert got == {k[:3]: (n, want[(*k[:3], "t")]) for k, n in want.items() if k[3] == "d" and n}
    assert store.batches() == ["load", "revise", "withdraw"]


def test_empty_table(spark):
    store = tokens.maintain(H.table(spark, []), scratch_path(spark, f"rollup-{uuid.uuid4().hex[:6]}"), {"words": "words"})
    assert totals(store) == {}
