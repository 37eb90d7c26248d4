import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.llm import substring
from tests.llm import helpers as H


def brute(rows, width):
    key = lambda r: (r[0] is not None, r[0] or 0)
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            first[s] = min(first.get(s, key(r)), key(r))
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if key(r) > first[tuple(w[i : i + width])]:
                gone |= set(range(i, i + width))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("seed, width, parts", [(1, 13, 3), (2, 3, 1), (3, 2, 7)])
def test_same_as_brute_force(spark, seed, width, parts):
    rows = H.awkward(seed)
    rng = random.Random(seed)
    rows += [(500 + i, " ".join(rng.choice("ab c".split()) for _ in range(rng.randint(0, 30))), "en", "hot", 1) for i in range(30)]
    got = substring.remove_repeats(H.with_clashes(H.table(spark, rows, parts)), width).collect()
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == ordered(brute(rows, width))
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_other_white_space_belongs_to_words(spark):
    text = "a b c\x1cd e f g\x85h " * 4
    got = substring.remove_repeats(spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string"), 3).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 16, 0), (2, 16, 16)]


def test_empty_table(spark):
    assert substring.remove_repeats(H.table(spark, [])).count() == 0


def test_packing_keeps_56_bits():
    values = np.random.default_rng(1).integers(0, 1 << 63, 100, dtype=np.uint64)
    assert (substring.unpack7(substring.pack7(values)) == values & np.uint64((1 << 56) - 1)).all()


def test_a_hot_window_sends_one_entry_per_batch(spark):
    rows = [(i, "one hot passage of words that all documents hold " + str(i), "en", "hot", 1) for i in range(3000)]
    plain = H.table(spark, rows, 2).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_sum"), F.col("text").alias("_text"))
    packed = substring.pack_windows(plain, 5, 4).filter("not local").select(F.sum(F.length("payload")) / 7).first()[0]
    assert packed < 3000 + 2 * 50
