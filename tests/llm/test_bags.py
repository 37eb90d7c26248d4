import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from arealens.llm import bags
from tests.llm import helpers as H

ITEMS = "item_id long, text string, doc_id string"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(rows, items, top):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows if terms(r[1])]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys((i[0], i[1]) for i in items):
        found = []
        for key, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, *_, key) in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return out


def some_items(rows, seed):
    rng = random.Random(seed)
    words = [w for r in rows for w in (r[1] or "").split()]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), "x") for i in range(15)]
    items += [(20, None, "x"), (21, "", "x"), (22, " -- ", "x"), (23, "neverseen", "x"), (None, rows[0][1], "x"), (3, "AB1 ab1 Ab1 é é", "x")]
    return items + items[:2]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("seed, top, block", [(1, 20, 1 << 20), (2, 3, 1 << 20), (3, 5, 200)])
def test_same_as_brute_force(spark, seed, top, block):
    rows = H.awkward(seed)
    rows += [(500 - i, "ab1 cd2 ef3 only these words stand here", "en", "hot", 1) for i in range(30)]
    rows += [(600 + i, "ab1 cd2 ef3, only THESE words stand here!", "en", "hot", 1) for i in range(30)]
    items = some_items(rows, seed) + [(30, "ab1 these stand", "x")]
    got = bags.search(H.with_clashes(H.table(spark, rows, 4)), spark.createDataFrame(items, ITEMS), top, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(tuple(r) for r in got.collect()) == order(brute(rows, items, top))


def test_a_class_is_scored_once_and_keeps_its_smallest_keys(spark):
    rows = [(i, "same words here", "en", "hot", 1) for i in range(99, -1, -1)] + [(200, "other words", "en", "hot", 1)]
    block = bags.Items([(1, "same words")])
    found = bags.bags(H.table(spark, rows, 5), block.hashes, "doc_id", "text")
    got = sorted(tuple(r.members) for r in bags.classes(found, 101, 302, 20).collect())
    assert got == [tuple(range(20)), (200,)]


def test_best_keeps_ties_by_key_over_many_calls():
    rng = np.random.default_rng(3)
    best, seen = bags.Best(4, 5), []
    for _ in range(12):
        scored = rng.integers(0, 6, (30, 4))
        members = [np.sort(rng.integers(0, 10**6, rng.integers(1, 4))) for _ in range(30)]
        best.add(scored, members)
        seen += [(i, -int(scored[c, i]), int(d)) for c in range(30) for i in range(4) for d in members[c] if scored[c, i] > 0]
    want = [x for i in range(4) for x in sorted(s for s in seen if s[0] == i)[:5]]
    assert list(zip(best.item.tolist(), (-best.score).tolist(), best.doc.tolist())) == want


def test_scores_in_small_pieces(monkeypatch):
    block = bags.Items([(1, "a b b c"), (2, "b"), (3, "c d e")])
    rng = np.random.default_rng(1)
    terms_ = np.sort(rng.integers(0, len(block.hashes), 40))
    args = (np.array([80, 100]), np.array([0, 15, 40]), terms_, rng.integers(1, 9, 40), block, np.arange(1, len(block.hashes) + 1))
    whole = bags.scores(*args)
    monkeypatch.setattr(bags, "CELLS", 3)
    assert whole.tolist() == bags.scores(*args).tolist() and whole.any()


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "ab1", "x")], ITEMS)
    assert bags.search(H.table(spark, []), some).count() == 0
    got = bags.search(H.table(spark, H.awkward(1)), none)
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
