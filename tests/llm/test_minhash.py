import random
import re

import numpy as np
import pytest

from arealens.llm import graph, minhash
from tests.llm import helpers as H


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def brute(rows):
    """(doc_id, n_shingles, component_id, kept), with rows of one key as one document and NULL keys apart."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    sets = [shingle_set(r[1]) for r in order]
    root = H.components(list(zip(sets, [r[0] for r in order])), lambda a, b: linked(a[0], b[0]) or (a[1] is not None and a[1] == b[1]))
    return [(r[0], len(s), order[i][0], r[0] == order[i][0]) for r, s, i in zip(order, sets, root)]


def family_rows(seed, families=8, n=30):
    rng, rows = random.Random(seed), []
    for f in range(families):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(20, 150))]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(own), "en", "hot", 1))
    rng.shuffle(rows)
    return rows


def without_null_keys(rows):
    return [r for r in rows if r[0] is not None]


@pytest.mark.parametrize("seed, task_shingles", [(1, minhash.TASK_SHINGLES), (2, 300)])
def test_components_same_as_brute_force(spark, seed, task_shingles):
    rows = without_null_keys(H.awkward(seed)) + [(1000 + r[0], *r[1:]) for r in family_rows(seed, 5, 25 if task_shingles > 1000 else 12)]
    got = minhash.near_duplicates(H.with_clashes(H.table(spark, rows)), task_shingles=task_shingles).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(brute(rows))


def test_rows_without_a_key_are_documents_of_their_own(spark):
    rows = [(None, "a b c d e f g h"), (None, "one two three four five six"), (3, "a b c d e f g h"), (4, None), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in got), key=str) == sorted(
        [(None, None, True, 4), (None, None, True, 2), (3, None, False, 4), (4, 4, True, 0), (None, None, True, 0)], key=str
    )


def test_one_of_each_keeps_all_columns(spark):
    rows = H.awkward(4)
    got = minhash.one_of_each(H.with_clashes(H.table(spark, rows))).collect()
    roots = {r[2] for r in brute(without_null_keys(rows))}
    with_null = [r for r in rows if r[0] is None and r[1]]
    near_null = {r[0] for r in without_null_keys(rows) if any(linked(shingle_set(r[1]), shingle_set(n[1])) for n in with_null)}
    assert {r.doc_id for r in got if r.doc_id is not None} == roots - near_null
    assert all(r.node == "mine" for r in got) and len({(r.doc_id, r.text) for r in got}) == len(got)


def test_different_texts_of_one_key_all_stay(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "totally different words stand in this one", "alpha  beta gamma delta epsilon zeta", None, None]
    got = minhash.one_of_each(H.table(spark, [(1, t, "en", "hot", 1) for t in texts])).collect()
    assert sorted(r.text or "" for r in got) in (["", *sorted(texts[:2])], ["", *sorted(texts[1:3])])


def test_empty_table(spark):
    assert minhash.near_duplicates(H.table(spark, [])).count() == 0
    assert minhash.one_of_each(H.table(spark, [])).count() == 0


def plain_superminhash(values, m):
    """The same signature, one shingle and one rank at a time."""
    out = [0xFFFFFFFF] * m
    for v in values:
        order = list(range(m))
        for j in range(m):
            x = int(minhash.tb.mix(np.array([(int(v) + int(minhash.STEP) * (j + 1)) % (1 << 64)], np.uint64))[0])
            k = j + ((x >> 32) * (m - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 22 | x & 0x3FFFFF)
    return out


def test_signature_with_early_stopping_equals_the_plain_one():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40):
        values = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        got = minhash.superminhash(values, np.zeros(n, np.int64), 1, 24)[0]
        assert got.tolist() == plain_superminhash(values, 24)


def test_signatures_estimate_similarity_better_than_independent_minima():
    rng, errors = np.random.default_rng(4), []
    for _ in range(200):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (30, 10, 10))
        values, rows = np.concatenate([both, a, both, b]), np.repeat([0, 1], 40)
        s = minhash.superminhash(values, rows, 2, 64)
        errors.append((s[0] == s[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.square(errors)) < 0.6 * 0.4 / 64


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(600, i) for i in range(601, 700)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    names = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(names)}
    pairs = {frozenset((at[a], at[b])) for a, b in edges}
    root = H.components(list(range(len(names))), lambda a, b: frozenset((a, b)) in pairs)
    assert got == {n: names[root[at[n]]] for n in names if any(n in e and e[0] != e[1] for e in edges)}
