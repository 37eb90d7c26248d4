import random

import numpy as np
import pytest

from arealens.llm import quality
from tests.llm import helpers as H

GOOD = "river stone garden window morning paper letter music quiet market bridge winter story people answer".split()
BAD = "zork blip quux frob".split()
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n, seed=1):
    """Clean prose, shouting junk (seen by its layout) and prose with bad words (seen by its content)."""
    rng, docs, truth = random.Random(seed), [], {}
    for i in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 80))]
        kind = rng.choice("gggjt")
        if kind == "j":
            words = [w.upper() + "!!" for w in words]
        if kind == "t":
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["a", "en", "ish"])
        docs.append((i, " ".join(words), "en", rng.choice(["hot", "b"]), 1))
        truth[i] = (1, 0) if kind == "g" else (0, 0) if kind == "j" else (1, 1)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(3000)
    labels = [(i, *truth[i], "x") for i in range(0, 3000, 3)]
    got = quality.classify(H.with_clashes(H.table(spark, docs)).drop("score", "keep"), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 3000
    held = [(r.keep, truth[r.doc_id] == (1, 0)) for r in got if r.doc_id % 3]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([a for a, b in held if b]) > 0.98
    assert all(0 <= r.p_content <= 1 and 0 <= r.p_meta <= 1 and 0 <= r.score <= 1 and r.node == "mine" for r in got)


def test_each_view_sees_its_own_side(spark):
    docs, truth = corpus(1500, 2)
    labels = spark.createDataFrame([(i, *truth[i], "x") for i in range(0, 1500, 2)], LABELS)
    rows = quality.classify(H.table(spark, docs), labels).collect()
    mean = lambda f, c: np.mean([getattr(r, c) for r in rows if truth[r.doc_id] == f])
    assert mean((1, 1), "p_content") < 0.3 < mean((1, 1), "p_meta")
    assert mean((0, 0), "p_meta") < 0.2


def test_pseudo_labels_teach_the_other_view():
    rng = np.random.default_rng(1)
    n = 1200
    y = rng.integers(0, 2, n)
    meta = np.stack([y + rng.normal(0, 0.05, n), rng.normal(0, 1, n)], axis=1).astype(np.float32)
    slots = np.where(rng.random((n, 6)) < 0.9, y[:, None] * 100, (1 - y[:, None]) * 100) + rng.integers(0, 60, (n, 6))
    sample = quality.Sample([np.unique(x) for x in slots], meta)
    given = np.where(np.arange(n) < 40, y, -1)
    seen = []
    for rounds in (0, 3):
        model = quality.co_train(sample, given, rounds=rounds, confident=300, sure=0.8)
        margin = model.content.margins(sample)
        seen.append(((margin > 0) == (y > 0))[40:].mean())
    assert seen[1] > seen[0] + 0.02


@pytest.mark.parametrize("labels", [[], [(0, 1, 0, "x")], [(i, 1, 0, "x") for i in range(20)], [(None, 0, 0, "x"), (1, None, 1, "x")]])
def test_without_two_classes_everything_stays(spark, labels):
    rows = H.awkward()
    got = quality.classify(H.table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and {(r.score, r.keep) for r in got} == {(0.5, True)}


def test_awkward_rows_and_repeated_labels(spark):
    docs, truth = corpus(300, 3)
    rows = docs + [(1000 + (r[0] or 0), *r[1:]) for r in H.awkward()] + [(None, None, None, None, None)]
    labels = [(i, *truth[i], "x") for i in range(0, 300, 2)] * 2 + [(1, 1, None, "x"), (1, 0, 0, "x")]
    got = quality.classify(H.table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    assert quality.classify(H.table(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_one_round_of_exchange_against_brute_force(spark):
    docs, truth = corpus(600, 5)
    docs += [(5000 + i, docs[7][1], "en", "hot", 1) for i in range(200)] + [(None, None, None, None, None), (6000, "", "en", "b", 0)]
    table = H.table(spark, docs, 5)
    rows = table.select(quality.F.xxhash64("text").alias("_sum"), quality.F.col("text").alias("_text"), quality.code("lang").alias("_a"), quality.code("source").alias("_b"))
    keys, every = quality.features(rows.dropDuplicates(["_sum"]).withColumn("_y", quality.F.lit(-1)))
    ids = keys.column("_sum").to_numpy()
    by_text = {r._sum: r._text for r in rows.distinct().collect()}
    kind = {d[1]: truth.get(d[0]) for d in reversed(docs)}
    y = np.array([1 if kind[by_text[i]] == (1, 0) else 0 for i in ids.tolist()])
    learn = np.arange(0, len(ids), 5)
    views = {"content": quality.ContentView(every, learn, y[learn].astype(float)), "meta": quality.MetadataView(every.meta[learn], y[learn].astype(float))}
    scales = {k: quality.calibrate(quality.margins_of(v, every)[learn], y[learn]) for k, v in views.items()}
    taken = {"content": ids[1:4], "meta": ids[2:9]}
    got = quality.table_pool(rows, ids[learn], 30, 0.9)(views, scales, taken)
    for giver, learner in quality.TURNS:
        a, b = scales[giver]
        odds = a * quality.margins_of(views[giver], every) + b
        closed = set(ids[learn].tolist()) | set(taken[learner].tolist())
        bar = np.log(0.9 / 0.1)
        want = {}
        for label, sign in ((0, -1), (1, 1)):
            sure = sorted((-sign * o, i) for o, i in zip(odds.tolist(), ids.tolist()) if sign * o >= bar and i not in closed)
            want |= {i: label for _, i in sure[:30]}
        found, label, features = got[learner]
        assert dict(zip(found.tolist(), label.tolist())) == want and len(found) == len(want) == features.n > 30
