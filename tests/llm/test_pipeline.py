"""The pipeline on a small corpus with planted cases, stage by stage against brute force."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from arealens.llm import suffix
from tests.llm import helpers as H
from tests.llm.test_minhash import linked, shingle_set
from tests.llm.test_mixing import expected_copies
from tests.llm.test_quality import BAD, GOOD
from tests.llm.test_suffix import brute

LEAK = "the planted benchmark question asks how many silver apples fall from nine old trees in one long autumn day"
PASSAGE = " ".join(f"shared{i} passage" for i in range(45))


def documents():
    rng, rows, truth = random.Random(11), [], {}

    def prose(n):
        return [rng.choice(GOOD) + rng.choice(["", "s", "ed"]) + str(rng.randrange(300)) for _ in range(n)]

    for i in range(400):
        words, kind = prose(rng.randint(30, 90)), "clean"
        if i % 10 == 3:
            words, kind = [w.upper() + "!!" for w in words], "junk"
        elif i % 10 == 6:
            words[5:5] = [rng.choice(BAD) + "a" for _ in range(4)]
            kind = "toxic"
        elif i % 40 == 0:
            words[9:9], kind = LEAK.split(), "leak"
        elif i % 40 == 1:
            words[9:9], kind = PASSAGE.split(), "passage"
        elif i % 20 == 8 and i > 20:
            words, kind = rows[i - 4][1].split() + [], "copy"
            if i % 40 == 8:
                words[3] = "edited"
                kind = "near"
        truth[i] = kind
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), rng.choice(["hot", "hot", "b"]), None))
    rows = [(*r[:4], len(r[1])) for r in rows]
    extra = [(None, " ".join(prose(40)), None, None, None), (900, None, "en", "b", 0), (901, "", "en", "b", 0), (rows[5][0], *rows[5][1:])]
    return rows + extra, truth


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, truth = documents()
    path = tmp_path_factory.mktemp("corpus")
    docs = H.with_clashes(spark.createDataFrame(rows, H.SCHEMA).repartition(3))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(k != "junk"), int(k == "toxic")) for i, k in truth.items() if i % 2 == 0 or k == "junk"]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, "short"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_against_brute_force(spark, folder, tmp_path):
    _, truth = documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = (before, [r.asDict() for r in docs.collect()])
        assert all(r["node"] == "mine" for r in seen[name][1])

    before, after = seen["quality classifier"]
    kept = {r["doc_id"] for r in after}
    assert not [i for i in kept if truth.get(i) == "junk"]
    assert sum(truth.get(i) == "toxic" for i in kept) <= 2
    clean = [i for i, k in truth.items() if k not in ("junk", "toxic")]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)

    before, after = seen["near duplicates"]
    with_key = sorted({r for r in before if r[0] is not None}, key=lambda r: r[0])
    sets = [shingle_set(r[1]) for r in with_key]
    root = H.components(sets, linked)
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted({with_key[i][0] for i in root})

    before, after = seen["repeated strings"]
    want = {i: (n, gone, body.decode()) for i, n, gone, _, body in brute(before, suffix.PASSAGE)}
    assert len(after) == len(before) and any(gone for _, gone, _ in want.values())
    for r in after:
        assert (r["text"] or "") == want[r["doc_id"]][2]
        assert want[r["doc_id"]][1] == 0 or r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in after if r["text"] is None} == {r[0] for r in before if r[1] is None}

    before, after = seen["benchmark decontamination"]
    assert sorted(r["doc_id"] or -1 for r in after) == sorted((r[0] if r[0] is not None else -1) for r in before if LEAK not in (r[1] or ""))
    assert len(after) < len(before)

    before, after = seen["mixing"]
    want = {(i, t): k for i, t, k in expected_copies(before) if k}
    got = {}
    for r in after:
        got[(r["doc_id"], r["text"])] = got.get((r["doc_id"], r["text"]), 0) + 1
    assert got == want


def test_run_gives_the_rows_of_the_last_stage(spark, folder):
    first = P.run(spark, folder)
    again = P.run(spark, folder)
    key = [F.coalesce("doc_id", F.lit(-1)).alias("i"), "mix_copy", "mix_order"]
    assert first.count() > 100
    assert sorted(first.select(*key).collect()) == sorted(again.select(*key).collect())


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    shutil.copytree(f"{folder}/documents.parquet", f"{tmp_path}/kept")
    docs = spark.read.parquet(f"{tmp_path}/kept")
    assert P.STAGES[0][1](spark, docs, str(tmp_path)).count() == docs.count()
    assert P.STAGES[3][1](spark, docs, str(tmp_path)).count() == docs.count()
