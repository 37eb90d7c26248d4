import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arealens.llm import mixing
from tests.llm import helpers as H


def expected_copies(rows, weights=None, total=None, seed="mix-1"):
    sources = Counter(r[3] for r in rows)
    weight = {s: 1.0 if weights is None else (weights.get(s, 0.0) if s is not None else 0.0) for s in sources}
    out = []
    for doc_id, text, _, source, _ in rows:
        rate = weight[source] / sum(weight.values()) * (total or len(rows)) / sources[source]
        inner = hashlib.md5((text or "").encode()).hexdigest()
        key = f"{seed}|{'' if doc_id is None else doc_id}|{inner}"
        u = (int(hashlib.md5(key.encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        k, p = 0, math.exp(-rate)
        c = p
        while rate > 0 and c <= u:
            k += 1
            p *= rate / k
            c += p
        out.append((doc_id, text, k))
    return out


@pytest.mark.parametrize("weights, total", [(None, None), ({"hot": 3.0, "b": 1.0}, 500), ({"b": 1.0}, 2000)])
def test_copies_follow_the_poisson_quantile(spark, weights, total):
    rows = H.awkward()
    docs = H.with_clashes(H.table(spark, rows)).withColumns({c: F.lit("mine") for c in ("_u", "_source", "_steps", "_w")})
    got = mixing.poisson_mix(docs, weights, total).collect()
    want = expected_copies(rows, weights, total)
    assert Counter((r.doc_id, r.text) for r in got) == Counter({k: n for k, n in sum_by(want).items() if n})
    assert all({r.node, r._u, r._source, r._steps, r._w, r._id} == {"mine"} for r in got)
    assert [r.mix_order for r in got] == sorted(r.mix_order for r in got)


def sum_by(rows):
    out = Counter()
    for doc_id, text, k in rows:
        out[(doc_id, text)] += k
    return out


def test_targets_are_met_in_the_mean(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 10 else "b", 1) for i in range(4000)]
    got = Counter(r.source for r in mixing.poisson_mix(H.table(spark, rows), {"hot": 1.0, "b": 1.0}).collect())
    assert abs(got["hot"] - 2000) < 200 and abs(got["b"] - 2000) < 200


def test_empty_table_and_no_weight(spark):
    assert mixing.poisson_mix(H.table(spark, [])).count() == 0
    assert mixing.poisson_mix(H.table(spark, H.awkward()), {}).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.poisson_mix(H.table(spark, H.awkward()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
