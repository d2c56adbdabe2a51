import math

import numpy as np
import pytest

from windrow.llm import topk

KIND = "vec_id bigint, embedding array<double>"


def plain(rows, every, k):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(1024 * x) for x in v]
            own[i] = min(own.get(i, v), v)
    out = []
    for q, v in own.items():
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in own.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def found(df, **kw):
    return sorted(tuple(r) for r in topk.search(df, **kw).collect())


@pytest.mark.parametrize("shard,block", [(8192, 4096), (60, 7)])
def test_equals_plain(spark, shard, block):
    """Clusters, a third of all rows one vector, ties, zeros; one shard and one block, and many."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(5, 16))
    rows = [(i, (centre[i % 5] + rng.normal(size=16) * (0.1 + i % 3)).tolist()) for i in range(400)]
    rows += [(i, [0.25] * 16) for i in range(400, 600)] + [(i, [0.0] * 16) for i in range(600, 620)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert found(df, every=20, k=10, shard=shard, block=block) == plain(rows, 20, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [-1.0, 0.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]),
        (100, [1.0, 2.0, 3.0]), (200, [60000.0, -60000.0]), (300, []), (400, []), (500, [-0.00001, 0.0]),
    ]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' AS id", "1 AS d", "2 AS v", "3 AS shard", "4 AS score")
    assert found(df) == plain(rows, 100, 10)
    assert found(df, k=2) == plain(rows, 100, 2)
    assert found(df.where("vec_id IS NULL")) == []
    assert topk.search(df.where("vec_id < 0")).columns == ["query_id", "rank", "vec_id", "score"]


def test_stops_before_the_end_and_only_on_proof():
    """A row of the greatest score that meets its impact last is still found."""
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, (3000, 32))
    v[1234] = 20
    import pyarrow as pa

    t = pa.table({"id": pa.array(range(3000)), "v": pa.array(v.tolist(), pa.list_(pa.int32())), "d": pa.array([32] * 3000, pa.int32()), "shard": pa.array([0] * 3000)})
    index = topk._index(topk.segments(8)(t))
    assert (index.vectors == v).all()
    for q in [np.ones(32, np.int64), rng.integers(-9, 9, 32), np.zeros(32, np.int64), -np.ones(32, np.int64)]:
        for least in (None, int(np.sort(v @ q)[-40])):
            ids, scores = index.top(q, 7, 10, least)
            want = sorted((-int(s), i) for i, s in enumerate(v @ q) if i != 7)[:10]
            assert list(zip((-scores).tolist(), ids.tolist())) == want
