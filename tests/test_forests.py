"""Trees, forests and linear models against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.functions import trees as tr
from windrow.operators import forests, linear, ml


def plain_tree(x, y, w, depth, least):
    """CART by trying every cut of every feature: nested (feature, cut), left, right; a leaf is its heaviest class."""

    def worth(m):
        return sum(w[m & (y == c)].sum() ** 2 for c in set(y[m])) / w[m].sum()

    def node(m, level):
        leaf = max(sorted(set(y[m])), key=lambda c: (round(w[m & (y == c)].sum(), 9), -c))
        best, at = 1e-12, None
        if level < depth and len(set(y[m])) > 1:
            for j in range(x.shape[1]):
                values = sorted(set(x[m, j]))
                for a, b in zip(values, values[1:]):
                    left, right = m & (x[:, j] <= a), m & (x[:, j] > a)
                    if min(left.sum(), right.sum()) >= least and worth(left) + worth(right) - worth(m) > best + 1e-12:
                        best, at = worth(left) + worth(right) - worth(m), (j, (a + b) / 2)
        if at is None:
            return int(leaf)
        return at, node(m & (x[:, at[0]] <= at[1]), level + 1), node(m & (x[:, at[0]] > at[1]), level + 1)

    return node(np.ones(len(y), bool), 0)


def nested(t, i):
    if t.feature[i] < 0:
        return int(t.value[i])
    return (int(t.feature[i]), t.cut[i]), nested(t, t.left[i]), nested(t, t.left[i] + 1)


def same(a, b):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return a == b
    return a[0][0] == b[0][0] and abs(a[0][1] - b[0][1]) < 1e-9 and same(a[1], b[1]) and same(a[2], b[2])


@pytest.mark.parametrize("seed", range(4))
def test_trees_equal_plain(seed):
    """Several trees grown at once, with ties, weights and equal values."""
    rng = np.random.default_rng(seed)
    n = 240
    x, y, w, tree = rng.normal(size=(n, 4)).round(1), rng.integers(0, 2 + seed, n), rng.integers(1, 4, n).astype(float), rng.integers(0, 3, n)
    allowed = np.ones((3, 4), bool)
    allowed[1, 2:] = False
    grown = tr.grow(x, y, w, tree, allowed, 5, 2 + seed, rng, every=True)
    for t in range(3):
        m = tree == t
        assert same(nested(grown, t), plain_tree(x[m][:, allowed[t]], y[m], w[m], 5, 2 + seed))
    assert tr.grow(x[:0], y[:0], w[:0], tree[:0], allowed, 5, 2, rng).feature.tolist() == [-1] * 3


def test_leaves_follow_the_cuts():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(500, 3)), rng.integers(0, 4, 500)
    t = tr.grow(x, y, np.ones(500), np.zeros(500, int), np.ones((1, 3), bool), 30, 1, rng, every=True)
    assert (t.value[t.leaves(x, np.zeros(500, int))] == y).all()  # grown to the end


def test_boosting_equals_plain_rounds():
    """One feature of few values: each round's leaves are the mean rests of the cuts that lower the error most."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, (300, 1)).astype(float), rng.normal(size=300)
    start, t = tr.boost(x, y, 3, 1, rate=0.5, least=5)
    pred = np.full(300, y.mean())
    for _ in range(3):
        rest = y - pred
        cuts = [c for c in range(11) if 5 <= (x[:, 0] <= c).sum() <= 295]
        c = max(cuts, key=lambda c: sum(rest[m].sum() ** 2 / m.sum() for m in (x[:, 0] <= c, x[:, 0] > c)))
        for m in (x[:, 0] <= c, x[:, 0] > c):
            pred[m] += 0.5 * rest[m].mean()
    assert np.allclose(tr.predict(start, t, x), pred)
    assert np.allclose(tr.predict(*tr.boost(x, y, 200, 3, least=1), x), [y[x[:, 0] == v].mean() for v in x[:, 0]], atol=1e-3)


def cases(spark, n=600, noise=0.05, models=("a", "b")):
    rng = np.random.default_rng(4)
    rows = []
    for m in models:
        for i in range(n):
            y = int(rng.integers(0, 3))
            rows.append((m, int(rng.integers(0, 3)), f"c{y}", f"{i}", y + rng.normal() * noise, float(rng.normal()), None if i % 5 == 0 else -y + rng.normal() * noise))
    return spark.createDataFrame(rows, "_m string, _part bigint, _y string, _id string, good double, bad double, gaps double")


def test_forests_learn_what_there_is(spark):
    df = cases(spark)
    sets = {"good": ["good", "bad"], "bad": ["bad"], "gaps": ["gaps"]}
    got = forests.forest_votes(df, sets, trees=20)
    acc = {(r["_m"], r["features"]): r for r in forests.scores(got, ["_m", "features"]).collect()}
    assert len(acc) == 6 and all(r.n == 600 and abs(r.chance - 1 / 3) < 1e-9 for r in acc.values())
    for m in "ab":
        assert acc[m, "good"].acc > 0.97 and 0.75 < acc[m, "gaps"].acc < 0.95 and acc[m, "bad"].acc < 0.45


def test_votes_do_not_depend_on_partitions_and_leave_out_the_part(spark):
    df = cases(spark, 200, 1.0, ("a",))
    pick = lambda x: {(r["_id"], r["features"]): r["_p"] for r in forests.forest_votes(x, {"s": ["good", "bad"]}, trees=8).collect()}
    assert pick(df) == pick(df.repartition(7, "_id").orderBy(F.desc("_id")))
    # A label that only one part has cannot be given to that part's rows.
    odd = df.withColumn("_y", F.when(F.col("_part") == 1, "only").otherwise(F.col("_y")))
    got = forests.forest_votes(odd, {"s": ["good"]}, trees=8).select("_part", "_p").distinct().collect()
    assert not [r for r in got if r["_part"] == 1 and r["_p"] == "only"] and [r for r in got if r["_p"] == "only"]


def test_a_hot_model_is_sampled_by_tree_and_voted_on_whole(spark):
    df = cases(spark, 3000, 0.05, ("hot",)).unionByName(cases(spark, 40, 0.05, ("rare",)))
    got = forests.forest_votes(df, {"s": ["good"]}, trees=10, rows_per_tree=100)
    acc = {r["_m"]: r for r in forests.scores(got, ["_m"]).collect()}
    assert acc["hot"].n == 3000 and acc["hot"].acc > 0.95 and acc["rare"].n == 40


def test_trees_see_all_rows_of_a_large_model(spark):
    """A class of six rows a part among 18,000 is in every tree's bootstrap; a sample of some thousand rows would mostly miss it."""
    df = spark.range(18000).selectExpr("'m' AS _m", "id % 3 AS _part", "IF(id < 18, 'rare', IF(xxhash64(id) % 2 = 0, 'a', 'b')) AS _y", "string(id) AS _id", "IF(id < 18, 9D, (xxhash64(id, 1) % 1000) / 1000D) AS x")
    got = forests.forest_votes(df, {"s": ["x"]}, trees=16).collect()
    assert len(got) == 18000 and {r["_p"] for r in got if r["_y"] == "rare"} == {"rare"} and {r["_p"] for r in got if r["_y"] != "rare"} == {"a", "b"}


def test_votes_are_the_same_one_tree_at_a_time(spark, monkeypatch):
    """Where the rows of all of a number's trees are too many for one go, they are grown singly; the draws of rows stay."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 900)
    rows = pa.table({"_h": rng.integers(-(1 << 62), 1 << 62, 900), "_part": rng.integers(0, 3, 900), "_c": y.astype(np.int32), "_n": np.arange(900), "good": y + rng.normal(size=900) * 0.05, "gaps": np.where(rng.random(900) < 0.3, np.nan, -y)})
    model = forests.Model(rows, ["good", "gaps"], [["good"], ["good", "gaps"]], 16, 2, 42)
    whole = [model.votes(t, 1.0) for t in range(9)]
    monkeypatch.setattr(forests, "ROWS_AT_ONCE", 100)
    single = [model.votes(t, 1.0) for t in range(9)]
    for told in (whole, single):
        assert (forests._most(np.stack(told, 2).reshape(1800, 9)).reshape(900, 2) == model.y[:, None]).mean() > 0.97
    u = forests.uniform(model.h, 42, 1)
    assert 0 <= u.min() and u.max() < 1 and abs(forests.poisson(u, 1.0).mean() - 1) < 0.1 and abs(forests.poisson(u, 0.1).mean() - 0.1) < 0.05


def test_odd_cases(spark):
    df = cases(spark, 30, models=("a",))
    one = df.withColumn("_part", F.lit(0).cast("bigint"))
    assert [r["_p"] for r in forests.forest_votes(one, {"s": ["good"]}, trees=3).collect()] == [None] * 30  # nothing to learn from
    assert forests.forest_votes(df.where("_y IS NULL"), {"s": ["good"]}, trees=3).count() == 0
    empty = df.withColumns({"good": F.lit(None).cast("double")})
    assert forests.forest_votes(empty, {"s": ["good"]}, trees=3).where("_p IS NOT NULL").count() == 30


def windows(spark, groups=2, entities=6, routes=4, n=6, spread=0.1):
    rng = np.random.default_rng(9)
    rows = [
        (f"{g}|{e}|{r}|{i}", f"g{g}", f"e{e}", r, e + spread * rng.normal(), float(rng.normal()))
        for g in range(groups) for e in range(entities) for r in range(routes) for i in range(n)
    ]
    rows += [("x1", "g0", "lonely", 0, 99.0, 0.0), ("x2", "g9", "alone", 0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "win_id string, grp string, entity string, route bigint, own double, other double")


def test_entities_are_recognised_in_every_group(spark):
    got = {(r.grp, r.features): r for r in ml.identifiability(windows(spark), {"own": ["own"], "other": ["other"]}, trees=15).collect()}
    assert set(got) == {(g, s) for g in ("g0", "g1") for s in ("own", "other")}
    for g in ("g0", "g1"):
        r = got[g, "own"]
        assert r.acc > 0.97 and r.vote_acc > 0.97 and r.n == 144 and r.routes == 24 and abs(r.chance - 1 / 6) < 1e-9 and got[g, "other"].acc < 0.4


def test_entities_are_recognised_across_groups(spark):
    got = {(r.train_grp, r.test_grp, r.features): r for r in ml.cross_group_transfer(windows(spark, 3), {"own": ["own"], "other": ["other"]}, trees=15).collect()}
    assert len(got) == 12
    assert all(r.n == 144 and (r.acc > 0.97 if k[2] == "own" else r.acc < 0.4) for k, r in got.items())


def test_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 3)), np.zeros(400)])
    x[:, 3] *= 1e-6  # of another size, and one direction that no row spans
    y = x @ [1, 2, -3, 4e5, 0] + rng.normal(size=400)
    z = [None if i % 3 else float(v) for i, v in enumerate(y * y)]
    df = spark.createDataFrame([(a.tolist(), float(b), c, None) for a, b, c in zip(x, y, z)], "x array<double>, y double, z double, none double").repartition(6)
    got = linear.least_squares(df, "x", ["y", "z", "none"])
    ok = [i for i, v in enumerate(z) if v is not None]
    assert np.allclose(x @ got["y"], x @ np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.allclose(x[ok] @ got["z"], x[ok] @ np.linalg.lstsq(x[ok], y[ok] ** 2, rcond=None)[0]) and "none" not in got
    ridge = np.linalg.solve(x.T @ x + np.diag([0, 7, 7, 7, 7.0]), x.T @ y)
    assert np.allclose(linear.least_squares(df, "x", ["y"], penalty=7.0)["y"], ridge)


def test_residuals_take_categories_and_keep_every_row(spark):
    rows = [(f"w{i}", float(i % 3) * 10 + (i % 7), None if i % 4 == 0 else float(i % 5), float(i % 7), ["p", "q", "r"][i % 3]) for i in range(420)]
    df = spark.createDataFrame(rows, "win_id string, a double, b double, ctx double, kind string")
    for fn in (ml.residualize, ml.residualize_linear):
        out, r2 = fn(df, ["a", "b"], ["ctx"], categories={"kind": 2 if fn is ml.residualize else 3})
        got = out.select("a", "r_a", "b", "r_b").collect()
        assert len(got) == 420 and all((r.r_b is None) == (r.b is None) and r.r_a is not None for r in got)
        r2 = {r.stat: r.r2 for r in r2.collect()}
        assert r2["a"] > 0.999 and r2["b"] < 0.2
    assert max(abs(r.r_a) for r in got) < 1e-6  # a is linear in the context
