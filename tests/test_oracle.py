"""Every registered query against its SQL twin, and the rows-only ones against their invariants."""

import pytest
from compare import check

from windrow.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_equals_sql(spark, duck, sf, name):
    n, result, _, diff = check(spark, duck, QUERIES[name], ORACLES[name], sf)
    assert result == "ok", (result, diff)
    assert n > 0


def rows(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def test_model_queries(spark, sf):
    assert abs(sum(r["importance"] for r in rows(spark, sf, "importances")) - 1) < 1e-4
    assert {r["label"] for r in rows(spark, sf, "probe_contrast")} == {"entity", "route", "grp"}
    m = rows(spark, sf, "embed_map")
    assert sum(r["representative"] for r in m) == len({r["cluster"] for r in m})
    got = rows(spark, sf, "forecast_events")
    assert {r["slice"] for r in got} == {"all", "near", "far", "brake", "steer"} and all(0 <= r["auroc"] <= 1 and 0 <= r["ap"] <= 1 for r in got)
    f = rows(spark, sf, "few_shot_predict")
    assert f and all(r["generic"] >= 0 and r["personal"] >= 0 for r in f)


def test_forest_queries_cover_every_group_pair_and_set(spark, sf, duck):
    from windrow.catalog.q_ml import BEHAV, ROUTE_FOLDS, SUBSETS

    groups = {r[0] for r in duck.execute(f"SELECT DISTINCT grp FROM ({ROUTE_FOLDS})").fetchall()}
    got = rows(spark, sf, "identifiability")
    assert {(r["grp"], r["features"]) for r in got} == {(g, s) for g in groups for s in SUBSETS} and groups
    assert all(r["n_features"] == len(SUBSETS[r["features"]]) and r["routes"] > 0 for r in got)
    got = rows(spark, sf, "cross_group_transfer")
    assert {(r["train_grp"], r["test_grp"]) for r in got} == {(a, b) for a in "012" for b in "012" if a != b} and len(got) == 18
    boosted, linear = ({r["stat"]: r["r2"] for r in rows(spark, sf, n)} for n in ("residualize", "residualize_linear"))
    assert set(boosted) == set(linear) == set(BEHAV) and all(linear[b] <= boosted[b] <= 1 for b in BEHAV)
    assert {r["features"] for r in rows(spark, sf, "residual_leakage")} == {"raw", "residual"}


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_result_does_not_depend_on_partitioning(spark, sf):
    """Sampling is keyed by hash: another partitioning of the input draws the same rows."""
    from windrow.catalog.q_curate import emb, keyed
    from windrow.operators import pairs, sampling

    k = keyed(spark, sf)
    a = {tuple(r) for r in pairs.negative_pairs(k).collect()}
    b = {tuple(r) for r in pairs.negative_pairs(k.repartition(13, "wi0")).collect()}
    assert a == b and a
    e = emb(spark, sf)
    pick = lambda df: {(r.win_id, r.role, r["rank"]) for r in sampling.support_query(df, "win_id", 5).collect()}
    assert pick(e) == pick(e.repartition(7))
