"""The model queries run with the operators' own settings, not with smaller ones."""

import inspect

import pytest

from windrow.catalog import QUERIES, q_ml

SETTINGS = {"k", "trees", "depth", "iters", "model", "pca", "rows", "min_routes", "min_windows", "min_shared"}


@pytest.mark.parametrize("name", ["leakage_probe", "source_probe", "identifiability", "cross_group_transfer", "residualize", "embed_map", "importances", "linear_probe", "probe_contrast", "forecast_events"])
def test_settings_are_the_defaults(monkeypatch, spark, sf, name):
    real = getattr(q_ml.ml, name)
    sig, seen = inspect.signature(real), {}

    class Seen(Exception):
        pass

    def spy(*args, **kwargs):
        b = sig.bind(*args, **kwargs)
        b.apply_defaults()
        seen.update(b.arguments)
        raise Seen

    monkeypatch.setattr(q_ml.ml, name, spy)
    monkeypatch.setattr(q_ml.c, "stage", lambda spark, n, d, build, *a, _stage=q_ml.c.stage: build() if n == "forecast" else _stage(spark, n, d, build, *a))
    with pytest.raises(Seen):
        QUERIES[name](spark, sf)
    wanted = {p.name: p.default for p in sig.parameters.values() if p.name in SETTINGS}
    assert wanted and {p: seen[p] for p in wanted} == wanted
