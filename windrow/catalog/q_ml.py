"""Model-based queries, all with the operators' own settings. Forests and boosted trees have no SQL twin; what decides who takes part, and the linear models, do."""

from pyspark.sql import functions as F

from ..operators import curate as cu
from ..operators import metrics as mt
from ..operators import ml
from ..operators.features import STATS as STAT_NAMES
from . import common as c
from .common import STATS, WF, query, rounded
from .q_curate import emb
from .q_detect import anchors, negatives, positives

#: The statistics by what they tell of, and the feature sets made of them.
KINDS = {
    "speed": ["v_mean", "stop_frac"], "input": ["steer_rate_rms", "brake_rate"], "path": ["curv_p95", "curv_rate_rms"], "long": ["decel_p05", "accel_p95", "jerk_rms"],
    "follow": ["lead_frac", "thw_median"], "lane": ["lane_sdlp"],
}
SUBSETS = {
    "all": STAT_NAMES, "input": KINDS["input"], "path": KINDS["path"], "lateral": KINDS["input"] + KINDS["path"], "long": KINDS["long"], "follow": KINDS["follow"],
    "lane": KINDS["lane"], "no_speed": [f for f in STAT_NAMES if f not in KINDS["speed"]],
}
BEHAV = ["decel_p05", "accel_p95", "jerk_rms", "steer_rate_rms", "curv_rate_rms", "thw_median", "lane_sdlp", "brake_rate"]
CONTEXT = ["v_mean", "stop_frac", "curv_p95", "lead_frac"]
CATEGORIES = {"scenario": 30, "grp": 30}
CHANNELS = ["vEgo", "aEgo", "steeringAngleDeg", "actual_curvature", "leadOne_dRel"]


@query(
    "channel_norm",
    f"""WITH {STATS}, g AS (SELECT entity, count(*) AS n FROM stats GROUP BY entity), r AS (SELECT *, (row_number() OVER (ORDER BY n DESC, entity) - 1) % 10 AS a FROM g),
    train AS (SELECT entity FROM r WHERE a NOT IN (0, 9)),
    l AS (SELECT unnest({CHANNELS}) AS channel, unnest([{", ".join(CHANNELS)}]) AS x FROM wf SEMI JOIN train USING (entity))
    SELECT channel, round(avg(x), 6) + 0.0 AS mu, round(stddev_pop(x) + 1e-3, 6) + 0.0 AS sd FROM l GROUP BY channel""",
)
def channel_norm(spark, d):
    # All frames of the train entities: fold 0 of five is held out.
    train = ml.group_kfold(c.stats(spark, d), "entity", 5).filter(F.col("fold") > 0)
    return rounded(ml.channel_norm(c.win_frames(spark, d).join(train, "entity", "left_semi"), CHANNELS))


@query(
    "group_kfold",
    f"""WITH {STATS}, g AS (SELECT entity, count(*) AS n FROM stats GROUP BY entity), r AS (SELECT *, (row_number() OVER (ORDER BY n DESC, entity) - 1) % 10 AS a FROM g)
    SELECT entity, n, CASE WHEN a < 5 THEN a ELSE 9 - a END AS fold FROM r""",
)
def group_kfold(spark, d):
    return ml.group_kfold(c.stats(spark, d), "entity", 5)


@query("leakage_probe")
def leakage_probe(spark, d):
    return rounded(ml.leakage_probe(c.stats(spark, d), STAT_NAMES, "grp", "entity"))


@query("source_probe")
def source_probe(spark, d):
    st = c.stats(spark, d).withColumn("src", F.when(F.col("route") % 2 == 0, "low").otherwise("high"))
    return rounded(ml.source_probe(st, STAT_NAMES, "src", "entity", 20))


@query("identifiability")
def identifiability(spark, d):
    return rounded(ml.identifiability(c.stats(spark, d), SUBSETS))


ROUTE_FOLDS = f"""WITH {STATS}, r AS (SELECT grp, entity, route, count(*) AS n FROM stats GROUP BY ALL),
    e AS (SELECT grp, entity, count(*) AS routes FROM r GROUP BY ALL HAVING count(*) >= 2 AND sum(n) >= 8),
    g AS (SELECT grp, least(5, min(routes)) AS k FROM e GROUP BY grp HAVING count(*) > 1),
    o AS (SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY n DESC, entity, route) - 1) % (2 * k) AS a FROM r JOIN g USING (grp) SEMI JOIN e USING (grp, entity))
    SELECT grp, entity, route, CASE WHEN a < k THEN a ELSE 2 * k - 1 - a END AS fold FROM o"""


@query("route_folds", ROUTE_FOLDS)
def route_folds(spark, d):
    return ml.route_folds(c.stats(spark, d), "grp", "entity", "route")


@query("importances")
def importances(spark, d):
    return rounded(ml.importances(c.stats(spark, d), STAT_NAMES, "scenario"))


def by_phase(spark, d):
    """Three groups that all entities share."""
    return c.stats(spark, d).withColumn("grp", (F.col("route") % 3).cast("string"))


@query("cross_group_transfer")
def cross_group_transfer(spark, d):
    return rounded(ml.cross_group_transfer(by_phase(spark, d), {"steering": KINDS["input"], "path": KINDS["path"], "all": STAT_NAMES}))


@query(
    "transfer_cases",
    f"""WITH {STATS}, s AS (SELECT * REPLACE ((route % 3)::VARCHAR AS grp) FROM stats), cells AS (SELECT entity, grp FROM s GROUP BY ALL HAVING count(*) >= 3),
    p AS (SELECT a.entity, a.grp AS grp_a, b.grp AS grp_b FROM cells a JOIN cells b ON a.entity = b.entity AND a.grp < b.grp),
    q AS (SELECT grp_a, grp_b FROM p GROUP BY ALL HAVING count(*) >= 2)
    SELECT grp_a, grp_b, grp, count(DISTINCT entity) AS entities, count(*) AS n FROM s JOIN p USING (entity) SEMI JOIN q USING (grp_a, grp_b) WHERE grp IN (grp_a, grp_b) GROUP BY ALL""",
)
def transfer_cases(spark, d):
    return ml.transfer_cases(by_phase(spark, d)).groupBy("grp_a", "grp_b", "grp").agg(F.countDistinct("entity").alias("entities"), F.count(F.lit(1)).alias("n"))


def residuals(spark, d):
    return ml.residualize(c.stats(spark, d), BEHAV, CONTEXT, ["win_id", "entity", "grp"], CATEGORIES)


@query("residualize")
def residualize(spark, d):
    return rounded(residuals(spark, d)[1])


@query("residual_leakage")
def residual_leakage(spark, d):
    """Raw statistics against residuals: how well the group can be read from either, on unseen entities."""
    rows = residuals(spark, d)[0]
    return rounded(ml.leakage_by_set(rows, {"raw": BEHAV, "residual": ["r_" + b for b in BEHAV]}, "grp", "entity"))


#: Least squares in SQL: of ``known`` (stat, x, z: x and the target behind it) the normal equations, solved column by column into ``beta`` (stat, b).
SOLVED = """
cell AS (SELECT stat, i, j, sum(zi * z[j]) AS v FROM (SELECT stat, i, zi, z, unnest(range(1, len(z) + 1)) AS j FROM (SELECT stat, z, unnest(range(1, len(z))) AS i, unnest(z[:len(z) - 1]) AS zi FROM known)) GROUP BY ALL),
rows_ AS (SELECT stat, i, list(v ORDER BY j) AS r FROM cell GROUP BY stat, i),
mat AS (SELECT stat, list(r ORDER BY i) AS m FROM rows_ GROUP BY stat),
solve AS (SELECT stat, 0 AS k, m FROM mat UNION ALL
  SELECT stat, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
    ELSE list_transform(list_zip(r, m[k + 1]), lambda p: p[1] - r[k + 1] / m[k + 1][k + 1] * p[2]) END) FROM solve WHERE k < len(m)),
beta AS (SELECT stat, list_transform(m, lambda r: r[len(r)]) AS b FROM solve WHERE k = len(m))"""

NORMAL = f"""
cats AS (SELECT list(DISTINCT scenario ORDER BY scenario) AS sc, list(DISTINCT grp ORDER BY grp) AS gr FROM stats),
design AS (SELECT win_id, list_concat([1.0::DOUBLE, {", ".join(CONTEXT)}], list_transform(sc[2:], lambda v: (scenario = v)::INT::DOUBLE), list_transform(gr[2:], lambda v: (grp = v)::INT::DOUBLE)) AS x,
  unnest({BEHAV}) AS stat, unnest([{", ".join(BEHAV)}]) AS y FROM stats, cats),
known AS (SELECT stat, x, y, list_append(x, y) AS z FROM design WHERE y IS NOT NULL),{SOLVED}"""


@query(
    "residualize_linear",
    f"""WITH RECURSIVE {STATS}, {NORMAL}
    SELECT stat, round(1 - sum((y - list_dot_product(x, b)) ^ 2) / (var_pop(y) * count(y)), 6) + 0.0 AS r2 FROM known JOIN beta USING (stat) GROUP BY stat""",
)
def residualize_linear(spark, d):
    return rounded(ml.residualize_linear(c.stats(spark, d), BEHAV, CONTEXT, categories=CATEGORIES)[1])


@query(
    "residualize_means",
    f"""WITH {STATS}, r AS (SELECT unnest(['jerk_rms', 'v_mean']) AS stat, unnest([jerk_rms, v_mean]) AS y,
      unnest([jerk_rms - avg(jerk_rms) OVER (PARTITION BY scenario), v_mean - avg(v_mean) OVER (PARTITION BY scenario)]) AS r FROM stats)
    SELECT stat, round(1 - sum(r * r) / (var_pop(y) * count(y)), 6) + 0.0 AS r2 FROM r WHERE y IS NOT NULL GROUP BY stat""",
)
def residualize_means(spark, d):
    return rounded(ml.residualize_means(c.stats(spark, d), ["jerk_rms", "v_mean"], ["scenario"])[1])


@query("linear_probe")
def linear_probe(spark, d):
    return rounded(ml.linear_probe(emb(spark, d), "vec", "entity"))


@query("probe_contrast")
def probe_contrast(spark, d):
    return rounded(ml.probe_contrast(emb(spark, d), "vec", ["entity", "route", "grp"]))


@query("embed_map")
def embed_map(spark, d):
    return ml.embed_map(emb(spark, d)).drop("pc")


def anchor_table(spark, d):
    """Window frames, and the anchors with their entity. Onsets and anchors are unions, which lie in no buckets: each is dealt once to those of the
    frames, and all joins and groupings between stay there."""
    f = c.win_frames(spark, d)
    bucketed = lambda name, build, order: c.stage(spark, name, d, build, ["win_id"], [order], lambda: c.frame_rows(spark, d))
    onsets = bucketed("onsets", lambda: anchors(f)[0], "onset")
    pos = positives(onsets)
    neg = negatives(spark, d, f, (onsets, pos)).select("win_id", "a", "y", F.lit(None).cast("bigint").alias("lead"), F.lit("none").alias("kind"))
    entity = f.select("win_id", "entity").distinct()
    parts = [x.distinct().join(entity, "win_id") for x in (pos.select("win_id", "a", "y", "lead", "kind"), neg)]
    return f, bucketed("anchors", lambda: parts[0].unionByName(parts[1]), "a")


@query("forecast_events")
def forecast_events(spark, d):
    f, a = anchor_table(spark, d)
    folds = cu.entity_folds(a, few=0.0, test=0.3, val=0.0)
    scored = c.stage(spark, "forecast", d, lambda: ml.forecast_events(a, f, folds, 5, bounded=True))
    slices = {"all": F.lit(True), "near": (F.col("y") == 0) | (F.col("lead") <= 2), "far": (F.col("y") == 0) | (F.col("lead") > 2)}
    slices |= {kind: (F.col("y") == 0) | (F.col("kind") == kind) for kind in ("brake", "steer")}
    out = mt.auroc_and_precision(mt.with_slices(scored, slices), "score", "y", ["slice"])
    return rounded(out.filter(F.col("n_pos") > 20))


FEW = ["v_mean", "stop_frac", "lead_frac"]


@query(
    "few_shot_predict",
    f"""WITH RECURSIVE {STATS}, med AS (SELECT {", ".join(f"quantile_cont({f}, 0.5) AS m_{f}" for f in FEW)} FROM stats),
    t AS (SELECT win_id, entity, route, jerk_rms AS y, [1.0::DOUBLE, {", ".join(f"coalesce({f}, m_{f})" for f in FEW)}] AS x FROM stats, med WHERE jerk_rms IS NOT NULL),
    rt AS (SELECT entity, route, row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws(':', '42', entity, route)), entity, route) AS r, count(*) OVER (PARTITION BY entity) AS n
      FROM (SELECT DISTINCT entity, route FROM t)),
    ro AS (SELECT entity, route, CASE WHEN r <= greatest(1, n // 2) THEN 'support' ELSE 'query' END AS role FROM rt WHERE n >= 2),
    q AS (SELECT *, row_number() OVER (PARTITION BY entity, role ORDER BY md5(concat_ws(':', '42-row', win_id)), win_id) AS rank FROM t JOIN ro USING (entity, route)),
    known AS (SELECT 'y' AS stat, x, list_append(x, y) AS z FROM q WHERE role = 'support'),{SOLVED},
    g AS (SELECT *, list_dot_product(x, b) AS g FROM q, beta), o AS (SELECT entity, avg(y - g) AS off FROM g WHERE role = 'support' AND rank <= 5 GROUP BY entity)
    SELECT entity, count(*) AS n, round(avg(abs(y - g)), 6) + 0.0 AS generic, round(avg(abs(y - g - off)), 6) + 0.0 AS personal FROM g JOIN o USING (entity) WHERE role = 'query' GROUP BY entity""",
)
def few_shot_predict(spark, d):
    err = ml.few_shot_predict(c.stats(spark, d), FEW, "jerk_rms", 5)
    return rounded(err.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg("err_generic").alias("generic"), F.avg("err_personal").alias("personal")))
