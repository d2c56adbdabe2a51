"""Window statistics, style features, scenario and label queries."""

from pyspark.sql import functions as F

from ..operators import features as ft
from . import common as c
from .common import COARSE, SIG, STAT_COLS, STATS, WF, labels_sql, long_labels_sql, query, rounded, rsel

RATE = COARSE["rate"]
K = "entity, route, win_id"


def wf(spark, d):
    return c.win_frames(spark, d)


@query(
    "flagship",
    f"""WITH {STATS}, {labels_sql()}, {long_labels_sql()}
    SELECT scenario, prim, count(*) AS windows, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = -1) AS neg,
      count(*) FILTER (WHERE label = 0) AS neutral FROM lab JOIN lablong USING (win_id) GROUP BY ALL""",
)
def flagship(spark, d):
    lab = c.labelled(spark, d)
    long = ft.unpivot_labels(lab, keys=["scenario"])
    x = F.col("label")
    return long.groupBy("scenario", "prim").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(x == 1).alias("pos"),
        F.count_if(x == -1).alias("neg"),
        F.count_if(x == 0).alias("neutral"),
    )


@query("window_stats", f"WITH {STATS} SELECT win_id, {rsel(STAT_COLS, 7, 0.0317)} FROM stats0")
def window_stats(spark, d):
    return rounded(ft.window_stats(wf(spark, d), RATE, c.STATS_MIN), 7, 0.0317)


@query("diff_rms", f"WITH {WF} SELECT win_id, round(sqrt(avg(d_a * d_a)), 6) + 0.0 AS diff_rms FROM wfd GROUP BY win_id")
def diff_rms(spark, d):
    return rounded(ft.diff_rms(wf(spark, d), "aEgo", RATE))


@query(
    "headway_stats",
    f"""WITH {WF}, h AS (SELECT win_id,
      CASE WHEN count_if(fol) > 5 THEN quantile_cont(thw, 0.5) FILTER (WHERE fol) END AS thw_median,
      CASE WHEN count_if(fol) > 5 THEN quantile_cont(thw, 0.25) FILTER (WHERE fol) END AS thw_p25,
      CASE WHEN count_if(fol) > 5 THEN avg((thw < 1)::INT) FILTER (WHERE fol) END AS close_follow_rate,
      avg((leadOne_status > 0.5)::INT) AS lead_present_rate FROM wfd GROUP BY win_id)
    SELECT win_id, {rsel("thw_median thw_p25 close_follow_rate lead_present_rate", 7, 0.0317)} FROM h""",
)
def headway_stats(spark, d):
    return rounded(ft.headway_stats(wf(spark, d)), 7, 0.0317)


@query(
    "ttc_min",
    f"""WITH {WF}, h AS (SELECT win_id, CASE WHEN count_if(fol) > 5 THEN
      min(leadOne_dRel / -leadOne_vRel) FILTER (WHERE fol AND leadOne_vRel < -0.5) END AS ttc_min FROM wfd GROUP BY win_id)
    SELECT win_id, {rsel("ttc_min", 7, 0.0317)} FROM h""",
)
def ttc_min(spark, d):
    return rounded(ft.ttc_min(wf(spark, d)), 7, 0.0317)


@query(
    "long_features",
    f"""WITH {WF}, h AS (SELECT win_id, stddev_pop(aEgo) AS accel_std, quantile_cont(aEgo, 0.95) AS accel_p95,
      quantile_cont(aEgo, 0.05) AS decel_p05, sqrt(avg(d_a * d_a)) AS jerk_rms, avg((aEgo < -2)::INT) AS hard_brake_rate,
      avg((aEgo > 1.5)::INT) AS hard_accel_rate FROM wfd GROUP BY win_id)
    SELECT win_id, {rsel("accel_std accel_p95 decel_p05 jerk_rms hard_brake_rate hard_accel_rate")} FROM h""",
)
def long_features(spark, d):
    return rounded(ft.long_features(wf(spark, d), RATE))


def with_touch(f):
    """The star schema has no steering-touch or brake-pressure channel; derive them."""
    return (
        f.withColumn("steeringPressed", (F.abs("steeringAngleDeg") > 60).cast("double"))
        .withColumn("brake", F.when(F.col("brakePressed") > 0.5, -F.col("aEgo") / 10).otherwise(0.0))
        .withColumn("slip", F.round(F.col("actual_curvature") - F.col("steeringRateDeg") / 5000, 6))
    )


@query(
    "lateral_input_features",
    f"""WITH {WF}, h AS (SELECT win_id, stddev_pop(steeringAngleDeg) AS steer_std,
      sqrt(avg(steeringRateDeg * steeringRateDeg)) AS steer_rate_rms,
      avg((abs(steeringAngleDeg) > 60)::INT) AS steer_touch_rate FROM wf GROUP BY win_id)
    SELECT win_id, {rsel("steer_std steer_rate_rms steer_touch_rate")} FROM h""",
)
def lateral_input_features(spark, d):
    return rounded(ft.lateral_input_features(with_touch(wf(spark, d))))


@query(
    "steering_entropy",
    f"""WITH {WF}, e AS (SELECT win_id, round(steeringAngleDeg - 2 * lag(steeringAngleDeg, 1) OVER w
        + lag(steeringAngleDeg, 2) OVER w, 9) AS e FROM wf WINDOW w AS (PARTITION BY win_id ORDER BY pos)),
    a AS (SELECT win_id, count(*) AS n, quantile_cont(abs(e), 0.9) + 1e-6 AS al, max(abs(e)) AS m FROM e GROUP BY win_id),
    b AS (SELECT win_id, (e / al >= -5)::INT + (e / al >= -2.5)::INT + (e / al >= -1)::INT + (e / al >= -0.5)::INT
        + (e / al >= 0.5)::INT + (e / al >= 1)::INT + (e / al >= 2.5)::INT + (e / al >= 5)::INT AS bin, count(*) AS cnt
      FROM e JOIN a USING (win_id) WHERE e IS NOT NULL GROUP BY ALL),
    p AS (SELECT win_id, cnt / sum(cnt) OVER (PARTITION BY win_id) AS p FROM b),
    h AS (SELECT win_id, -sum(p * ln(p)) / ln(9) AS h FROM p GROUP BY win_id)
    SELECT win_id, round(CASE WHEN n >= 10 THEN CASE WHEN m <= 1e-8 THEN 0 ELSE h END END, 6) + 0.0 AS steer_entropy
    FROM a LEFT JOIN h USING (win_id)""",
)
def steering_entropy(spark, d):
    return rounded(ft.steering_entropy(wf(spark, d)))


@query(
    "reversal_rate",
    f"""WITH RECURSIVE {WF},
    d AS (SELECT win_id, pos, round(steeringAngleDeg - lag(steeringAngleDeg) OVER (PARTITION BY win_id ORDER BY pos), 9) AS dx,
      count(*) OVER (PARTITION BY win_id) AS n FROM wf),
    r AS (
      SELECT win_id, pos, n, 0 AS revs, 0 AS last, 0.0::DOUBLE AS acc FROM d WHERE pos = 0
      UNION ALL
      SELECT d.win_id, d.pos, d.n,
        CASE WHEN sign(dx) <> 0 AND sign(dx) <> last AND abs(round(acc + dx, 9)) > 2 THEN revs + 1 ELSE revs END,
        CASE WHEN sign(dx) <> 0 AND sign(dx) <> last AND abs(round(acc + dx, 9)) > 2 THEN sign(dx)::INT ELSE last END,
        CASE WHEN sign(dx) <> 0 AND sign(dx) <> last AND abs(round(acc + dx, 9)) > 2 THEN 0.0 ELSE round(acc + dx, 9) END
      FROM r JOIN d ON d.win_id = r.win_id AND d.pos = r.pos + 1)
    SELECT win_id, revs::BIGINT AS revs, round(CASE WHEN n >= 3 THEN revs / (n / 1.0 / 60.0 + 1e-9) END, 6) + 0.0
      AS steer_reversal_rate FROM r WHERE pos = n - 1""",
)
def reversal_rate(spark, d):
    return rounded(ft.reversal_rate(wf(spark, d), rate=RATE))


@query(
    "path_features",
    f"""WITH {WF}, s AS (SELECT *, round(actual_curvature - steeringRateDeg / 5000, 6) AS slip FROM wfd),
    h AS (SELECT win_id, avg(abs(actual_curvature)) AS curv_absmean, stddev_pop(actual_curvature) AS curv_std,
      quantile_cont(abs(actual_curvature), 0.95) AS curv_p95, sqrt(avg(d_k * d_k)) AS curv_rate_rms,
      avg((abs(actual_curvature) > 0.01)::INT) AS sharp_corner_rate, avg(abs(slip)) AS slip_absmean,
      stddev_pop(slip) AS slip_std FROM s GROUP BY win_id)
    SELECT win_id, {rsel("curv_absmean curv_std curv_p95 curv_rate_rms sharp_corner_rate slip_absmean slip_std")} FROM h""",
)
def path_features(spark, d):
    return rounded(ft.path_features(with_touch(wf(spark, d)), RATE))


@query(
    "lane_features",
    f"""WITH {WF}, h AS (SELECT win_id, avg((laneLeft_y + laneRight_y) / 2) AS lane_bias,
      stddev_pop((laneLeft_y + laneRight_y) / 2) AS lane_sdlp, avg(laneRight_y - laneLeft_y) AS lane_width FROM wf GROUP BY win_id)
    SELECT win_id, {rsel("lane_bias lane_sdlp lane_width")} FROM h""",
)
def lane_features(spark, d):
    return rounded(ft.lane_features(wf(spark, d)))


@query(
    "pedal_speed_features",
    f"""WITH {WF}, h AS (SELECT win_id, avg(brakePressed) AS brake_rate, avg(gasPressed) AS gas_rate,
      quantile_cont(CASE WHEN brakePressed > 0.5 THEN -aEgo / 10 ELSE 0.0 END, 0.95) AS brake_mag_p95,
      avg(vEgo) AS speed_mean, stddev_pop(vEgo) AS speed_std FROM wf GROUP BY win_id)
    SELECT win_id, {rsel("brake_rate gas_rate brake_mag_p95 speed_mean speed_std")} FROM h""",
)
def pedal_speed_features(spark, d):
    return rounded(ft.pedal_speed_features(with_touch(wf(spark, d))))


@query(
    "select_feature_group",
    f"""WITH {WF}, h AS (SELECT win_id, avg((laneLeft_y + laneRight_y) / 2) AS lane_bias,
      stddev_pop((laneLeft_y + laneRight_y) / 2) AS lane_sdlp, avg(laneRight_y - laneLeft_y) AS lane_width FROM wf GROUP BY win_id)
    SELECT win_id, {rsel("lane_bias lane_sdlp lane_width")} FROM h""",
)
def select_feature_group(spark, d):
    return rounded(ft.select_feature_group(ft.style_features(with_touch(wf(spark, d)), RATE, group="lane"), "lane"))


@query("scenario_bucket", f"WITH {STATS} SELECT win_id, scenario FROM stats")
def scenario_bucket(spark, d):
    return c.stats(spark, d).select("win_id", "scenario")


PRIMS = ", ".join("p_" + p for p in ft.PRIMITIVES)


@query("quantile_labels", f"WITH {STATS}, {labels_sql()} SELECT win_id, scenario, {PRIMS} FROM lab")
def quantile_labels(spark, d):
    return c.labelled(spark, d).select("win_id", "scenario", *["p_" + p for p in ft.PRIMITIVES])


def _sens(setting, name):
    return f"""SELECT '{setting}' AS setting, prim, count(*) AS n, round(avg((a.label <> b.label)::INT), 6) + 0.0 AS change_rate
    FROM l80 a JOIN {name} b USING (win_id, prim)
    WHERE a.label IS NOT NULL AND b.label IS NOT NULL AND (a.label <> 0 OR b.label <> 0) GROUP BY prim"""


@query(
    "label_sensitivity",
    f"""WITH {STATS}, {labels_sql()}, {labels_sql(75, 25, 'lab75')}, {labels_sql(85, 15, 'lab85')},
    {long_labels_sql('lab', 'l80')}, {long_labels_sql('lab75', 'l75')}, {long_labels_sql('lab85', 'l85')}
    {_sens('75/25', 'l75')} UNION ALL {_sens('85/15', 'l85')}""",
)
def label_sensitivity(spark, d):
    return rounded(ft.label_sensitivity(c.stats(spark, d), min_n=COARSE["min_n"]))


@query(
    "label_repro",
    f"""WITH {STATS}, {labels_sql()}, stats_r AS (SELECT * REPLACE (round(jerk_rms, 2) AS jerk_rms) FROM stats),
    {labels_sql(name='labr', src='stats_r')}, {long_labels_sql('lab', 'la')}, {long_labels_sql('labr', 'lb')}
    SELECT prim, count(*) AS n, round(avg((a.label = b.label)::INT), 6) + 0.0 AS share_equal,
      avg((a.label = b.label)::INT) >= 0.999 AS ok
    FROM la a JOIN lb b USING (win_id, prim) WHERE a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY prim""",
)
def label_repro(spark, d):
    st = c.stats(spark, d)
    a = ft.quantile_labels(st, min_n=COARSE["min_n"])
    b = ft.quantile_labels(st.withColumn("jerk_rms", F.round("jerk_rms", 2)), min_n=COARSE["min_n"])
    return rounded(ft.label_repro(a, b))


@query(
    "label_coverage",
    f"""WITH {STATS}, {labels_sql()}, {long_labels_sql()} SELECT prim, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = -1) AS neg,
      count(*) FILTER (WHERE label = 0) AS neutral, count_if(label IS NULL) AS na FROM lablong GROUP BY prim""",
)
def label_coverage(spark, d):
    return ft.label_coverage(c.labelled(spark, d))


@query(
    "moving_avg_zero_pad",
    f"""WITH {SIG} SELECT entity, route, idx, round(sum(vEgo) OVER (PARTITION BY entity, route ORDER BY idx
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) + 0.0 AS smooth FROM sig""",
)
def moving_avg_zero_pad(spark, d):
    f = c.sig(spark, d).select("entity", "route", "idx", "vEgo")
    return rounded(ft.moving_avg_zero_pad(f, "vEgo").drop("vEgo"))


_KM = {
    "close_following": "CASE WHEN leadOne_dRel > 0 THEN leadOne_dRel / greatest(vEgo, 1) END",
    "large_headway": "CASE WHEN leadOne_dRel > 0 THEN leadOne_dRel / greatest(vEgo, 1) END",
    "hard_braking": "aEgo",
    "high_jerk": "-coalesce(abs(d_a), 0)",
    "sharp_steer_raw": "-coalesce(abs(steeringAngleDeg - lag(steeringAngleDeg) OVER w), 0)",
    "sharp_steer_path": "-coalesce(abs(d_k), 0)",
    "lane_correction": "-coalesce(abs(laneLeft_y - lag(laneLeft_y) OVER w), 0)",
    "curve_entry_decel": "-abs(actual_curvature)",
}


@query(
    "key_moment",
    f"""WITH {WF}, s AS ({" UNION ALL ".join(
        f"SELECT win_id, pos, '{p}' AS prim, round({e}, 9) AS s FROM wfd WINDOW w AS (PARTITION BY win_id ORDER BY pos)"
        for p, e in _KM.items())}),
    f AS (SELECT *, row_number() OVER (PARTITION BY win_id, prim ORDER BY s NULLS LAST, pos) AS rn FROM s)
    SELECT win_id, prim, CASE WHEN s IS NOT NULL THEN pos::DOUBLE END AS t FROM f WHERE rn = 1""",
)
def key_moment(spark, d):
    return ft.key_moment(wf(spark, d), RATE)


@query(
    "sensor_ok",
    f"""WITH {WF} SELECT win_id FROM wf GROUP BY win_id HAVING max(abs(aEgo)) <= 2.9 AND stddev_pop(abs(aEgo)) >= 0.8
    AND avg((aEgo IS NOT NULL)::INT) > 0.9""",
)
def sensor_ok(spark, d):
    return ft.sensor_ok(wf(spark, d), max_abs=2.9, min_std=0.8)


EV = "ev AS (SELECT win_id, pos AS onset FROM wf WHERE aEgo < -2.9)"


def brake_events(f):
    return f.filter(F.col("aEgo") < -2.9).select("win_id", F.col("pos").alias("onset"))


@query(
    "event_features",
    f"""WITH {WF}, {EV}, ok AS (SELECT win_id FROM wf GROUP BY win_id HAVING stddev_pop(abs(aEgo)) >= 0.05
      AND max(abs(aEgo)) <= 9),
    sm AS (SELECT win_id, pos, aEgo, vEgo, sum(abs(actual_curvature)) OVER (PARTITION BY win_id ORDER BY pos
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS k FROM wf SEMI JOIN ok USING (win_id)),
    h AS (SELECT win_id, onset, avg(aEgo) FILTER (WHERE pos < onset) AS pre_a,
      max(vEgo) FILTER (WHERE pos = onset - 4) AS v0, max(k) FILTER (WHERE pos >= onset) AS peak
      FROM ev JOIN sm USING (win_id) WHERE pos BETWEEN onset - 4 AND onset + 3 GROUP BY ALL HAVING count(*) = 8)
    SELECT win_id, onset, {rsel("pre_a v0 peak")} FROM h""",
)
def event_features(spark, d):
    f = wf(spark, d)
    return rounded(ft.event_features(f, brake_events(f), 4, 4))


@query(
    "lead_free",
    f"""WITH {WF}, {EV} SELECT win_id, onset FROM ev WHERE NOT EXISTS (SELECT 1 FROM wf WHERE wf.win_id = ev.win_id
      AND pos BETWEEN onset - 2 AND onset + 2 AND leadOne_status > 0.5 AND leadOne_dRel > 0 AND leadOne_dRel < 60)""",
)
def lead_free(spark, d):
    f = wf(spark, d)
    return ft.lead_free(f, brake_events(f), pre=2, post=2)


@query(
    "event_evidence",
    f"""WITH {STATS}, {EV}, e AS (SELECT ev.win_id, onset, scenario, avg((leadOne_status > 0.5)::INT) AS lead_share,
      avg(leadOne_vRel) AS closing FROM ev JOIN stats USING (win_id) JOIN wf ON wf.win_id = ev.win_id
      AND pos BETWEEN onset - 5 AND onset - 1 GROUP BY ALL)
    SELECT win_id, onset, scenario, {rsel("lead_share closing")}, CASE WHEN lead_share > 0.5 AND round(closing, 9) < -0.3
      THEN 'lead_decelerating' WHEN scenario = 'curve' THEN 'curve_entry' ELSE 'no_external_evidence' END AS explanation
    FROM e""",
)
def event_evidence(spark, d):
    f = wf(spark, d)
    ev = brake_events(f).join(c.stats(spark, d).select("win_id", "scenario"), "win_id")
    return rounded(ft.event_evidence(f, ev, 5))
