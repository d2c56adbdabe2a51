"""Event detection and forecast-anchor queries.

Route-level detectors run on the signal table, window-level ones on the frames of the
sliding windows, with run lengths scaled to the coarse signals.
"""

from pyspark.sql import functions as F

from ..operators import detect as dt
from . import common as c
from .common import COARSE, SIG, WF, query, rounded, rsel, runs_sql

RATE = COARSE["rate"]


def onset_sql(pred, name, min_len=2, min_start=3, quiet=2, src="sig", keys="entity, route", order="idx"):
    """Runs of pred whose start has no true frame in the quiet frames before, and is late enough."""
    on = " AND ".join(f"p.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    return f"""{runs_sql(pred, 1, src, name + '_r', keys, order)},
    {name} AS (SELECT {keys}, i0 AS onset FROM {name}_r r WHERE i1 - i0 + 1 >= {min_len} AND i0 >= {min_start}
      AND NOT EXISTS (SELECT 1 FROM {name}_r p WHERE {on} AND p.i1 < r.i0 AND p.i1 >= r.i0 - {quiet}))"""


@query("onset_runs", f"WITH {SIG}, {onset_sql('aEgo < -1.2', 'o')} SELECT * FROM o")
def onset_runs(spark, d):
    return dt.onset_runs(c.sig(spark, d), F.col("aEgo") < -1.2, 2, 3, 2)


ACCEL_PARTS = """
sm0 AS (SELECT win_id, pos, vEgo AS v, round(sum(vEgo) OVER w / 5, 9) AS vs, round(sum(aEgo) OVER w / 5, 9) AS s_a,
    max(pos) OVER (PARTITION BY win_id) AS last
  FROM wf WINDOW w AS (PARTITION BY win_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
sm AS (SELECT *, round(lead(vs) OVER (PARTITION BY win_id ORDER BY pos) - vs, 9) AS dv FROM sm0),
cand AS (
  SELECT a.win_id, a.pos AS onset, max(b.vs) FILTER (WHERE b.pos >= a.pos) - a.vs AS gain
  FROM sm a JOIN sm b ON a.win_id = b.win_id AND b.pos BETWEEN a.pos - 5 AND a.pos + 10
  WHERE a.dv > 0 AND a.pos + 10 <= a.last
  GROUP BY a.win_id, a.pos, a.vs
  HAVING round(max(b.vs) FILTER (WHERE b.pos >= a.pos) - a.vs, 9) >= 3
    AND count(*) FILTER (WHERE b.dv > 0.01 AND b.pos >= a.pos AND b.pos < a.pos + 10) >= 4
    AND count(*) FILTER (WHERE b.dv < -0.03 AND b.pos >= a.pos AND b.pos < a.pos + 10) <= 6
    AND count(*) FILTER (WHERE b.s_a >= 1 AND b.pos >= a.pos) > 0
    AND min(b.v) > -0.2
    AND NOT coalesce(max(b.pos) FILTER (WHERE b.vs < 0.3) > min(b.pos) FILTER (WHERE b.vs > 1), false)
),
picks AS (
  SELECT win_id, min(onset) AS onset FROM cand GROUP BY win_id
  UNION ALL
  SELECT p.win_id, (SELECT min(k.onset) FROM cand k WHERE k.win_id = p.win_id AND k.onset >= p.onset + 10)
  FROM picks p WHERE p.onset IS NOT NULL
)"""
ACCEL = f"{WF},{ACCEL_PARTS}"
ACC = dict(win=10, min_gain=3.0, rise_min=4, dec_max=6, a_dur=1)


@query(
    "accel_events",
    f"""WITH RECURSIVE {ACCEL} SELECT win_id, onset, round(gain, 6) + 0.0 AS gain FROM cand JOIN picks USING (win_id, onset)
    WHERE onset >= 2""",
)
def accel_events(spark, d):
    return rounded(dt.accel_events(c.win_frames(spark, d), min_start=2, **ACC))


def reversing_sql(cand, pre=8, post=8):
    """Phases of a clip as running maxima: has moved, has halted after that, and since the halt rolls, then drives, again."""
    run = "(PARTITION BY win_id, onset ORDER BY pos)"
    return f"""
clip AS (SELECT k.win_id, k.onset, w.pos, w.vEgo AS v, w.steeringAngleDeg AS angle,
    round(sum(w.vEgo) OVER (PARTITION BY k.win_id, k.onset ORDER BY w.pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 9) AS smooth
  FROM {cand} k JOIN wf w ON w.win_id = k.win_id AND w.pos BETWEEN k.onset - {pre} AND k.onset + {post}),
moving AS (SELECT *, max((smooth > 1)::INT) OVER {run} AS moved FROM clip),
halting AS (SELECT *, max((moved = 1 AND smooth < 0.3)::INT) OVER {run} AS halted FROM moving),
phases AS (SELECT *, max((halted = 1 AND smooth >= 0.5)::INT) OVER {run} AS rolls, max((halted = 1 AND smooth > 1)::INT) OVER {run} AS drives FROM halting),
rev AS (SELECT win_id, onset, min(v) < -0.2 OR coalesce(max(drives) = 1 AND max(abs(angle)) FILTER (WHERE halted = 1 AND rolls = 0) > 45, false) AS reversing
  FROM phases GROUP BY ALL)"""


@query(
    "has_reversing",
    f"""WITH {WF}, cand AS (SELECT win_id, pos AS onset FROM wf WHERE abs(steeringAngleDeg) > 60),
    {reversing_sql("cand")} SELECT * FROM rev""",
)
def has_reversing(spark, d):
    f = c.win_frames(spark, d)
    cand = f.filter(F.abs("steeringAngleDeg") > 60).select("win_id", F.col("pos").alias("onset"))
    return dt.has_reversing(f, cand, 45.0, 8, 8, block=None)  # candidates meet frames in the frames' buckets


TURN_PRED = "abs(steeringAngleDeg) > 20 AND vEgo > 1.5 AND vEgo < 15"


TURNS = f"""
live AS (SELECT win_id FROM wf GROUP BY win_id HAVING stddev_pop(steeringAngleDeg) > 0.1
  AND count(*) = count(steeringAngleDeg)), lf AS (SELECT * FROM wf SEMI JOIN live USING (win_id)),
{onset_sql(TURN_PRED, 'o', src='lf', keys='win_id', order='pos')},
quick AS (SELECT win_id, onset FROM o WHERE (SELECT max(abs(steeringRateDeg)) FROM wf w WHERE w.win_id = o.win_id
  AND w.pos BETWEEN o.onset - 5 AND o.onset + 4) > 40),
{reversing_sql("quick")},
turns AS (SELECT win_id, onset FROM rev WHERE NOT reversing)"""


TURN = dict(angle=20, rate=40, min_len=2, min_start=3, quiet=2, v_lo=1.5, v_hi=15, clip=8)


@query("turn_events", f"WITH {WF}, {TURNS} SELECT * FROM turns")
def turn_events(spark, d):
    return dt.turn_events(c.win_frames(spark, d), **TURN)


@query(
    "curve_events",
    f"""WITH {SIG}, {onset_sql('abs(actual_curvature) > 0.005 AND abs(actual_curvature) < 0.03 AND vEgo >= 10', 'o')}
    SELECT * FROM o""",
)
def curve_events(spark, d):
    return dt.curve_events(c.sig(spark, d), min_len=2, min_start=3, quiet=2)


def follow_sql(src="sig", keys="entity, route", order="idx"):
    ks = [k.strip() for k in keys.split(",")]
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in ks)
    ksel = ", ".join(f"k.{k}" for k in ks)
    return f"""
fl0 AS (SELECT {keys}, {order}, leadOne_dRel AS dist,
    lag(leadOne_dRel) OVER (PARTITION BY {keys} ORDER BY {order}) AS prev_dist,
    CASE WHEN leadOne_dRel > 0 AND vEgo > 2 THEN leadOne_dRel / greatest(vEgo, 2) END AS thw,
    abs(actual_curvature) > 0.018 OR (abs(steeringAngleDeg) > 100 AND stddev_pop(steeringAngleDeg)
      OVER (PARTITION BY {keys}) > 0.1) AS turn
  FROM {src}),
{runs_sql("turn", 1, "fl0", "truns", keys, order)},
turning AS (SELECT {keys}, unnest(range(i0, i1 + 1)) AS {order} FROM truns WHERE n >= 2),
fl AS (SELECT *, coalesce(thw < 5, false)
    AND NOT (round(abs(dist - coalesce(prev_dist, dist)), 9) > 40 AND abs(dist - coalesce(prev_dist, dist))
      > 0.5 * greatest(coalesce(prev_dist, dist), 1e-3))
    AND NOT EXISTS (SELECT 1 FROM turning t WHERE {on("t", "fl0")} AND t.{order} = fl0.{order}) AS ok FROM fl0),
{runs_sql("ok", 1, "fl", "fruns", keys, order)},
fchunks AS (SELECT {keys}, i0 AS i, i0 + unnest(range(0, n // 3)) * 3 AS onset FROM fruns),
fsteps AS (SELECT *, onset + unnest([0, 1, 2]) AS {order} FROM fchunks),
fc AS (SELECT {ksel}, k.i, k.onset, avg(thw) AS mean_thw, min(thw) FILTER (WHERE f.{order} < k.onset + 2) AS near,
    bool_or(f.{order} = k.onset AND coalesce(f.prev_dist > 0 AND f.dist < 0.7 * f.prev_dist, false)) AS fell
  FROM fsteps k JOIN fl f ON {on("f", "k")} AND f.{order} = k.{order} GROUP BY {ksel}, k.i, k.onset),
fcut AS (SELECT *, CASE WHEN onset = i AND (near < 1.5 OR fell) THEN 'cutin' ELSE '' END AS subtype FROM fc)"""


FOLLOW = f"{SIG},{follow_sql()}"


FOLLOWING = dict(jump=40.0, turn_k=0.018, turn_angle=100.0, turn_len=2)


def following(spark, d):
    """Written once: its readers are the runs, their frames and the starts of runs."""
    build = lambda: dt.following_frames(c.sig(spark, d), **FOLLOWING, tasks=c.sig_tasks(spark, d))
    return c.stage(spark, "following", d, build)


@query("following_chunks", f"WITH {FOLLOW} SELECT entity, route, i, onset, {rsel('mean_thw')} FROM fc")
def following_chunks(spark, d):
    return rounded(dt.following_chunks(following(spark, d), 3, tasks=c.sig_tasks(spark, d)))


@query("cutin_tag", f"WITH {FOLLOW} SELECT entity, route, i, onset, subtype FROM fcut")
def cutin_tag(spark, d):
    f = following(spark, d)
    n = c.sig_tasks(spark, d)
    out = dt.cutin_tag(dt.following_chunks(f, 3, tasks=n), f, first=2, tasks=n)
    return out.select("entity", "route", "i", "onset", "subtype")


def jump_sql(src="sig", keys="entity, route", order="idx", thr=0.5):
    part = f"(PARTITION BY {keys} ORDER BY {order})"
    return f"""
lj AS (SELECT {keys}, {order}, coalesce(laneLeft_y, 0) - lag(coalesce(laneLeft_y, 0)) OVER {part} AS dl,
  coalesce(laneRight_y, 0) - lag(coalesce(laneRight_y, 0)) OVER {part} AS dr FROM {src}),
{runs_sql(f"round(abs(dl), 9) > {thr}", 1, "lj", "ljl", keys, order)},
{runs_sql(f"round(abs(dr), 9) > {thr}", 1, "lj", "ljr", keys, order)},
jumps AS (SELECT {keys}, i0 AS step, 'jump' AS rule FROM ljl UNION ALL SELECT {keys}, i0, 'jumpR' FROM ljr)"""


@query("lane_jump", f"WITH {SIG}, {jump_sql(thr=0.6)} SELECT * FROM jumps")
def lane_jump(spark, d):
    return dt.lane_jump(c.sig(spark, d))


DRIFT = """
ld AS (SELECT win_id, pos, round(abs(coalesce(lead(laneLeft_y, 5) OVER w, CASE WHEN lead(pos, 5) OVER w IS NOT NULL
    THEN 0 END) - coalesce(laneLeft_y, 0)), 9) AS l, round(abs(coalesce(lead(laneRight_y, 5) OVER w,
    CASE WHEN lead(pos, 5) OVER w IS NOT NULL THEN 0 END) - coalesce(laneRight_y, 0)), 9) AS r,
    max(abs(actual_curvature)) OVER (PARTITION BY win_id ORDER BY pos ROWS BETWEEN 0 PRECEDING AND 5 FOLLOWING) AS k
  FROM wf WINDOW w AS (PARTITION BY win_id ORDER BY pos)),
drifts AS (SELECT win_id, pos + 3 AS step, 'drift' AS rule FROM ld WHERE pos % 2 = 0 AND k < 0.0195 AND l > 0.5
  UNION ALL SELECT win_id, pos + 3, 'driftR' FROM ld WHERE pos % 2 = 0 AND k < 0.0195 AND r > 0.5)"""


@query("lane_drift", f"WITH {WF}, {DRIFT} SELECT * FROM drifts")
def lane_drift(spark, d):
    return dt.lane_drift(c.win_frames(spark, d), every=2, seg=6, thr=0.5, k_max=0.0195)


def sshape_sql(src="sig", keys="entity, route", order="idx"):
    return f"""
slive AS (SELECT {keys} FROM {src} GROUP BY {keys} HAVING stddev_pop(steeringAngleDeg) > 0.1),
ssf AS (SELECT * FROM {src} SEMI JOIN slive USING ({keys})),
{runs_sql("abs(steeringRateDeg) > 20 AND vEgo > 10 AND abs(actual_curvature) < 0.011", 1, "ssf", "ssr", keys, order)},
sshapes AS (SELECT {keys}, i0 AS step, 'sshape' AS rule FROM ssr WHERE n >= 2)"""


@query("lane_sshape", f"WITH {SIG}, {sshape_sql()} SELECT * FROM sshapes")
def lane_sshape(spark, d):
    return dt.lane_sshape(c.sig(spark, d), k_max=0.011, min_len=2)


LANES = dict(jump=0.5, every=2, seg=6, drift=0.5, drift_k=0.0195, k_max=0.011, min_len=2, gap=3, around=2)


LANE = f"""{WF}, {jump_sql("wf", "win_id", "pos")}, {DRIFT}, {sshape_sql("wf", "win_id", "pos")},
hits AS (SELECT * FROM jumps UNION ALL SELECT * FROM drifts UNION ALL SELECT * FROM sshapes),
anchors AS (
  SELECT win_id, min(step) AS step FROM hits GROUP BY ALL
  UNION ALL
  SELECT a.win_id, (SELECT min(h.step) FROM hits h WHERE h.win_id = a.win_id AND h.step > a.step + 3)
  FROM anchors a WHERE a.step IS NOT NULL),
merged AS (SELECT a.win_id, a.step, string_agg(DISTINCT h.rule, '+' ORDER BY h.rule) AS subtype,
    count(DISTINCT h.rule)::DOUBLE AS score FROM anchors a JOIN hits h ON h.win_id = a.win_id
    AND h.step BETWEEN a.step AND a.step + 3 WHERE a.step IS NOT NULL GROUP BY ALL),
lanes AS (SELECT * FROM merged m WHERE NOT EXISTS (SELECT 1 FROM wf WHERE wf.win_id = m.win_id
    AND wf.pos BETWEEN m.step - 2 AND m.step + 2 AND wf.vEgo <= 6.7))"""


@query("lane_candidates", f"WITH RECURSIVE {LANE} SELECT win_id, step, score, subtype FROM lanes")
def lane_candidates(spark, d):
    return dt.lane_changes(c.win_frames(spark, d), **LANES)


EVENTS = f"""{LANE}, {onset_sql('aEgo < -1.2', 'dec', src='wf', keys='win_id', order='pos')},
{onset_sql('abs(actual_curvature) > 0.005 AND abs(actual_curvature) < 0.03 AND vEgo >= 10', 'cur', src='wf', keys='win_id', order='pos')},
{ACCEL_PARTS}, {TURNS}, {follow_sql("wf", "win_id", "pos")},
evt AS (SELECT win_id, 'lane_change' AS cls, step AS onset, score, subtype FROM lanes
  UNION ALL SELECT win_id, 'decel', onset, 1.0, '' FROM dec UNION ALL SELECT win_id, 'curve', onset, 1.0, '' FROM cur
  UNION ALL SELECT win_id, 'turn', onset, 1.0, '' FROM turns UNION ALL SELECT win_id, 'car_following', onset, mean_thw, subtype FROM fcut
  UNION ALL SELECT win_id, 'accel', onset, gain, '' FROM cand JOIN picks USING (win_id, onset) WHERE onset >= 2)"""


def events(f):
    """All six classes of a window's events."""
    onset = dict(min_len=2, min_start=3, quiet=2)
    return dt.window_events(
        f, onset, onset, TURN, dict(min_start=2, **ACC), LANES, FOLLOWING, dict(length=3, first=2)
    )


@query("event_table", f"""WITH RECURSIVE {EVENTS} SELECT cls, subtype, count(*) AS n, round(avg(score), 6) + 0.0 AS score FROM evt GROUP BY ALL""")
def event_table(spark, d):
    return rounded(dt.event_counts(events(c.win_frames(spark, d))))


@query(
    "event_table_distinct",
    f"""WITH RECURSIVE {EVENTS}, a AS (SELECT entity, route, cls, wi0 + onset AS ab, max(score) AS s, count(*) AS w FROM evt JOIN bounds USING (win_id) GROUP BY ALL),
    i AS (SELECT *, sum(CASE WHEN ab - p <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY entity, route, cls ORDER BY ab) AS g FROM (SELECT *, lag(ab) OVER (PARTITION BY entity, route, cls ORDER BY ab) AS p FROM a))
    SELECT entity, route, cls, min(ab) AS onset, round(max(s) + {0.25e-6!r}::DOUBLE, 6) + 0.0 AS score, sum(w)::BIGINT AS n_windows FROM i GROUP BY entity, route, cls, g""",
)
def event_table_distinct(spark, d):
    return rounded(dt.distinct_events(events(c.win_frames(spark, d)), c.stats(spark, d), gap=1), nudge=0.25)


@query(
    "dominant_event",
    f"""WITH RECURSIVE {EVENTS}, top AS (SELECT win_id, arg_min(cls, CASE cls WHEN 'curve' THEN 1 WHEN 'turn' THEN 2 WHEN 'lane_change' THEN 3
      WHEN 'decel' THEN 4 WHEN 'accel' THEN 5 ELSE 6 END) AS cls FROM evt GROUP BY win_id)
    SELECT win_id, coalesce(cls, 'none') AS cls FROM bounds LEFT JOIN top USING (win_id)""",
)
def dominant_event(spark, d):
    f = c.win_frames(spark, d)
    return dt.dominant_event(c.stats(spark, d), events(f))


def calm_sql(src="sig", keys="entity, route", order="idx", col="aEgo", thr=-2.0, calm=-1.0, w=3):
    part = f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"""SELECT {keys}, {order} AS onset FROM (SELECT *, min({col}) OVER {part} AS m, count({col}) OVER {part} AS k
      FROM {src}) WHERE {col} < {thr} AND m > {calm} AND k = {w}"""


@query("calm_cross", f"WITH {SIG} {calm_sql()}")
def calm_cross(spark, d):
    return dt.calm_cross(c.sig(spark, d), "aEgo", w=COARSE["calm_w"])


#: A quick change of curvature after calm steering: thresholds of the fixture's steps of 0.005 a frame.
STEER = dict(thr=-0.027, calm=-0.022)

ANCHORS = f"""{WF}, turn AS (SELECT win_id, pos, -abs(actual_curvature - coalesce(lag(actual_curvature) OVER (PARTITION BY win_id ORDER BY pos), actual_curvature)) AS turning FROM wf),
onsets AS (SELECT *, 'brake' AS kind FROM ({calm_sql("wf", "win_id", "pos")}) UNION ALL SELECT *, 'steer' FROM ({calm_sql("turn", "win_id", "pos", "turning", **STEER)})),
pos_a AS (SELECT win_id, kind, onset, lead, onset - lead AS a, 1::BIGINT AS y FROM (SELECT *, unnest([1, 2, 3, 4, 5]::BIGINT[]) AS lead
  FROM onsets WHERE onset >= 6) WHERE onset - lead >= 5)"""


def anchors(f):
    brake = dt.calm_cross(f, "aEgo", w=COARSE["calm_w"], keys=dt.WIN, order="pos", chunk=None)
    steer = dt.calm_cross(dt.turning(f), "turning", w=COARSE["calm_w"], keys=dt.WIN, order="pos", chunk=None, **STEER)
    onsets = brake.withColumn("kind", F.lit("brake")).unionByName(steer.withColumn("kind", F.lit("steer")))
    return onsets, positives(onsets)


def positives(onsets):
    return dt.positive_anchors(onsets, hist=5, leads=(1, 2, 3, 4, 5), margin=1)


@query("positive_anchors", f"WITH {ANCHORS} SELECT win_id, kind, onset, lead, a, y FROM pos_a")
def positive_anchors(spark, d):
    return anchors(c.win_frames(spark, d))[1].select("win_id", "kind", "onset", "lead", "a", "y")


NEGATIVES = f"""{ANCHORS},
draws AS (SELECT win_id, draw, 5 + ('0x' || substr(md5(concat_ws(':', '42', win_id, draw)), 1, 8))::BIGINT % 10 AS a
  FROM (SELECT win_id, unnest(range(1, 7)) AS draw FROM bounds)),
neg_a AS (SELECT win_id, draw, a, 0::BIGINT AS y FROM draws n
  WHERE NOT EXISTS (SELECT 1 FROM onsets o WHERE o.win_id = n.win_id AND o.onset > n.a AND o.onset <= n.a + 5)
    AND NOT EXISTS (SELECT 1 FROM pos_a p WHERE p.win_id = n.win_id AND p.a // 3 = n.a // 3))"""


def negatives(spark, d, f, found=None):
    """``found``: the onsets and positive anchors, if the caller has them."""
    onsets, pos = found or anchors(f)
    wins = f.select("win_id").distinct()
    return dt.negative_anchors(wins, onsets, pos, fut=5, hist=5, length=20, bucket=3)


@query("negative_anchors", f"WITH {NEGATIVES} SELECT * FROM neg_a")
def negative_anchors(spark, d):
    return negatives(spark, d, c.win_frames(spark, d))


@query(
    "lead_bin",
    f"""WITH {ANCHORS}, b AS (SELECT CASE WHEN lead > 0 AND lead <= 1.01 THEN '0-1s' WHEN lead > 1.01 AND lead <= 3.01
      THEN '1-3s' WHEN lead > 3.01 AND lead <= 5.01 THEN '3-5s' END AS lead_bin FROM pos_a)
    SELECT lead_bin, count(*) AS n FROM b GROUP BY ALL""",
)
def lead_bin(spark, d):
    a = anchors(c.win_frames(spark, d))[1]
    return dt.lead_bin(a, F.col("lead") / RATE).groupBy("lead_bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_sustained",
    f"""WITH {WF} SELECT win_id, min(pos) AS first FROM (SELECT win_id, pos, sum((vEgo > 6)::INT) OVER (PARTITION BY win_id
      ORDER BY pos ROWS BETWEEN 0 PRECEDING AND 3 FOLLOWING) AS s FROM wf) WHERE s = 4 AND pos >= 2 GROUP BY win_id""",
)
def first_sustained(spark, d):
    return dt.first_sustained(c.win_frames(spark, d), F.col("vEgo") > 6, 4, lo=2)
