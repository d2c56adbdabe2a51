"""Span, window and session queries."""

from pyspark.sql import functions as F

from ..operators import spans as sp
from ..sources import tables as tb
from . import common as c
from .common import BOUNDS, COARSE, SIG, SPANS, WF, query, rounded, rsel, runs_sql

SPAN_TABLE = (
    SPANS
    + """,
span_t AS (
  SELECT entity, route, row_number() OVER (PARTITION BY entity, route ORDER BY i0) - 1 AS span_id, i0, i1,
    i0::DOUBLE AS t0, i1::DOUBLE AS t1, (i1 - i0 + 1)::DOUBLE AS dur_s, moving_frac
  FROM (SELECT p.entity, p.route, p.i0, p.i1, avg((s.vEgo > 2)::INT) AS moving_frac
    FROM spans p JOIN sig s ON s.entity = p.entity AND s.route = p.route AND s.idx BETWEEN p.i0 AND p.i1
    GROUP BY ALL)
)"""
)


@query("merge_runs", f"WITH {SPANS} SELECT * FROM spans")
def merge_runs(spark, d):
    return c.human_spans(c.sig(spark, d))


@query("span_table", f"WITH {SPAN_TABLE} SELECT entity, route, span_id, i0, i1, {rsel('t0 t1 dur_s moving_frac')} FROM span_t")
def span_table(spark, d):
    f = c.sig(spark, d)
    return rounded(sp.span_table(f, c.human_spans(f), rate=COARSE["rate"]))


@query(
    "span_rollup",
    f"""WITH {SPAN_TABLE}, r AS (SELECT count(*) AS n, sum(dur_s) / 3600 AS hours,
    sum(dur_s * moving_frac) / 3600 AS moving_hours, quantile_cont(dur_s, 0.5) AS p50, quantile_cont(dur_s, 0.9) AS p90
    FROM span_t) SELECT n, {rsel("hours moving_hours p50 p90")} FROM r""",
)
def span_rollup(spark, d):
    f = c.sig(spark, d)
    n = c.sig_tasks(spark, d)
    return rounded(sp.span_rollup(sp.span_table(f, c.human_spans(f, n), rate=COARSE["rate"], tasks=n)))


@query("raw_runs", f"WITH {SIG}, {runs_sql('aEgo < -1.2')} SELECT entity, route, i0 AS i, i1 + 1 AS j FROM runs")
def raw_runs(spark, d):
    return sp.raw_runs(c.sig(spark, d), F.col("aEgo") < -1.2)


@query(
    "slide_windows",
    f"""WITH {BOUNDS} SELECT b.entity, b.route, win_id, wi0, wi1, round(avg((vEgo > 2)::INT), 6) + 0.0 AS moving_frac
    FROM bounds b JOIN sig s ON s.entity = b.entity AND s.route = b.route AND s.idx BETWEEN wi0 AND wi1
    GROUP BY ALL HAVING avg((vEgo > 2)::INT) >= 0.5""",
)
def slide_windows(spark, d):
    f = c.sig(spark, d)
    return rounded(sp.slide_windows(f, c.human_spans(f), COARSE["win"], COARSE["stride"], COARSE["min_len"]))


@query(
    "tumble_compact",
    f"""WITH {SIG}, kept AS (SELECT *, row_number() OVER (PARTITION BY entity, route ORDER BY idx) - 1 AS rn,
      count(*) OVER (PARTITION BY entity, route) AS al FROM sig WHERE is_human > 0.5 AND vEgo > 2)
    SELECT entity, route, rn // 20 AS win_no, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx
    FROM kept WHERE (rn // 20 + 1) * 20 <= al GROUP BY ALL""",
)
def tumble_compact(spark, d):
    w = sp.tumble_compact(c.sig(spark, d), (F.col("is_human") > 0.5) & (F.col("vEgo") > 2), COARSE["win"])
    return w.groupBy("entity", "route", "win_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


@query(
    "chunk_runs",
    f"""WITH {SIG}, {runs_sql('vEgo > 5')} SELECT entity, route, i0 AS i,
    i0 + unnest(range(0, (i1 + 1 - i0) // 10)) * 10 AS t FROM runs""",
)
def chunk_runs(spark, d):
    return sp.chunk_runs(sp.raw_runs(c.sig(spark, d), F.col("vEgo") > 5), COARSE["chunk_len"])


HITS = f"""{WF}, hits AS (
  SELECT win_id, pos AS step, 'brake' AS rule FROM wf WHERE aEgo < -2.5
  UNION ALL SELECT win_id, pos, 'steer' FROM wf WHERE abs(steeringAngleDeg) > 110)"""


def rule_hits(f):
    a = f.filter(F.col("aEgo") < -2.5).select("win_id", F.col("pos").alias("step"), F.lit("brake").alias("rule"))
    b = f.filter(F.abs("steeringAngleDeg") > 110).select("win_id", F.col("pos").alias("step"), F.lit("steer").alias("rule"))
    return a.unionByName(b)


@query(
    "dedupe_anchored",
    f"""WITH RECURSIVE {HITS}, hs AS (SELECT DISTINCT win_id, step FROM hits),
    anchors AS (
      SELECT win_id, min(step) AS step FROM hs GROUP BY ALL
      UNION ALL
      SELECT a.win_id, (SELECT min(h.step) FROM hs h WHERE h.win_id = a.win_id
        AND h.step > a.step + 4) FROM anchors a WHERE a.step IS NOT NULL)
    SELECT a.win_id, a.step, string_agg(DISTINCT h.rule, '+' ORDER BY h.rule) AS rules
    FROM anchors a JOIN hits h ON h.win_id = a.win_id AND h.step BETWEEN a.step AND a.step + 4
    WHERE a.step IS NOT NULL GROUP BY ALL""",
)
def dedupe_anchored(spark, d):
    out = sp.dedupe_anchored(rule_hits(c.win_frames(spark, d)), 4)
    return out.withColumn("rules", F.array_join("rules", "+"))


ROUTE_HITS = f"""{SIG}, hits AS (SELECT entity, route, idx AS step, 'brake' AS rule FROM sig WHERE aEgo < -1.2
  UNION ALL SELECT entity, route, idx, 'turn' FROM sig WHERE abs(actual_curvature) > 0.012)"""


@query(
    "dedupe_anchored_routes",
    f"""WITH RECURSIVE {ROUTE_HITS}, hs AS (SELECT DISTINCT entity, route, step FROM hits),
    nxt AS (SELECT a.entity, a.route, a.step, min(b.step) AS nx FROM hs a LEFT JOIN hs b ON a.entity = b.entity AND a.route = b.route AND b.step > a.step + 4 GROUP BY ALL),
    anchors AS (SELECT entity, route, min(step) AS step FROM hs GROUP BY ALL
      UNION ALL SELECT a.entity, a.route, n.nx FROM anchors a JOIN nxt n ON n.entity = a.entity AND n.route = a.route AND n.step = a.step WHERE n.nx IS NOT NULL)
    SELECT a.entity, a.route, a.step, string_agg(DISTINCT h.rule, '+' ORDER BY h.rule) AS rules
    FROM anchors a JOIN hits h ON h.entity = a.entity AND h.route = a.route AND h.step BETWEEN a.step AND a.step + 4 GROUP BY ALL""",
)
def dedupe_anchored_routes(spark, d):
    """Hits of whole routes, which may be of any length."""
    f = c.sig(spark, d)
    hit = lambda pred, rule: f.filter(pred).select("entity", "route", F.col("idx").alias("step"), F.lit(rule).alias("rule"))
    hits = hit(F.col("aEgo") < -1.2, "brake").unionByName(hit(F.abs("actual_curvature") > 0.012, "turn"))
    out = sp.dedupe_anchored(hits, 4, sp.ROUTE, chunk=64)
    return out.withColumn("rules", F.array_join("rules", "+"))


SESSIONS = """ev AS (SELECT user_id AS entity, epoch_us(ts) AS t FROM events),
""" + runs_sql("true", 21_600_000_000, "ev", "sess", "entity", "t")


@query(
    "session_merge",
    f"""WITH {SESSIONS} SELECT entity, i0 - 300000000 AS start, i1 + 300000000 AS "end", n FROM sess""",
)
def session_merge(spark, d):
    ev = tb.samples(spark, d).select("entity", F.col("t_us").alias("t"))
    return sp.session_merge(ev, 21_600_000_000, 300_000_000, chunk=86_400_000_000 * 30)


@query(
    "event_slice",
    f"""WITH {SIG}, ev AS (SELECT entity, route, onset, onset + k AS idx FROM (SELECT entity, route, idx AS onset, unnest(range(-5, 4)) AS k FROM sig WHERE aEgo < -2.9))
    SELECT entity, route, onset, idx, (idx - onset)::DOUBLE AS t_rel, aEgo FROM ev JOIN sig USING (entity, route, idx)""",
)
def event_slice(spark, d):
    f = c.sig(spark, d)
    ev = f.filter(F.col("aEgo") < -2.9).select("entity", "route", F.col("idx").alias("onset"))
    out = sp.event_slice(f.select("entity", "route", "idx", "aEgo"), ev, 5, 3, COARSE["rate"])
    return out.select("entity", "route", "onset", "idx", "t_rel", "aEgo")
