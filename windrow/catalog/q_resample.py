"""Resampling and alignment queries."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators import resample as rs
from ..sources import ingest
from ..sources import tables as tb
from . import common as c
from .common import COARSE, SIG, SPANS, WF, query, rounded, rsel

STEP = 21_600_000_000  # six hours: about one grid point per logged value of a user
CHUNK_US = STEP * 40

SAMPLES = """samples AS (SELECT user_id AS entity, 0::BIGINT AS route, event_type AS field, epoch_us(ts) AS t_us, value,
  event_id AS seq FROM events)"""
GRID = f"""{SAMPLES},
gspan AS (SELECT entity, route, min(t_us) AS t0, max(t_us) AS t1 FROM samples WHERE field = 'view' GROUP BY ALL HAVING count(*) >= 2),
grid AS (SELECT entity, route, idx, t0 + idx * {STEP} AS t_us FROM (SELECT *, unnest(range(0,
  ceil((t1 - t0 + {STEP} / 2) / {STEP})::BIGINT)) AS idx FROM gspan))"""


def grid(s):
    return rs.make_grid(s, "view", STEP)


@query("make_grid", f"WITH {GRID} SELECT entity, route, idx, t_us, round(idx * {STEP} / 1000000.0, 6) + 0.0 AS time_s FROM grid")
def make_grid(spark, d):
    return rounded(grid(tb.samples(spark, d)))


CLICKS = "clicks AS (SELECT * FROM samples WHERE field = 'click' AND value IS NOT NULL)"
PREV = """p AS (SELECT g.entity, g.route, g.idx, g.t_us, max(t_us_s) AS pt FROM grid g LEFT JOIN (SELECT entity, t_us AS t_us_s
  FROM clicks) s ON s.entity = g.entity AND s.t_us_s <= g.t_us GROUP BY ALL),
n AS (SELECT g.entity, g.idx, min(t_us_s) AS nt FROM grid g LEFT JOIN (SELECT entity, t_us AS t_us_s FROM clicks) s
  ON s.entity = g.entity AND s.t_us_s >= g.t_us GROUP BY ALL),
pv AS (SELECT entity, t_us, arg_max(value, seq) AS v FROM clicks GROUP BY ALL),
pn AS (SELECT p.*, nt, a.v AS v0, b.v AS v1 FROM p JOIN n USING (entity, idx) LEFT JOIN pv a ON a.entity = p.entity AND a.t_us = p.pt
  LEFT JOIN pv b ON b.entity = p.entity AND b.t_us = nt)"""


@query(
    "interp_linear",
    f"""WITH {GRID}, {CLICKS}, {PREV} SELECT entity, route, idx, t_us, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR pt = nt
    THEN v0 ELSE v0 + (v1 - v0) * ((t_us - pt) / (nt - pt)) END, 6) + 0.0 AS value FROM pn""",
)
def interp_linear(spark, d):
    s = tb.samples(spark, d)
    return rounded(rs.interp_linear(grid(s), s.filter(F.col("field") == "click"), chunk=CHUNK_US))


@query(
    "hold_last",
    f"""WITH {GRID}, {CLICKS}, {PREV} SELECT entity, route, idx, t_us, round(coalesce(v0, v1), 6) + 0.0 AS value FROM pn""",
)
def hold_last(spark, d):
    s = tb.samples(spark, d)
    return rounded(rs.hold_last(grid(s), s.filter(F.col("field") == "click"), chunk=CHUNK_US))


@query(
    "ensure_columns",
    f"""WITH {SAMPLES} SELECT entity, t_us, value, NULL::VARCHAR AS unit FROM samples""",
)
def ensure_columns(spark, d):
    schema = StructType(
        [
            StructField("entity", LongType()),
            StructField("t_us", LongType()),
            StructField("value", DoubleType()),
            StructField("unit", StringType()),
        ]
    )
    return ingest.ensure_columns(tb.samples(spark, d), schema)


@query(
    "route_fallback",
    f"""WITH {SIG} SELECT entity, route, idx, round(CASE WHEN count(CASE WHEN route % 2 = 0 THEN laneLeft_y END)
      OVER (PARTITION BY entity, route) > 0 THEN CASE WHEN route % 2 = 0 THEN laneLeft_y END ELSE laneRight_y END, 6) + 0.0
      AS value FROM sig""",
)
def route_fallback(spark, d):
    f = c.sig(spark, d).withColumn("a", F.when(F.col("route") % 2 == 0, F.col("laneLeft_y")))
    out = rs.route_fallback(f.select("entity", "route", "idx", "a", "laneRight_y"), "a", "laneRight_y")
    return rounded(out.select("entity", "route", "idx", "value"))


@query(
    "guarded_ratio",
    f"""WITH {SIG}, r AS (SELECT entity, route, idx, CASE WHEN vEgo > 3 THEN steeringRateDeg / 100 / vEgo END AS curv_measured,
      actual_curvature FROM sig), q AS (SELECT *, actual_curvature - curv_measured AS slip FROM r)
    SELECT entity, route, idx, {rsel("curv_measured slip", 9)} FROM q""",
)
def guarded_ratio(spark, d):
    f = c.sig(spark, d).withColumn("yawRate", F.col("steeringRateDeg") / 100)
    return rounded(rs.guarded_ratio(f).select("entity", "route", "idx", "curv_measured", "slip"), 9)


@query(
    "regime_mask",
    f"""WITH {SIG} SELECT entity, route, idx, coalesce(brakePressed < 0.5 AND laneLeft_y < 0.5, false)::BIGINT AS is_human FROM sig""",
)
def regime_mask(spark, d):
    f = rs.regime_mask(c.sig(spark, d), "brakePressed", "laneLeft_y")
    return f.select("entity", "route", "idx", "is_human")


FILES = """files AS (SELECT concat('S', l_suppkey) AS entity, year(l_shipdate)::BIGINT AS route, l_linenumber::BIGINT AS k FROM lineitem),
kmin AS (SELECT entity, route, min(k) AS k_min FROM files GROUP BY ALL)"""


def files(spark, d):
    return tb.table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity"),
        F.year("l_shipdate").cast("bigint").alias("route"),
        F.col("l_linenumber").cast("bigint").alias("k"),
    )


@query("chunk_index", f"WITH {SIG}, {FILES} SELECT entity, route, idx, k_min + idx // 10 AS k FROM sig JOIN kmin USING (entity, route)")
def chunk_index(spark, d):
    out = rs.chunk_index(c.sig(spark, d), files(spark, d), len_s=10.0)
    return out.select("entity", "route", "idx", "k")


@query(
    "needed_chunks",
    f"""WITH {SPANS}, {FILES} SELECT DISTINCT entity, route, unnest(range(k_min + i0 // 10, k_min + i1 // 10 + 1)) AS k
    FROM spans JOIN kmin USING (entity, route)""",
)
def needed_chunks(spark, d):
    spans = c.human_spans(c.sig(spark, d)).select("entity", "route", F.col("i0").alias("t0"), F.col("i1").alias("t1"))
    first = files(spark, d).groupBy("entity", "route").agg(F.min("k").alias("k_min"))
    return rs.needed_chunks(spans.join(first, ["entity", "route"]), len_s=10.0)


# Sidecar stream: the day of an event is its chunk, its rank inside the day the index. One chunk
# stands for 60 s, so windows start every half day (30 s).
TOKENS = """ev AS (SELECT user_id AS entity, (epoch_us(ts) // 86400000000) AS k, row_number() OVER (PARTITION BY user_id,
    epoch_us(ts) // 86400000000 ORDER BY epoch_us(ts), event_id) - 1 AS i, event_id % 10 AS x, event_id % 7 AS y FROM events),
uw AS (SELECT entity, min(k) AS k_min, max(k) - min(k) + 1 AS days FROM ev GROUP BY entity),
wins AS (SELECT entity, k_min, unnest(range(0, 2 * days)) * 30 AS t0 FROM uw),
slots AS (SELECT entity, k_min, t0, concat_ws('|', entity, t0) AS win_id, unnest(range(0, 6)) AS j FROM wins)"""


def tokens(spark, d):
    s = tb.samples(spark, d).select("entity", "t_us", F.col("seq"))
    s = s.withColumn("k", F.floor(F.col("t_us") / 86_400_000_000))
    s = tb.dense_index(s.withColumn("day", F.col("k")), ["entity", "k"], "day", ["t_us", "seq"], "i")
    vec = F.array((F.col("seq") % 10).cast("double"), (F.col("seq") % 7).cast("double"))
    s = s.select("entity", "k", "i", vec.alias("vec"))
    days = s.groupBy("entity").agg(F.min("k").alias("k_min"), (F.max("k") - F.min("k") + 1).alias("days"))
    w = days.select("entity", "k_min", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("days") * 2 - 1) * 30, F.lit(30).cast("bigint"))).alias("t0"))
    return w.withColumn("win_id", F.concat_ws("|", "entity", "t0")), s


def flat(df):
    """The aligned array as text: whole numbers only, so it compares exactly."""
    row = F.transform("arr", lambda v: F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ","))
    return df.select("win_id", F.array_join(row, ";").alias("arr"), "n_valid")


def align_sql(index, step):
    return f"""WITH {TOKENS}, a AS (SELECT s.win_id, s.j, e.x, e.y FROM slots s LEFT JOIN ev e ON e.entity = s.entity
      AND e.k = s.k_min + (t0 + j * {step}) // 60 AND e.i = {index})
    SELECT win_id, string_agg(concat(coalesce(x, 0), ',', coalesce(y, 0)), ';' ORDER BY j) AS arr, count(x) AS n_valid FROM a GROUP BY win_id"""


@query("align_tokens", align_sql("round_even(((t0 + j * 20) % 60) / 20.0, 0)::BIGINT", 20))
def align_tokens(spark, d):
    w, s = tokens(spark, d)
    return flat(rs.align_tokens(w, s, fps=0.05, n=6, dim=2, keys=["entity"]))


@query("align_clips", align_sql("((t0 + j * 20) % 60) // 20", 20))
def align_clips(spark, d):
    w, s = tokens(spark, d)
    return flat(rs.align_clips(w, s, clip_s=20.0, n=6, dim=2, keys=["entity"]))


@query(
    "stride_tokens",
    f"""WITH {TOKENS}, a AS (SELECT s.win_id, s.j, e.x, e.y FROM slots s LEFT JOIN ev e ON e.entity = s.entity
      AND e.k = s.k_min + (t0 + j * 20) // 60 AND e.i = ((t0 + j * 20) % 60) // 20)
    SELECT win_id, string_agg(concat(coalesce(x, 0), ',', coalesce(y, 0)), ';' ORDER BY j) FILTER (WHERE j % 2 = 0 AND j < 4) AS arr,
      count(x) AS n_valid FROM a GROUP BY win_id""",
)
def stride_tokens(spark, d):
    w, s = tokens(spark, d)
    a = rs.align_clips(w, s, clip_s=20.0, n=6, dim=2, keys=["entity"])
    return flat(rs.stride_tokens(a, step=2, n=2).select("win_id", F.col("strided").alias("arr"), "n_valid"))


@query(
    "masked_mean_pool",
    f"""WITH {TOKENS}, a AS (SELECT s.win_id, s.j, e.x, e.y, count(x) OVER (PARTITION BY s.win_id) AS n FROM slots s LEFT JOIN ev e
      ON e.entity = s.entity AND e.k = s.k_min + (t0 + j * 20) // 60 AND e.i = ((t0 + j * 20) % 60) // 20)
    SELECT win_id, round(coalesce(sum(coalesce(x, 0)) FILTER (WHERE j < n), 0) / greatest(any_value(n), 1), 6) + 0.0 AS v0,
      round(coalesce(sum(coalesce(y, 0)) FILTER (WHERE j < n), 0) / greatest(any_value(n), 1), 6) + 0.0 AS v1 FROM a GROUP BY win_id""",
)
def masked_mean_pool(spark, d):
    w, s = tokens(spark, d)
    a = rs.align_clips(w, s, clip_s=20.0, n=6, dim=2, keys=["entity"])
    p = rs.masked_mean_pool(a, dim=2)
    return rounded(p.select("win_id", F.col("vec")[0].alias("v0"), F.col("vec")[1].alias("v1")))


@query(
    "causal_tokens",
    """WITH a AS (SELECT event_id, event_id % 550 AS a, event_id % 121 AS n FROM events)
    SELECT event_id, least(n, (a + 4) // 5) AS hi_full, greatest(least(n, (a + 4) // 5), greatest(0, (a - 50) // 5)) AS hi_5s,
      CASE WHEN a < 50 THEN 0 ELSE (a - 50) // 5 END AS lo_5s, least(n, a // 40) AS hi_clip,
      greatest(0, least(n, a // 40) - 2) AS lo_clip FROM a""",
)
def causal_tokens(spark, d):
    a = tb.table(spark, d, "events").select(
        "event_id", (F.col("event_id") % 550).alias("a"), (F.col("event_id") % 121).alias("n_valid")
    )
    ren = lambda df, lo, hi: df.withColumnRenamed("lo", lo).withColumnRenamed("hi", hi)
    out = ren(rs.causal_tokens(a), "lo_full", "hi_full")
    out = ren(rs.causal_tokens(out, mode="5s"), "lo_5s", "hi_5s")
    out = ren(rs.causal_tokens(out, step=40, mode="5s"), "lo_clip", "hi_clip")
    return out.select("event_id", "hi_full", "hi_5s", "lo_5s", "hi_clip", "lo_clip")


@query(
    "downsample_mean",
    f"""WITH {WF}, m AS (SELECT win_id, pos // 5 AS sec, avg(vEgo) AS vEgo, avg(aEgo) AS aEgo FROM wf GROUP BY ALL)
    SELECT win_id, sec, {rsel("vEgo aEgo", 9)} FROM m""",
)
def downsample_mean(spark, d):
    return rounded(rs.downsample_mean(c.win_frames(spark, d), ["vEgo", "aEgo"], 5), 9)


@query(
    "normtime_corr",
    f"""WITH {SIG}, ab AS (SELECT entity, route, idx, vEgo AS v, 0 AS s FROM sig
      UNION ALL SELECT entity, route - 1, idx, vEgo, 1 FROM sig),
    sz AS (SELECT entity, route, s, max(idx) AS last FROM ab GROUP BY ALL),
    g AS (SELECT *, i * last / 49.0 AS tt, least(floor(i * last / 49.0), greatest(last - 1, 0))::BIGINT AS b
      FROM (SELECT *, unnest(range(0, 50)) AS i FROM sz)),
    r AS (SELECT g.entity, g.route, g.s, g.i, sum(v * CASE WHEN idx = b THEN 1 - (tt - b) ELSE tt - b END) AS v FROM g JOIN ab
      ON ab.entity = g.entity AND ab.route = g.route AND ab.s = g.s AND ab.idx BETWEEN b AND b + 1 GROUP BY ALL)
    SELECT entity, route, round(corr(x.v, y.v), 6) + 0.0 AS r FROM r x JOIN r y USING (entity, route, i)
    WHERE x.s = 0 AND y.s = 1 GROUP BY ALL""",
)
def normtime_corr(spark, d):
    a = c.sig(spark, d).select("entity", "route", "idx", F.col("vEgo").alias("value"))
    b = a.withColumn("route", F.col("route") - 1)
    return rounded(rs.normtime_corr(a, b, 50))


@query(
    "best_lag_corr",
    f"""WITH {SIG}, n AS (SELECT entity, route, count(*) AS n FROM sig GROUP BY ALL), lags AS (SELECT unnest(range(-5, 6)) AS lag),
    r AS (SELECT x.entity, x.route, lag, round(corr(x.vEgo, y.aEgo), 9) AS r FROM lags, sig x JOIN sig y
        ON x.entity = y.entity AND x.route = y.route AND x.idx = y.idx + lag JOIN n ON n.entity = x.entity AND n.route = x.route
      WHERE n - abs(lag) >= n // 2 GROUP BY ALL)
    SELECT entity, route, round(max(r), 6) + 0.0 AS r, arg_min(lag, (-r, lag)) AS lag FROM r GROUP BY ALL""",
)
def best_lag_corr(spark, d):
    return rounded(rs.best_lag_corr(c.sig(spark, d), "vEgo", "aEgo", 5))


@query(
    "pack_windows",
    f"""WITH {WF} SELECT win_id, string_agg(concat((vEgo * 10)::INT, ',', (coalesce(laneLeft_y, 0) * 10)::INT), ';' ORDER BY pos)
      || repeat(';0,0', 24 - count(*)::INT) AS x, count(*) AS n FROM wf GROUP BY win_id""",
)
def pack_windows(spark, d):
    p = rs.pack_windows(c.win_frames(spark, d), ["vEgo", "laneLeft_y"], 24)
    cell = lambda v: F.array_join(F.transform(v, lambda x: F.round(x * 10).cast("int").cast("string")), ",")
    return p.select(
        "win_id",
        F.array_join(F.transform("x", cell), ";").alias("x"),
        F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("n"),
    )
