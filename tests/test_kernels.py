"""The chunked plans against plain windows and numpy, with chunks so small that every row is near a border."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from windrow.plans import blocks, ordered


def series(spark, n=400, keys=3, seed=1, hot=True):
    """Frames of a few keys; with ``hot`` the first key holds most of the rows."""
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        m = n if (hot and k == 0) else n // 8
        rows += [(k, i, rng.random() < 0.6, rng.choice([None, rng.randint(0, 9)]), rng.gauss(0, 1)) for i in range(m)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, idx bigint, flag boolean, v int, x double")


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chunk", [1, 3, 7, 64])
@pytest.mark.parametrize("gap", [1, 3, 10])
def test_runs(spark, chunk, gap):
    df = series(spark).filter("flag")
    agg = [("s", F.col("x"), F.sum)]
    a = ordered.runs(df, ["k"], "idx", gap, chunk=chunk)
    b = ordered.runs(df, ["k"], "idx", gap, chunk=None)
    assert as_set(a) == as_set(b)
    s1 = as_set(ordered.runs(df, ["k"], "idx", gap, agg, chunk))
    s2 = as_set(ordered.runs(df, ["k"], "idx", gap, agg, None))
    assert np.allclose([r[-1] for r in s1], [r[-1] for r in s2])


@pytest.mark.parametrize("chunk", [2, 5, 50])
def test_rolling(spark, chunk):
    df = series(spark)
    cols = {
        "s": lambda w: F.sum("v").over(w.rowsBetween(-3, 4)),
        "l": lambda w: F.lag("v", 2).over(w),
        "m": lambda w: F.max("s").over(w.rowsBetween(-1, 0)),
    }
    a = ordered.rolling(df, ["k"], "idx", 8, 8, cols, chunk)
    b = ordered.rolling(df, ["k"], "idx", 8, 8, cols, None)
    assert as_set(a) == as_set(b)


@pytest.mark.parametrize("chunk", [1, 4, 33])
def test_carry_and_running_sum(spark, chunk):
    df = series(spark).select("k", "idx", "v")
    a = ordered.carry(df, ["k"], ["idx"], {"p": "v"}, {"n": "v"}, chunk)
    b = ordered.carry(df, ["k"], ["idx"], {"p": "v"}, {"n": "v"}, None)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)
    one = {"r": F.lit(1)}
    assert as_set(ordered.running_sum(df.select("k", "idx"), ["k"], "idx", one, chunk)) == as_set(
        ordered.running_sum(df.select("k", "idx"), ["k"], "idx", one, None)
    )


def test_ranks(spark):
    df = series(spark).select("k", "idx", F.round("x", 1).alias("x"))
    w = Window.partitionBy("k").orderBy(F.desc("x"), "idx")
    want = as_set(df.withColumn("r", F.row_number().over(w)))
    assert as_set(ordered.exact_rank(df, ["k"], "x", ["idx"], descending=True, name="r")) == want
    h = Window.partitionBy("k").orderBy(F.md5(F.concat_ws(":", F.lit("5"), F.col("idx").cast("string"))), "idx")
    want = as_set(df.withColumn("r", F.row_number().over(h)).withColumn("n", F.count("*").over(Window.partitionBy("k"))))
    assert as_set(ordered.hash_rank(df, ["k"], ["idx"], 5, "r", "n")) == want


@pytest.mark.parametrize("digits", [1, 6])
def test_quantiles(spark, digits):
    df = series(spark, 700).select("k", F.round(F.col("x") * F.col("x") * F.signum("x"), digits).alias("x"))
    probs = [0.0, 0.005, 0.05, 0.2, 0.5, 0.8, 0.95, 0.995, 1.0] + [i / 100 for i in range(1, 100)]
    got = {(r.k, round(r.prob, 9)): r.q for r in ordered.exact_quantiles(df, ["k"], "x", probs).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        for p in set(probs):
            assert abs(got[(k, round(p, 9))] - np.percentile(g.x, 100 * p)) < 1e-9, (k, p)


def test_running_totals_spreads_a_hot_group(spark):
    """A group of any size is cut into many window partitions."""
    df = spark.range(20000).select(F.lit(1).alias("g"), (F.rand(3) * 100 - 50).alias("x"))
    slices = df.select(*[c.alias(n) for n, c in ordered._slices("x").items()]).distinct().count()
    assert slices > 10000
    t = ordered.running_totals(df, ["g"], "x", {"n": F.count(F.lit(1))})
    w = Window.orderBy("x")
    assert t.withColumn("want", F.sum("n").over(w)).filter("want <> cum_n OR tot_n <> 20000").count() == 0


@pytest.mark.parametrize("block", [5, 64])
def test_attach(spark, block):
    df = series(spark).select("k", "idx")
    spans = spark.createDataFrame([(0, 0, 0), (0, 3, 17), (0, 250, 399), (1, 10, 12), (2, 90, 95)], "k bigint, i0 bigint, i1 bigint")
    want = sorted((s.k, s.i0, s.i1, r.idx) for s in spans.collect() for r in df.collect() if r.k == s.k and s.i0 <= r.idx <= s.i1)
    assert as_set(ordered.attach(df, spans, ["k"], block=block)) == want


def test_blocks_do_not_change_ranks(spark):
    rng = np.random.default_rng(0)
    q, p = rng.normal(size=(40, 6)), rng.normal(size=(23, 6))
    cos = blocks.similarity("cosine", q, p)
    qs = spark.createDataFrame([(i, v.tolist(), float(cos[i, i % 23])) for i, v in enumerate(q)], "id bigint, vec array<double>, own double")
    ps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "pid bigint, vec array<double>")
    want = {i: int((np.round(cos[i], 9) > round(cos[i, i % 23], 9)).sum()) for i in range(40)}
    for block in (4, 100):
        got = {r.id: r.better for r in blocks.count_better(qs, ps, [], "id", "pid", block=block).collect()}
        assert got == want
    pts = ps.withColumn("e", F.col("pid") % 3)
    d = ((p[:, None] - p[None]) ** 2).sum(-1) + np.diag([np.inf] * 23)
    for block in (4, 100):
        got = {r.pid: r.nn for r in blocks.nearest(pts, "pid", "e", block=block).collect()}
        assert got == {i: int(d[i].argmin()) for i in range(23)}


def test_detectors_do_not_depend_on_the_chunk(spark, sf):
    from windrow.catalog import common
    from windrow.operators import detect, spans

    f = common.sig(spark, sf).filter(F.col("entity").isin("S1", "S2"))
    jobs = {
        "onset": lambda c: detect.onset_runs(f, F.col("aEgo") < -1.2, 2, 3, 2, chunk=c),
        "near": lambda c: detect.onset_runs(f, F.col("aEgo") < -1.2, 1, 3, 4, chunk=c, near=(F.abs("steeringRateDeg"), 3, 2, 30.0)),
        "follow": lambda c: detect.following_frames(f, jump=40.0, turn_k=0.018, turn_len=2, chunk=c),
        "jump": lambda c: detect.lane_jump(f, chunk=c),
        "drift": lambda c: detect.lane_drift(f, 2, 6, 0.5, 0.0195, None, ["entity", "route"], "idx", c),
        "sshape": lambda c: detect.lane_sshape(f, k_max=0.011, min_len=2, chunk=c),
        "calm": lambda c: detect.calm_cross(f, "aEgo", w=3, chunk=c),
        "first": lambda c: detect.first_sustained(f, F.col("vEgo") > 6, 4, ["entity", "route"], "idx", chunk=c),
    }
    for name, job in jobs.items():
        want = as_set(job(None))
        assert want, name
        assert as_set(job(9)) == want, name
    pred = F.col("vEgo") > 2
    for chunk in (9, 1000):
        got = spans.tumble_compact(f, pred, 7, chunk=chunk).select("entity", "route", "idx", "win_no", "pos")
        if chunk == 9:
            small = as_set(got)
    assert small == as_set(got)


def test_worker_functions_travel_by_value(tmp_path):
    """A Python worker without this package can load and run what is sent to it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(blocks.similarity))
    code = "import pickle, sys, numpy as np; f = pickle.load(open('f.pkl', 'rb')); print(f('cosine', np.eye(2), np.eye(2)).shape)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "(2, 2)" in out.stdout, out.stderr


def test_rank_splits_equal_values(spark):
    """A million rows of one value are ranked by their ties, and no task has more than twice its share."""
    n = 1_000_000
    df = spark.range(n).selectExpr("'c' AS cls", "1.0D AS score", "CAST(id AS STRING) AS id")
    out = ordered.exact_rank(df, ["cls"], "score", ["id"], name="r")
    got = out.agg(F.min("r"), F.max("r"), F.count_distinct("r")).first()
    assert tuple(got) == (1, n, n)
    first = {r.id for r in out.filter("r <= 5").collect()}
    assert first == set(sorted(map(str, range(n)))[:5])
    parts = [p for p in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert max(p["count"] for p in parts) <= 2 * n / 8 + 1000


def test_rank_of_values_close_together(spark):
    df = spark.range(100_000).selectExpr("'c' AS cls", "1.0D + (id * 7919 % 100000) * 1e-14 AS x", "id")
    out = ordered.exact_rank(df, ["cls"], "x", ["id"], name="r", descending=True, total="n")
    r = out.orderBy("r").limit(3).collect()
    assert [x.r for x in r] == [1, 2, 3] and r[0].x >= r[1].x >= r[2].x and r[0].n == 100_000


def test_one_pass_events_equal_the_single_detectors(spark, sf):
    from windrow.catalog import common
    from windrow.catalog import q_detect as q
    from windrow.operators import detect as dt

    f = common.win_frames(spark, sf)
    win = dict(keys=dt.WIN, order="pos", chunk=None)
    fol = dt.following_frames(f, **q.FOLLOWING, **win)
    tagged = dt.cutin_tag(dt.following_chunks(fol, 3, **win), fol, first=2, keys=dt.WIN, order="pos")
    hits = dt.lane_jump(f, 0.5, **win).unionByName(dt.lane_drift(f, 2, 6, 0.5, 0.0195))
    hits = hits.unionByName(dt.lane_sshape(f, k_max=0.011, min_len=2, **win))
    lanes = dt.lane_candidates(hits, f, 3, around=2)
    want = dt.event_table(
        dt.as_events(lanes, "lane_change", "step", F.col("score"), F.col("subtype")),
        dt.as_events(dt.onset_runs(f, F.col("aEgo") < -1.2, 2, 3, 2, **win), "decel"),
        dt.as_events(dt.curve_events(f, min_len=2, min_start=3, quiet=2, **win), "curve"),
        dt.as_events(dt.turn_events(f, **q.TURN), "turn"),
        dt.as_events(dt.accel_events(f, min_start=2, **q.ACC), "accel", score=F.col("gain")),
        dt.as_events(tagged, "car_following", score=F.col("mean_thw"), subtype=F.col("subtype")),
    )
    got = q.events(f)
    cols = ["win_id", "cls", "onset", F.round("score", 6).alias("score"), "subtype"]
    rows = as_set(want.select(cols))
    assert len({r[1] for r in rows}) == 6
    assert as_set(got.select(cols)) == rows
    # Rows without signals give no events and no error.
    blank = f.select("win_id", "pos", *[F.lit(None).cast(f.schema[c].dataType).alias(c) for c in f.columns if c not in ("win_id", "pos")])
    assert q.events(blank).count() == 0 and q.events(f.limit(0)).count() == 0


def test_one_pass_reads_the_frames_without_a_shuffle(spark, sf, capsys):
    from windrow.catalog import common
    from windrow.catalog import q_detect as q
    from windrow.operators import detect as dt
    from windrow.plans.ordered import rolling

    f = common.win_frames(spark, sf).withColumn("_live", dt._live(dt.WIN))
    rolling(f, ["win_id"], "pos", 0, 0, dt.lane_marks(**{k: v for k, v in q.LANES.items()}), None).filter("lane").explain("formatted")
    assert "Exchange" not in capsys.readouterr().out
