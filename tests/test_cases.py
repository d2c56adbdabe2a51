"""Hand-made cases, one assertion each, and brute-force checks of the numeric operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import curate, detect, distance, features, metrics, pairs, resample, sampling, spans


def frames(spark, flags, keys=("e", "r")):
    rows = [(*keys, i, bool(x)) for i, x in enumerate(flags)]
    return spark.createDataFrame(rows, "entity string, route string, idx bigint, on boolean")


def test_merge_runs(spark):
    f = frames(spark, [1] * 10 + [0, 0] + [1] * 10)
    run = lambda g: [(r.i0, r.i1) for r in spans.merge_runs(f, F.col("on"), g, 10).orderBy("i0").collect()]
    assert run(3) == [(0, 21)]
    assert run(2) == [(0, 9), (12, 21)]
    assert spans.merge_runs(frames(spark, [0] * 30), F.col("on"), 3, 10).count() == 0


def test_short_span_gives_one_partial_window(spark):
    s = spark.createDataFrame([("e", "r", 5, 16), ("e", "r", 40, 44), ("e", "r", 100, 139)], "entity string, route string, i0 bigint, i1 bigint")
    w = [(r.wi0, r.wi1) for r in spans.window_bounds(s, 20, 10, 10).orderBy("wi0").collect()]
    assert w == [(5, 16), (100, 119), (110, 129), (120, 139)]


def test_compact_window_spans_the_gap(spark):
    f = frames(spark, [1] * 6 + [0] * 5 + [1] * 7)
    w = spans.tumble_compact(f, F.col("on"), 10, chunk=4).groupBy("win_no").agg(F.min("idx").alias("a"), F.max("idx").alias("b")).collect()
    assert [(r.win_no, r.a, r.b) for r in w] == [(0, 0, 14)]


def test_anchored_and_chained_dedupe_differ(spark):
    h = spark.createDataFrame([("w", s, "a") for s in (0, 25, 50)], "win_id string, step bigint, rule string")
    assert sorted(r.step for r in spans.dedupe_anchored(h, 30).collect()) == [0, 50]
    ev = h.select(F.col("win_id").alias("entity"), F.col("step").alias("t"))
    assert [r.n for r in spans.session_merge(ev, 30, 5, chunk=10).collect()] == [3]


def samples(spark, rows):
    return spark.createDataFrame([("e", 0, "f", t, v, i) for i, (t, v) in enumerate(rows)], "entity string, route bigint, field string, t_us bigint, value double, seq bigint")


def test_hold_and_interp_clamp(spark):
    s = samples(spark, [(10, 1.0), (20, 3.0), (20, 5.0), (30, 7.0)])
    g = spark.createDataFrame([("e", 0, i, t) for i, t in enumerate([0, 10, 15, 20, 25, 40])], "entity string, route bigint, idx bigint, t_us bigint")
    for chunk in (None, 7.0):
        hold = [r.value for r in resample.hold_last(g, s, chunk=chunk).orderBy("idx").collect()]
        assert hold == [1.0, 1.0, 1.0, 5.0, 5.0, 7.0]
        lin = [r.value for r in resample.interp_linear(g, s, chunk=chunk).orderBy("idx").collect()]
        assert lin[0] == 1.0 and lin[1] == 1.0 and lin[2] == 2.0 and lin[4] == 6.0 and lin[5] == 7.0


def test_grid_needs_two_samples_and_is_end_exclusive(spark):
    s = samples(spark, [(0, 1.0), (100, 1.0)])
    assert resample.make_grid(s, "f", 10, block=3).count() == len(np.arange(0, 105, 10))
    assert resample.make_grid(s, "f", 40).count() == len(np.arange(0, 120, 40))
    assert resample.make_grid(samples(spark, [(0, 1.0)]), "f", 10).count() == 0


def test_alignment_rounds_half_to_even(spark):
    w = spark.createDataFrame([("e", "w", 0.0, 0)], "entity string, win_id string, t0 double, k_min bigint")
    tok = spark.createDataFrame([("e", 0, i, [float(i)]) for i in range(9)], "entity string, k bigint, i bigint, vec array<double>")
    out = resample._align(w, tok, ["entity"], 4, 1, 0.5, 60.0, lambda s: F.rint(s)).collect()[0]
    assert [v[0] for v in out.arr] == [0.0, 0.0, 1.0, 2.0]  # t = 0, .5, 1, 1.5


def win(spark, cols):
    n = len(next(iter(cols.values())))
    rows = [("w", i, *[cols[c][i] for c in cols]) for i in range(n)]
    return spark.createDataFrame(rows, "win_id string, pos bigint, " + ", ".join(f"{c} double" for c in cols))


def test_constant_statistic_is_minus_one(spark):
    rows = [(f"w{i}", "free", 1.0) for i in range(60)]
    st = spark.createDataFrame(rows, "win_id string, scenario string, jerk_rms double")
    for direction in ("high", "low"):
        lab = features.quantile_labels(st, {"p": ("jerk_rms", direction, None)})
        assert {r.p_p for r in lab.collect()} == {-1.0}
    few = features.quantile_labels(st.limit(49), {"p": ("jerk_rms", "high", None)})
    assert {r.p_p for r in few.collect()} == {None}


def test_moving_average_pads_with_zero(spark):
    f = win(spark, {"x": [1.0] * 8})
    got = [r.smooth for r in features.moving_avg_zero_pad(f, "x", 5, ["win_id"], "pos", None).orderBy("pos").collect()]
    assert np.allclose(got, np.convolve(np.ones(8), np.ones(5) / 5, "same"))


def test_reversals(spark):
    f = win(spark, {"steeringAngleDeg": [0.0, 3.0, 0.0, 3.0]})
    assert features.reversal_rate(f).collect()[0].revs == 3


def test_steering_entropy_against_numpy(spark):
    rng = random.Random(2)
    x = [rng.gauss(0, 5) for _ in range(200)]
    e = np.diff(x, n=2)
    a = np.percentile(np.abs(e), 90) + 1e-6
    p, _ = np.histogram(e, bins=np.array([-np.inf, -5, -2.5, -1, -0.5, 0.5, 1, 2.5, 5, np.inf]) * a)
    p = p[p > 0] / p.sum()
    want = -np.sum(p * np.log(p)) / np.log(9)
    got = features.steering_entropy(win(spark, {"steeringAngleDeg": x})).collect()[0].steer_entropy
    assert abs(got - want) < 1e-9
    flat = features.steering_entropy(win(spark, {"steeringAngleDeg": [1.0] * 20})).collect()[0].steer_entropy
    assert flat == 0.0


def test_speed_bins_are_right_closed(spark):
    w = spark.createDataFrame([("free", v, None, "g") for v in (0.0, 10.0, 30.0)], "scenario string, v_mean double, thw_median double, grp string")
    got = [r.key.split("|")[1] for r in pairs.match_key(w).orderBy("v_mean").collect()]
    assert got == ["nan", "v0", "v2"]


def scores(spark, s, y):
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, y int")


def verify(spark, s, y):
    return metrics.verification(scores(spark, s, y), "score", "y").collect()[0]


def test_auroc_and_eer_cases(spark):
    assert verify(spark, [1] * 6, [0, 1, 0, 1, 0, 1]).auroc == 0.5
    perfect = verify(spark, [0, 1, 2, 3], [0, 0, 1, 1])
    assert perfect.auroc == 1.0 and perfect.eer == 0.0
    assert verify(spark, [3, 2, 1, 0], [0, 0, 1, 1]).auroc == 0.0
    assert verify(spark, [1, 2], [1, 1]).auroc is None


@pytest.mark.parametrize("levels", [5, 1000])
def test_auroc_eer_ap_brute_force(spark, levels):
    rng = random.Random(levels)
    y = [rng.random() < 0.4 for _ in range(300)]
    s = [rng.randint(0, levels) + (levels // 4) * b for b in y]
    got = verify(spark, s, y)
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(got.auroc - want) < 1e-12
    # ROC points by distinct score, collinear interior points dropped.
    cuts = sorted(set(s), reverse=True)
    pts = [(sum(n >= c for n in neg), sum(p >= c for p in pos), c) for c in cuts]
    keep = [
        p for i, p in enumerate(pts)
        if i in (0, len(pts) - 1) or any(pts[i + 1][j] - 2 * p[j] + pts[i - 1][j] for j in (0, 1))
    ]
    best = min(keep, key=lambda p: (abs((len(pos) - p[1]) * len(neg) - p[0] * len(pos)), -p[2]))
    assert abs(got.eer - (best[0] / len(neg) + 1 - best[1] / len(pos)) / 2) < 1e-12
    ap, seen, hits = 0.0, 0, 0
    for c in cuts:
        h = sum(p == c for p in pos)
        seen, hits = seen + s.count(c), hits + h
        ap += h / len(pos) * hits / seen
    assert abs(metrics.average_precision(scores(spark, s, y), "score", "y").collect()[0].ap - ap) < 1e-12


def two(spark, a, b):
    rows = [(float(x), 0) for x in a] + [(float(x), 1) for x in b]
    return spark.createDataFrame(rows, "x double, side int").withColumn("g", F.lit(1))


def test_wasserstein_cases(spark):
    a = [1.0, 2.5, 4.0, 4.0, 9.0, 11.0]
    w = lambda x, y: distance.w1(two(spark, x, y), ["g"]).collect()[0].w1
    assert w(a, a) == 0.0
    assert abs(w(a, [x + 1.75 for x in a]) - 1.75) < 1e-12
    assert w(a, a[:4]) is None


def test_kl_of_two_valued_samples(spark):
    """Shares 3/4 and 1/4 against 1/4 and 3/4: the divergence is ln(3) / 2, but for the smoothing of empty bins."""
    x, y = [0.0] * 75 + [1.0] * 25, [0.0] * 25 + [1.0] * 75
    kl = lambda p, q: distance.kl_hist(two(spark, p, q), ["g"]).collect()[0].kl
    assert abs(kl(x, y) - math.log(3) / 2) < 1e-3
    assert abs(kl(x, x)) < 1e-9 and kl(x, y[:30]) > 0


@pytest.mark.parametrize("block", [16, 4096])
@pytest.mark.parametrize("gap", [0.5, 40.0])
def test_mmd_of_two_points(spark, block, gap):
    """All of one sample at 0 and all of the other at ``gap``: the bandwidth is the gap, so the distance is 2 - 2 exp(-1/2)."""
    mmd = lambda p, q: distance.mmd_rbf(two(spark, p, q), ["g"], block=block).collect()[0].mmd
    assert abs(mmd([0.0] * 40, [gap] * 25) - (2 - 2 * math.exp(-0.5))) < 1e-6
    same = [0.0, 1.0, 1.0, 4.0, 9.0] * 8
    assert abs(mmd(same, same)) < 1e-9


def test_bootstrap_of_one_entity(spark):
    df = spark.createDataFrame([("e", 2.0), ("e", 4.0)], "entity string, value double")
    r = metrics.cluster_bootstrap(df, B=50).collect()[0]
    assert r.n == 1 and r.lo == r.hi == r.mean == 3.0


def test_majority_vote_tie(spark):
    df = spark.createDataFrame([("r", p) for p in "bbaac"], "route string, p string")
    assert metrics.majority_vote(df, ["route"], "p").collect()[0].vote == "a"


def test_fold_floors(spark):
    folds = curate.entity_folds(spark.range(10).withColumnRenamed("id", "entity")).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in folds} == {"few_shot": 1, "test": 1, "val": 1, "train": 7}


def test_slots_survive(spark):
    prev = spark.createDataFrame([("c", i, f"k{i}") for i in range(1, 6)], "cls string, slot bigint, id string")
    pool = spark.createDataFrame([("c", k) for k in ("k1", "k3", "k5", "n1", "n2", "n3")], "cls string, id string")
    out = {r.slot: (r.id, r.replaced) for r in sampling.carry_slots(prev, pool, "id").collect()}
    assert {s: v for s, v in out.items() if not v[1]} == {1: ("k1", False), 3: ("k3", False), 5: ("k5", False)}
    assert set(out) == {1, 2, 3, 4, 5} and out[2][0] != out[4][0] and out[2][0].startswith("n")


def test_nan_is_null(spark):
    from windrow.sources.tables import nan_to_null

    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"))
    assert df.agg(F.avg("x")).collect()[0][0] == 1.0


def ramp(start, rate, length=600, until=None, at=5.0):
    """A constant speed, and from frame ``start`` on (to ``until``) a steady gain at 10 Hz: speeds and accelerations."""
    until = length if until is None else until
    v = [at + rate * 0.1 * min(max(i - start, 0), until - start) for i in range(length)]
    a = [rate if start <= i < until else 0.0 for i in range(length)]
    return v, a


def test_accel_events_of_drawn_traces(spark):
    """A five-frame mean sees a ramp two frames early; weak, short, stopped and reversing traces are no events."""
    stop = [5.0] * 100 + [0.0] * 40 + [0.15 * i for i in range(100)] + [15.0] * 360
    back = ramp(200, 1.5, until=300)
    traces = {
        "early": ramp(100, 1.5, until=200), "late": ramp(300, 1.5, until=400), "weak": ramp(100, 0.2), "short": ramp(100, 1.5, until=115),
        "flat": ([9.0] * 600, [0.0] * 600), "back": ([-1.0 if i == 210 else x for i, x in enumerate(back[0])], back[1]), "long": ramp(50, 1.2, until=250),
        "stop": (stop, [0.0] * 140 + [1.5] * 100 + [0.0] * 360),
    }
    rows = [(w, i, x, y) for w, (v, a) in traces.items() for i, (x, y) in enumerate(zip(v, a))]
    f = spark.createDataFrame(rows, "win_id string, pos bigint, vEgo double, aEgo double")
    got = {}
    for r in detect.accel_events(f).collect():
        got.setdefault(r.win_id, []).append(r.onset)
    assert got["early"] == [98] and got["late"] == [298]
    assert sorted(got["long"])[:2] == [48, 48 + 95]  # a hit skips its 95 frames
    assert {"weak", "short", "flat"}.isdisjoint(got) and all(not 115 <= i <= 212 for i in got.get("back", []))
    gain = {r.win_id: r.gain for r in detect.accel_events(f).filter("onset in (98, 298)").collect()}
    assert abs(gain["early"] - 0.15 * 93) < 1e-9 and abs(gain["late"] - gain["early"]) < 1e-9


def test_reversing_clips(spark):
    """Drive, halt with turned wheels, drive is reversing; a plain halt, a crawl and steady driving are not; a negative speed is."""
    go, halt = [3.0] * 10, [0.0] * 10
    clips = {"turn": (go + halt + go, 60.0), "plain": (go + halt + go, 10.0), "steady": (go * 3, 90.0), "stays": (go + halt * 2, 90.0), "back": (go + [-1.0] * 2 + go, 0.0), "from rest": (halt + go * 2, 90.0)}
    rows = [(w, i, v, angle) for w, (speeds, angle) in clips.items() for i, v in enumerate(speeds)]
    f = spark.createDataFrame(rows, "win_id string, pos bigint, vEgo double, steeringAngleDeg double")
    cand = spark.createDataFrame([(w, 15) for w in clips], "win_id string, onset bigint")
    assert {r.win_id for r in detect.has_reversing(f, cand, 45.0, 15, 15).collect() if r.reversing} == {"turn", "back"}


def test_best_lag(spark):
    rng = np.random.default_rng(1)
    b = rng.normal(size=300)
    a = np.roll(b, 7)  # a[i + 7] = b[i]
    f = spark.createDataFrame([("e", 0, i, float(a[i]), float(b[i])) for i in range(300)], "entity string, route bigint, idx bigint, a double, b double")
    for chunk in (40, 10_000):
        r = resample.best_lag_corr(f, "a", "b", 20, chunk=chunk).collect()[0]
        assert r.lag == 7 and r.r > 0.999


def test_normal_nll(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.2)], "y double, m double, v double")
    want = 0.5 * (0.2 + 0.25 * math.exp(-0.2) + math.log(2 * math.pi))
    assert abs(distance.gaussian_nll(df, "y", "m", "v").collect()[0].nll - want) < 1e-12
    mix = df.select("y", F.lit([3.0]).alias("w"), F.array("m").alias("m"), F.array("v").alias("v"))
    assert abs(distance.mixture_nll(mix, "y", "w", "m", "v").collect()[0].nll - want) < 1e-12


def test_resampling_needs_both_neighbours(spark):
    from windrow.operators import resample

    rows = [("k", i, None if i == 2 else float(i * i)) for i in range(6) if i != 4]
    df = spark.createDataFrame(rows, "entity string, idx bigint, value double")
    got = {r.i: r.v for r in resample._resampled(df, ["entity"], 11, "idx", "value").collect()}
    assert [got.get(i) for i in range(11)] == [0.0, 0.5, 1.0, None, None, None, 9.0, None, None, None, 25.0]


def test_steering_onsets(spark):
    from windrow.operators import detect

    k = [0.0, 0.0, 0.001, 0.0, 0.03, 0.03, 0.0, 0.0, 0.0, 0.0, 0.05]
    f = spark.createDataFrame([("w", i, v) for i, v in enumerate(k)], "win_id string, pos bigint, actual_curvature double")
    t = {r.pos: round(r.turning, 6) for r in detect.turning(f).collect()}
    assert [t[i] for i in (0, 2, 4, 5, 6, 10)] == [0.0, -0.001, -0.03, 0.0, -0.03, -0.05]
    on = detect.calm_cross(detect.turning(f), "turning", -0.02, -0.01, 3, ["win_id"], "pos", None)
    assert sorted(r.onset for r in on.collect()) == [4, 10]


def greedy(steps, gap):
    out = []
    for s in sorted(set(steps)):
        if not out or s - out[-1] > gap:
            out.append(s)
    return out


def test_anchors_of_long_routes(spark):
    """One route holds most hits, in one chain over many chunks; the same answer as going through them one by one."""
    import random

    from windrow.operators import spans

    rng = random.Random(8)
    steps = {"long": [], "gaps": [5, 300, 301, 304, 305, 10_000], "one": [7]}
    at = 0
    while at < 6000:
        at += rng.choice([1, 1, 2, 3])
        steps["long"].append(at)
    rows = [("e", k, s, rng.choice("abc")) for k, v in steps.items() for s in v] + [("e", "one", 7, "z"), ("e", "one", 7, "z")]
    df = spark.createDataFrame(rows, "entity string, route string, step bigint, rule string")
    got = {(r.route, r.step): list(r.rules) for r in spans.dedupe_anchored(df, 4, ["entity", "route"], chunk=100).collect()}
    want = {}
    for k, v in steps.items():
        heads = greedy(v, 4)
        for _, route, s, rule in rows:
            if route == k:
                want.setdefault((k, max(h for h in heads if h <= s)), set()).add(rule)
    assert got == {k: sorted(v) for k, v in want.items()}
    assert spans.dedupe_anchored(df.where("step < 0"), 4, ["entity", "route"], chunk=100).count() == 0


def test_one_event_in_overlapping_windows_counts_once(spark):
    from windrow.operators import detect

    ev = [("w0", "brake", 12, 1.0), ("w1", "brake", 2, 3.0), ("w1", "brake", 9, 1.0), ("w1", "turn", 2, 1.0), ("w2", "brake", 0, 1.0), ("v0", "brake", 12, 1.0)]
    events = spark.createDataFrame(ev, "win_id string, cls string, onset bigint, score double")
    wins = spark.createDataFrame([("w0", "e", 1, 0), ("w1", "e", 1, 10), ("w2", "e", 1, 20), ("v0", "f", 1, 0)], "win_id string, entity string, route bigint, wi0 bigint")
    rows = lambda gap: sorted(tuple(r) for r in detect.distinct_events(events, wins, gap).collect())
    both = [("e", 1, "brake", 12, 3.0, 2), ("e", 1, "turn", 12, 1.0, 1), ("f", 1, "brake", 12, 1.0, 1)]
    assert rows(1) == sorted([*both, ("e", 1, "brake", 19, 1.0, 2)])
    assert rows(0) == sorted([*both, ("e", 1, "brake", 19, 1.0, 1), ("e", 1, "brake", 20, 1.0, 1)])


def test_linear_probe_is_at_its_optimum(spark):
    """Predictions equal those of penalised multinomial regression solved by plain gradient steps."""
    import numpy as np

    from windrow.operators import ml

    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 4)) * [1, 5, 0.2, 1] + np.eye(3, 4)[y] * 1.5
    df = spark.createDataFrame([(f"w{i}", x[i].tolist(), f"c{y[i]}") for i in range(240)], "win_id string, vec array<double>, lab string")
    (got,) = ml.linear_probe(df, "vec", "lab").collect()
    from windrow.plans.ordered import hash_rank

    ranked = hash_rank(df.select("win_id", df.lab.alias("_y")), ["_y"], ["win_id"], 42, "_r", "_n").collect()
    train = np.zeros(240, bool)
    for r in ranked:
        train[int(r.win_id[1:])] = r["_r"] <= r["_n"] // 2
    w, b = np.zeros((4, 3)), np.zeros(3)
    t = np.eye(3)[y[train]]
    for _ in range(20_000):
        z = x[train] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.002 * (x[train].T @ (p - t) + w)
        b -= 0.002 * (p - t).sum(0)
    acc = ((x[~train] @ w + b).argmax(1) == y[~train]).mean()
    assert got.n == (~train).sum() and abs(got.acc - acc) < 0.011 and got.chance == 1 / 3
