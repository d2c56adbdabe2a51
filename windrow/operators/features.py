"""Per-window features, scenario buckets and quantile-based weak labels.

Inputs are window frames (one row per window and frame, with ``win_id`` and ``pos``);
a window is bounded by its length, so grouping by ``win_id`` is always small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import CHUNK, attach, exact_quantiles, rolling

WIN = ("win_id",)
ROUTE = ("entity", "route")

STATS = [
    "v_mean", "stop_frac", "decel_p05", "accel_p95", "jerk_rms", "curv_p95",
    "curv_rate_rms", "steer_rate_rms", "lead_frac", "brake_rate", "thw_median", "lane_sdlp",
]

# Primitive -> (statistic, end of its range labelled +1, only in this scenario).
PRIMITIVES = {
    "close_following": ("thw_median", "low", "car_following"),
    "large_headway": ("thw_median", "high", "car_following"),
    "hard_braking": ("decel_p05", "low", None),
    "high_jerk": ("jerk_rms", "high", None),
    "sharp_steer_raw": ("steer_rate_rms", "high", None),
    "sharp_steer_path": ("curv_rate_rms", "high", None),
    "lane_correction": ("lane_sdlp", "high", None),
    "curve_entry_decel": ("decel_p05", "low", "curve"),
}

# Style feature -> group, to slice feature sets.
FEATURE_GROUPS = {
    "long": ["accel_std", "accel_p95", "decel_p05", "jerk_rms", "hard_brake_rate", "hard_accel_rate"],
    "input": [
        "steer_std", "steer_rate_rms", "steer_entropy", "steer_reversal_rate", "steer_touch_rate",
        "brake_rate", "gas_rate", "brake_mag_p95",
    ],
    "path": [
        "curv_absmean", "curv_std", "curv_p95", "curv_rate_rms", "sharp_corner_rate", "slip_absmean", "slip_std",
    ],
    "lane": ["lane_bias", "lane_sdlp", "lane_width"],
    "follow": ["thw_median", "thw_p25", "close_follow_rate", "ttc_min", "lead_present_rate"],
    "speed": ["speed_mean", "speed_std"],
}


def named(exprs: dict[str, Column]) -> list[Column]:
    return [e.alias(n) for n, e in exprs.items()]


def share(cond: Column) -> Column:
    """Share of rows where the condition holds; an unknown condition counts as false."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def _delta(col: str, keys: Sequence[str], rate: float, pos: str = "pos") -> Column:
    w = Window.partitionBy(*keys).orderBy(pos)
    return (F.col(col) - F.lag(col).over(w)) * rate


def _following() -> Column:
    return (F.col("leadOne_status") > 0.5) & (F.col("vEgo") > 2.0)


def _headway() -> Column:
    return F.col("leadOne_dRel") / F.greatest(F.col("vEgo"), F.lit(0.5))


def _with_percentiles(frames: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """Percentiles over each window's frames as columns of its frames.

    As aggregates each would be a map per window, and past 128 windows a task sorts its rows by window, and the maps
    again. The frames of a window are side by side anyhow.
    """
    whole = Window.partitionBy(*keys)
    return frames.withColumns({n: F.percentile(x, F.lit(p)).over(whole) for n, (x, p) in wanted.items()})


def window_stats(
    frames: DataFrame, rate: float = 10.0, min_valid: int = 10, keys: Sequence[str] = WIN
) -> DataFrame:
    """The twelve statistics of each window in one pass over its frames."""
    f = frames.withColumn("_jerk", _delta("aEgo", keys, rate)).withColumn(
        "_dcurv", _delta("actual_curvature", keys, rate)
    )
    follow = _following()
    lane_ok = F.count("laneLeft_y") > min_valid
    center = (F.col("laneLeft_y") + F.col("laneRight_y")) / 2
    f = _with_percentiles(f, keys, {**_long_percentiles(), **_path_percentiles(), "_thw50": (F.when(follow, _headway()), 0.5)})
    return f.groupBy(*keys).agg(
        F.avg("vEgo").alias("v_mean"),
        share(F.col("vEgo") < 1.0).alias("stop_frac"),
        F.max("_decel05").alias("decel_p05"),
        F.max("_accel95").alias("accel_p95"),
        rms(F.col("_jerk")).alias("jerk_rms"),
        F.max("_curv95").alias("curv_p95"),
        rms(F.col("_dcurv")).alias("curv_rate_rms"),
        rms(F.col("steeringRateDeg")).alias("steer_rate_rms"),
        share(F.col("leadOne_status") > 0.5).alias("lead_frac"),
        F.avg("brakePressed").alias("brake_rate"),
        F.when(F.count_if(follow) > min_valid, F.max("_thw50")).alias("thw_median"),
        F.when(lane_ok, F.stddev_pop(center)).alias("lane_sdlp"),
    )


def diff_rms(frames: DataFrame, col: str, rate: float = 10.0, keys: Sequence[str] = WIN) -> DataFrame:
    """Root mean square of the first difference times the rate, within each window."""
    f = frames.select(*keys, "pos", col).withColumn("_d", _delta(col, keys, rate))
    return f.groupBy(*keys).agg(rms(F.col("_d")).alias("diff_rms"))


def _headway_percentiles() -> dict[str, tuple[Column, float]]:
    thw = F.when(_following(), _headway())
    return {"_thw50": (thw, 0.5), "_thw25": (thw, 0.25)}


def _headway_exprs(min_n: int = 5) -> dict[str, Column]:
    follow = _following()
    enough = F.count_if(follow) > min_n
    thw = F.when(follow, _headway())
    return {
        "thw_median": F.when(enough, F.max("_thw50")),
        "thw_p25": F.when(enough, F.max("_thw25")),
        "close_follow_rate": F.when(enough, F.avg(F.when(thw < 1.0, 1.0).when(follow, 0.0))),
        "lead_present_rate": share(F.col("leadOne_status") > 0.5),
    }


def headway_stats(frames: DataFrame, min_n: int = 5, keys: Sequence[str] = WIN) -> DataFrame:
    """Time headway over moving frames with a lead: median, p25, share below 1 s; null if <= min_n frames."""
    return _with_percentiles(frames, keys, _headway_percentiles()).groupBy(*keys).agg(*named(_headway_exprs(min_n)))


def _ttc_exprs(closing: float = -0.5, min_n: int = 5) -> dict[str, Column]:
    near = _following() & (F.col("leadOne_vRel") < closing)
    ttc = F.min(F.when(near, F.col("leadOne_dRel") / -F.col("leadOne_vRel")))
    return {
        "ttc_min": F.when(F.count_if(_following()) > min_n, ttc),
    }


def ttc_min(frames: DataFrame, closing: float = -0.5, min_n: int = 5, keys: Sequence[str] = WIN) -> DataFrame:
    """Smallest time to collision over following frames closing faster than ``closing``."""
    return frames.groupBy(*keys).agg(*named(_ttc_exprs(closing, min_n)))


def _long_percentiles() -> dict[str, tuple[Column, float]]:
    return {"_decel05": (F.col("aEgo"), 0.05), "_accel95": (F.col("aEgo"), 0.95)}


def _long_exprs() -> dict[str, Column]:
    return {
        "accel_std": F.stddev_pop("aEgo"),
        "accel_p95": F.max("_accel95"),
        "decel_p05": F.max("_decel05"),
        "jerk_rms": rms(F.col("_jerk")),
        "hard_brake_rate": share(F.col("aEgo") < -2.0),
        "hard_accel_rate": share(F.col("aEgo") > 1.5),
    }


def long_features(frames: DataFrame, rate: float = 10.0, keys: Sequence[str] = WIN) -> DataFrame:
    """Longitudinal group."""
    f = _with_percentiles(frames.withColumn("_jerk", _delta("aEgo", keys, rate)), keys, _long_percentiles())
    return f.groupBy(*keys).agg(*named(_long_exprs()))


def _input_exprs() -> dict[str, Column]:
    return {
        "steer_std": F.stddev_pop("steeringAngleDeg"),
        "steer_rate_rms": rms(F.col("steeringRateDeg")),
        "steer_touch_rate": F.avg("steeringPressed"),
    }


def lateral_input_features(frames: DataFrame, keys: Sequence[str] = WIN) -> DataFrame:
    """Lateral actuation group (without entropy and reversals, which have their own operators)."""
    return frames.groupBy(*keys).agg(*named(_input_exprs()))


def steering_entropy(frames: DataFrame, col: str = "steeringAngleDeg", keys: Sequence[str] = WIN) -> DataFrame:
    """Entropy of the second difference in nine bins scaled by its own 90th percentile, over ln 9."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("pos")
    f = frames.select(*keys, "pos", F.col(col).alias("_x"))
    f = f.withColumn("_e", F.col("_x") - 2 * F.lag("_x", 1).over(w) + F.lag("_x", 2).over(w))
    whole = Window.partitionBy(*keys)
    f = f.select(
        *keys,
        F.round("_e", 9).alias("_e"),
        F.count(F.lit(1)).over(whole).alias("_n"),
        F.percentile(F.abs(F.round("_e", 9)), F.lit(0.9)).over(whole).alias("_p"),
    )
    u = F.col("_e") / (F.col("_p") + 1e-6)
    edges = [-5.0, -2.5, -1.0, -0.5, 0.5, 1.0, 2.5, 5.0]
    bin_no = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    f = f.withColumn("_bin", F.when(F.col("_e").isNotNull(), bin_no))
    counts = f.groupBy(*keys, "_bin").agg(
        F.count("_e").alias("_c"), F.max("_n").alias("_n"), F.max(F.abs("_e")).alias("_m")
    )
    total = Window.partitionBy(*keys)
    counts = counts.withColumn("_p", F.col("_c") / F.sum("_c").over(total))
    h = F.coalesce(-F.sum(F.when(F.col("_c") > 0, F.col("_p") * F.ln("_p"))) / F.ln(F.lit(9.0)), F.lit(0.0))
    flat = F.max("_m") <= 1e-8
    out = F.when(F.max("_n") < 10, F.lit(None)).when(flat, 0.0).otherwise(h)
    return counts.groupBy(*keys).agg(out.cast("double").alias("steer_entropy"))


def reversal_rate(
    frames: DataFrame,
    col: str = "steeringAngleDeg",
    theta: float = 2.0,
    rate: float = 10.0,
    keys: Sequence[str] = WIN,
) -> DataFrame:
    """Direction reversals larger than theta per minute.

    Each step depends on the last counted reversal, so this folds over the window's
    ordered values: bounded by the window length.
    """
    keys = list(keys)
    packed = frames.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(col).cast("double").alias("x")))).alias("_s"),
    )
    xs = F.transform(F.filter("_s", lambda s: s["x"].isNotNull()), lambda s: s["x"])
    packed = packed.withColumn("_x", xs)
    n = F.size("_x")
    deltas = F.zip_with(
        F.slice("_x", 2, F.greatest(n - 1, F.lit(0))), F.slice("_x", 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.round(b - a, 9)
    )
    zero = F.struct(F.lit(0).alias("revs"), F.lit(0).alias("last"), F.lit(0.0).alias("acc"))

    def step(st, d):
        acc, sign = F.round(st["acc"] + d, 9), F.signum(d).cast("int")
        hit = (sign != 0) & (sign != st["last"]) & (F.abs(acc) > theta)
        return F.struct(
            F.when(hit, st["revs"] + 1).otherwise(st["revs"]).alias("revs"),
            F.when(hit, sign).otherwise(st["last"]).alias("last"),
            F.when(hit, 0.0).otherwise(acc).alias("acc"),
        )

    revs = F.aggregate(deltas, zero, step)["revs"]
    per_min = F.when(n >= 3, revs / (n / rate / 60.0 + 1e-9))
    return packed.select(*keys, revs.cast("bigint").alias("revs"), per_min.alias("steer_reversal_rate"))


def _path_percentiles() -> dict[str, tuple[Column, float]]:
    return {"_curv95": (F.abs("actual_curvature"), 0.95)}


def _path_exprs() -> dict[str, Column]:
    k = F.abs("actual_curvature")
    return {
        "curv_absmean": F.avg(k),
        "curv_std": F.stddev_pop("actual_curvature"),
        "curv_p95": F.max("_curv95"),
        "curv_rate_rms": rms(F.col("_dc")),
        "sharp_corner_rate": share(k > 0.01),
        "slip_absmean": F.avg(F.abs("slip")),
        "slip_std": F.stddev_pop("slip"),
    }


def path_features(frames: DataFrame, rate: float = 10.0, keys: Sequence[str] = WIN) -> DataFrame:
    """Realised path group: curvature and slip."""
    f = _with_percentiles(frames.withColumn("_dc", _delta("actual_curvature", keys, rate)), keys, _path_percentiles())
    return f.groupBy(*keys).agg(*named(_path_exprs()))


def _lane_exprs() -> dict[str, Column]:
    ok = F.count("laneLeft_y") > 0
    center = (F.col("laneLeft_y") + F.col("laneRight_y")) / 2
    return {
        "lane_bias": F.when(ok, F.avg(center)),
        "lane_sdlp": F.when(ok, F.stddev_pop(center)),
        "lane_width": F.when(ok, F.avg(F.col("laneRight_y") - F.col("laneLeft_y"))),
    }


def lane_features(frames: DataFrame, keys: Sequence[str] = WIN) -> DataFrame:
    """Lane placement group; null where no left line is known."""
    return frames.groupBy(*keys).agg(*named(_lane_exprs()))


def _pedal_percentiles() -> dict[str, tuple[Column, float]]:
    return {"_brake95": (F.col("brake"), 0.95)}


def _pedal_exprs() -> dict[str, Column]:
    return {
        "brake_rate": F.avg("brakePressed"),
        "gas_rate": F.avg("gasPressed"),
        "brake_mag_p95": F.max("_brake95"),
        "speed_mean": F.avg("vEgo"),
        "speed_std": F.stddev_pop("vEgo"),
    }


def pedal_speed_features(frames: DataFrame, keys: Sequence[str] = WIN) -> DataFrame:
    """Pedal and speed groups."""
    return _with_percentiles(frames, keys, _pedal_percentiles()).groupBy(*keys).agg(*named(_pedal_exprs()))


def style_features(frames: DataFrame, rate: float = 10.0, keys: Sequence[str] = WIN, group: str | None = None) -> DataFrame:
    """All style feature groups of each window, side by side; with ``group`` only its columns.

    Everything but entropy and reversals is one aggregation; those two join only if they are wanted.
    """
    wanted = FEATURE_GROUPS[group] if group else [c for cols in FEATURE_GROUPS.values() for c in cols]
    parts = {"steer_entropy": lambda: steering_entropy(frames, keys=keys), "steer_reversal_rate": lambda: reversal_rate(frames, rate=rate, keys=keys).drop("revs")}
    f = frames.withColumn("_jerk", _delta("aEgo", keys, rate)).withColumn("_dc", _delta("actual_curvature", keys, rate))
    f = _with_percentiles(f, keys, {**_long_percentiles(), **_path_percentiles(), **_headway_percentiles(), **_pedal_percentiles()})
    exprs = {**_long_exprs(), **_input_exprs(), **_path_exprs(), **_lane_exprs(), **_headway_exprs(), **_ttc_exprs(), **_pedal_exprs()}
    out = f.groupBy(*keys).agg(*[exprs[c].alias(c) for c in wanted if c in exprs]) if set(wanted) & set(exprs) else frames.select(*keys).distinct()
    for c in dict.fromkeys(wanted):
        if c in parts:
            out = out.join(parts[c](), list(keys))
    return out.select(*keys, *dict.fromkeys(wanted))


def select_feature_group(df: DataFrame, group: str, keys: Sequence[str] = WIN) -> DataFrame:
    """The key columns plus the features tagged with ``group``."""
    return df.select(*keys, *[c for c in FEATURE_GROUPS[group] if c in df.columns])


def scenario_bucket(
    stats: DataFrame,
    stop: float = 0.10,
    curve: float = 0.01,
    lead: float = 0.5,
    thw: float = 3.5,
    v_high: float = 25.0,
    v_low: float = 15.0,
) -> DataFrame:
    """One scenario per window by ordered rules."""
    rule = (
        F.when(F.col("stop_frac") > stop, "stop_go")
        .when(F.col("curv_p95") > curve, "curve")
        .when((F.col("lead_frac") > lead) & (F.col("thw_median") < thw), "car_following")
        .when(F.col("v_mean") > v_high, "high_speed")
        .when(F.col("v_mean") < v_low, "urban")
        .otherwise("free")
    )
    return stats.withColumn("scenario", rule)


def label_cuts(stats: DataFrame, spec: dict, probs: Sequence[float], min_n: int) -> DataFrame:
    """Exact quantiles of every labelled statistic, one row per scenario: q_<stat>_<percent>."""
    names = sorted({s for s, _, _ in spec.values()})
    pairs = ", ".join(f"'{s}', {s}" for s in names)
    long = stats.selectExpr("scenario", f"stack({len(names)}, {pairs}) AS (stat, x)")
    q = exact_quantiles(long, ["scenario", "stat"], "x", [p / 100 for p in probs])
    q = q.filter(F.col("n") >= min_n)
    at = lambda s, p: F.max(F.when((F.col("stat") == s) & (F.col("prob") == p / 100), F.col("q")))
    return q.groupBy("scenario").agg(*[at(s, p).alias(f"q_{s}_{p:g}") for s in names for p in probs])


def apply_labels(cut: DataFrame, spec: dict, hi: float, lo: float, prefix: str = "p_") -> DataFrame:
    """Labels from the statistics and the cut points joined to each row."""
    for prim, (s, direction, only) in spec.items():
        x, ql, qh = F.col(s), F.col(f"q_{s}_{lo:g}"), F.col(f"q_{s}_{hi:g}")
        plus, minus = (x >= qh, x <= ql) if direction == "high" else (x <= ql, x >= qh)
        # A value on both cuts (constant statistic) is -1.
        label = F.when(minus, -1.0).when(plus, 1.0).otherwise(0.0)
        ok = x.isNotNull() & ql.isNotNull()
        if only:
            ok = ok & (F.col("scenario") == only)
        cut = cut.withColumn(prefix + prim, F.when(ok, label))
    return cut


def quantile_labels(
    stats: DataFrame, spec: dict = PRIMITIVES, hi: float = 80, lo: float = 20, min_n: int = 50
) -> DataFrame:
    """Scenario-conditioned labels p_<primitive> in {+1, 0, -1, null}.

    Cut points are exact quantiles per scenario (few groups, each of any size). They
    come back as one row per scenario (six at most), so they are broadcast.
    """
    cuts = label_cuts(stats, spec, [lo, hi], min_n)
    out = apply_labels(stats.join(F.broadcast(cuts), "scenario", "left"), spec, hi, lo)
    return out.drop(*[c for c in cuts.columns if c.startswith("q_")])


def unpivot_labels(df: DataFrame, spec: dict = PRIMITIVES, keys: Sequence[str] = WIN) -> DataFrame:
    """One row per (window, primitive) with its label."""
    pairs = ", ".join(f"'{p}', p_{p}" for p in spec)
    return df.selectExpr(*keys, f"stack({len(spec)}, {pairs}) AS (prim, label)")


def label_sensitivity(
    stats: DataFrame,
    pairs: Sequence[tuple[float, float]] = ((75, 25), (85, 15)),
    base: tuple[float, float] = (80, 20),
    spec: dict = PRIMITIVES,
    min_n: int = 50,
) -> DataFrame:
    """Share of labels that change under other cut points, over rows non-neutral in either setting."""
    levels = sorted({p for pair in [base, *pairs] for p in pair})
    cuts = label_cuts(stats, spec, levels, min_n)
    cut = stats.join(F.broadcast(cuts), "scenario", "left")  # one row per scenario
    for i, (h, l) in enumerate([base, *pairs]):
        cut = apply_labels(cut, spec, h, l, f"s{i}_")
    # One row per (window, setting, primitive): the base label next to the changed one.
    rows = [
        f"'{h:g}/{l:g}', '{p}', s0_{p}, s{i}_{p}" for i, (h, l) in enumerate(pairs, 1) for p in spec
    ]
    both = cut.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (setting, prim, a, b)")
    both = both.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & ((F.col("a") != 0) | (F.col("b") != 0)))
    return both.groupBy("setting", "prim").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("a") != F.col("b")).alias("change_rate")
    )


def label_repro(a: DataFrame, b: DataFrame, spec: dict = PRIMITIVES, tol: float = 0.999) -> DataFrame:
    """Share of equal labels where both are present, and whether the gate passes."""
    ua = unpivot_labels(a, spec).withColumnRenamed("label", "a")
    ub = unpivot_labels(b, spec).withColumnRenamed("label", "b")
    both = ua.join(ub, ["win_id", "prim"]).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    out = both.groupBy("prim").agg(F.count(F.lit(1)).alias("n"), share(F.col("a") == F.col("b")).alias("share_equal"))
    return out.withColumn("ok", F.col("share_equal") >= tol)


def label_coverage(df: DataFrame, spec: dict = PRIMITIVES) -> DataFrame:
    """Counts of +1 / -1 / neutral / missing per primitive."""
    x = F.col("label")
    return unpivot_labels(df, spec).groupBy("prim").agg(
        F.count_if(x == 1).alias("pos"),
        F.count_if(x == -1).alias("neg"),
        F.count_if(x == 0).alias("neutral"),
        F.count_if(x.isNull()).alias("na"),
    )


def moving_avg_zero_pad(
    frames: DataFrame,
    col: str,
    k: int = 5,
    keys: Sequence[str] = ROUTE,
    order: str = "idx",
    chunk: int | None = CHUNK,
    out: str = "smooth",
) -> DataFrame:
    """Centred moving average that divides by k at the edges too (zero padding)."""
    before, after = k // 2, k - 1 - k // 2
    spec = {out: lambda w: F.sum(F.coalesce(F.col(col), F.lit(0.0))).over(w.rowsBetween(-before, after)) / k}
    return rolling(frames, keys, order, before, after, spec, chunk)


def key_moment(frames: DataFrame, rate: float = 10.0, keys: Sequence[str] = WIN) -> DataFrame:
    """Second of the most label-relevant frame per (window, primitive); the first frame on ties."""
    keys = list(keys)
    change = lambda c: F.coalesce(F.abs(_delta(c, keys, 1.0)), F.lit(0.0))
    near = F.when(F.col("leadOne_dRel") > 0, F.col("leadOne_dRel") / F.greatest(F.col("vEgo"), F.lit(1.0)))
    low = {"close_following": near, "large_headway": near, "hard_braking": F.col("aEgo")}
    high = {
        "high_jerk": change("aEgo"),
        "sharp_steer_raw": change("steeringAngleDeg"),
        "sharp_steer_path": change("actual_curvature"),
        "lane_correction": change("laneLeft_y"),
        "curve_entry_decel": F.abs("actual_curvature"),
    }
    score = {**low, **{k: -v for k, v in high.items()}}
    f = frames.select(*keys, "pos", *[F.round(c, 9).alias("_s_" + k) for k, c in score.items()])
    first = lambda k: F.min_by("pos", F.when(F.col("_s_" + k).isNotNull(), F.struct("_s_" + k, "pos"))) / rate
    wide = f.groupBy(*keys).agg(*[first(k).alias(k) for k in score])
    pairs = ", ".join(f"'{n}', {n}" for n in score)
    return wide.selectExpr(*keys, f"stack({len(score)}, {pairs}) AS (prim, t)")


def sensor_ok(
    frames: DataFrame, max_abs: float = 9.0, min_std: float = 0.05, min_finite: float = 0.9, keys: Sequence[str] = WIN
) -> DataFrame:
    """Keys whose acceleration channel looks sane: no spike, not flat, mostly present."""
    stats = frames.groupBy(*keys).agg(
        F.max(F.abs("aEgo")).alias("_m"),
        F.stddev_pop(F.abs("aEgo")).alias("_s"),
        share(F.col("aEgo").isNotNull()).alias("_f"),
    )
    ok = (F.col("_m") <= max_abs) & (F.col("_s") >= min_std) & (F.col("_f") > min_finite)
    return stats.filter(ok).select(*keys)


def event_features(
    frames: DataFrame,
    events: DataFrame,
    pre: int = 40,
    post: int = 40,
    lo: int | None = None,
    hi: int | None = None,
    k: int = 5,
    keys: Sequence[str] = WIN,
    order: str = "pos",
    chunk: int | None = None,
) -> DataFrame:
    """Per event on a sane sensor whose clip lies wholly in the window (and lo <= onset <= hi, if given): mean acceleration of the ``pre`` frames
    before, speed ``pre`` frames before, and the smoothed curvature peak of the ``post`` frames after."""
    keys = list(keys)
    sane = frames.join(sensor_ok(frames, keys=keys), keys, "left_semi")
    cols = sane.select(*keys, order, "aEgo", "vEgo", F.abs("actual_curvature").alias("_k"))
    smooth = moving_avg_zero_pad(cols, "_k", k, keys, order, chunk)
    near = events
    if lo is not None:
        near = near.filter(F.col("onset") >= lo)
    if hi is not None:
        near = near.filter(F.col("onset") <= hi)
    bounds = near.withColumn("_lo", F.col("onset") - pre).withColumn("_hi", F.col("onset") + post - 1)
    j = attach(smooth, bounds, keys, order, "_lo", "_hi", block=max(pre + post, 64))
    before = F.col(order) < F.col("onset")
    out = j.groupBy(*keys, "onset").agg(
        F.count(F.lit(1)).alias("_frames"),
        F.avg(F.when(before, F.col("aEgo"))).alias("pre_a"),
        F.max(F.when(F.col(order) == F.col("onset") - pre, F.col("vEgo"))).alias("v0"),
        F.max(F.when(~before, F.col("smooth"))).alias("peak"),
    )
    return out.filter(F.col("_frames") == pre + post).drop("_frames")


def lead_free(
    frames: DataFrame,
    events: DataFrame,
    lo: float = 0.0,
    hi: float = 60.0,
    pre: int = 40,
    post: int = 40,
    keys: Sequence[str] = WIN,
    order: str = "pos",
) -> DataFrame:
    """Events with no lead at a distance in (lo, hi) in the frames around them."""
    bounds = events.withColumn("_lo", F.col("onset") - pre).withColumn("_hi", F.col("onset") + post)
    near = frames.filter(
        (F.col("leadOne_status") > 0.5) & (F.col("leadOne_dRel") > lo) & (F.col("leadOne_dRel") < hi)
    ).select(*keys, order)
    seen = attach(near, bounds, keys, order, "_lo", "_hi", block=max(pre + post + 1, 64))
    return events.join(seen.select(*keys, "onset").distinct(), [*keys, "onset"], "left_anti")


def event_evidence(
    frames: DataFrame,
    events: DataFrame,
    pre: int = 50,
    lead_cut: float = 0.5,
    closing_cut: float = -0.3,
    keys: Sequence[str] = WIN,
    order: str = "pos",
) -> DataFrame:
    """Lead share and mean closing speed before each event, and the explanation they support.

    ``events`` carries the window's ``scenario``.
    """
    bounds = events.withColumn("_lo", F.col("onset") - pre).withColumn("_hi", F.col("onset") - 1)
    j = attach(frames, bounds, keys, order, "_lo", "_hi", block=max(pre, 64))
    ev = j.groupBy(*keys, "onset", "scenario").agg(
        share(F.col("leadOne_status") > 0.5).alias("lead_share"), F.avg("leadOne_vRel").alias("closing")
    )
    why = (
        F.when((F.col("lead_share") > lead_cut) & (F.round("closing", 9) < closing_cut), "lead_decelerating")
        .when(F.col("scenario") == "curve", "curve_entry")
        .otherwise("no_external_evidence")
    )
    return ev.withColumn("explanation", why)
