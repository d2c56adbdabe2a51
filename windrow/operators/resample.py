"""Resampling, time alignment and as-of joins.

Narrow samples are (keys, t_us, value, seq); grids are (keys, t_us). Times are whole
microseconds (or any integer clock).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from ..plans.ordered import CHUNK, carry, chunk_of, join_per_key

KEYS = ("entity", "route")


def make_grid(
    samples: DataFrame,
    ref_field: str,
    step: int,
    keys: Sequence[str] = KEYS,
    ticks_per_s: float = 1e6,
    block: int = CHUNK,
) -> DataFrame:
    """Uniform grid over the reference field's span, from its first sample, end-exclusive at t1 + step/2.

    Keys with fewer than two reference samples get no grid. Long grids grow block by block,
    so no row ever holds a whole grid.
    """
    keys = list(keys)
    span = samples.filter(F.col("field") == ref_field).groupBy(*keys).agg(
        F.min("t_us").alias("_t0"), F.max("t_us").alias("_t1"), F.count(F.lit(1)).alias("_n")
    )
    # Number of grid points: the smallest n with t0 + n * step >= t1 + step / 2.
    n = F.ceil((F.col("_t1") - F.col("_t0") + step / 2) / step).cast("bigint")
    span = span.filter(F.col("_n") >= 2).withColumn("_len", n)
    blocks = span.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_len") - 1) / block))))
    pos = F.sequence(F.col("_b") * block, F.least((F.col("_b") + 1) * block, F.col("_len")) - 1)
    grid = blocks.select(*keys, "_t0", F.explode(pos).alias("idx"))
    return grid.select(
        *keys,
        "idx",
        (F.col("_t0") + F.col("idx") * step).alias("t_us"),
        (F.col("idx") * (step / ticks_per_s)).alias("time_s"),
    )


def _merged(grid: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Grid and samples on one time line; a sample at a grid point's time sorts before it."""
    sample = F.struct(F.col("t_us").alias("t"), F.col("value").cast("double").alias("v"))
    s = samples.filter(F.col("value").isNotNull()).select(
        *keys, "t_us", F.lit(0).alias("_g"), "seq", sample.alias("_s"), F.lit(None).cast("bigint").alias("idx")
    )
    none = F.lit(None).cast("struct<t:bigint,v:double>")
    g = grid.select(
        *keys, "t_us", F.lit(1).alias("_g"), F.lit(0).cast("bigint").alias("seq"), none.alias("_s"), "idx"
    )
    return s.unionByName(g)


def interp_linear(
    grid: DataFrame, samples: DataFrame, keys: Sequence[str] = KEYS, chunk: float | None = 6e10, out: str = "value"
) -> DataFrame:
    """Linear interpolation of the samples onto the grid, clamped at both ends. No range join."""
    keys = list(keys)
    line = _merged(grid, samples, keys)
    line = carry(line, keys, ["t_us", "_g", "seq"], {"_p": "_s"}, {"_n": "_s"}, chunk)
    p, n = F.col("_p"), F.col("_n")
    slope = (n["v"] - p["v"]) * ((F.col("t_us") - p["t"]) / (n["t"] - p["t"]))
    value = (
        F.when(p.isNull(), n["v"]).when(n.isNull() | (n["t"] == p["t"]), p["v"]).otherwise(p["v"] + slope)
    )
    return line.filter(F.col("_g") == 1).select(*keys, "idx", "t_us", value.alias(out))


def hold_last(
    grid: DataFrame, samples: DataFrame, keys: Sequence[str] = KEYS, chunk: float | None = 6e10, out: str = "value"
) -> DataFrame:
    """Zero-order hold: the last sample at or before each grid point; before the first, the first one."""
    keys = list(keys)
    line = _merged(grid, samples, keys)
    line = carry(line, keys, ["t_us", "_g", "seq"], {"_p": "_s"}, {"_n": "_s"}, chunk)
    value = F.coalesce(F.col("_p.v"), F.col("_n.v"))
    return line.filter(F.col("_g") == 1).select(*keys, "idx", "t_us", value.alias(out))


def route_fallback(
    df: DataFrame, a: str, b: str, keys: Sequence[str] = KEYS, order: str = "idx", out: str = "value"
) -> DataFrame:
    """Stream ``a``, or stream ``b`` where ``a`` has no value on the whole route.

    One small aggregate per route joined back, not a window over the route.
    """
    keys = list(keys)
    has = df.groupBy(*keys).agg((F.count(a) > 0).alias("_has"))
    joined = join_per_key(df, has, keys, order)
    return joined.withColumn(out, F.when(F.col("_has"), F.col(a)).otherwise(F.col(b))).drop("_has")


def guarded_ratio(
    df: DataFrame, y: str = "yawRate", v: str = "vEgo", ref: str = "actual_curvature", v_min: float = 3.0
) -> DataFrame:
    """Measured curvature y / v above a speed floor, and its slip against the reference."""
    curv = F.when(F.col(v) > v_min, F.col(y) / F.col(v))
    return df.withColumn("curv_measured", curv).withColumn("slip", F.col(ref) - F.col("curv_measured"))


def regime_mask(df: DataFrame, flag_a: str, flag_b: str, out: str = "is_human") -> DataFrame:
    """1 where both control flags are known and off."""
    off = F.coalesce((F.col(flag_a) < 0.5) & (F.col(flag_b) < 0.5), F.lit(False))
    return df.withColumn(out, off.cast("bigint"))


def chunk_index(
    df: DataFrame, chunks: DataFrame, t: str = "time_s", keys: Sequence[str] = KEYS, len_s: float = 60.0
) -> DataFrame:
    """Index of the recording file that holds time t: the route's smallest file index + floor(t / len_s)."""
    keys = list(keys)
    first = chunks.groupBy(*keys).agg(F.min("k").alias("k_min"))
    out = join_per_key(df, first, keys, t, "left", len_s * 1024).withColumn("k_min", F.coalesce("k_min", F.lit(0)))
    return out.withColumn("k", (F.col("k_min") + F.floor(F.col(t) / len_s)).cast("bigint"))


def needed_chunks(spans: DataFrame, keys: Sequence[str] = KEYS, len_s: float = 60.0) -> DataFrame:
    """Distinct file indexes overlapped by any span (columns t0, t1, k_min)."""
    first, last = (F.col("k_min") + F.floor(F.col(t) / len_s) for t in ("t0", "t1"))
    return spans.select(*keys, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("k")).distinct()


def _align(
    windows: DataFrame, tokens: DataFrame, keys: list[str], n: int, dim: int, step_s: float, chunk_s: float, index
) -> DataFrame:
    """Slots j at t0 + j * step_s, equi-joined to the sidecar stream on (keys, chunk, index)."""
    slots = windows.select(*keys, "win_id", "t0", "k_min", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    t = F.col("t0") + F.col("j") * step_s
    inside = t - F.floor(t / chunk_s) * chunk_s
    slots = slots.select(
        *keys, "win_id", "j", (F.col("k_min") + F.floor(t / chunk_s)).cast("bigint").alias("k"), index(inside).cast("bigint").alias("i")
    )
    tok = tokens.select(*keys, "k", "i", as_double("vec").alias("_vec"))
    joined = slots.join(tok, [*keys, "k", "i"], "left")
    zero = F.lit([0.0] * dim)
    cell = F.struct("j", F.coalesce("_vec", zero).alias("v"))
    packed = joined.groupBy("win_id").agg(
        F.array_sort(F.collect_list(cell)).alias("_c"), F.count("_vec").alias("n_valid")
    )
    return packed.select("win_id", F.col("_c.v").alias("arr"), "n_valid")


def align_tokens(
    windows: DataFrame,
    tokens: DataFrame,
    fps: float = 2.0,
    n: int = 120,
    dim: int = 768,
    chunk_s: float = 60.0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Point alignment: slot j takes the token nearest t0 + j / fps (half to even); missing slots are zero."""
    return _align(windows, tokens, list(keys), n, dim, 1.0 / fps, chunk_s, lambda s: F.rint(F.round(s * fps, 9)))


def align_clips(
    windows: DataFrame,
    clips: DataFrame,
    clip_s: float = 4.0,
    n: int = 15,
    dim: int = 1024,
    chunk_s: float = 60.0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Clip alignment: slot j takes the clip that covers t0 + j * clip_s."""
    return _align(windows, clips, list(keys), n, dim, clip_s, chunk_s, lambda s: F.floor(F.round(s / clip_s, 9)))


def stride_tokens(df: DataFrame, arr: str = "arr", step: int = 10, n: int = 12, out: str = "strided") -> DataFrame:
    """Every step-th token, the first n of them."""
    return df.withColumn(out, F.slice(F.filter(arr, lambda x, i: i % step == 0), 1, n))


def masked_mean_pool(df: DataFrame, arr: str = "arr", n_valid: str = "n_valid", dim: int = 768, out: str = "vec") -> DataFrame:
    """Mean of the first n_valid tokens; zeros where there are none."""
    n = F.greatest(F.col(n_valid).cast("int"), F.lit(0))
    total = F.aggregate(
        F.slice(arr, 1, n), F.lit([0.0] * dim), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q)
    )
    return df.withColumn(out, F.transform(total, lambda x: x / F.greatest(n, F.lit(1))))


def causal_tokens(anchors: DataFrame, step: int = 5, mode: str = "full", hist: int = 50, arr: str | None = None) -> DataFrame:
    """Token range [lo, hi) that may be seen at anchor ``a`` (columns a, n_valid).

    Frames (step 5) count once they start before the anchor, clips (other steps) once they
    are over. Mode "5s" keeps the recent ones. With ``arr`` the visible tokens are sliced out.
    """
    a, n = F.col("a"), F.col("n_valid")
    if step == 5:
        hi = F.least(n, F.floor((a + 4) / 5))
        lo = F.lit(0) if mode == "full" else F.greatest(F.lit(0), F.floor((a - hist) / 5))
    else:
        hi = F.least(n, F.floor(a / step))
        lo = F.lit(0) if mode == "full" else F.greatest(F.lit(0), hi - 2)
    out = anchors.withColumn("lo", lo.cast("bigint")).withColumn("hi", F.greatest(hi, lo).cast("bigint"))
    if arr:
        out = out.withColumn("visible", F.slice(arr, (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    return out


def downsample_mean(
    frames: DataFrame, cols: Sequence[str], n: int = 10, keys: Sequence[str] = ("win_id",), order: str = "pos"
) -> DataFrame:
    """Mean of every n rows."""
    sec = F.floor(F.col(order) / n).cast("bigint").alias("sec")
    return frames.groupBy(*keys, sec).agg(*[F.avg(c).alias(c) for c in cols])


def _resampled(series: DataFrame, keys: list[str], n: int, order: str, value: str) -> DataFrame:
    """n points over the normalised time of each series, by linear interpolation of the two neighbours; null where one of them is missing or null."""
    size = series.groupBy(*keys).agg(F.max(order).alias("_last"))
    g = size.select(*keys, "_last", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    at = F.col("i") * F.col("_last") / (n - 1)
    base = F.least(F.floor(at), F.greatest(F.col("_last") - 1, F.lit(0)))
    g = g.withColumn("_b", base).withColumn("_w", at - F.col("_b"))
    need = g.select(
        *keys,
        "i",
        F.explode(
            F.array(
                F.struct(F.col("_b").alias("o"), (1 - F.col("_w")).alias("w")),
                F.struct((F.col("_b") + 1).alias("o"), F.col("_w").alias("w")),
            )
        ).alias("_x"),
    ).select(*keys, "i", F.col("_x.o").alias(order), F.col("_x.w").alias("_w"))
    need = need.filter(F.col("_w") != 0)
    got = need.join(series.select(*keys, order, F.col(value).alias("_v")), [*keys, order], "left")
    whole = F.count("_v") == F.count(F.lit(1))
    return got.groupBy(*keys, "i").agg(F.when(whole, F.sum(F.col("_v") * F.col("_w"))).alias("v"))


def normtime_corr(
    a: DataFrame, b: DataFrame, n: int = 5000, keys: Sequence[str] = KEYS, order: str = "idx", value: str = "value"
) -> DataFrame:
    """Pearson r of two series per key after resampling both to n points of normalised time."""
    keys = list(keys)
    ra = _resampled(a, keys, n, order, value).withColumnRenamed("v", "_a")
    rb = _resampled(b, keys, n, order, value).withColumnRenamed("v", "_b")
    return ra.join(rb, [*keys, "i"]).groupBy(*keys).agg(F.corr("_a", "_b").alias("r"))


def best_lag_corr(
    frames: DataFrame,
    a: str,
    b: str,
    max_lag: int = 200,
    keys: Sequence[str] = KEYS,
    order: str = "idx",
    chunk: int = CHUNK,
) -> DataFrame:
    """Best Pearson r between ``a`` shifted by each lag in [-max_lag, max_lag] and ``b``: r, lag, n.

    A lag needs an overlap of half the series; the smallest lag wins a tie. Every chunk of
    b meets its stretch of a once (a halo of max_lag frames) and yields one row of partial
    sums per lag, so no row is multiplied by the number of lags in the shuffle.
    """
    keys = list(keys)
    mean = frames.groupBy(*keys).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), (F.max(order) + 1).alias("_n"))
    x = join_per_key(frames.select(*keys, order, a, b), mean, keys, order).select(
        *keys, F.col(order).alias("_o"), (F.col(a) - F.col("_ma")).alias("_a"), (F.col(b) - F.col("_mb")).alias("_b")
    )
    x = x.withColumn("_c", F.explode(F.sequence(chunk_of(F.col("_o") - max_lag, chunk), chunk_of(F.col("_o") + max_lag, chunk))))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def partial(group: pa.Table) -> pa.Table:
        at = group["_o"].to_numpy()
        own = at // chunk == group["_c"][0].as_py()
        stats = {c: [] for c in ["lag", *names]}
        if own.any():
            lo, hi = at[own].min(), at[own].max()
            y = np.full(hi - lo + 1, np.nan)
            y[at[own] - lo] = group["_b"].to_numpy()[own]
            # x covers the own stretch and max_lag frames on both sides.
            x = np.full(len(y) + 2 * max_lag, np.nan)
            near = (at >= lo - max_lag) & (at <= hi + max_lag)
            x[at[near] - lo + max_lag] = group["_a"].to_numpy()[near]
            for lag in range(-max_lag, max_lag + 1):
                z = x[max_lag + lag : max_lag + lag + len(y)]
                ok = ~(np.isnan(z) | np.isnan(y))
                p, q = z[ok], y[ok]
                for c, v in zip(stats, (lag, len(p), p.sum(), q.sum(), p @ p, q @ q, p @ q)):
                    stats[c].append(v)
        n = len(stats["lag"])
        key_cols = {k: pa.array([group[k][0].as_py()] * n, group.schema.field(k).type) for k in keys}
        return pa.table({**key_cols, **{c: pa.array(v, pa.int64() if c in ("lag", "n") else pa.float64()) for c, v in stats.items()}})

    types = dict(frames.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "lag bigint", "n bigint", *[f"{c} double" for c in names[1:]]])
    # The work per row is in Python: spread it over all tasks, however few bytes it is.
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = x.repartition(n, *keys, "_c").groupBy(*keys, "_c").applyInArrow(partial, schema).filter("n > 0")
    s = part.groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in names]).join(mean.select(*keys, "_n"), keys)
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    r = F.when((vx > 1e-12) & (vy > 1e-12), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    s = s.filter(F.col("_n") - F.abs("lag") >= F.floor(F.col("_n") / 2)).withColumn("r", F.round(r, 9))
    best = F.min_by(F.struct("r", "lag"), F.when(F.col("r").isNotNull(), F.struct(-F.col("r"), F.col("lag"))))
    return s.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.r", "_best.lag")


def pack_windows(
    frames: DataFrame, channels: Sequence[str], length: int = 600, keys: Sequence[str] = ("win_id",), order: str = "pos"
) -> DataFrame:
    """Dense padded bundle per window: x = array of [channels] rows, mask = valid rows.

    Null and infinite values become 0, rows beyond ``length`` are cut, short windows padded.
    """
    clean = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).otherwise(0.0).cast("float")
    row = F.array(*[F.coalesce(clean(c), F.lit(0.0).cast("float")) for c in channels])
    inside = frames.filter(F.col(order) < length)
    packed = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, row.alias("v")))).alias("_c"))
    n = F.size("_c")
    pad = F.array_repeat(F.lit([0.0] * len(channels)).cast("array<float>"), F.lit(length) - n)
    return packed.select(
        *keys,
        F.concat(F.col("_c.v"), pad).alias("x"),
        F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(length) - n)).alias("mask"),
    )
