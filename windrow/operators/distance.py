"""Distribution distances and prediction quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import attach, exact_quantiles, exact_rank, running_totals
from ..plans.stage import materialize
from .metrics import _neighbour, cluster_bootstrap

# Copies of a group's range that its values meet: a group of any size is spread over so many keys.
RANGE_COPIES = 64
# Samples needed on each side, histogram smoothing, bandwidth guard.
MIN_SIDE = 5
SMOOTH = 1e-6
SIGMA_EPS = 1e-9


def two_sided(a: DataFrame, b: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Both samples in one table: by, x, side (0 = a, 1 = b); missing values dropped."""
    pick = lambda df, s: df.select(*by, F.col(value).cast("double").alias("x"), F.lit(s).alias("side"))
    return pick(a, 0).unionByName(pick(b, 1)).filter(F.col("x").isNotNull() & ~F.isnan("x"))


def _sides() -> dict[str, Column]:
    return {"na": F.sum(1 - F.col("side")), "nb": F.sum(F.col("side"))}


def w1(ab: DataFrame, by: Sequence[str]) -> DataFrame:
    """Wasserstein-1 per slice: area between the two empirical distribution functions."""
    by = list(by)
    t = running_totals(ab, by, "x", {**_sides(), "one": F.lit(1).cast("bigint")})
    pts = t.select(*by, F.col("cum_one").alias("r"), "x", "cum_na", "cum_nb", "tot_na", "tot_nb")
    pts = _neighbour(pts, by, "r", ["x", "cum_na", "cum_nb", "tot_na", "tot_nb"], {"_next": "x"}, 1)
    share = lambda s: F.try_divide(F.col("cum_" + s), F.col("tot_" + s))
    area = F.abs(share("na") - share("nb")) * (F.col("_next") - F.col("x"))
    enough = (F.max("tot_na") >= MIN_SIDE) & (F.max("tot_nb") >= MIN_SIDE)
    return pts.groupBy(*by).agg(F.when(enough, F.coalesce(F.sum(area), F.lit(0.0))).alias("w1"))


def kl_hist(ab: DataFrame, by: Sequence[str], bins: int = 30) -> DataFrame:
    """KL divergence of two smoothed histograms over the pooled 0.5 - 99.5 % range, values outside dropped."""
    by = list(by)
    q = exact_quantiles(ab, by, "x", [0.005, 0.995])
    lo, hi = (F.max(F.when(F.col("prob") == p, F.col("q"))) for p in (0.005, 0.995))
    rng = q.groupBy(*by).agg(lo.alias("_lo"), hi.alias("_hi"))
    size = ab.groupBy(*by).agg(F.count_if(F.col("side") == 0).alias("_ta"), F.count_if(F.col("side") == 1).alias("_tb"))
    rng = rng.join(size, by) if by else rng.join(size)  # one row each
    # Equal values are one row, and a group's values are dealt over copies of its range: no task gets a group.
    x = ab.groupBy(*by, "x").agg(*[c.alias(n) for n, c in _sides().items()])
    x = x.withColumn("_s", F.pmod(F.xxhash64("x"), F.lit(RANGE_COPIES)))
    x = x.join(rng.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(RANGE_COPIES - 1).cast("bigint")))), [*by, "_s"])
    x = x.filter((F.col("x") >= F.col("_lo")) & (F.col("x") <= F.col("_hi")) & (F.col("_hi") > F.col("_lo")))
    b = F.least(F.floor(F.round((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins, 9)), F.lit(bins - 1))
    cnt = x.groupBy(*by, b.alias("_b")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.max("_ta").alias("_ta"), F.max("_tb").alias("_tb"))
    tot = cnt.groupBy(*by).agg(F.sum("na").alias("_sa"), F.sum("nb").alias("_sb"))
    cnt = cnt.join(tot, by) if by else cnt.join(tot)
    da, db = F.col("_sa") + bins * SMOOTH, F.col("_sb") + bins * SMOOTH
    p, r = (F.col("na") + SMOOTH) / da, (F.col("nb") + SMOOTH) / db
    # Empty bins all contribute the same amount.
    p0, r0 = SMOOTH / F.max(da), SMOOTH / F.max(db)
    kl = F.sum(p * F.ln(p / r)) + (bins - F.count(F.lit(1))) * p0 * F.ln(p0 / r0)
    enough = (F.max("_ta") >= MIN_SIDE) & (F.max("_tb") >= MIN_SIDE)
    return cnt.groupBy(*by).agg(F.when(enough, kl).alias("kl"))


def _block_pairs(v: DataFrame, by: list[str], block: int) -> DataFrame:
    """Distinct values with counts, cut into blocks by rank, each sent to every block pair it is part of."""
    n = F.floor((F.col("tot_one") - 1) / block)
    v = v.withColumn("_b", F.floor((F.col("cum_one") - 1) / block))
    grid = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n),
        lambda o: F.struct(F.least(o, F.col("_b")).alias("i"), F.greatest(o, F.col("_b")).alias("j")),
    )
    return v.withColumn("_p", F.explode(grid)).select("*", "_p.i", "_p.j")


def mmd_rbf(ab: DataFrame, by: Sequence[str], sigma: float | None = None, block: int = 2048, refine: int = 3) -> DataFrame:
    """Squared maximum mean discrepancy with a Gaussian kernel (V-statistic), per slice.

    Equal values are collapsed to counts; every two blocks of distinct values meet in one
    task and leave a few sums, never pairs. The default bandwidth is the median positive
    gap over all pairs of values: found by counting gaps in 4096 bins per block pair and
    narrowing to the median's bin, ``refine`` times (an error of range / 4096^refine).
    """
    by, nb = list(by), 4096
    v = running_totals(ab, by, "x", {**_sides(), "one": F.lit(1).cast("bigint")})
    v = materialize(v.select(*by, "x", "na", "nb", "cum_one", "tot_one", "tot_na", "tot_nb"), "values")
    v = v.withColumn("w", F.col("na") + F.col("nb"))
    types = dict(v.dtypes)
    kt = "".join(f"`{k}` {types[k]}, " for k in by)
    keys = [*by, "i", "j"]

    def key_of(pdf: pd.DataFrame) -> dict:
        return {k: pdf[k].iloc[0] for k in by}

    if sigma is None:
        ext = v.groupBy(*by).agg((F.max("x") - F.min("x")).alias("hi"), F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("w")).alias("_w2"))
        # Unordered pairs of unequal values, and the ranks of the two middle gaps.
        m = ((F.col("_w") * F.col("_w") - F.col("_w2")) / 2).cast("bigint")
        target = F.explode(F.array(F.struct(F.lit(1).alias("t"), F.floor((m - 1) / 2).alias("rank")), F.struct(F.lit(2).alias("t"), F.floor(m / 2).alias("rank"))))
        st = ext.filter(F.col("hi") > 0).select(*by, F.lit(0.0).alias("lo"), "hi", target.alias("_t")).select(*by, "_t.t", "lo", "hi", "_t.rank")
        st = materialize(st, "median")

        def hist(pdf: pd.DataFrame) -> pd.DataFrame:
            i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
            rows = []
            for t, g in pdf.groupby("t"):
                lo, hi = float(g["lo"].iloc[0]), float(g["hi"].iloc[0])
                left, right = g[g["_b"] == i], g[g["_b"] == j]
                gap = np.abs(left["x"].to_numpy()[:, None] - right["x"].to_numpy()[None, :])
                weight = left["w"].to_numpy()[:, None] * right["w"].to_numpy()[None, :]
                use = gap > 0
                if i == j:
                    use &= np.triu(np.ones(gap.shape, bool), 1)
                gap, weight = gap[use], weight[use]
                rows.append((int(t), -1, int(weight[gap < lo].sum())))
                inside = (gap >= lo) & (gap <= hi)
                at = np.minimum(np.floor((gap[inside] - lo) / (hi - lo) * nb), nb - 1).astype(int)
                counts = np.bincount(at, weight[inside], nb)
                rows += [(int(t), int(b), int(counts[b])) for b in np.flatnonzero(counts)]
            out = pd.DataFrame(rows, columns=["t", "bin", "n"])
            for k, val in key_of(pdf).items():
                out[k] = val
            return out[[*by, "t", "bin", "n"]]

        for _ in range(refine):
            x = _block_pairs(v.join(st, by) if by else v.join(st), by, block)
            h = x.groupBy(*keys).applyInPandas(hist, kt + "t int, bin int, n bigint")
            h = h.groupBy(*by, "t", "bin").agg(F.sum("n").alias("n"))
            # At most 4098 bins per slice and target.
            w = Window.partitionBy(*by, "t").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            h = h.withColumn("cum", F.sum("n").over(w)).join(st, [*by, "t"])
            width = (F.col("hi") - F.col("lo")) / nb
            hitbin = h.filter((F.col("bin") >= 0) & (F.col("cum") > F.col("rank"))).groupBy(*by, "t").agg(
                F.min_by(
                    F.struct(
                        # A little wider than the bin, so that rounding cannot push the median out.
                        (F.col("lo") + (F.col("bin") - 1e-6) * width).alias("lo"),
                        (F.col("lo") + (F.col("bin") + 1 + 1e-6) * width).alias("hi"),
                        "rank",
                    ),
                    "bin",
                ).alias("_s")
            )
            st = materialize(hitbin.select(*by, "t", "_s.lo", "_s.hi", "_s.rank"), "median")
        sig = st.groupBy(*by).agg((F.avg((F.col("lo") + F.col("hi")) / 2) + SIGMA_EPS).alias("sigma"))
        v = v.join(sig, by) if by else v.join(sig)
    else:
        v = v.withColumn("sigma", F.lit(float(sigma)))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = pdf[pdf["_b"] == i], pdf[pdf["_b"] == j]
        s = float(pdf["sigma"].iloc[0])
        k = np.exp(-np.square(left["x"].to_numpy()[:, None] - right["x"].to_numpy()[None, :]) / (2 * s * s))
        la, lb, ra, rb = (p[c].to_numpy(float) for p in (left, right) for c in ("na", "nb"))
        both = 1.0 if i == j else 2.0
        xy = la @ k @ rb if i == j else la @ k @ rb + lb @ k @ ra
        out = pd.DataFrame([(both * (la @ k @ ra), both * (lb @ k @ rb), xy)], columns=["xx", "yy", "xy"])
        for kk, val in key_of(pdf).items():
            out[kk] = val
        return out[[*by, "xx", "yy", "xy"]]

    x = _block_pairs(v, by, block)
    part = x.groupBy(*keys).applyInPandas(sums, kt + "xx double, yy double, xy double")
    total = part.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy")])
    size = v.groupBy(*by).agg(F.max("tot_na").cast("double").alias("a"), F.max("tot_nb").cast("double").alias("b"))
    out = total.join(size, by) if by else total.join(size)
    a, b = F.col("a"), F.col("b")
    mmd = F.col("xx") / (a * a) + F.col("yy") / (b * b) - 2 * F.col("xy") / (a * b)
    return out.select(*by, F.when((a >= MIN_SIDE) & (b >= MIN_SIDE), mmd).alias("mmd"))


METRICS = {"w1": w1, "kl": kl_hist, "mmd": mmd_rbf}


def style_distance(
    pred: DataFrame, true: DataFrame, features: Sequence[str], metric: str = "w1", min_n: int = 20, scenario: str = "scenario", detail: bool = False
) -> DataFrame:
    """Distance per scenario (min_n rows or more) and feature, averaged: one row, or all with ``detail``."""
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in features)
    long = lambda df: df.selectExpr(f"{scenario} AS scenario", f"stack({len(features)}, {pairs}) AS (feature, x)")
    big = true.groupBy(F.col(scenario).alias("scenario")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_n)
    keep = lambda df: long(df).join(big.select("scenario"), "scenario", "left_semi")
    d = METRICS[metric](two_sided(keep(pred), keep(true), ["scenario", "feature"], "x"), ["scenario", "feature"])
    if detail:
        return d
    return d.agg(F.count(metric).alias("cells"), F.avg(metric).alias("distance"))


def personalization_gain(err: DataFrame, base: str, alt: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean error of both predictors, absolute gain and gain in percent."""
    out = err.groupBy(*by).agg(F.avg(base).alias("base"), F.avg(alt).alias("alt"))
    gain = F.col("base") - F.col("alt")
    return out.select(*by, "base", "alt", gain.alias("gain"), F.when(F.col("base") != 0, 100 * gain / F.col("base")).alias("gain_pct"))


def rmse_by_query(
    steps: DataFrame,
    pred: str,
    true: str,
    keys: Sequence[str],
    horizons: Sequence[int] = (10, 30, 50),
    step: str = "step",
) -> DataFrame:
    """Root mean square error per query and horizon (steps 1..h): keys, horizon, rmse."""
    err = F.col(pred) - F.col(true)
    hs = F.filter(F.lit([int(h) for h in horizons]), lambda h: h >= F.col(step))
    rows = steps.select(*keys, (err * err).alias("_e"), F.explode(hs).alias("horizon"))
    return rows.groupBy(*keys, "horizon").agg(F.sqrt(F.avg("_e")).alias("rmse"))


def stratified_rmse(err: DataFrame, labels: DataFrame, on: Sequence[str], value: str = "rmse", min_n: int = 30) -> DataFrame:
    """Mean query error per label, over the queries labelled +1 (at least min_n). ``labels`` has (on, prim, label)."""
    rows = err.join(labels.filter(F.col("label") == 1), list(on))
    return rows.groupBy("prim", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value)).filter(F.col("n") >= min_n)


def gain_per_entity(err: DataFrame, base: str, alt: str, entity: str = "entity", B: int = 2000, seed: int = 42) -> DataFrame:
    """Mean gain over entities, share of entities that gain, and the bootstrap interval."""
    per = err.groupBy(entity).agg((F.avg(base) - F.avg(alt)).alias("value"))
    per = materialize(per, "gain")
    pos = per.agg(F.avg((F.col("value") > 0).cast("double")).alias("share_pos"))
    return cluster_bootstrap(per, entity, "value", B, seed).join(pos)  # one row each


LOG_2PI = float(np.log(2 * np.pi))


def _as_array(df: DataFrame, name: str) -> Column:
    return F.col(name) if dict(df.dtypes)[name].startswith("array") else F.array(name)


def gaussian_nll(df: DataFrame, y: str, mu: str, logv: str, out: str = "nll") -> DataFrame:
    """Negative log likelihood of y under N(mu, exp(logv)), summed over the dimensions of array columns."""
    zipped = F.arrays_zip(*[_as_array(df, c).alias(n) for c, n in ((y, "y"), (mu, "m"), (logv, "v"))])
    terms = F.transform(zipped, lambda c: 0.5 * (c["v"] + (c["y"] - c["m"]) ** 2 * F.exp(-c["v"]) + LOG_2PI))
    return df.withColumn(out, F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))


def _logsumexp(arr: Column) -> Column:
    top = F.array_max(arr)
    return top + F.ln(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def mixture_nll(df: DataFrame, y: str, logit: str, mu: str, logv: str, out: str = "nll") -> DataFrame:
    """Negative log likelihood under a mixture: arrays of component logits, means and log variances."""
    comp = F.transform(
        F.arrays_zip(F.col(logit).alias("w"), F.col(mu).alias("m"), F.col(logv).alias("v")),
        lambda c: c["w"] - 0.5 * (c["v"] + (F.col(y) - c["m"]) ** 2 * F.exp(-c["v"]) + LOG_2PI),
    )
    return df.withColumn("_comp", comp).withColumn(out, _logsumexp(F.col(logit)) - _logsumexp(F.col("_comp"))).drop("_comp")


def sampled_nll(df: DataFrame, keys: Sequence[str], loglik: str, out: str = "nll") -> DataFrame:
    """Importance-sampled estimate: minus the log of the mean likelihood over draws (one row per draw)."""
    top = df.groupBy(*keys).agg(F.max(loglik).alias("_top"))
    x = df.join(top, list(keys))
    return x.groupBy(*keys).agg((-(F.max("_top") + F.ln(F.avg(F.exp(F.col(loglik) - F.col("_top")))))).alias(out))


def trajectory_stats(steps: DataFrame, keys: Sequence[str], a: str = "a", k: str = "k") -> DataFrame:
    """Mean and 5th percentile of acceleration, and mean absolute curvature, of one trajectory (bounded length)."""
    return steps.groupBy(*keys).agg(
        F.avg(a).alias("a_mean"), F.percentile(a, F.lit(0.05)).alias("a_p05"), F.avg(F.abs(k)).alias("k_absmean")
    )


def history_future(
    frames: DataFrame, anchors: DataFrame, hist: int = 50, fut: int = 50, keys: Sequence[str] = ("win_id",), order: str = "pos", bounded: bool = False
) -> DataFrame:
    """Frames around each anchor a: part "history" for [a - hist, a), "future" for [a, a + fut); step from 1.

    ``bounded``: a key has few frames (a window), so frames that lie in buckets of the keys stay there.
    """
    bounds = anchors.withColumn("_lo", F.col("a") - hist).withColumn("_hi", F.col("a") + fut - 1)
    j = attach(frames, bounds, keys, order, "_lo", "_hi", block=None if bounded else max(hist + fut, 64))
    past = F.col(order) < F.col("a")
    j = j.withColumn("part", F.when(past, "history").otherwise("future"))
    return j.withColumn("step", F.when(past, F.col(order) - F.col("_lo") + 1).otherwise(F.col(order) - F.col("a") + 1)).drop("_lo", "_hi")


def ablation_table(err: DataFrame, base: str, setting: str = "setting", value: str = "sq_err") -> DataFrame:
    """RMSE per setting and its change against the base setting in percent."""
    agg = err.groupBy(setting).agg(F.sqrt(F.avg(value)).alias("rmse"))
    ref = agg.filter(F.col(setting) == base).select(F.col("rmse").alias("_base"))
    delta = 100 * (F.col("_base") - F.col("rmse")) / F.col("_base")
    return agg.join(ref).select(setting, "rmse", delta.alias("gain_pct"))  # ref is one row


def exemplars(err: DataFrame, key: str, gain: str = "gain") -> DataFrame:
    """Best, second and median row by gain."""
    ranked = exact_rank(err.select(key, gain), [], gain, [key], descending=True, name="_r", total="_n")
    role = (
        F.when(F.col("_r") == 1, "best").when(F.col("_r") == 2, "second").when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, "median")
    )
    return ranked.withColumn("role", role).filter(F.col("role").isNotNull()).select("role", key, gain)
