"""Condition-matched pairs. No operator emits all pairs of a group: rows are ranked and
capped first, and partners are neighbours in a keyed shuffle, or meet inside a bounded band."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.hashing import hash_draw
from ..plans.ordered import exact_quantiles, hash_rank, hash_top_n, top_n
from ..plans.stage import materialize

# Right-closed bins, open at 0 (a value outside gets "nan").
V_BINS = (0.0, 10.0, 20.0, 30.0, float("inf"))
THW_BINS = (0.0, 1.2, 2.0, float("inf"))


def cut_bins(x: Column, edges: Sequence[float], prefix: str) -> Column:
    out = F.lit("nan")
    for i in reversed(range(len(edges) - 1)):
        inside = (x > edges[i]) & (x <= edges[i + 1]) if edges[i + 1] != float("inf") else x > edges[i]
        out = F.when(inside, f"{prefix}{i}").otherwise(out)
    return out


def match_key(windows: DataFrame, v_bins: Sequence[float] = V_BINS, thw_bins: Sequence[float] = THW_BINS, grp: str = "grp") -> DataFrame:
    """scenario | speed bin | headway bin (car following only, else na) | group."""
    v = cut_bins(F.col("v_mean"), v_bins, "v")
    thw = F.when(F.col("scenario") == "car_following", cut_bins(F.col("thw_median"), thw_bins, "t")).otherwise("na")
    return windows.withColumn("key", F.concat_ws("|", "scenario", v, thw, F.col(grp).cast("string")))


def _usable_keys(keyed: DataFrame, min_rows: int, min_entities: int) -> DataFrame:
    agg = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("entity").alias("_e"))
    return agg.filter((F.col("_n") >= min_rows) & (F.col("_e") >= min_entities)).select("key")


def _neighbours(ranked: DataFrame, by: list[str], rank: str, last: int) -> DataFrame:
    """Pairs of neighbours in rank order; groups hold at most last + 1 rows."""
    w = Window.partitionBy(*by).orderBy(rank)
    nxt = ranked.select(
        *by, rank, F.col("win_id").alias("_a"), F.col("entity").alias("_ea"), F.col("route").alias("_ra"),
        F.lead("win_id").over(w).alias("_b"), F.lead("entity").over(w).alias("_eb"), F.lead("route").over(w).alias("_rb"),
    )
    return nxt.filter(F.col("_b").isNotNull() & (F.col(rank) <= last))


def _finish(cand: DataFrame, same: int, per_key: int, seed: str) -> DataFrame:
    pairs = cand.select("key", F.least("_a", "_b").alias("win_a"), F.greatest("_a", "_b").alias("win_b")).distinct()
    pairs = hash_top_n(pairs, ["key"], per_key, seed, "key", "win_a", "win_b")
    return pairs.withColumn("same_entity", F.lit(same).cast("bigint"))


def positive_pairs(
    keyed: DataFrame, per_entity: int = 8, per_key: int = 30, seed: int = 42, min_rows: int = 4, min_entities: int = 2
) -> DataFrame:
    """Same key and entity, different route: at most per_entity draws per entity, per_key pairs per key."""
    rows = keyed.select("key", "entity", "route", "win_id").join(_usable_keys(keyed, min_rows, min_entities), "key", "left_semi")
    ranked = hash_top_n(rows, ["key", "entity"], per_entity + 1, f"{seed}-pos", "win_id", name="_r")
    cand = _neighbours(ranked, ["key", "entity"], "_r", per_entity).filter(F.col("_ra") != F.col("_rb"))
    return _finish(cand, 1, per_key, f"{seed}-poscap")


def negative_pairs(
    keyed: DataFrame, per_key: int = 30, draws: int = 200, seed: int = 42, min_rows: int = 4, min_entities: int = 2
) -> DataFrame:
    """Same key, different entity: min(2 n, draws) draws of two of a key's n rows, at most per_key pairs per key.

    Draws are numbered; each draws two positions of the key's keyed shuffle by hash, so every row of a key can be drawn.
    """
    rows = keyed.select("key", "entity", "win_id").join(_usable_keys(keyed, min_rows, min_entities), "key", "left_semi")
    ranked = hash_rank(rows, ["key"], ["win_id"], f"{seed}-neg", "_r", "_n")
    sizes = ranked.groupBy("key").agg(F.max("_n").alias("_n"))
    drawn = sizes.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(2 * F.col("_n"), F.lit(draws)))))
    side = lambda s: hash_draw(f"{seed}-neg{s}", F.col("_n"), "key", "_i") + 1
    drawn = drawn.select("key", side("a").alias("_ra"), side("b").alias("_rb"))
    at = lambda s: ranked.select("key", F.col("_r").alias(f"_r{s}"), F.col("win_id").alias(f"_{s}"), F.col("entity").alias(f"_e{s}"))
    cand = drawn.join(at("a"), ["key", "_ra"]).join(at("b"), ["key", "_rb"]).filter(F.col("_ea") != F.col("_eb"))
    return _finish(cand, 0, per_key, f"{seed}-negcap")


def balance_pairs(pos: DataFrame, neg: DataFrame, target: int = 25_000, seed: int = 42) -> DataFrame:
    """Equally many of both classes: min(positives, negatives, target), by hash."""
    both = materialize(pos.unionByName(neg), "pairs")
    ranked = hash_rank(both, ["same_entity"], ["key", "win_a", "win_b"], seed, "_r", "_n")
    sizes = both.groupBy("same_entity").agg(F.count(F.lit(1)).alias("_c"))
    n = sizes.agg(F.least(F.min("_c"), F.lit(target), F.when(F.count(F.lit(1)) < 2, F.lit(0))).alias("_m"))
    return ranked.join(n).filter(F.col("_r") <= F.col("_m")).select(*both.columns)  # n is one row


def pair_report(pairs: DataFrame) -> DataFrame:
    """Per scenario (first part of the key) and over all: keys, pairs, median and largest pairs per key."""
    per_key = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    scen = F.split("key", r"\|")[0]
    per_key = per_key.select(F.explode(F.array(scen, F.lit("all"))).alias("scenario"), "m")
    med = exact_quantiles(per_key, ["scenario"], "m", [0.5]).select("scenario", F.col("q").alias("median"))
    agg = per_key.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("m").alias("pairs"), F.max("m").alias("largest")
    )
    return agg.join(med, "scenario")


def with_sides(pairs: DataFrame, table: DataFrame, cols: Sequence[str], key: str = "win_id") -> DataFrame:
    """Join a table's columns to both sides of each pair as <col>_a and <col>_b."""
    side = lambda s: table.select(F.col(key).alias(f"win_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return pairs.join(side("a"), "win_a").join(side("b"), "win_b")


def contrast_pairs(pairs: DataFrame, stats: DataFrame, col: str, min_diff: float = 1.2, sane: Column | None = None) -> DataFrame:
    """Pairs whose statistic differs by more than min_diff, both sides sane, each unordered pair once."""
    table = stats.filter(sane) if sane is not None else stats
    both = with_sides(pairs, table, [col])
    both = both.withColumn("contrast", F.abs(F.col(f"{col}_a") - F.col(f"{col}_b"))).filter(F.round("contrast", 9) > min_diff)
    lo, hi = F.least("win_a", "win_b"), F.greatest("win_a", "win_b")
    return both.select("key", lo.alias("win_a"), hi.alias("win_b"), "contrast").dropDuplicates(["win_a", "win_b"])


def _reach(e: DataFrame, grp: str, top: int, min_contrast: float, close: Column, contrast: Column) -> DataFrame:
    """Rows that can be in a group's best ``top`` pairs, with ``_sides``, the sides of a pair they can be (0: the lower, 1: the higher), and
    ``_lead``: whether they can be the smaller id of one.

    In each cell the lowest and the highest rows make true pairs; the last of the best ``top`` of them bounds the ranked list from below. A row stays
    if the highest or the lowest row of the cells around it allows a contrast as good as that (one over ``min_contrast`` where no bound is found); at an
    equal contrast the smaller id decides.
    """
    k = math.isqrt(top - 1) + 2
    cell = [grp, "_v", "_p"]
    cols = ("entity", "id", "peak", "v0", "pre_a")
    side = lambda order, s: top_n(e, cell, k, order, "id").select(*cell, *[F.col(c).alias(c + s) for c in cols])
    both = side(F.asc("pre_a"), "_l").hint("merge").join(side(F.desc("pre_a"), "_h"), cell).filter(F.col("pre_a_l") < F.col("pre_a_h"))
    first = F.col("id_l") < F.col("id_h")
    both = both.select(grp, *[F.when(first, F.col(c + x)).otherwise(F.col(c + y)).alias(c + s) for c in cols for s, x, y in (("_a", "_l", "_h"), ("_b", "_h", "_l"))])
    best = top_n(both.filter(close).withColumn("_c", F.round(contrast, 9)), [grp], top, F.desc("_c"), "id_a", "id_b")
    bound = best.groupBy(grp).agg(F.max(F.struct((-F.col("_c")).alias("c"), "id_a")).alias("_w"), F.count(F.lit(1)).alias("_n"))
    bound = bound.filter(F.col("_n") >= top).select(grp, (-F.col("_w.c")).alias("_c"), F.col("_w.id_a").alias("_first"))
    near = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    ends = e.groupBy(*cell).agg(F.min("pre_a").alias("_lo"), F.max("pre_a").alias("_hi")).withColumn("_dv", F.explode(near)).withColumn("_dp", F.explode(near))
    ends = ends.groupBy(grp, (F.col("_v") + F.col("_dv")).alias("_v"), (F.col("_p") + F.col("_dp")).alias("_p")).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    out = e.hint("merge").join(ends, cell).join(F.broadcast(bound), grp, "left")  # bound is a row a group
    rise, fall = F.round(F.col("_hi") - F.col("pre_a"), 9), F.round(F.col("pre_a") - F.col("_lo"), 9)
    fits = lambda gap: F.coalesce(gap >= F.col("_c"), F.lit(True)) & (gap > min_contrast)
    sides = F.filter(F.array(F.when(fits(rise), 0), F.when(fits(fall), 1)), lambda i: i.isNotNull())
    lead = F.col("_c").isNull() | (F.greatest(rise, fall) > F.col("_c")) | (F.col("id") <= F.col("_first"))
    return out.select(*e.columns, sides.alias("_sides"), lead.alias("_lead")).filter(F.size("_sides") > 0)


def band_pairs(
    events: DataFrame,
    rel: float = 0.2,
    dv: float = 3.0,
    min_contrast: float = 0.8,
    top: int | None = None,
    grp: str = "grp",
    salt: int = 4,
) -> DataFrame:
    """Event pairs of one group and two entities with close peak, close speed and contrasting approach.

    A band join on two axes: speeds within dv meet in neighbouring cells of width dv, and
    peaks within a share ``rel`` of each other in neighbouring cells of the log scale. So
    only rows of the same small cell meet, however large the group is; a cell's right rows are dealt
    by hash to ``salt`` tasks, to which its left rows are copied. ``top`` is the length of each group's
    ranked list (greatest contrast first), for which only the rows meet that can be in it, and only those that can be a pair's lower side with those
    that can be its higher one (most rows of a cell may be equally low); without it all pairs are given.
    """
    width = -math.log1p(-rel) * 1.0001
    cols = ("entity", "id", "peak", "v0", "pre_a")
    e = events.select(grp, *cols).filter(F.col("peak") > 0).dropna(subset=[grp, *cols])
    e = e.withColumn("_v", F.floor(F.col("v0") / dv)).withColumn("_p", F.floor(F.ln("peak") / width))
    contrast = F.abs(F.col("pre_a_a") - F.col("pre_a_b"))
    close = (
        (F.col("id_a") < F.col("id_b"))
        & (F.col("entity_a") != F.col("entity_b"))
        & (F.round(F.abs(F.col("peak_a") - F.col("peak_b")) - rel * F.greatest("peak_a", "peak_b"), 9) <= 0)
        & (F.round(F.abs(F.col("v0_a") - F.col("v0_b")), 9) <= dv)
        & (F.round(contrast, 9) > min_contrast)
    )
    if top:
        e = materialize(_reach(e, grp, top, min_contrast, close, contrast), "band")
        close = close & ((F.col("pre_a_a") <= F.col("pre_a_b")) == (F.col("_side") == 0))
    else:
        e = e.withColumn("_lead", F.lit(True)).withColumn("_sides", F.array(F.lit(0)))
    near = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    a = e.filter("_lead").withColumn("_dv", F.explode(near)).withColumn("_dp", F.explode(near))
    a = a.select(
        grp,
        (F.col("_v") + F.col("_dv")).alias("_v"),
        (F.col("_p") + F.col("_dp")).alias("_p"),
        "_sides",
        F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt"),
        *[F.col(c).alias(c + "_a") for c in cols],
    )
    a = a.withColumn("_side", F.explode("_sides")).drop("_sides")
    other = F.explode(F.transform("_sides", lambda i: 1 - i) if top else F.col("_sides")).alias("_side")
    b = e.select(grp, "_v", "_p", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int").alias("_salt"), other, *[F.col(c).alias(c + "_b") for c in cols])
    # Sizes are not known before rows are copied: neither side may be broadcast.
    out = a.hint("merge").join(b, [grp, "_v", "_p", "_salt", "_side"]).filter(close).select(grp, "id_a", "id_b", contrast.alias("contrast"))
    return top_n(out, [grp], top, F.desc(F.round("contrast", 9)), "id_a", "id_b") if top else out


def pair_hist_intersection(pairs: DataFrame, vecs: DataFrame, key: str = "win_id") -> DataFrame:
    """Histogram intersection of the two sides' (non-negative) vectors."""
    both = with_sides(pairs, vecs, ["vec"], key)
    return both.select("win_a", "win_b", vec.hist_intersection("vec_a", "vec_b").alias("sim"))


def matched_lift(pairs: DataFrame, attrs: DataFrame, cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Attribute agreement on matched pairs, on random pairs, and their ratio.

    Random pairs keep each left side and take the right side of the next pair in a keyed
    shuffle, so there are as many of them as matched ones.
    """
    ranked = hash_rank(pairs.select("win_a", "win_b"), [], ["win_a", "win_b"], seed, "_r", "_n")
    shifted = ranked.select((F.col("_r") % F.col("_n") + 1).alias("_r"), F.col("win_b").alias("_other"))
    rnd = ranked.join(shifted, "_r").select("win_a", F.col("_other").alias("win_b"))
    kinds = pairs.select("win_a", "win_b", F.lit("m").alias("kind")).unionByName(rnd.withColumn("kind", F.lit("r")))
    both = with_sides(kinds, attrs, cols)
    rows = ", ".join(f"'{c}', CAST({c}_a = {c}_b AS INT)" for c in cols)
    long = both.selectExpr("kind", f"stack({len(cols)}, {rows}) AS (attr, eq)")
    out = long.groupBy("attr").agg(
        F.avg(F.when(F.col("kind") == "m", F.col("eq"))).alias("matched"),
        F.avg(F.when(F.col("kind") == "r", F.col("eq"))).alias("random"),
    )
    return out.withColumn("lift", F.when(F.col("random") > 0, F.col("matched") / F.col("random")))
