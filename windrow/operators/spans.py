"""Spans, windows and sessions: gap-merged runs, sliding and tumbling windows, event slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import CHUNK, attach, carry, exact_quantiles, join_per_key, rolling, running_sum, runs
from ..plans.stage import materialize

ROUTE = ("entity", "route")


def merge_runs(
    frames: DataFrame,
    pred: Column,
    max_gap: int = 20,
    min_len: int = 300,
    keys: Sequence[str] = ROUTE,
    order: str = "idx",
    chunk: int | None = CHUNK,
    tasks: int | None = None,
) -> DataFrame:
    """Runs of true frames, merged over index steps <= max_gap; inclusive length >= min_len."""
    found = runs(frames.filter(F.coalesce(pred, F.lit(False))), keys, order, max_gap, chunk=chunk, tasks=tasks)
    return found.filter(F.col("i1") - F.col("i0") + 1 >= min_len).select(*keys, "i0", "i1")


def span_table(
    frames: DataFrame,
    spans: DataFrame,
    v_move: float = 2.0,
    rate: float = 10.0,
    keys: Sequence[str] = ROUTE,
    chunk: int = CHUNK,
    tasks: int | None = None,
) -> DataFrame:
    """Number the spans of a route and add times, duration and moving share.

    The share counts every frame inside a span, also the merged gap frames. Spans are
    summarised per frame block first, so a long span is not one task's work. The span
    number is ordered per chunk of start positions, then offset.
    """
    keys = list(keys)
    inside = attach(frames.select(*keys, "idx", "vEgo"), spans.select(*keys, "i0", "i1"), keys, tasks=tasks)
    share = inside.groupBy(*keys, "i0", "i1").agg(F.avg((F.col("vEgo") > v_move).cast("double")).alias("moving_frac"))
    numbered = running_sum(share, keys, "i0", {"span_id": F.lit(1)}, chunk=chunk * 8)
    return numbered.select(
        *keys,
        (F.col("span_id") - 1).cast("bigint").alias("span_id"),
        "i0",
        "i1",
        (F.col("i0") / rate).alias("t0"),
        (F.col("i1") / rate).alias("t1"),
        ((F.col("i1") - F.col("i0") + 1) / rate).alias("dur_s"),
        "moving_frac",
    )


def span_rollup(spans: DataFrame) -> DataFrame:
    """Counts, hours, moving hours, and median / 90th percentile duration."""
    totals = spans.agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("dur_s") / 3600).alias("hours"),
        (F.sum(F.col("dur_s") * F.col("moving_frac")) / 3600).alias("moving_hours"),
    )
    q = exact_quantiles(spans.select(F.lit(0).alias("_g"), "dur_s"), ["_g"], "dur_s", [0.5, 0.9])
    q = q.agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("q"))).alias("p50"),
        F.max(F.when(F.col("prob") == 0.9, F.col("q"))).alias("p90"),
    )
    return totals.join(q)  # one row each


def raw_runs(
    frames: DataFrame,
    pred: Column,
    keys: Sequence[str] = ROUTE,
    order: str = "idx",
    chunk: int | None = CHUNK,
) -> DataFrame:
    """Contiguous runs of true frames, half-open [i, j)."""
    found = runs(frames.filter(F.coalesce(pred, F.lit(False))), keys, order, 1, chunk=chunk)
    return found.select(*keys, F.col("i0").alias("i"), (F.col("i1") + 1).alias("j"))


def window_bounds(
    spans: DataFrame, win: int = 600, stride: int = 300, min_len: int = 300, keys: Sequence[str] = ROUTE
) -> DataFrame:
    """Sliding windows anchored at the span start; a span shorter than ``win`` gives one partial window."""
    n = F.col("i1") - F.col("i0") + 1
    full = F.sequence(F.lit(0).cast("bigint"), F.floor((n - win) / stride))
    steps = F.when(n >= win, full).when(n >= min_len, F.array(F.lit(0).cast("bigint")))
    out = spans.select(*keys, "i0", "i1", F.explode(steps).alias("_k"))
    start = F.col("i0") + F.col("_k") * stride
    return out.select(*keys, "i0", start.alias("wi0"), F.least(start + win - 1, F.col("i1")).alias("wi1")).withColumn(
        "win_id", F.concat_ws("|", *keys, "wi0")
    )


def slide_frames(
    frames: DataFrame,
    spans: DataFrame,
    win: int = 600,
    stride: int = 300,
    min_len: int = 300,
    keys: Sequence[str] = ROUTE,
    tasks: int | None = None,
) -> DataFrame:
    """The frames of every sliding window, one row per (window, frame), with ``pos`` from 0.

    Each frame meets the windows of its own block only; a frame is copied
    win / stride times at most. ``tasks`` is the number of tasks that they meet in.
    """
    bounds = window_bounds(spans, win, stride, min_len, keys).drop("i0")
    joined = attach(frames, bounds, keys, "idx", "wi0", "wi1", block=win, tasks=tasks)
    return joined.withColumn("pos", F.col("idx") - F.col("wi0"))


def slide_windows(
    frames: DataFrame,
    spans: DataFrame,
    win: int = 600,
    stride: int = 300,
    min_len: int = 300,
    moving: float = 0.5,
    v_move: float = 2.0,
    keys: Sequence[str] = ROUTE,
) -> DataFrame:
    """Window bounds, kept where at least ``moving`` of the frames move."""
    inside = slide_frames(frames.select(*keys, "idx", "vEgo"), spans, win, stride, min_len, keys)
    share = F.avg((F.col("vEgo") > v_move).cast("double"))
    kept = inside.groupBy(*keys, "win_id", "wi0", "wi1").agg(share.alias("moving_frac"))
    return kept.filter(F.col("moving_frac") >= moving)


def tumble_compact(
    frames: DataFrame,
    pred: Column,
    win: int = 600,
    keys: Sequence[str] = ROUTE,
    order: str = "idx",
    chunk: int = CHUNK,
) -> DataFrame:
    """Tumbling windows over the filtered rows only (so they span removed frames); tail dropped.

    Adds ``win_no`` and ``pos``. The running count goes by chunk totals, as does the
    total that tells which windows are full.
    """
    kept = frames.filter(F.coalesce(pred, F.lit(False)))
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    ranked = running_sum(kept, keys, order, {"_rn": F.lit(1)}, chunk)
    out = join_per_key(ranked, sizes, keys, order, chunk=chunk)
    out = out.withColumn("win_no", F.floor((F.col("_rn") - 1) / win).cast("bigint"))
    out = out.withColumn("pos", ((F.col("_rn") - 1) % win).cast("bigint"))
    return out.filter((F.col("win_no") + 1) * win <= F.col("_all")).drop("_rn", "_all")


def chunk_runs(runs_df: DataFrame, length: int = 100, keys: Sequence[str] = ROUTE) -> DataFrame:
    """Cut half-open runs [i, j) into full chunks of ``length`` steps: run start i and chunk start t."""
    n = F.floor((F.col("j") - F.col("i")) / length)
    cut = runs_df.filter(n >= 1).select(*keys, "i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("_k"))
    return cut.select(*keys, "i", (F.col("i") + F.col("_k") * length).alias("t"))


def long_anchors(hits: DataFrame, gap: int, keys: Sequence[str], step: str = "step", chunk: int = CHUNK) -> DataFrame:
    """Greedy anchors of keys of any length, by doubling.

    Each hit points at the first one more than ``gap`` after it; one more than twice the gap after it starts a chain, so only
    near hits are looked at. The first hit of every chain is an anchor; in each turn the anchors known so far add
    those that their pointers reach, and pointers go twice as far: as many turns as the logarithm of the most anchors in a chain. All joins
    are on (key, step), of which there is one row.
    """
    keys = list(keys)
    return _long_anchors(materialize(hits.select(*keys, F.col(step).cast("bigint").alias(step)).distinct(), "hits"), gap, keys, step, chunk)


def _long_anchors(own: DataFrame, gap: int, keys: list[str], step: str, chunk: int) -> DataFrame:
    """``long_anchors`` of a written table with one row per (key, step)."""
    own = own.select(*keys, step)
    near = {"_to": lambda w: F.min(step).over(w.rangeBetween(gap + 1, 2 * gap))}
    ahead = rolling(own, keys, step, 0, 2 * gap, near, chunk)
    jump = materialize(ahead.filter(F.col("_to").isNotNull()), "jumps")
    known = materialize(runs(own, keys, step, gap, chunk=chunk).select(*keys, F.col("i0").alias(step)), "anchors")
    n = known.count()
    while True:
        more = known.join(jump, [*keys, step]).select(*keys, F.col("_to").alias(step))
        known = materialize(known.unionByName(more).distinct(), "anchors")
        before, n = n, known.count()
        if n == before:
            return known
        far = jump.join(jump.select(*keys, F.col(step).alias("_to"), F.col("_to").alias("_next")), [*keys, "_to"])
        jump = materialize(far.select(*keys, step, F.col("_next").alias("_to")), "jumps")


def anchor_hits(hits: DataFrame, gap: int, keys: Sequence[str] = ("win_id",), step: str = "step", chunk: int | None = None) -> DataFrame:
    """Greedy anchors: the first hit, then each time the first hit more than ``gap`` after the last anchor.

    Each choice depends on the one before, so this folds over the ordered hits of one
    chain (neighbours at most ``gap`` apart; chains cannot influence each other). With ``chunk=None`` keys
    are window ids: an array never holds more than a window's steps. Otherwise see ``long_anchors``.
    """
    keys = list(keys)
    if chunk is not None:
        return long_anchors(hits, gap, keys, step, chunk)
    w = Window.partitionBy(*keys).orderBy(step)
    apart = F.col(step) - F.lag(step).over(w)
    steps = hits.select(*keys, F.col(step).cast("bigint").alias(step)).distinct()
    steps = steps.withColumn("_chain", F.sum(F.when(apart <= gap, 0).otherwise(1)).over(w))
    packed = steps.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(step)).alias("_s"))
    start = F.array().cast("array<bigint>")
    picked = F.aggregate(
        "_s",
        start,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x - F.try_element_at(acc, F.lit(-1)) <= gap), acc
        ).otherwise(F.array_append(acc, x)),
    )
    return packed.select(*keys, F.explode(picked).alias(step))


def dedupe_anchored(
    hits: DataFrame, gap: int = 30, keys: Sequence[str] = ("win_id",), step: str = "step", rule: str = "rule", chunk: int | None = None
) -> DataFrame:
    """Group hits within ``gap`` steps of the group's first hit; one row per group with its sorted rules.

    Every hit belongs to the last anchor at or before it. Keys of any length (routes) take a ``chunk``, windows None.
    """
    keys = list(keys)
    if chunk is not None:
        return _dedupe_long(hits, gap, keys, step, rule, chunk)
    none = F.lit(None).cast("bigint")
    heads = anchor_hits(hits, gap, keys, step).select(*keys, F.col(step).alias("_at"), F.lit(0).alias("_side"), F.col(step).alias("_anchor"), F.lit(None).cast(hits.schema[rule].dataType).alias(rule))
    members = hits.select(*keys, F.col(step).cast("bigint").alias("_at"), F.lit(1).alias("_side"), none.alias("_anchor"), rule)
    told = carry(heads.unionByName(members), keys, ["_at", "_side"], {step: "_anchor"}, chunk=None).filter(F.col("_side") == 1)
    return told.groupBy(*keys, step).agg(F.array_sort(F.collect_set(rule)).alias("rules"))


def _dedupe_long(hits: DataFrame, gap: int, keys: list[str], step: str, rule: str, chunk: int) -> DataFrame:
    """``dedupe_anchored`` of keys of any length: all steps of it read one written table with a row per (key, step)."""
    own = hits.groupBy(*keys, F.col(step).cast("bigint").alias(step)).agg(F.collect_set(rule).alias("rules"))
    own = materialize(own, "hits")
    anchors = _long_anchors(own, gap, keys, step, chunk)
    heads = anchors.select(*keys, F.col(step).alias("_at"), F.lit(0).alias("_side"), F.col(step).alias("_anchor"), F.lit(None).cast(own.schema["rules"].dataType).alias("rules"))
    members = own.select(*keys, F.col(step).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_anchor"), "rules")
    told = carry(heads.unionByName(members), keys, ["_at", "_side"], {step: "_anchor"}, chunk=chunk).filter(F.col("_side") == 1)
    return told.groupBy(*keys, step).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))


def session_merge(
    events: DataFrame,
    gap_s: float = 5.0,
    pad_s: float = 5.0,
    keys: Sequence[str] = ("entity",),
    t: str = "t",
    chunk: float | None = 3600.0 * 24 * 365,
) -> DataFrame:
    """Chain-merge events whose consecutive time gap is at most gap_s; pad the span on both sides."""
    found = runs(events, keys, t, gap_s, chunk=chunk)
    return found.select(*keys, (F.col("i0") - pad_s).alias("start"), (F.col("i1") + pad_s).alias("end"), "n")


def event_slice(
    frames: DataFrame,
    events: DataFrame,
    pre: int = 50,
    post: int = 30,
    rate: float = 10.0,
    keys: Sequence[str] = ROUTE,
    onset: str = "onset",
) -> DataFrame:
    """Frames from ``pre`` before to ``post`` after each event, with relative time."""
    bounds = events.withColumn("_lo", F.col(onset) - pre).withColumn("_hi", F.col(onset) + post)
    joined = attach(frames, bounds, keys, "idx", "_lo", "_hi", block=max(pre + post + 1, 64))
    return joined.withColumn("t_rel", (F.col("idx") - F.col(onset)) / rate).drop("_lo", "_hi")
