"""Order-dependent plans that never put a whole group into one task.

A time series, a class or a score list may hold a third of all rows, so a plain
``Window.partitionBy(key)`` is not an option. Everything here works on *chunks*
(a key plus a slice of its order): the row-level work runs per chunk, and only
chunk summaries (a row or two per chunk) are ordered over the whole key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_order
from .stage import materialize

# Frames per chunk. One task sees at most this many rows of one key at a time.
CHUNK = 32_768


def chunk_of(order: str | Column, size: float) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(size)).cast("bigint")


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    before: int,
    after: int,
    columns: dict[str, Callable[[Window], Column]] | Sequence[dict[str, Callable[[Window], Column]]],
    chunk: int | None = CHUNK,
    tasks: int | None = None,
) -> DataFrame:
    """Add columns computed over a bounded neighbourhood of each row.

    ``columns`` maps a name to a function of the ordered window spec. With
    ``chunk`` each chunk gets copies of the ``before``/``after`` neighbouring
    order values (the halo), so the answer is the one of an unchunked window.
    ``chunk=None`` is for keys that are bounded already (a window id). Frames are
    expected one per order value. Columns may use earlier ones. A list of dicts is a list of levels: the columns
    of a level use those of earlier levels only, and are found in one pass over the rows. ``tasks`` is their number
    for rows of known number; else the session's.
    """
    cols = df.columns
    levels = [{n: fn} for n, fn in columns.items()] if isinstance(columns, dict) else columns
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(order)
        for level in levels:
            df = df.withColumns({n: fn(w) for n, fn in level.items()})
        return df
    o = F.col(order)
    df = df.withColumn("_chunk", F.explode(F.sequence(chunk_of(o - after, chunk), chunk_of(o + before, chunk))))
    df = df.repartition(tasks, *keys, "_chunk") if tasks else df
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    for level in levels:
        df = df.withColumns({n: fn(w) for n, fn in level.items()})
    names = cols + [n for level in levels for n in level if n not in cols]
    return df.filter(F.col("_chunk") == chunk_of(o, chunk)).select(*names)


def runs(
    true_rows: DataFrame,
    keys: Sequence[str],
    order: str,
    max_gap: int = 1,
    aggs: Sequence[tuple[str, Column, Callable[[str], Column]]] = (),
    chunk: int | None = CHUNK,
    tasks: int | None = None,
) -> DataFrame:
    """Runs of rows whose order step is at most ``max_gap``: keys, i0, i1 (inclusive), n.

    Fragments are found per chunk. A fragment that is neither the first nor the
    last of its chunk is final; only the outer ones (two per chunk) are stitched
    over the whole key. ``aggs`` holds (name, row column, merge function) for more
    values per run. ``tasks`` is the number of tasks for rows of known number; else the session's.
    """
    keys = list(keys)
    rows = true_rows.select(*keys, F.col(order).alias("_o"), *[c.alias(n) for n, c, _ in aggs])
    rows = rows.withColumn("_c", chunk_of("_o", chunk) if chunk else F.lit(0).cast("bigint"))
    rows = rows.repartition(tasks, *keys, "_c") if tasks else rows
    w = Window.partitionBy(*keys, "_c").orderBy("_o")
    step = F.col("_o") - F.lag("_o").over(w)
    rows = rows.withColumn("_isl", F.sum(F.when(step <= max_gap, 0).otherwise(1)).over(w))
    frag = rows.groupBy(*keys, "_c", "_isl").agg(
        F.min("_o").alias("i0"),
        F.max("_o").alias("i1"),
        F.count(F.lit(1)).alias("n"),
        *[m(n).alias(n) for n, _, m in aggs],
    )
    if chunk:
        wc = Window.partitionBy(*keys, "_c")
        outer = (F.col("_isl") == 1) | (F.col("_isl") == F.max("_isl").over(wc))
        frag = frag.withColumn("_outer", outer)
        frag = frag.withColumn("_c", F.when(F.col("_outer"), F.lit(None)).otherwise(F.col("_c")))
        frag = frag.withColumn("_isl", F.when(F.col("_outer"), F.lit(0)).otherwise(F.col("_isl")))
        wk = Window.partitionBy(*keys, "_c", "_isl").orderBy("i0")
        gap = F.col("i0") - F.lag("i1").over(wk)
        frag = frag.withColumn("_m", F.sum(F.when(gap <= max_gap, 0).otherwise(1)).over(wk))
        frag = frag.groupBy(*keys, "_c", "_isl", "_m").agg(
            F.min("i0").alias("i0"),
            F.max("i1").alias("i1"),
            F.sum("n").alias("n"),
            *[m(n).alias(n) for n, _, m in aggs],
        )
    return frag.select(*keys, "i0", "i1", "n", *[n for n, _, _ in aggs])


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    forward: dict[str, str],
    backward: dict[str, str] | None = None,
    chunk: float | None = CHUNK,
) -> DataFrame:
    """Carry the last (``forward``) or next (``backward``) non-null value to every row.

    ``forward``/``backward`` map a new column to the column carried. ``order[0]`` is
    numeric and is sliced into chunks; the other order columns break ties. The
    as-of kernel: no range join, and the carry between chunks is one row per chunk.
    """
    keys, backward = list(keys), backward or {}
    cols = df.columns
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        for out, src in forward.items():
            df = df.withColumn(out, F.last(src, ignorenulls=True).over(back))
        for out, src in backward.items():
            df = df.withColumn(out, F.first(src, ignorenulls=True).over(ahead))
        return df
    df = df.withColumn("_c", chunk_of(order[0], chunk))
    w = Window.partitionBy(*keys, "_c").orderBy(*order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    for out, src in forward.items():
        df = df.withColumn(out, F.last(src, ignorenulls=True).over(back))
    for out, src in backward.items():
        df = df.withColumn(out, F.first(src, ignorenulls=True).over(ahead))
    # One summary row per chunk: its last forward value and its first backward value.
    pos = F.struct(*order)
    edge = df.groupBy(*keys, "_c").agg(
        *[F.max_by(out, pos).alias("_e" + out) for out in forward],
        *[F.min_by(out, pos).alias("_e" + out) for out in backward],
    )
    wk = Window.partitionBy(*keys).orderBy("_c")
    edge = edge.select(
        *keys,
        "_c",
        *[
            F.last("_e" + out, ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("_e" + out)
            for out in forward
        ],
        *[
            F.first("_e" + out, ignorenulls=True).over(wk.rowsBetween(1, Window.unboundedFollowing)).alias("_e" + out)
            for out in backward
        ],
    )
    df = df.join(edge, [*keys, "_c"], "left")
    outs = [*forward, *backward]
    return df.select(*cols, *[F.coalesce(out, "_e" + out).alias(out) for out in outs])


def join_per_key(
    frames: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    order: str,
    how: str = "inner",
    chunk: float | None = CHUNK,
    tasks: int | None = None,
) -> DataFrame:
    """Join a table with one row per key to the frames of that key.

    A plain join on the key would put all frames of a hot key into one task, and later
    chunked steps would inherit that partitioning. So the small table is first copied to
    each of the key's chunks, and the frames are joined per chunk.
    """
    keys = list(keys)
    if chunk is None:
        return frames.join(per_key, keys, how)
    chunks = frames.select(*keys, chunk_of(order, chunk).alias("_jc")).distinct()
    spread = chunks.join(per_key, keys)
    frames = frames.withColumn("_jc", chunk_of(order, chunk))
    frames, spread = (x.repartition(tasks, *keys, "_jc") if tasks else x for x in (frames, spread))
    return frames.join(spread, [*keys, "_jc"], how).drop("_jc")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str | Column],
    chunk: float | None = CHUNK,
) -> DataFrame:
    """Inclusive running sums along a numeric order, by chunk totals plus local sums."""
    keys = list(keys)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    cols = df.columns
    df = df.withColumn("_c", chunk_of(order, chunk))
    w = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, "_c").agg(*[F.sum(c).alias("_t" + n) for n, c in sums.items()])
    wk = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_c", *[F.coalesce(F.sum("_t" + n).over(wk), F.lit(0)).alias("_t" + n) for n in sums])
    local = df.select("*", *[F.sum(c).over(w).alias("_l" + n) for n, c in sums.items()])
    joined = local.join(totals, [*keys, "_c"])
    return joined.select(*cols, *[(F.col("_l" + n) + F.col("_t" + n)).alias(n) for n in sums])


def _slices(order: str) -> dict[str, Column]:
    """Two levels of order-preserving slices of a number: 1/16 octave, then 2^-20 octave.

    They depend on the value alone, so a recomputed task slices alike and nothing has
    to be sampled. Each level is at most a few ten thousand slices wide.
    """
    x = F.col(order).cast("double")
    octave, sign = F.coalesce(F.log2(F.abs(x)), F.lit(0.0)), F.signum(x)
    return {
        "_hi": (sign * (F.floor(octave * 16) + 20_000)).cast("bigint"),
        "_lo": (sign * F.floor(octave * (1 << 20))).cast("bigint"),
    }


def _slice_offsets(sizes: DataFrame, by: list[str], sums: Sequence[str]) -> DataFrame:
    """From totals ``_t<sum>`` per (by, _hi, _lo): the sum before each slice ``_p<sum>`` and ``tot_<sum>``."""
    prior = (Window.unboundedPreceding, -1)
    z = lambda c: F.coalesce(c, F.lit(0))
    coarse = sizes.groupBy(*by, "_hi").agg(*[F.sum("_t" + n).alias("_t" + n) for n in sums])
    wa = Window.partitionBy(*by)
    coarse = coarse.select(
        *by,
        "_hi",
        *[z(F.sum("_t" + n).over(wa.orderBy("_hi").rowsBetween(*prior))).alias("_q" + n) for n in sums],
        *[F.sum("_t" + n).over(wa).alias("tot_" + n) for n in sums],
    )
    wf = Window.partitionBy(*by, "_hi").orderBy("_lo").rowsBetween(*prior)
    fine = sizes.select(*by, "_hi", "_lo", *[z(F.sum("_t" + n).over(wf)).alias("_f" + n) for n in sums])
    out = fine.join(coarse, [*by, "_hi"])
    return out.select(
        *by, "_hi", "_lo", *[(F.col("_f" + n) + F.col("_q" + n)).alias("_p" + n) for n in sums], *["tot_" + n for n in sums]
    )


def running_totals(df: DataFrame, by: Sequence[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """Collapse to distinct (group, order) rows with inclusive running sums and totals.

    Returns by, order, each sum ``s``, ``cum_s`` and ``tot_s``. Collapsing first makes
    ties harmless; the running sum then goes slice by slice, so a group of any size is
    spread over many tasks.
    """
    by, sl = list(by), _slices(order)
    collapsed = df.groupBy(*by, order).agg(*[c.alias(n) for n, c in sums.items()])
    collapsed = collapsed.select("*", *[c.alias(n) for n, c in sl.items()])
    sizes = collapsed.groupBy(*by, "_hi", "_lo").agg(*[F.sum(n).alias("_t" + n) for n in sums])
    w = Window.partitionBy(*by, "_hi", "_lo").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = collapsed.select("*", *[F.sum(n).over(w).alias("_l" + n) for n in sums])
    out = local.join(_slice_offsets(sizes, by, list(sums)), [*by, "_hi", "_lo"])
    return out.select(
        *by,
        order,
        *list(sums),
        *[(F.col("_l" + n) + F.col("_p" + n)).alias("cum_" + n) for n in sums],
        *["tot_" + n for n in sums],
    )


def exact_rank(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    descending: bool = False,
    name: str = "rnk",
    total: str | None = None,
) -> DataFrame:
    """1-based row number per group by ``order`` (then ``ties``), for groups of any size and any number of ties.

    Rows are written in ranges of (group, order, ties), so that equal values are split too; a range's rank is its
    local row number plus the rows of its group in the ranges before. The written ranges stay as they are, so a
    task that runs again gives the same ranks. Runs a job while the plan is built.
    """
    by, cols = list(by), df.columns
    df = df.withColumn("_ord", -F.col(order) if descending else F.col(order))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = materialize(df.repartitionByRange(parts, *by, "_ord", *ties).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_k").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "_part", before.alias("_before"), F.sum("_k").over(w).alias("_all"))
    out = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_ord", *ties))).join(sizes, [*by, "_part"])
    extra = [F.col("_all").alias(total)] if total else []
    return out.select(*cols, (F.col("_r") + F.col("_before")).cast("bigint").alias(name), *extra)


def hash_rank(
    df: DataFrame,
    by: Sequence[str],
    keys: Sequence[str],
    seed: int | str,
    name: str = "rnk",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in its group's keyed shuffle; ``keys`` identify the row.

    The hash is uniform, so its first digits slice a group evenly.
    """
    by, cols = list(by), df.columns
    df = df.withColumn("_h", hash_order(seed, *keys)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    wb = Window.partitionBy(*by)
    sizes = sizes.select(
        *by,
        "_b",
        F.coalesce(F.sum("_k").over(wb.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"),
        F.sum("_k").over(wb).alias("_all"),
    )
    w = Window.partitionBy(*by, "_b").orderBy("_h", *keys)
    out = df.withColumn("_r", F.row_number().over(w)).join(sizes, [*by, "_b"])
    extra = [F.col("_all").alias(total)] if total else []
    return out.select(*cols, (F.col("_r") + F.col("_p")).cast("bigint").alias(name), *extra)


def top_n(df: DataFrame, by: Sequence[str], n: int, *order: str | Column, name: str | None = None) -> DataFrame:
    """First n rows per group. A literal n lets Spark cut each map task to n rows per group first."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn("_rn", rn).filter(F.col("_rn") <= n)
    return out.withColumn(name, F.col("_rn").cast("bigint")).drop("_rn") if name else out.drop("_rn")


def hash_top_n(
    df: DataFrame, by: Sequence[str], n: int, seed: int | str, *keys: str, name: str | None = None
) -> DataFrame:
    """n rows per group by keyed hash."""
    cols = df.columns
    out = top_n(df.withColumn("_h", hash_order(seed, *keys)), by, n, "_h", *keys, name=name)
    return out.select(*cols, *([name] if name else []))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
) -> DataFrame:
    """Exact quantiles with linear interpolation over groups of any size: by, prob, q, n.

    Rank positions come from ``running_totals``; at most two distinct values per
    (group, prob) survive the filter.
    """
    by, probs = list(by), sorted({float(p) for p in probs})
    ranked = running_totals(df.filter(F.col(value).isNotNull()), by, value, {"c": F.count(F.lit(1))})
    start, last = F.col("cum_c") - F.col("c"), F.col("tot_c") - 1
    # A row covers a small stretch of the probability axis. A lookup of 1024 cells tells which
    # wanted probabilities can lie in it: for nearly every row none, and it ends there.
    cells = 1024
    first = F.lit([bisect_left(probs, g / cells) for g in range(cells + 1)] + [len(probs)] * 2)
    width = F.greatest(last, F.lit(1))
    lo_cell = F.greatest(F.floor((start - 1 - 1e-6) / width * cells), F.lit(0)).cast("int")
    hi_cell = F.least(F.floor((F.col("cum_c") + 1e-6) / width * cells) + 1, F.lit(cells + 1)).cast("int")
    near = ranked.select(
        *by, value, start.alias("_s"), F.col("cum_c").alias("_e"), last.alias("_last"), first[lo_cell].alias("_i"), first[hi_cell].alias("_j")
    ).filter(F.col("_i") < F.col("_j"))
    # A rank of p * (n - 1) that is a whole number up to float noise counts as whole.
    low = lambda p: F.floor(p * F.col("_last") + 1e-9)
    high = lambda p: F.ceil(p * F.col("_last") - 1e-9)
    covers = lambda at: (F.col("_s") <= at) & (at < F.col("_e"))
    some = F.slice(F.lit(probs), F.col("_i") + 1, F.col("_j") - F.col("_i"))
    hits = near.select(
        *by, value, "_last", F.explode(F.filter(some, lambda p: covers(low(p)) | covers(high(p)))).alias("prob")
    )
    hits = hits.withColumn("_f", F.greatest(F.col("prob") * F.col("_last") - low(F.col("prob")), F.lit(0.0)))
    out = hits.groupBy(*by, "prob", "_last").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first("_f").alias("_f")
    )
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    return out.select(*by, "prob", q.alias("q"), (F.col("_last") + 1).alias("n"))


def quantile_columns(df: DataFrame, by: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` with one column per named probability."""
    by = list(by)
    long = exact_quantiles(df, by, value, sorted(set(named.values())))
    picks = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("q"))).alias(n) for n, p in named.items()]
    return long.groupBy(*by).agg(*picks, F.max("n").alias("n"))


def attach(
    frames: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    order: str = "idx",
    lo: str = "i0",
    hi: str = "i1",
    block: int | None = 4096,
    tasks: int | None = None,
) -> DataFrame:
    """Join each span to the frames with lo <= order <= hi, without a range join.

    Spans are copied to the blocks they touch and the join is an equi-join on
    (keys, block), so a key with very many frames is spread over its blocks. ``block=None`` is
    for bounded keys (a window id): frames that lie in buckets of the keys then stay where they are.
    ``tasks`` is the number of tasks of the join, for frames of known size; else the session's.
    """
    keys = list(keys)
    own = [c for c in frames.columns if c not in spans.columns or c in keys]
    if block is None:
        joined = spans.join(frames.select(*own), keys)
    else:
        s = spans.withColumn("_blk", F.explode(F.sequence(chunk_of(lo, block), chunk_of(hi, block))))
        f = frames.select(*own).withColumn("_blk", chunk_of(order, block))
        s, f = (x.repartition(tasks, *keys, "_blk") if tasks else x for x in (s, f))
        joined = s.join(f, [*keys, "_blk"])
    joined = joined.filter(F.col(order).between(F.col(lo), F.col(hi)))
    return joined.select(*spans.columns, *[c for c in own if c not in keys])
