"""Plans that must hold on larger tables: what is copied, shuffled or kept does not grow faster than the rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from windrow.operators import pairs as pr


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("levels", [3, 1000])
def test_band_pairs_ranked_list(spark, levels):
    """The ranked list of rows with many equal contrasts, or none, is that of all pairs; no side of the join is broadcast."""
    rnd = random.Random(levels)
    rows = [("g", f"e{i % 7}", f"w{i * 7919 % 1000:03d}", rnd.choice([0.02, 0.0205, 0.03]), rnd.uniform(0, 4), rnd.randrange(levels) * 6.0 / levels) for i in range(400)]
    rows += [("h", "a", "x1", 0.02, 1.0, 0.0), ("h", "b", "x2", 0.02, 1.0, 3.0), ("h", "c", "x3", 0.02, 1.0, None), ("h", None, "x4", 0.02, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "grp string, entity string, id string, peak double, v0 double, pre_a double")
    want = []
    for g in "gh":
        found = []
        for a, b in itertools.combinations(sorted((r for r in rows if r[0] == g and None not in r), key=lambda r: r[2]), 2):
            c = abs(a[5] - b[5])
            if a[1] != b[1] and round(abs(a[3] - b[3]) - 0.05 * max(a[3], b[3]), 9) <= 0 and round(abs(a[4] - b[4]), 9) <= 0.5 and round(c, 9) > 1.2:
                found.append((-round(c, 9), a[2], b[2]))
        want += [(g, a, b, -c) for c, a, b in sorted(found)[:40]]
    out = pr.band_pairs(df, 0.05, 0.5, 1.2, top=40)
    assert sorted((r.grp, r.id_a, r.id_b, round(r.contrast, 9)) for r in out.collect()) == sorted(want)
    assert "BroadcastExchange" not in plan(out)
    assert "BroadcastExchange" not in plan(pr.band_pairs(df, 0.05, 0.5, 1.2))
    assert pr.band_pairs(df, 0.05, 0.5, 1.2).count() > len(want)


def test_band_pairs_meet_by_sides(spark, monkeypatch):
    """Many equally low rows of a cell do not meet each other: they meet the few that can be the higher side of a ranked pair."""
    rnd = random.Random(5)
    rows = [("g", f"e{i % 7}", f"w{i * 7919 % 2000:04d}", 0.02, rnd.uniform(3.1, 3.4), 0.0) for i in range(1500)]
    rows += [("g", f"e{i % 7}", f"x{i:04d}" if i % 2 else f"a{i:04d}", 0.02, rnd.uniform(3.1, 3.4), 5.0 + i / 100) for i in range(9)]
    df = spark.createDataFrame(rows, "grp string, entity string, id string, peak double, v0 double, pre_a double")
    written, keep = [], pr.materialize
    monkeypatch.setattr(pr, "materialize", lambda df, *a: written.append(keep(df, *a)) or written[-1])
    got = [(r.id_a, r.id_b, round(r.contrast, 9)) for r in pr.band_pairs(df, 0.05, 0.5, 1.2, top=40).collect()]
    want = [(min(a[2], b[2]), max(a[2], b[2]), round(b[5] - a[5], 9)) for a in rows[:1500] for b in rows[1500:] if a[1] != b[1]]
    assert sorted(got) == sorted(sorted(want, key=lambda p: (-p[2], p[0], p[1]))[:40])
    assert written[0].filter("array_contains(_sides, 1)").count() <= 9
    assert written[0].filter("size(_sides) > 1").count() == 0


def test_forest_votes_leave_a_task_as_one_class(spark):
    """What leaves a task that votes is one row a case and feature set, however many classes the trees name; a hot model's cases are spread."""
    import numpy as np

    from windrow.operators import forests

    rng = np.random.default_rng(3)
    rows = [("m", i % 2, f"c{int(rng.integers(0, 40)):02d}", str(i), float(rng.normal()), float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "_m string, _part int, _y string, _id string, x double, z double").withColumn("_part", F.col("_part").cast("bigint"))
    out = forests.forest_votes(df, {"x": ["x"], "all": ["x", "z"]}, trees=30, depth=6)
    assert len(out.inputFiles()) > 1 and out.count() == 1200 and out.filter("_p IS NULL").count() == 0
    text = plan(out)
    assert "_votes" not in text and "TREES_PER_BLOCK" not in dir(forests)
    assert forests._most(np.array([[2, 1, 2, 1, 0], [3, 3, 0, 0, 0], [5, 4, 3, 2, 1]])).tolist() == [1, 0, 1]


def test_blocks_copy_little_and_multiply_tile_by_tile(spark):
    """Queries are copied once for each block of many items, not of a few thousand; tiles give what one product gives."""
    import numpy as np

    from windrow.plans import blocks

    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, (2500, 3)).astype(float)
    pts = spark.createDataFrame([(f"p{i * 7 % 2500:04d}", f"e{i % 9}", x[i].tolist()) for i in range(2500)], "id string, e string, vec array<double>")
    grid = blocks.block_grid(pts, spark.range(9000).selectExpr("id AS i"), [], "id", "i", lambda a, b: a[["id"]], "id string")
    assert grid.count() == 2500  # one row a query and item block
    ids = [f"p{i * 7 % 2500:04d}" for i in range(2500)]
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    order = np.argsort(ids)
    want = {ids[i]: ids[order[d2[i, order].argmin()]] for i in range(2500)}
    assert {r.id: r.nn for r in blocks.nearest(pts, "id", "e").collect()} == want


def test_nearest_rows_meet_near_leaves_only(monkeypatch):
    """The nearest other row, by place where equally near, without all pairs: ids that repeat, ties, rows without a number."""
    import numpy as np

    from windrow.plans import blocks

    rng, pairs, real = np.random.default_rng(2), [0], blocks.similarity

    def counted(kind, q, p):
        pairs[0] += len(q) * len(p)
        return real(kind, q, p)

    monkeypatch.setattr(blocks, "similarity", counted)
    for dims, digits in ((4, 9), (4, 1), (20, 0)):
        y, theirs = rng.normal(size=(9000, dims)).round(digits), rng.integers(0, 8000, 9000)
        x, mine = y[:700].copy(), theirs[:700]
        y[17], x[5] = np.nan, np.nan
        pairs[0] = 0
        d2, at = blocks.nearest_rows(x, mine, y, theirs)
        want = np.round(((x[:, None] - y[None]) ** 2).sum(2), 9)
        want[(mine[:, None] == theirs) | np.isnan(want)] = np.inf
        ok = np.arange(700) != 5
        assert np.isinf(d2[5]) and (at[ok] == want.argmin(1)[ok]).all() and np.allclose(d2[ok], want.min(1)[ok], atol=2e-9)
        assert dims > 4 or pairs[0] < 0.3 * 700 * 9000


def test_importances_rows_are_spread(spark, monkeypatch):
    """A small table is not one task's work in every pass of the forest."""
    from windrow.operators import ml

    written = []
    keep = ml.materialize
    monkeypatch.setattr(ml, "materialize", lambda df, *a: written.append(keep(df, *a)) or written[-1])
    df = spark.range(2000).selectExpr("rand(1) AS x", "rand(2) AS z", "IF(rand(1) > 0.5, 'a', 'b') AS y").coalesce(1)
    found = {r.feature: r.importance for r in ml.importances(df, ["x", "z"], "y", trees=5, depth=3).collect()}
    assert found["x"] > found["z"] and len(written[0].inputFiles()) >= spark.sparkContext.defaultParallelism


def test_clips_meet_frames_in_their_buckets(spark, sf):
    """No frame is shuffled for the clips around candidates: windows' frames lie in buckets of their window."""
    from windrow.catalog import QUERIES

    assert "Exchange hashpartitioning" not in plan(QUERIES["has_reversing"](spark, sf))


def test_blocks_are_counted_by_group(spark):
    """Rows of three groups do not meet in more blocks than those of one: what is copied is what a group's blocks need; short vectors lie in larger blocks."""
    from windrow.plans import blocks

    q = spark.range(300).selectExpr("id % 3 AS g", "id AS i", "array(CAST(id AS DOUBLE), 1D) AS vec")
    fn = lambda a, b: a[["g", "i"]].assign(n=len(b))
    grid = blocks.block_grid(q, q.withColumnRenamed("i", "j"), ["g"], "i", "j", fn, "g bigint, i bigint, n bigint", 100)
    assert sorted(r.n for r in grid.collect()) == [100] * 300
    assert blocks.rows_of_block(64) == blocks.rows_of_block(768) == blocks.BLOCK and blocks.rows_of_block(12) == 4 * blocks.BLOCK


def test_ablations_are_made_behind_the_joins(spark):
    """Settings are views of one table of vectors: they give what enrollment gives on rows that were zeroed first, with fewer joined rows."""
    from windrow.operators import metrics as mt

    rnd = random.Random(6)
    rows = [(f"w{i:04d}", f"e{i % 8}", i // 8 % 5, [rnd.gauss(i % 8, 2.0) for _ in range(4)]) for i in range(480)]
    df = spark.createDataFrame(rows, "win_id string, entity string, route bigint, vec array<double>")
    groups = {"no_head": (0, 1), "no_tail": (3,)}
    key = lambda r: (r.setting, r.k, r.n_entities, r.n_queries, *(round(x, 9) for x in (r.top1, r.top5, r.auroc, r.eer)))
    got = sorted(key(r) for r in mt.ablate_channels(df, groups, 3, 2, 3).collect())
    zeroed = [(n, *r[:3], [0.0 if i in dims else v for i, v in enumerate(r[3])]) for n, dims in {"full": (), **groups}.items() for r in rows]
    first = spark.createDataFrame(zeroed, "setting string, win_id string, entity string, route bigint, vec array<double>")
    assert got == sorted(key(r) for r in mt.enroll(first, [3], 2, 3, by=["setting"]).collect()) and len(got) == 3
    scores = mt.enroll_scores(df, [3], 2, 3, views={"full": lambda v: v, "none": lambda v: F.transform(v, lambda x: x * 0)})
    assert scores.groupBy("setting").agg(F.max("own").alias("own")).filter("setting = 'none' AND own <> 0").count() == 0


def lineitem(spark, folder, rows):
    """Tables of a handful of lines: rows of (supplier, ship date, order, line); the other columns follow from the row's number."""
    flags = ["R", "A", "N"]
    li = [(o, o % 50, s, n, float(i * 7 % 50 + 1), float(i % 97) * 900.0, i % 11 / 100, i % 9 / 100, flags[i % 3], "OF"[i % 2], day) for i, (s, day, o, n) in enumerate(rows)]
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(li, cols).repartition(5).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")


def test_signals_lie_by_route(spark, tmp_path, monkeypatch):
    """A route's frames are written by one task; a route of very many goes by months, with the same numbers; all tasks' rows are bounded."""
    import datetime

    from windrow.catalog import common as c
    from windrow.plans import stage as st
    from windrow.sources import tables as tb

    rnd = random.Random(4)
    days = [datetime.datetime(1996, 1, 1) + datetime.timedelta(days=rnd.randrange(700)) for _ in range(900)] + [None, None]
    rows = [(rnd.choice([1, 1, 2, 3]) if i % 89 else None, day, rnd.randrange(60), i) for i, day in enumerate(days)]
    lineitem(spark, str(tmp_path), rows)
    want = {}
    for s, day, o, n in sorted((r for r in rows if None not in r[:2]), key=lambda r: r[1:]):
        want.setdefault((f"S{s}", day.year), []).append(n)
    f = c.sig(spark, str(tmp_path))
    routes = f.withColumn("_file", F.input_file_name()).groupBy("entity", "route").agg(F.count_distinct("_file").alias("files"), F.count(F.lit(1)).alias("n"), F.max("idx").alias("last")).collect()
    assert {(r.entity, r.route): r.n for r in routes} == {k: len(v) for k, v in want.items()}
    assert all(r.files == 1 and r.last == r.n - 1 for r in routes)
    got = sorted(tuple(r) for r in f.collect())
    monkeypatch.setattr(tb, "ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(st, "ROWS_PER_BUCKET", 50)
    cut = tb.signals(spark, str(tmp_path))
    assert sorted(tuple(r) for r in cut.drop(*tb.RAW).collect()) == got
    assert st.tasks_for(spark, 901) == 19 and st.tasks_for(spark, 1) == spark.sparkContext.defaultParallelism


def test_window_frames_are_shuffled_as_raw_columns(spark, sf):
    """What is shuffled for the windows' frames has lineitem's columns, not the telemetry; a frame is a row of at most 16 columns."""
    from windrow.catalog import common as c
    from windrow.sources import tables as tb

    f = c.win_frames(spark, sf)
    assert f.columns[:7] == ["entity", "route", "wi0", "wi1", "win_id", "grp", "idx"] and f.columns[-2:] == ["is_human", "pos"]
    assert not set(tb.RAW) & set(f.columns) and not set(tb.RAW) & set(c.sig(spark, sf).columns)


def test_window_statistics_sort_once(spark, sf):
    """Percentiles are no aggregates (which sort rows and maps again): frames lie by window, and are sorted once at most."""
    from windrow.catalog import QUERIES

    for name in ("window_stats", "headway_stats", "path_features", "long_features", "pedal_speed_features"):
        text = plan(QUERIES[name](spark, sf))
        assert "ObjectHashAggregate" not in text and "Exchange" not in text, name
        assert text.count("Sort [") == 1, name


def test_kl_hist_deals_a_group_over_tasks(spark):
    """Values of one group meet copies of its range: no task gets the group; equal values are one row."""
    from windrow.operators import distance as ds

    ab = spark.range(3000).select(F.lit("g").alias("g"), (F.col("id") % 700 / 7.0).alias("x"), (F.col("id") % 2).cast("int").alias("side"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ds.kl_hist(ab, ["g"])
        join = [line for line in plan(out).splitlines() if "Join" in line and "_s#" in line]
        assert join and out.collect()[0].kl == pytest.approx(ds.kl_hist(ab.drop("g"), []).collect()[0].kl)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_steps_take_a_number_of_tasks(spark):
    """Runs, joins with spans and rolling columns give the same rows in any number of tasks, which adaptive execution does not merge."""
    from windrow.operators import spans as sp
    from windrow.plans import ordered

    f = spark.range(600).select((F.col("id") % 3).cast("string").alias("entity"), (F.col("id") % 2).alias("route"), F.floor(F.col("id") / 6).alias("idx"), (F.col("id") % 13 * 1.0).alias("vEgo"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    human = sp.merge_runs(f, F.col("vEgo") > 3, 2, 3)
    assert rows(human) == rows(sp.merge_runs(f, F.col("vEgo") > 3, 2, 3, tasks=11)) and rows(human)
    assert rows(sp.span_table(f, human)) == rows(sp.span_table(f, human, tasks=11))
    assert rows(sp.slide_frames(f, human, 8, 4, 3)) == rows(sp.slide_frames(f, human, 8, 4, 3, tasks=11))
    cols = {"p": lambda w: F.lag("vEgo", 2).over(w)}
    roll = ordered.rolling(f, ["entity", "route"], "idx", 2, 0, cols, 16, tasks=11)
    assert rows(roll) == rows(ordered.rolling(f, ["entity", "route"], "idx", 2, 0, cols, 16))
    assert "REPARTITION_BY_NUM" in plan(roll) and "REPARTITION_BY_NUM" in plan(sp.span_table(f, human, tasks=11))


def test_following_is_written_once(spark, sf):
    """Runs of following, their frames and the starts of runs read one written table."""
    from windrow.catalog import QUERIES

    text = plan(QUERIES["cutin_tag"](spark, sf))
    assert "following_" in text and "vEgo" not in text


def test_long_anchors_look_at_near_hits_only(spark):
    """Pointers come from hits within twice the gap, in one pass; several rules at one step are one row of what is carried."""
    from windrow.operators import spans as sp

    rnd = random.Random(8)
    rows = sorted({(f"e{e}", s, rnd.choice("ab")) for e in range(3) for s in (rnd.randrange(400) for _ in range(150 + 60 * e))}) + [("far", 5, "a"), ("far", 9_000, "b"), ("far", 9_001, "a")]
    want = {}
    for e, s, r in sorted(rows):
        at = max((a for x, a in want if x == e), default=None)
        want.setdefault((e, s if at is None or s > at + 4 else at), set()).add(r)
    df = spark.createDataFrame(rows, "entity string, step long, rule string")
    for chunk in (7, 64, 100_000):
        got = {(r.entity, r.step): r.rules for r in sp.dedupe_anchored(df, 4, ["entity"], chunk=chunk).collect()}
        assert got == {k: sorted(v) for k, v in want.items()}
    assert "carry" not in sp._long_anchors.__code__.co_names


def test_forecast_finds_features_in_the_buckets_of_frames(spark):
    """Frames that lie in buckets of their window meet anchors there: only the anchors are shuffled, and each feature is a column of its own; the
    rows are those of the join on blocks."""
    from windrow.operators import ml
    from windrow.plans.stage import materialize

    rnd = random.Random(5)
    rows = [(f"w{w}", p, *[rnd.choice([0.0, 0.5, 1.0, None]) for _ in ml.HISTORY_SIGNALS]) for w in range(40) for p in range(20)]
    frames = spark.createDataFrame(rows, "win_id string, pos long, " + ", ".join(f"{s} double" for s in ml.HISTORY_SIGNALS))
    frames = materialize(frames, "frames", ["win_id"], ["pos"], 800)
    cases = [(f"w{w}", 5 + k, (w + k) % 2, f"e{w % 8}") for w in range(40) for k in range(0, 12, 3)]
    anchors = spark.createDataFrame(cases + cases[:3], "win_id string, a long, y long, entity string")
    near, far = ml.history_features(frames, anchors, 5, bounded=True), ml.history_features(frames, anchors, 5)
    value = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert value(near) == value(far) and near.count() == len(cases)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near, far = (plan(ml.history_features(frames, anchors, 5, bounded=b)).count("Exchange hashpartitioning") for b in (True, False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (near, far) == (1, 3)  # the anchors; before, also the frames, and the rows of the join
    folds = spark.createDataFrame([(f"e{i}", "test" if i < 3 else "train") for i in range(8)], "entity string, fold string")
    once = ml.forecast_events(anchors, frames, folds, 5, iters=1, bounded=True)
    assert sorted((r.win_id, r.a, r.y, r.entity) for r in once.collect()) == sorted(c for c in cases if c[3] < "e3")
    twice = ml.forecast_events(anchors, frames, folds.unionByName(folds), 5, iters=1, bounded=True)
    assert twice.count() == 2 * once.count()


def test_ranking_in_one_pass_is_both_metrics(spark):
    from windrow.operators import metrics as mt

    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), rnd.choice([None, 0.1, 0.2, 0.7, 0.9]), rnd.randrange(2)) for _ in range(200)] + [("c", 0.5, 1), ("d", 0.5, 0), (None, 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    got = {r.g: r for r in mt.auroc_and_precision(df, "score", "y", ["g"]).collect()}
    au, ap = ({r.g: r for r in f(df, "score", "y", ["g"]).collect()} for f in (mt.auroc, mt.average_precision))
    assert set(got) == set(au) == set(ap)
    for g, r in got.items():
        assert (r.n_pos, r.n_neg) == (au[g].n_pos, au[g].n_neg)
        assert r.auroc == pytest.approx(au[g].auroc, abs=1e-12, nan_ok=True) and r.ap == pytest.approx(ap[g].ap, abs=1e-12)
