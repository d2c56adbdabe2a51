"""Verification, retrieval and classification metrics over slices of any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.hashing import hash_draw, hash_uint
from ..plans.blocks import block_grid, count_better, nearest, similarity
from ..plans.ordered import exact_quantiles, hash_rank, hash_top_n, running_totals, top_n
from ..plans.stage import materialize
from .curate import eligible_cells
from .pairs import with_sides
from .sampling import support_query


def _neighbour(points: DataFrame, by: list[str], rank: str, own: Sequence[str], other: dict[str, str], step: int) -> DataFrame:
    """Give each ranked row values of the row ``step`` ranks away, without a window over the group.

    Every row is sent to its own rank and, as a neighbour, to the rank that needs it.
    """
    mine = F.struct(F.col(rank).alias("_r"), F.lit(True).alias("_own"))
    theirs = F.struct((F.col(rank) - step).alias("_r"), F.lit(False).alias("_own"))
    both = points.withColumn("_to", F.explode(F.array(mine, theirs)))
    pick = lambda c, flag: F.max(F.when(F.col("_to._own") == flag, F.col(c)))
    out = both.groupBy(*by, F.col("_to._r").alias(rank)).agg(
        *[pick(c, True).alias(c) for c in own], *[pick(c, False).alias(n) for n, c in other.items()]
    )
    return out.filter(F.col(own[0]).isNotNull())


def roc_points(df: DataFrame, score: str, label: str, by: Sequence[str] = (), drop_collinear: bool = True) -> DataFrame:
    """ROC points per slice, one per distinct score: score, pos, neg, tp, fp, n_pos, n_neg, keep.

    ``keep`` is false for interior points on the straight line between their neighbours.
    """
    by = list(by)
    y = F.col(label).cast("bigint")
    tot = running_totals(
        df.filter(F.col(score).isNotNull() & y.isNotNull()),
        by,
        score,
        {"pos": F.sum(y), "neg": F.sum(1 - y), "one": F.lit(1).cast("bigint")},
    )
    # "one" is a constant per distinct score: its running sum is the rank of the score.
    pts = tot.select(
        *by,
        F.col("cum_one").alias("r"),
        F.col(score).alias("score"),
        "pos",
        "neg",
        (F.col("tot_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("tot_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
        F.col("tot_pos").alias("n_pos"),
        F.col("tot_neg").alias("n_neg"),
        F.col("tot_one").alias("n_pts"),
    )
    own = ["score", "pos", "neg", "tp", "fp", "n_pos", "n_neg", "n_pts"]
    pts = _neighbour(pts, by, "r", own, {"_lpos": "pos", "_lneg": "neg"}, -1)
    interior = (F.col("r") > 1) & (F.col("r") < F.col("n_pts"))
    flat = interior & (F.col("pos") == F.col("_lpos")) & (F.col("neg") == F.col("_lneg"))
    keep = ~flat if drop_collinear else F.lit(True)
    return pts.select(*by, "score", "pos", "neg", "tp", "fp", "n_pos", "n_neg", keep.alias("keep"))


def _area() -> Column:
    """Mann-Whitney count with half ties: negatives below each distinct score's positives."""
    above = F.col("tp") - F.col("pos") + F.col("pos") * 0.5
    return F.try_divide(F.sum(F.col("neg").cast("double") * above), F.max("n_pos").cast("double") * F.max("n_neg"))


def _eer() -> Column:
    fn = (F.col("n_pos") - F.col("tp")).cast("double")
    gap = F.abs(fn * F.col("n_neg") - F.col("fp").cast("double") * F.col("n_pos"))
    eer = (F.try_divide(F.col("fp"), F.col("n_neg")) + F.try_divide(fn, F.col("n_pos"))) / 2
    return F.min_by(eer, F.when(F.col("keep"), F.struct(gap, -F.col("score"))))


def verification(df: DataFrame, score: str, label: str, by: Sequence[str] = (), drop_collinear: bool = True) -> DataFrame:
    """AUROC and EER per slice in one pass over the ROC points."""
    by = list(by)
    pts = roc_points(df, score, label, by, drop_collinear)
    return pts.groupBy(*by).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), _area().alias("auroc"), _eer().alias("eer")
    )


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware AUROC per slice."""
    by = list(by)
    y = F.col(label).cast("bigint")
    t = running_totals(df.filter(F.col(score).isNotNull()), by, score, {"pos": F.sum(y), "neg": F.sum(1 - y)})
    above = F.col("tot_pos") - F.col("cum_pos") + F.col("pos") * 0.5
    n_pos, n_neg = F.max("tot_pos"), F.max("tot_neg")
    area = F.try_divide(F.sum(F.col("neg").cast("double") * above), n_pos.cast("double") * n_neg)
    return t.groupBy(*by).agg(
        n_pos.alias("n_pos"), n_neg.alias("n_neg"), area.alias("auroc")
    )


def roc_eer(df: DataFrame, score: str, label: str, by: Sequence[str] = (), drop_collinear: bool = True) -> DataFrame:
    """Equal error rate: mean of both error rates where they are closest first (highest score first)."""
    by = list(by)
    pts = roc_points(df, score, label, by, drop_collinear)
    return pts.groupBy(*by).agg(F.count_if("keep").alias("points"), _eer().alias("eer"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over thresholds of recall gain times precision."""
    by = list(by)
    y = F.col(label).cast("bigint")
    t = running_totals(df.filter(F.col(score).isNotNull()), by, score, {"pos": F.sum(y), "all": F.count(F.lit(1))})
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    n = F.col("tot_all") - F.col("cum_all") + F.col("all")
    ap = F.sum(F.try_divide(F.col("pos"), F.col("tot_pos")) * (tp / n))
    return t.groupBy(*by).agg(F.max("tot_pos").alias("n_pos"), F.max("tot_all").alias("n"), ap.alias("ap"))


def auroc_and_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``auroc`` with the ``ap`` of ``average_precision``, from one pass of running totals."""
    by = list(by)
    y = F.col(label).cast("bigint")
    sums = {"pos": F.sum(y), "neg": F.sum(1 - y), "all": F.count(F.lit(1))}
    t = running_totals(df.filter(F.col(score).isNotNull()), by, score, sums)
    before = F.col("tot_pos") - F.col("cum_pos")
    tp, n = before + F.col("pos"), F.col("tot_all") - F.col("cum_all") + F.col("all")
    n_pos, n_neg = F.max("tot_pos"), F.max("tot_neg")
    area = F.try_divide(F.sum(F.col("neg").cast("double") * (before + F.col("pos") * 0.5)), n_pos.cast("double") * n_neg)
    ap = F.sum(F.try_divide(F.col("pos"), F.col("tot_pos")) * (tp / n))
    return t.groupBy(*by).agg(n_pos.alias("n_pos"), n_neg.alias("n_neg"), area.alias("auroc"), ap.alias("ap"))


def pair_cosine(pairs: DataFrame, emb: DataFrame, key: str = "win_id", col: str = "vec", out: str = "score") -> DataFrame:
    """Cosine similarity of the two sides of each pair."""
    both = with_sides(pairs, emb, [col], key)
    return both.withColumn(out, vec.cosine(f"{col}_a", f"{col}_b")).drop(f"{col}_a", f"{col}_b")


def pair_neg_l2(pairs: DataFrame, features: DataFrame, key: str = "win_id", col: str = "vec", out: str = "score") -> DataFrame:
    """Negative Euclidean distance of the two sides' (standardised) features."""
    both = with_sides(pairs, features, [col], key)
    return both.withColumn(out, vec.neg_l2(f"{col}_a", f"{col}_b")).drop(f"{col}_a", f"{col}_b")


Views = dict[str, Callable[[Column], Column]]


def _viewed(df: DataFrame, views: Views, cols: Sequence[str]) -> DataFrame:
    """One copy of each row per view, with its name (``setting``) and its vectors."""
    each = F.array(*[F.struct(F.lit(n).alias("setting"), *[f(F.col(c)).alias(c) for c in cols]) for n, f in views.items()])
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.explode(each).alias("_v")).select(*rest, "_v.*")


def enroll(
    emb: DataFrame,
    k_list: Sequence[int] = (1, 3, 5, 10),
    min_query: int = 5,
    min_proto: int = 5,
    seed: int = 42,
    by: Sequence[str] = (),
    key: str = "win_id",
    views: Views | None = None,
) -> DataFrame:
    """Few-shot enrollment: by, k, n_entities, n_queries, top1, top5, auroc, eer.

    ``emb`` has (by, key, entity, route, vec). The route split is one fixed keyed shuffle for
    all k. Genuine and impostor scores are equi-joins; only the retrieval rank looks at all
    prototypes, block by block. ``views`` as in ``enroll_scores``.
    """
    scores = materialize(enroll_scores(emb, k_list, min_query, min_proto, seed, by, key, views), "enroll")
    by = [*by, "setting"] if views else list(by)
    long = scores.select(*by, "k", F.expr("stack(2, own, 1, imp, 0) AS (score, label)"))
    ver = verification(long, "score", "label", [*by, "k"])
    rank = scores.groupBy(*by, "k").agg(
        F.count_distinct("entity").alias("n_entities"),
        F.count(F.lit(1)).alias("n_queries"),
        F.avg((F.col("better") < 1).cast("double")).alias("top1"),
        F.avg((F.col("better") < 5).cast("double")).alias("top5"),
    )
    return rank.join(ver.drop("n_pos", "n_neg"), [*by, "k"])


def enroll_scores(
    emb: DataFrame,
    k_list: Sequence[int] = (1, 3, 5, 10),
    min_query: int = 5,
    min_proto: int = 5,
    seed: int = 42,
    by: Sequence[str] = (),
    key: str = "win_id",
    views: Views | None = None,
) -> DataFrame:
    """Per query and k: own score, one impostor's score, number of better prototypes.

    ``views`` (name: function of a vector) adds a column ``setting``: rows are enrolled by each view of their vectors, which is taken behind the joins. A view
    must give the mean of vectors what it gives them, as setting numbers to 0 does.
    """
    by = list(by)
    base = emb.select(key, "entity", "route").distinct()
    roles = support_query(base, key, None, seed)
    enough = roles.groupBy("entity").agg(
        F.count_if(F.col("role") == "query").alias("_q"), F.count_if(F.col("role") == "support").alias("_s")
    )
    enough = enough.filter((F.col("_q") >= min_query) & (F.col("_s") >= 1)).select("entity")
    order = hash_rank(enough, [], ["entity"], f"{seed}-proto", "_ord", "_E").filter(F.col("_E") >= min_proto)
    roles = materialize(roles.join(order, "entity").select(key, "entity", "role", "rank", "_ord", "_E"), "roles")
    full = emb.select(*by, key, "vec").join(roles, key)
    ks = F.filter(F.lit([int(k) for k in k_list]), lambda k: k >= F.col("rank"))
    sup = full.filter(F.col("role") == "support").select(*by, "entity", "_ord", "vec", F.explode(ks).alias("k"))
    protos = materialize(vec.mean_vector(sup, [*by, "k", "entity", "_ord"], "vec", "proto"), "protos")
    draw = hash_draw(f"{seed}-imp", F.col("_E"), key) + 1
    imp = F.when(draw == F.col("_ord"), F.col("_ord") % F.col("_E") + 1).otherwise(draw)
    q = full.filter(F.col("role") == "query").select(
        *by, key, "entity", vec.as_double("vec").alias("vec"), imp.alias("_imp"), F.explode(F.lit([int(k) for k in k_list])).alias("k")
    )
    own = protos.select(*by, "k", "entity", F.col("proto").alias("_own"))
    other = protos.select(*by, "k", F.col("_ord").alias("_imp"), F.col("proto").alias("_other"))
    q = q.join(own, [*by, "k", "entity"]).join(other, [*by, "k", "_imp"])
    if views:
        q, protos = _viewed(q, views, ["vec", "_own", "_other"]), _viewed(protos, views, ["proto"])
        by.append("setting")
    q = q.select(*by, "k", key, "entity", "vec", vec.cosine("vec", "_own").alias("own"), vec.cosine("vec", "_other").alias("imp"))
    q = materialize(q, "scored")
    better = count_better(q, protos.select(*by, "k", "entity", F.col("proto").alias("vec")), [*by, "k"], key, "entity")
    return q.drop("vec").join(better, [*by, "k", key])


def own_vs_best_other(queries: DataFrame, protos: DataFrame, key: str = "win_id", block: int = 4096) -> DataFrame:
    """Per query: similarity to the own prototype, to the best other one, and whether own wins.

    ``queries`` has (key, entity, vec), ``protos`` (entity, vec).
    """
    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[[key]].copy()
        out["own"], out["other"] = np.nan, np.nan
        if len(left) and len(right):
            s = similarity("cosine", np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy()))
            mine = left["entity"].to_numpy()[:, None] == right["_pe"].to_numpy()[None, :]
            out["own"] = np.where(mine.any(1), np.where(mine, s, -np.inf).max(1), np.nan)
            out["other"] = np.where((~mine).any(1), np.where(mine, -np.inf, s).max(1), np.nan)
        return out.astype({"own": "float64", "other": "float64"})

    kt = dict(queries.dtypes)[key]
    p = protos.select(F.col("entity").alias("_pe"), "vec")
    grid = block_grid(queries.select(key, "entity", "vec"), p, [], key, "_pe", fn, f"`{key}` {kt}, own double, other double", block)
    clean = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    out = grid.groupBy(key).agg(clean("own").alias("own"), clean("other").alias("best_other"))
    return out.withColumn("correct", F.round("own", 9) > F.round("best_other", 9))


def with_slices(df: DataFrame, slices: dict[str, Column], name: str = "slice") -> DataFrame:
    """One copy of each row per slice it belongs to."""
    member = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in slices.items()]))
    return df.withColumn(name, F.explode(member))


def verify_pairs(pairs: DataFrame, score: str = "score", label: str = "same_entity", by: str = "scenario", min_n: int = 200) -> DataFrame:
    """Pair verification overall and per slice; slices need min_n pairs and both classes."""
    rows = pairs.select(score, label, F.explode(F.array(F.lit("all"), F.col(by))).alias("slice"))
    out = verification(rows, score, label, ["slice"])
    big = (F.col("n_pos") + F.col("n_neg") >= min_n) | (F.col("slice") == "all")
    return out.filter(big & F.col("auroc").isNotNull())


def sliced_auroc(df: DataFrame, slices: dict[str, Column], score: str = "score", label: str = "y", min_pos: int = 50) -> DataFrame:
    """AUROC over overlapping slices with more than min_pos positives."""
    out = auroc(with_slices(df, slices), score, label, ["slice"])
    return out.filter(F.col("n_pos") > min_pos)


def _negative_pool(emb: DataFrame, n_neg: int, seed: int, key: str) -> DataFrame:
    """Per group, 2 * n_neg rows by hash of which no entity fills more than half.

    So whichever entity is being verified, n_neg rows of others remain (if the group has them).
    """
    capped = hash_top_n(emb, ["grp", "entity"], n_neg, f"{seed}-neg", key)
    return hash_top_n(capped, ["grp"], 2 * n_neg, f"{seed}-neg", key, name="_nr")


def _trial_scores(trials: DataFrame, protos: DataFrame, pos: DataFrame, pool: DataFrame, ids: list[str], n_neg: int) -> DataFrame:
    """Score each trial's positives and its first n_neg negatives against its prototype."""
    neg = trials.join(pool.withColumnRenamed("entity", "_e"), F.col("grp") == F.col("query_grp"))
    neg = neg.filter(F.col("_e") != F.col("entity")).drop("grp", "_e")
    neg = top_n(neg, ids, n_neg, "_nr")
    both = pos.select(*ids, "vec", F.lit(1).alias("y")).unionByName(neg.select(*ids, "vec", F.lit(0).alias("y")))
    scored = both.join(protos, ids)
    return scored.select(*ids, "y", vec.cosine("vec", "proto").alias("score"))


def cross_group_verify(
    emb: DataFrame, caps: tuple[int, int, int] = (50, 200, 2000), min_n: int = 20, seed: int = 42, key: str = "win_id"
) -> DataFrame:
    """Enroll an entity on group A, verify it on group B against that group's other entities.

    ``kind`` is "cross" (A <> B) or "same" (both halves of one group, the control). One row per
    trial: kind, entity, enroll_grp, query_grp, n_pos, n_neg, auroc, eer. Vectors are scaled to length 1 first.
    """
    c_proto, c_pos, c_neg = caps
    unit = emb.select(key, "entity", "grp", vec.unit("vec").alias("vec"))
    cells = eligible_cells(unit, min_n)
    rows = hash_rank(unit.join(cells, ["entity", "grp"]), ["entity", "grp"], [key], seed, "_r").withColumnRenamed("n", "_n")
    rows = materialize(rows, "cells")
    pool = materialize(_negative_pool(unit, c_neg, seed, key), "pool")
    ids = ["kind", "entity", "enroll_grp", "query_grp"]
    # Cross: trials are ordered pairs of one entity's own cells.
    a = cells.select("entity", F.col("grp").alias("enroll_grp"))
    b = cells.select("entity", F.col("grp").alias("query_grp"))
    cross = a.join(b, "entity").filter(F.col("enroll_grp") != F.col("query_grp")).withColumn("kind", F.lit("cross"))
    same = cells.filter(F.col("n") >= 2 * min_n).select("entity", F.col("grp").alias("enroll_grp"), F.col("grp").alias("query_grp"), F.lit("same").alias("kind"))
    trials = materialize(cross.select(*ids).unionByName(same.select(*ids)), "trials")
    half = F.floor(F.col("_n") / 2)
    head = rows.withColumnRenamed("grp", "enroll_grp").join(trials, ["entity", "enroll_grp"])
    limit = F.when(F.col("kind") == "same", F.least(half, F.lit(c_proto))).otherwise(F.lit(c_proto))
    protos = vec.mean_vector(head.filter(F.col("_r") <= limit), ids, "vec", "proto")
    tail = rows.withColumnRenamed("grp", "query_grp").join(trials, ["entity", "query_grp"])
    start = F.when(F.col("kind") == "same", half).otherwise(F.lit(0))
    pos = tail.filter((F.col("_r") > start) & (F.col("_r") <= start + c_pos))
    scored = _trial_scores(trials, protos, pos, pool, ids, c_neg)
    out = verification(scored, "score", "y", ids)
    return out.filter((F.col("n_neg") >= min_n) & F.col("auroc").isNotNull())


#: A uniform number at or over the first k of these stands for a Poisson(1) count of k or more.
POISSON = tuple(round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 12) for k in range(9))


def cluster_bootstrap(
    df: DataFrame, entity: str = "entity", value: str = "value", B: int = 2000, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """95 % interval of the mean over entities, resampling entities: by, n, mean, lo, hi.

    Every entity gets a Poisson(1) weight in each of the B resamples, by hash of the entity and the resample's number, in
    place of drawing as many entities with repetition. No draw moves: weighted sums are formed where the entities lie, and only
    B rows of each task are shuffled.
    """
    by = list(by)
    per = materialize(df.groupBy(*by, entity).agg(F.avg(value).alias("_v")), "entities")
    boot = per.select(*by, entity, "_v", F.explode(F.sequence(F.lit(1), F.lit(B))).alias("_b"))
    u = hash_uint(f"{seed}-boot", *by, entity, "_b") / F.lit(float(1 << 32))
    weight = sum((F.when(F.col("_u") >= t, 1).otherwise(0) for t in POISSON), F.lit(0))
    boot = boot.withColumn("_u", u).select(*by, "_b", "_v", weight.alias("_w"))
    means = boot.groupBy(*by, "_b").agg((F.sum(F.col("_w") * F.col("_v")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m")).filter("_m IS NOT NULL")
    ci = means.groupBy(*by).agg(
        F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi")
    )
    mean = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    return mean.join(ci, by) if by else mean.join(ci)  # one row each


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class (and "all"): support, predicted, hit, recall, precision, f1; "all" has accuracy,
    balanced accuracy as recall and macro-F1 as f1. Classes are counted before anything is joined."""
    conf = df.groupBy(F.col(y).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = F.expr("stack(2, y, 1, p, 0) AS (cls, _true)")
    per = conf.select("n", (F.col("y") == F.col("p")).alias("_hit"), side).groupBy("cls").agg(
        F.coalesce(F.sum(F.when(F.col("_true") == 1, F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("_true") == 0, F.col("n"))), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when((F.col("_true") == 1) & F.col("_hit"), F.col("n"))), F.lit(0)).alias("hit"),
    )
    per = per.select(
        "*",
        F.when(F.col("support") > 0, F.col("hit") / F.col("support")).alias("recall"),
        F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0).alias("precision"),
        (2 * F.col("hit") / (F.col("support") + F.col("predicted"))).alias("f1"),
    )
    total = per.agg(
        F.lit("all").alias("cls"),
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hit").alias("hit"),
        F.avg("recall").alias("recall"),
        (F.sum("hit") / F.sum("support")).alias("precision"),
        F.avg("f1").alias("f1"),
    )
    return per.unionByName(total)


def majority_vote(df: DataFrame, route: Sequence[str], pred: str) -> DataFrame:
    """Most frequent prediction per route; the smaller label on a tie."""
    counts = df.groupBy(*route, pred).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*route).agg(
        F.min_by(pred, F.struct(-F.col("_n"), F.col(pred))).alias("vote"), F.max("_n").alias("votes")
    )


def loo_nn(routes: DataFrame, key: str = "rid", entity: str = "entity", block: int | None = None) -> DataFrame:
    """Nearest other route of each route's (standardised) mean features, and whether it is the same entity's.

    ``routes`` has (key, entity, vec).
    """
    routes = materialize(routes.select(key, entity, "vec"), "routes")
    nn = nearest(routes, key, entity, block=block)
    out = routes.select(key, entity).join(nn, key)
    return out.withColumn("same", F.col(entity) == F.col(f"nn_{entity}"))


def recall_lift(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Recall per class and its lift over chance 1 / n_classes."""
    per = df.groupBy(F.col(y).alias("cls")).agg(
        F.count(F.lit(1)).alias("support"), F.avg(F.when(F.col(y) == F.col(pred), 1.0).otherwise(0.0)).alias("recall")
    )
    n = per.agg(F.count(F.lit(1)).alias("_k"))
    return per.join(n).select("cls", "support", "recall", (F.col("recall") * F.col("_k")).alias("lift"))  # n is one row


def recall_at_k(a: DataFrame, b: DataFrame, ks: Sequence[int] = (1, 5, 10), key: str = "win_id") -> DataFrame:
    """Share of rows whose partner in the other modality ranks within k, both directions."""
    both = a.select(key, F.col("vec").alias("_a")).join(b.select(key, F.col("vec").alias("_b")), key)
    both = materialize(both.withColumn("own", vec.cosine("_a", "_b")), "modal")
    out = None
    for name, x, y in (("a_to_b", "_a", "_b"), ("b_to_a", "_b", "_a")):
        q = both.select(key, vec.as_double(x).alias("vec"), "own")
        items = both.select(F.col(key).alias("_iid"), vec.as_double(y).alias("vec"))
        rank = count_better(q, items, [], key, "_iid")
        part = rank.agg(
            F.lit(name).alias("direction"),
            F.count(F.lit(1)).alias("n"),
            *[F.avg((F.col("better") < k).cast("double")).alias(f"r{k}") for k in ks],
        )
        out = part if out is None else out.unionByName(part)
    return out


def ablate_channels(
    features: DataFrame, groups: dict[str, Sequence[int]], k: int = 5, min_query: int = 5, min_proto: int = 5, seed: int = 42
) -> DataFrame:
    """Enrollment with each group of (standardised) dimensions set to its mean 0, next to the full input."""
    def without(dims: Sequence[int]) -> Callable[[Column], Column]:
        return lambda v: F.transform(v, lambda x, i: F.when(i.isin(list(dims)), 0.0).otherwise(x)) if dims else v

    views = {n: without(dims) for n, dims in {"full": (), **groups}.items()}
    return enroll(features.select("win_id", "entity", "route", "vec"), [k], min_query, min_proto, seed, views=views)


def audit_agreement(answers: DataFrame, label: str = "label", answer: str = "answer") -> DataFrame:
    """yes / (yes + no) per label and overall; unsure and missing answers do not count."""
    rows = answers.select(F.explode(F.array(F.lit("all"), F.col(label))).alias("label"), F.col(answer).alias("_a"))
    yes, no = F.count_if(F.col("_a") == "yes"), F.count_if(F.col("_a") == "no")
    return rows.groupBy("label").agg(
        yes.alias("yes"), no.alias("no"), F.count_if(F.col("_a") == "unsure").alias("unsure"), F.when(yes + no > 0, yes / (yes + no)).alias("agreement")
    )


def annotator_agreement(a: DataFrame, b: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Share of equal answers per attribute over the common ids (two missing answers are equal)."""
    ren = lambda df, s: df.select(key, *[F.col(c).alias(f"{c}_{s}") for c in attrs])
    both = ren(a, "a").join(ren(b, "b"), key)
    rows = ", ".join(f"'{c}', CAST({c}_a <=> {c}_b AS DOUBLE)" for c in attrs)
    long = both.selectExpr(f"stack({len(attrs)}, {rows}) AS (attr, eq)")
    return long.groupBy("attr").agg(F.count(F.lit(1)).alias("n"), F.avg("eq").alias("agreement"))


def seed_summary(runs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population standard deviation over runs."""
    return runs.groupBy(*by).agg(
        F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")
    )


def utility_leakage(util: DataFrame, leak: DataFrame, name: str = "name") -> DataFrame:
    """One point per representation: utility, leakage, chance, and the leakage above chance."""
    return util.select(name, "utility").join(leak.select(name, "leakage", "chance"), name).select(
        name,
        "utility",
        "leakage",
        "chance",
        (F.col("leakage") - F.col("chance")).alias("leak_gap"),
        (F.col("utility") - F.col("leakage")).alias("gap"),
    )


def signal_agreement(frames: DataFrame, a: str, b: str, by: Sequence[str], min_r: float = 0.7) -> DataFrame:
    """Pearson r, slope of a on b, mean bias, spreads and the gate r >= min_r, per group."""
    ok = frames.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(a, b).alias("r"),
        F.regr_slope(F.col(a), F.col(b)).alias("slope"),
        F.avg(F.col(a) - F.col(b)).alias("bias"),
        F.stddev_pop(a).alias("std_a"),
        F.stddev_pop(b).alias("std_b"),
    )
    return out.withColumn("ok", F.coalesce(F.col("r") >= min_r, F.lit(False)))


def distribution_gate(a: DataFrame, b: DataFrame, cols: Sequence[str], tol: float = 1.5) -> DataFrame:
    """Per column: mean and spread differences in percent, largest gap of 99 quantiles, and the gate.

    The difference of means is taken of the larger of ``b``'s mean and spread, so that columns around zero are
    judged by their spread. Columns that are constant on both sides are left out.
    """
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    long = lambda df, s: df.selectExpr(f"'{s}' AS side", f"stack({len(cols)}, {pairs}) AS (col, x)")
    both = long(a, "a").unionByName(long(b, "b"))
    m = both.groupBy("col").agg(
        *[f(F.when(F.col("side") == s, F.col("x"))).alias(f"{n}_{s}") for s in "ab" for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    q = exact_quantiles(both, ["col", "side"], "x", [i / 100 for i in range(1, 100)])
    q = q.groupBy("col", "prob").agg(*[F.max(F.when(F.col("side") == s, F.col("q"))).alias("q" + s) for s in "ab"])
    gap = q.groupBy("col").agg(F.max(F.abs(F.col("qa") - F.col("qb"))).alias("max_gap"))
    pct = lambda n, scale: 100 * F.abs(F.col(f"{n}_a") - F.col(f"{n}_b")) / scale
    least = F.lit(1e-6)
    of_mean, of_std = F.greatest(F.abs("mean_b"), F.col("std_b"), least), F.greatest(F.col("std_b"), least)
    moving = m.filter((F.col("std_a") >= 1e-6) | (F.col("std_b") >= 1e-6))
    out = moving.join(gap, "col").select("col", pct("mean", of_mean).alias("mean_pct"), pct("std", of_std).alias("std_pct"), "max_gap")
    return out.withColumn("ok", (F.col("mean_pct") <= tol) & (F.col("std_pct") <= tol))
