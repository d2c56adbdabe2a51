"""Model-based operators: probes, residuals, maps, forecasts.

Folds, groups, group pairs and feature sets are columns of one job (``forests.py``); linear models are solved from sums of products
(``linear.py``); the rest is ``pyspark.ml``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trees as tr
from ..functions.hashing import hash_order
from ..functions.vectors import as_double, mean_vector
from ..plans.ordered import exact_quantiles, exact_rank, hash_rank
from ..plans.stage import materialize
from . import linear
from .distance import history_future
from .forests import forest_votes, scores
from .metrics import majority_vote
from .sampling import support_query


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) AS (col, x)")


def _one_row(long: DataFrame, cols: Sequence[str], value: str, prefix: str) -> DataFrame:
    return long.agg(*[F.max(F.when(F.col("col") == c, F.col(value))).alias(prefix + c) for c in cols])


def impute_standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill missing values with the exact median, then scale to mean 0 and population sd 1 (sd 0 counts as 1)."""
    med = _one_row(exact_quantiles(_long(df, cols), ["col"], "x", [0.5]), cols, "q", "_m_")
    filled = df.join(F.broadcast(med))  # one row
    filled = filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_m_" + c)) for c in cols}).drop(*med.columns)
    mom = filled.agg(
        *[F.avg(c).alias("_a_" + c) for c in cols], *[F.stddev_pop(c).alias("_s_" + c) for c in cols]
    )
    out = filled.join(F.broadcast(mom))  # one row
    scale = lambda c: F.when(F.col("_s_" + c) > 0, F.col("_s_" + c)).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col("_a_" + c)) / scale(c) for c in cols}).drop(*mom.columns)


def channel_norm(
    frames: DataFrame, cols: Sequence[str], n: int | None = None, eps: float = 1e-3, seed: int = 42, key: str = "win_id"
) -> DataFrame:
    """Mean and sd + eps per channel over all ``frames`` (give those of the train fold): channel, mu, sd.

    With ``n`` the sample is defined as the frames of n windows drawn by hash.
    """
    if n is not None:
        drawn = frames.select(key).distinct().withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(n).select(key)
        frames = frames.join(drawn, key, "left_semi")
    long = _long(frames, cols)
    return long.groupBy(F.col("col").alias("channel")).agg(F.avg("x").alias("mu"), (F.stddev_pop("x") + eps).alias("sd"))


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Fold per group: groups by size, largest first, dealt out in snake order."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = exact_rank(sizes, [], "n", [group], descending=True, name="_r")
    at = (F.col("_r") - 1) % (2 * k)
    return ranked.select(group, "n", F.when(at < k, at).otherwise(2 * k - 1 - at).alias("fold"))


def _features(df: DataFrame, features: Sequence[str], label: str, extra: Sequence[str]) -> DataFrame:
    """Rows with a string label, double features and per-class balancing weights."""
    rows = df.select(*extra, F.col(label).cast("string").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    rows = rows.filter(F.col("_y").isNotNull())
    sizes = rows.groupBy("_y").agg(F.count(F.lit(1)).alias("_c"))
    whole = sizes.agg(F.sum("_c").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = sizes.join(whole).select("_y", (F.col("_all") / (F.col("_k") * F.col("_c"))).alias("_w"))  # whole is one row
    return rows.join(weights, "_y")


def _forest(features: Sequence[str], trees: int, depth: int, seed: int) -> Pipeline:
    filled = [f + "_f" for f in features]
    return Pipeline(
        stages=[
            StringIndexer(inputCol="_y", outputCol="_label", handleInvalid="keep"),
            Imputer(strategy="median", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol="_vec", withMean=True),
            RandomForestClassifier(
                labelCol="_label", featuresCol="_vec", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed
            ),
        ]
    )


def _cases(df: DataFrame, model, part: str, label: str, key: Sequence[str], keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The input of ``forest_votes``: ``keep`` columns, features, _m, _part, _y and _id."""
    return df.select(
        *dict.fromkeys([*keep, *features]), model.cast("string").alias("_m"), F.col(part).cast("bigint").alias("_part"), F.col(label).cast("string").alias("_y"),
        F.concat_ws("|", *key).alias("_id"),
    )


def leakage_probe(
    df: DataFrame, features: Sequence[str], nuisance: str, group: str, k: int = 5, trees: int = 300, depth: int = 16, seed: int = 42, key: Sequence[str] = ("win_id",)
) -> DataFrame:
    """How well a nuisance label can be read from the features on unseen groups: bal_acc, n, chance, acc."""
    return leakage_by_set(df, {"all": features}, nuisance, group, k, trees, depth, seed, key).select("bal_acc", "n", "chance", "acc")


def leakage_by_set(
    df: DataFrame, subsets: dict[str, Sequence[str]], nuisance: str, group: str, k: int = 5, trees: int = 300, depth: int = 16, seed: int = 42, key: Sequence[str] = ("win_id",)
) -> DataFrame:
    """The leakage probe of several feature sets side by side, on the same folds: features, bal_acc, acc, chance, n."""
    folds = group_kfold(df, group, k).select(group, "fold")
    features = list(dict.fromkeys(f for s in subsets.values() for f in s))
    cases = _cases(df.join(folds, group), F.lit("all"), "fold", nuisance, key, (), features)
    return scores(forest_votes(cases, subsets, trees, depth, seed=seed), ["features"])


def source_probe(
    df: DataFrame, features: Sequence[str], src: str, group: str, min_n: int = 20, k: int = 5, trees: int = 300, depth: int = 16, seed: int = 42, key: Sequence[str] = ("win_id",)
) -> DataFrame:
    """Leakage probe of the recording source, over classes with at least min_n rows."""
    big = df.groupBy(src).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_n).select(src)
    return leakage_probe(df.join(big, src, "left_semi"), features, src, group, k, trees, depth, seed, key)


def route_folds(df: DataFrame, grp: str, entity: str, route: str, min_routes: int = 2, min_windows: int = 8, k: int = 5) -> DataFrame:
    """Folds for recognising entities within each group: (grp, entity, route, fold) of the entities with enough routes and windows.

    A group has as many folds as its scarcest entity has routes, from 2 to ``k``; its routes are dealt out by size in snake order. Groups with
    one such entity are left out.
    """
    sizes = df.groupBy(grp, entity, route).agg(F.count(F.lit(1)).alias("_n"))
    own = sizes.groupBy(grp, entity).agg(F.count(F.lit(1)).alias("_routes"), F.sum("_n").alias("_all")).filter((F.col("_routes") >= min_routes) & (F.col("_all") >= min_windows))
    whole = own.groupBy(grp).agg(F.least(F.lit(k), F.min("_routes")).alias("_k"), F.count(F.lit(1)).alias("_e")).filter("_e > 1").select(grp, "_k")
    routes = sizes.join(own.select(grp, entity), [grp, entity]).join(whole, grp)
    ranked = exact_rank(routes, [grp], "_n", [entity, route], descending=True, name="_r")
    at = (F.col("_r") - 1) % (2 * F.col("_k"))
    return ranked.select(grp, entity, route, F.when(at < F.col("_k"), at).otherwise(2 * F.col("_k") - 1 - at).alias("fold"))


def identifiability(
    df: DataFrame,
    subsets: dict[str, Sequence[str]],
    grp: str = "grp",
    entity: str = "entity",
    route: str = "route",
    k: int = 5,
    trees: int = 300,
    depth: int = 16,
    min_routes: int = 2,
    min_windows: int = 8,
    seed: int = 42,
    key: Sequence[str] = ("win_id",),
) -> DataFrame:
    """Entity recognition on held-out routes, in every group by every feature set: window and route-vote accuracy, chance.

    All groups, folds and feature sets are fitted together; see ``route_folds`` for who takes part.
    """
    features = list(dict.fromkeys(f for s in subsets.values() for f in s))
    folds = route_folds(df, grp, entity, route, min_routes, min_windows, k)
    cases = _cases(df.join(folds, [grp, entity, route]), F.col(grp), "fold", entity, key, (grp, route), features)
    pred = materialize(forest_votes(cases, subsets, trees, depth, seed=seed), "votes")
    vote = majority_vote(pred, [grp, "features", route, "_y"], "_p").groupBy(grp, "features").agg(
        F.avg(F.coalesce(F.col("vote") == F.col("_y"), F.lit(False)).cast("double")).alias("vote_acc"), F.count(F.lit(1)).alias("routes")
    )
    count = F.create_map(*[x for n, s in subsets.items() for x in (F.lit(n), F.lit(len(s)))])
    return scores(pred, [grp, "features"]).join(vote, [grp, "features"]).select(
        grp, "features", count[F.col("features")].alias("n_features"), "bal_acc", "acc", "vote_acc", "chance", "n", "routes"
    )


def importances(df: DataFrame, features: Sequence[str], label: str, trees: int = 300, depth: int = 10, seed: int = 42) -> DataFrame:
    """Feature importances of one forest over all rows (one row per feature)."""
    rows = _features(df, features, label, [])
    # Few bytes make much work here: a small file would be one task's in every pass.
    rows = materialize(rows.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), "forest")
    model = _forest(features, trees, depth, seed).fit(rows)
    imp = [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())]
    return df.sparkSession.createDataFrame(imp, "feature string, importance double")


def transfer_cases(df: DataFrame, grp: str = "grp", entity: str = "entity", min_n: int = 3, min_shared: int = 2) -> DataFrame:
    """Rows of every pair of groups that share ``min_shared`` entities with ``min_n`` rows in both, those entities only: ``df`` with grp_a, grp_b."""
    cells = materialize(df.groupBy(entity, grp).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_n), "cells")
    a, b = cells.select(entity, F.col(grp).alias("grp_a")), cells.select(entity, F.col(grp).alias("grp_b"))
    both = a.join(b, entity).filter(F.col("grp_a") < F.col("grp_b"))
    many = both.groupBy("grp_a", "grp_b").agg(F.count(F.lit(1)).alias("_e")).filter(F.col("_e") >= min_shared).select("grp_a", "grp_b")
    mine = both.join(many, ["grp_a", "grp_b"])  # entity by pair of its own groups
    sides = mine.select(entity, "grp_a", "grp_b", F.explode(F.array("grp_a", "grp_b")).alias(grp))
    return df.join(sides, [entity, grp])


def cross_group_transfer(
    df: DataFrame,
    subsets: dict[str, Sequence[str]],
    grp: str = "grp",
    entity: str = "entity",
    min_n: int = 3,
    min_shared: int = 2,
    trees: int = 300,
    depth: int = 16,
    seed: int = 42,
    key: Sequence[str] = ("win_id",),
) -> DataFrame:
    """Train on one group, test on another, over the entities both share: both directions of every pair, by every feature set.

    All pairs are fitted together: the two groups of a pair are its two folds.
    """
    features = list(dict.fromkeys(f for s in subsets.values() for f in s))
    rows = transfer_cases(df, grp, entity, min_n, min_shared).withColumn("_side", (F.col(grp) == F.col("grp_b")).cast("bigint"))
    cases = _cases(rows, F.concat_ws("|", "grp_a", "grp_b"), "_side", entity, key, ("grp_a", "grp_b", "_side"), features)
    pred = forest_votes(cases, subsets, trees, depth, seed=seed)
    first = F.col("_side") == 0
    pred = pred.select("*", F.when(first, F.col("grp_b")).otherwise(F.col("grp_a")).alias("train_grp"), F.when(first, F.col("grp_a")).otherwise(F.col("grp_b")).alias("test_grp"))
    return scores(pred, ["train_grp", "test_grp", "features"])


#: Rows (about, by hash) that the model of one statistic is fitted on.
RESIDUAL_ROWS = 50_000


def residualize(
    df: DataFrame, behav: Sequence[str], context: Sequence[str], keys: Sequence[str] = ("win_id",), categories: dict[str, int] | None = None, depth: int = 4, iters: int = 150,
    rows: int = RESIDUAL_ROWS, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Behaviour minus what a boosted-tree model of the context predicts: (rows with r_<stat>, R2 per stat).

    Context is numbers (missing: the median) and ``categories``: the most frequent values of a column, so many, as one column each. Every row
    stays. The statistics are fitted side by side, each on ``rows`` of the rows that know it, drawn by hash; its residual is null in the others.
    """
    wide, names = context_columns(df.select(*dict.fromkeys([*keys, *behav, *context, *(categories or {})])), context, categories)
    wide = materialize(wide.select(*keys, *[F.col(b).cast("double").alias(b) for b in behav], F.array(*names).alias("_x")), "context")
    pairs = ", ".join(f"'{b}', `{b}`" for b in behav)
    known = wide.select(F.concat_ws("|", *keys).alias("_id"), "_x", F.expr(f"stack({len(behav)}, {pairs}) AS (stat, y)")).filter("y IS NOT NULL")
    rate = known.groupBy("stat").agg((F.lit(float(rows)) / F.count(F.lit(1))).alias("_rate"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(rate, "stat").filter(draw < F.col("_rate")).select("stat", "_id", "_x", "y")

    def fit(key, part):
        import pandas as pd

        part = part.sort_values("_id", kind="stable")
        start, t = tr.boost(np.stack(part["_x"].to_numpy()), part["y"].to_numpy(float), iters, depth)
        return pd.DataFrame({"stat": [key[0]], "start": [start], **{c: [getattr(t, c)] for c in ("feature", "cut", "left", "value", "roots")}})

    fitted = sample.groupBy("stat").applyInPandas(fit, "stat string, start double, feature array<int>, cut array<double>, left array<int>, value array<double>, roots array<int>")
    # One small model a statistic: iters trees of at most 2 ^ depth leaves.
    models = {r["stat"]: (r["start"], tr.Trees(*(np.array(r[c]) for c in ("feature", "cut", "left", "value", "roots")))) for r in fitted.collect()}
    held, width = df.sparkSession.sparkContext.broadcast(models), len(names)

    def rest(parts):
        for part in parts:
            x = np.stack(part["_x"].to_numpy()) if len(part) else np.zeros((0, width))
            for b in behav:
                part["r_" + b] = part[b].to_numpy(float) - tr.predict(*held.value[b], x) if b in held.value else np.nan
            yield part.drop(columns="_x")

    kinds = ", ".join(f"`{c}` {t}" for c, t in wide.drop("_x").dtypes) + "".join(f", `r_{b}` double" for b in behav)
    out = wide.mapInPandas(rest, kinds)
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    out = materialize(out.select(*keys, *[clean(c) for b in behav for c in (b, "r_" + b)]), "residuals")
    return out, r_squared(out, behav)


def context_columns(df: DataFrame, context: Sequence[str], categories: dict[str, int] | None = None, base: bool = False) -> tuple[DataFrame, list]:
    """``df`` and the columns of a design: ``context`` as doubles (missing: the exact median, 0 if all miss) and one 0/1 column for each of the most
    frequent values of the ``categories`` (name: how many), by name; with ``base`` without the first one."""
    med = _one_row(exact_quantiles(_long(df, context), ["col"], "x", [0.5]), context, "q", "_m_")
    wide = df.join(F.broadcast(med))  # one row
    cols = [F.coalesce(F.col(c).cast("double"), "_m_" + c, F.lit(0.0)) for c in context]
    for c, n in (categories or {}).items():
        top = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), c).limit(n)
        values = sorted(r[0] for r in top.collect())  # n values
        cols += [F.coalesce(F.col(c) == v, F.lit(False)).cast("double") for v in values[int(base) :]]
    return wide, cols


def residualize_linear(
    df: DataFrame, behav: Sequence[str], context: Sequence[str], keys: Sequence[str] = ("win_id",), categories: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The linear variant of ``residualize``: least squares on the same context, from the sums of products of all rows."""
    wide, names = context_columns(df.select(*dict.fromkeys([*keys, *behav, *context, *(categories or {})])), context, categories, base=True)
    rows = materialize(wide.select(*keys, *[F.col(b).cast("double").alias(b) for b in behav], F.array(F.lit(1.0), *names).alias("_x")), "design")
    weights = linear.least_squares(rows, "_x", behav)
    fitted = lambda b: F.aggregate(F.zip_with("_x", F.array(*[F.lit(w) for w in weights[b]]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    out = rows.withColumns({"r_" + b: F.col(b) - fitted(b) if b in weights else F.lit(None).cast("double") for b in behav}).drop("_x")
    return out, r_squared(out, behav)


def residualize_means(df: DataFrame, behav: Sequence[str], context: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The linear variant: behaviour minus its mean over equal (categorical) context."""
    means = df.groupBy(*context).agg(*[F.avg(b).alias("_m_" + b) for b in behav])
    out = df.join(means, list(context)).withColumns({"r_" + b: F.col(b) - F.col("_m_" + b) for b in behav})
    out = out.drop(*["_m_" + b for b in behav])
    return out, r_squared(out, behav)


def r_squared(df: DataFrame, behav: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{b}', CAST({b} AS DOUBLE), CAST(r_{b} AS DOUBLE)" for b in behav)
    long = df.selectExpr(f"stack({len(behav)}, {pairs}) AS (stat, y, r)").filter("y IS NOT NULL")
    return long.groupBy("stat").agg((1 - F.sum(F.col("r") * F.col("r")) / (F.var_pop("y") * F.count("y"))).alias("r2"))


def linear_probe(df: DataFrame, vec: str, label: str, min_per: int = 4, seed: int = 42, key: str = "win_id", iters: int = 400, C: float = 1.0) -> DataFrame:
    """Logistic regression on half of each class (by hash), accuracy on the other half, lift over chance.

    The vectors are taken as they are; the weights, but not the intercepts, have an L2 penalty of 1 / (2 C) beside the summed loss.
    """
    rows = df.select(key, F.col(label).cast("string").alias("_y"), array_to_vector(as_double(vec)).alias("_vec"))
    ranked = hash_rank(rows, ["_y"], [key], seed, "_r", "_n").filter(F.col("_n") >= min_per)
    ranked = materialize(ranked.withColumn("_train", F.col("_r") <= F.floor(F.col("_n") / 2)), "probe")
    train = ranked.filter("_train")
    penalty = 1.0 / (C * max(1, train.count()))  # beside the mean loss
    fit = LogisticRegression(labelCol="_label", featuresCol="_vec", maxIter=iters, regParam=penalty, standardization=False, family="multinomial")
    model = Pipeline(stages=[StringIndexer(inputCol="_y", outputCol="_label"), fit]).fit(train)
    names = F.lit(list(model.stages[0].labels))
    pred = model.transform(ranked.filter("NOT _train")).select("_y", names[F.col("prediction").cast("int")].alias("_p"))
    acc = pred.agg(F.avg((F.col("_y") == F.col("_p")).cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"))
    k = ranked.select("_y").distinct().agg(F.count(F.lit(1)).alias("_k"))
    return acc.join(k).select("n", "acc", (1 / F.col("_k")).alias("chance"), (F.col("acc") * F.col("_k")).alias("lift"))  # one row each


def probe_contrast(df: DataFrame, vec: str, labels: Sequence[str], min_per: int = 4, seed: int = 42, iters: int = 400) -> DataFrame:
    """Linear probes of several labels (entity, route, group) side by side."""
    out = None
    for name in labels:
        part = linear_probe(df, vec, name, min_per, seed, iters=iters).select(F.lit(name).alias("label"), "n", "acc", "chance", "lift")
        out = part if out is None else out.unionByName(part)
    return out


def embed_map(df: DataFrame, vec: str = "vec", pca: int = 50, k: int = 8, seed: int = 42, entity: str = "entity") -> DataFrame:
    """Entities on a PCA map: cluster of each entity's centroid, its size, and each cluster's representative (largest)."""
    rows = df.select(entity, array_to_vector(as_double(vec)).alias("_vec"))
    model = PCA(k=pca, inputCol="_vec", outputCol="_pc").fit(rows)
    low = model.transform(rows).select(entity, vector_to_array("_pc").alias("pc"))
    centroid = mean_vector(low, [entity], "pc", "pc").join(low.groupBy(entity).agg(F.count(F.lit(1)).alias("n")), entity)
    points = materialize(centroid.withColumn("_c", array_to_vector("pc")).select(entity, "n", "pc", "_c"), "map")
    km = KMeans(k=k, featuresCol="_c", predictionCol="cluster", seed=seed).fit(points)
    out = km.transform(points).select(entity, "n", F.col("cluster").cast("bigint").alias("cluster"), "pc")
    top = out.groupBy("cluster").agg(F.min_by(entity, F.struct(-F.col("n"), F.col(entity))).alias("_top"))
    return out.join(top, "cluster").select(entity, "n", "cluster", (F.col(entity) == F.col("_top")).alias("representative"), "pc")


HISTORY_SIGNALS = ("vEgo", "aEgo", "actual_curvature", "steeringAngleDeg", "leadOne_dRel", "leadOne_vRel", "brakePressed")


def history_features(
    frames: DataFrame, anchors: DataFrame, hist: int = 50, signals: Sequence[str] = HISTORY_SIGNALS, keys: Sequence[str] = ("win_id",), order: str = "pos", bounded: bool = False
) -> DataFrame:
    """Tabular features of the frames before each anchor: mean, spread, range, last value and trend per signal."""
    h = history_future(frames, anchors, hist, 0, keys, order, bounded)
    aggs = []
    for s in signals:
        x = F.coalesce(F.col(s), F.lit(0.0))
        aggs += [
            F.avg(x).alias(f"{s}_mean"),
            F.stddev_pop(x).alias(f"{s}_std"),
            F.min(x).alias(f"{s}_min"),
            F.max(x).alias(f"{s}_max"),
            F.max_by(x, F.col("step")).alias(f"{s}_last"),
            F.coalesce(F.regr_slope(x, F.col("step").cast("double")), F.lit(0.0)).alias(f"{s}_trend"),
        ]
    return h.groupBy(*anchors.columns).agg(*aggs)


def forecast_events(
    anchors: DataFrame, frames: DataFrame, folds: DataFrame, hist: int = 50, model: str = "gbt", iters: int = 20, seed: int = 42, entity: str = "entity", bounded: bool = False
) -> DataFrame:
    """Event-forecast baseline: anchors of unseen entities (fold "test") with a score.

    ``anchors`` has the window key, entity, a, y (and what else should be kept); ``folds`` (entity, fold). ``bounded``: as in ``history_future``.
    The narrow anchors get their folds, so that features, once found, are not shuffled; each is written as a column of its own, since most have few values.
    """
    folds = folds.groupBy(entity, "fold").agg(F.count(F.lit(1)).alias("_times"))
    dealt = anchors.distinct().join(folds, entity)
    feats = history_features(frames, dealt, hist, bounded=bounded)
    names = [c for c in feats.columns if c not in dealt.columns]
    rows = feats.withColumn("_times", F.explode(F.array_repeat("fold", F.col("_times").cast("int")))).drop("_times")
    rows = materialize(rows.withColumn("_y", F.col("y").cast("double")), "forecast")
    rows = VectorAssembler(inputCols=names, outputCol="_vec").transform(rows)
    est = (
        GBTClassifier(labelCol="_y", featuresCol="_vec", maxIter=iters, maxDepth=4, seed=seed)
        if model == "gbt"
        else LogisticRegression(labelCol="_y", featuresCol="_vec", maxIter=iters)
    )
    fit = est.fit(rows.filter(F.col("fold") == "train"))
    scored = fit.transform(rows.filter(F.col("fold") == "test"))
    return scored.select(*anchors.columns, vector_to_array("probability")[1].alias("score"))


def few_shot_predict(
    samples: DataFrame, features: Sequence[str], target: str, k: int = 5, seed: int = 42, key: str = "win_id"
) -> DataFrame:
    """Generic linear predictor (least squares on the support rows) against the same plus the entity's mean residual on k support rows.

    A missing feature is its exact median; only rows without the target are left out. Returns the query rows with err_generic and err_personal (absolute errors).
    """
    rows = samples.select(key, "entity", "route", F.col(target).cast("double").alias("_t"), *[F.col(f).cast("double").alias(f) for f in features])
    med = _one_row(exact_quantiles(_long(rows, features), ["col"], "x", [0.5]), features, "q", "_m_")
    rows = rows.filter(F.col("_t").isNotNull()).join(F.broadcast(med))  # one row
    rows = rows.withColumns({f: F.coalesce(f, "_m_" + f, F.lit(0.0)) for f in features}).drop(*med.columns)
    roles = materialize(support_query(rows, key, None, seed), "fewshot")
    rows = roles.withColumn("_x", F.array(F.lit(1.0), *features))
    weights = linear.least_squares(rows.filter(F.col("role") == "support"), "_x", ["_t"]).get("_t", [0.0] * (len(features) + 1))
    pred = rows.withColumn("_g", sum((F.col("_x")[i] * w for i, w in enumerate(weights)), F.lit(0.0))).drop("_x")
    sup = pred.filter((F.col("role") == "support") & (F.col("rank") <= k))
    offset = sup.groupBy("entity").agg(F.avg(F.col("_t") - F.col("_g")).alias("_off"))
    q = pred.filter(F.col("role") == "query").join(offset, "entity")
    return q.select(
        key,
        "entity",
        "route",
        F.abs(F.col("_t") - F.col("_g")).alias("err_generic"),
        F.abs(F.col("_t") - F.col("_g") - F.col("_off")).alias("err_personal"),
    )


