"""Dimension normalisation, availability audit, curation and entity-disjoint splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import hash_rank

# Name tokens that do not name a model (trim, powertrain, feature generation).
STRIP_TOKENS = (
    "BOSCH", "ACC", "PEDAL", "CAMERA", "ASCM", "PREMIER", "RAVEN", "FL", "MMR", "NMS", "PE", "NON", "SCC", "SW",
    "HEV", "PHEV", "HYBRID", "EV", "ELECTRIC", "PRIME", "PREGLOBAL", "TSS2", "CHN", "RANGE",
)
# Fixed patterns: generation and year tokens.
GENERATION = r"^(MK\d+|GEN\d*|\d+(ST|ND|RD|TH)|\d+G|T\d+)$"
YEAR = r"^(19|20)\d{2}$"
# Brands of two words (first token -> brand).
TWO_WORD_BRANDS = {"ALFA": "ALFA_ROMEO"}

# Capability -> the channels that must vary for a route to have it.
CAPABILITIES = {
    "lateral_input": ("steeringAngleDeg",),
    "lateral_path": ("actual_curvature",),
    "yaw_sensed": ("yaw_rate",),
    "longitudinal": ("aEgo",),
    "car_following": ("leadOne_dRel",),
    "lane_keeping": ("laneLeft_y",),
    "brake_pedal": ("brake",),
    "gas_pedal": ("gas",),
}


def canon_name(
    df: DataFrame,
    col: str,
    strip: Sequence[str] = STRIP_TOKENS,
    special: Mapping[str, str] | None = None,
    brands: Mapping[str, str] = TWO_WORD_BRANDS,
) -> DataFrame:
    """Raw names with their canonical name and row count: raw, canon, n."""
    raw = df.groupBy(F.col(col).alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    tokens = F.split(F.translate("raw", "-", "_"), "_")
    first = F.upper(tokens[0])
    brand, skip = first, F.lit(2)
    for token, name in brands.items():
        brand = F.when(first == token, name).otherwise(brand)
        skip = F.when(first == token, F.lit(3)).otherwise(skip)
    upper = F.transform(F.slice(tokens, skip, F.greatest(F.size(tokens), F.lit(1))), lambda t: F.upper(t))
    drop = F.lit(list(strip))
    kept = F.filter(
        upper, lambda t: (t != "") & ~t.rlike(YEAR) & ~t.rlike(GENERATION) & ~F.array_contains(drop, t)
    )
    canon = F.array_join(F.concat(F.array(brand), kept), "_")
    if special:
        table = F.create_map(*[F.lit(x) for kv in special.items() for x in kv])
        canon = F.coalesce(table[F.col("raw")], canon)
    return raw.select("raw", canon.alias("canon"), "n")


def availability(
    frames: DataFrame,
    caps: Mapping[str, Sequence[str]] = CAPABILITIES,
    min_speed: float = 2.0,
    eps: float = 1e-6,
    rate: float = 10.0,
    keys: Sequence[str] = ("grp", "entity", "route"),
) -> DataFrame:
    """One audit row per route: rows, human moving rows and minutes, human share, capability flags, lead share."""
    hm = (F.col("is_human") > 0.5) & (F.col("vEgo") > min_speed)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    cols = sorted({c for cs in caps.values() for c in cs if c in frames.columns})
    agg = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(hm).alias("human_move_rows"),
        F.avg(yes(F.col("is_human") > 0.5)).alias("human_frac"),
        F.avg(yes(F.col("leadOne_status") > 0.5)).alias("lead_rate"),
        *[F.stddev_pop(F.when(hm, F.col(c))).alias("_sd_" + c) for c in cols],
    )
    live = lambda c: F.coalesce(F.col("_sd_" + c) >= eps, F.lit(False)) if c in cols else F.lit(False)
    flags = []
    for cap, cs in caps.items():
        ok = F.lit(True)
        for c in cs:
            ok = ok & live(c)
        flags.append(ok.cast("bigint").alias("has_" + cap))
    return agg.select(
        *keys,
        "rows",
        "human_move_rows",
        (F.col("human_move_rows") / rate / 60.0).alias("human_move_min"),
        "human_frac",
        "lead_rate",
        *flags,
    )


def coverage_rollup(avail: DataFrame, grp: str = "grp", caps: Sequence[str] = tuple(CAPABILITIES)) -> DataFrame:
    """Entities, routes, hours and share of routes per capability: one row per group and one for all (null)."""
    return avail.rollup(grp).agg(
        F.count_distinct("entity").alias("entities"),
        F.count(F.lit(1)).alias("routes"),
        (F.sum("human_move_min") / 60.0).alias("hours"),
        *[(100.0 * F.avg("has_" + c)).alias("pct_" + c) for c in caps],
    )


def curate(
    routes: DataFrame, min_route: float = 3.0, min_entity: float = 5.0, minutes: str = "minutes", entity: str = "entity"
) -> DataFrame:
    """Usable routes of entities whose usable minutes reach the minimum."""
    usable = routes.filter(F.col(minutes) >= min_route)
    good = usable.groupBy(entity).agg(F.sum(minutes).alias("_m")).filter(F.round("_m", 6) >= min_entity)
    return usable.join(good, entity, "left_semi")


def within_group(
    routes: DataFrame, min_routes: int = 2, min_entities: int = 4, grp: str = "grp", entity: str = "entity"
) -> DataFrame:
    """Routes of multi-route entities, in groups with enough of them; n_entities per group."""
    multi = routes.groupBy(grp, entity).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_routes)
    groups = multi.groupBy(grp).agg(F.count(F.lit(1)).alias("n_entities")).filter(F.col("n_entities") >= min_entities)
    return routes.join(multi.select(grp, entity), [grp, entity], "left_semi").join(groups, grp)


def cross_route(routes: DataFrame, min_routes: int = 3, seed: int = 42) -> DataFrame:
    """Hold out a third (at least one) of the routes of entities with min_routes or more: fold train / test."""
    ranked = hash_rank(routes.select("entity", "route"), ["entity"], ["entity", "route"], seed, "_r", "_n")
    held = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    out = ranked.filter(F.col("_n") >= min_routes)
    return out.select("entity", "route", F.when(F.col("_r") <= held, "test").otherwise("train").alias("fold"))


def cross_group(routes: DataFrame, grp: str = "grp", min_groups: int = 2) -> DataFrame:
    """Routes of entities seen on two or more groups, one row each (the map group -> routes, unnested)."""
    many = routes.groupBy("entity").agg(F.count_distinct(grp).alias("n_groups")).filter(F.col("n_groups") >= min_groups)
    return routes.select("entity", grp, "route").join(many, "entity")


def entity_folds(
    entities: DataFrame, few: float = 0.15, test: float = 0.15, val: float = 0.15, seed: int = 42, entity: str = "entity"
) -> DataFrame:
    """Entity-disjoint folds: a few-shot share, then shares of the rest for test and val (floors)."""
    ranked = hash_rank(entities.select(entity).distinct(), [], [entity], seed, "_r", "_n")
    n_few = F.floor(F.col("_n") * few)
    rest = F.col("_n") - n_few
    n_test, n_val = F.floor(rest * test), F.floor(rest * val)
    r = F.col("_r")
    fold = (
        F.when(r <= n_few, "few_shot")
        .when(r <= n_few + n_test, "test")
        .when(r <= n_few + n_test + n_val, "val")
        .otherwise("train")
    )
    return ranked.select(entity, fold.alias("fold"))


def regime_share(avail: DataFrame, keys: Sequence[str] = ("grp", "entity", "route")) -> DataFrame:
    """Share of human-controlled frames per route, with the minutes."""
    return avail.select(*keys, "human_frac", "human_move_min")


def cohort_counts(routes: DataFrame, grp: str = "grp") -> DataFrame:
    """Entities that share a group with another entity, and entities on two or more groups."""
    cells = routes.select("entity", grp).distinct()
    shared = cells.groupBy(grp).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    per = cells.join(shared.withColumn("_s", F.lit(1)), grp, "left").groupBy("entity")
    per = per.agg(F.max("_s").alias("_s"), F.count(F.lit(1)).alias("_g"))
    return per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("_s") == 1).alias("shared"),
        F.count_if(F.col("_g") >= 2).alias("multi"),
    )


def eligible_cells(windows: DataFrame, min_n: int = 20, grp: str = "grp") -> DataFrame:
    """(entity, group) cells with enough windows, of entities with two or more such cells."""
    cells = windows.groupBy("entity", grp).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    multi = cells.groupBy("entity").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= 2)
    return cells.join(multi.select("entity"), "entity", "left_semi")


def eligible_entities(windows: DataFrame, min_routes: int = 2, min_win: int = 8) -> DataFrame:
    """Entities with enough distinct routes and windows."""
    agg = windows.groupBy("entity").agg(F.count_distinct("route").alias("routes"), F.count(F.lit(1)).alias("n"))
    return agg.filter((F.col("routes") >= min_routes) & (F.col("n") >= min_win))


def shared_entity_pairs(windows: DataFrame, min_n: int = 3, min_shared: int = 2, grp: str = "grp") -> DataFrame:
    """Group pairs with at least min_shared entities that have min_n windows in each: grp_a, grp_b, shared.

    Pairs are formed among one entity's own groups only.
    """
    cells = windows.groupBy("entity", grp).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_n)
    a, b = cells.select("entity", F.col(grp).alias("grp_a")), cells.select("entity", F.col(grp).alias("grp_b"))
    both = a.join(b, "entity").filter(F.col("grp_a") < F.col("grp_b"))
    return both.groupBy("grp_a", "grp_b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared)


def purity(mix: DataFrame, cut: float = 0.9, frac: str = "frac") -> DataFrame:
    """Share of entities whose mean source share is beyond the cut on either side."""
    per = mix.groupBy("entity").agg(F.avg(frac).alias("_f"))
    pure = (F.round("_f", 9) > cut) | (F.round("_f", 9) < 1 - cut)
    return per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg(F.when(pure, 1.0).otherwise(0.0)).alias("pure_share"),
        F.avg("_f").alias("mean_frac"),
    )


def pseudonymise(df: DataFrame, key: str, salt: str, mapping: DataFrame | None = None, out: str = "pseudonym") -> DataFrame:
    """Replace a key by its mapped name (columns key, alias), or a salted hash where none is known."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    if mapping is None:
        return df.withColumn(out, hashed).drop(key)
    m = mapping.select(key, F.col("alias").alias("_alias"))
    return df.join(m, key, "left").withColumn(out, F.coalesce("_alias", hashed)).drop("_alias", key)


def sequential_pseudonyms(df: DataFrame, key: str, salt: str, prefix: str = "E") -> DataFrame:
    """A mapping key -> prefix + number, numbered in the order of a salted hash."""
    ranked = hash_rank(df.select(key).distinct(), [], [key], salt, "_r")
    return ranked.select(key, F.concat(F.lit(prefix), F.col("_r").cast("string")).alias("alias"))


def topk_other(df: DataFrame, col: str, k: int = 30, out: str | None = None, other: str = "OTHER") -> DataFrame:
    """Keep the k most frequent categories (name breaks ties), call the rest OTHER. The lookup has k rows."""
    out = out or col
    top = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), col).limit(k).select(col, F.lit(True).alias("_top"))
    kept = df.join(F.broadcast(top), col, "left")
    return kept.withColumn(out, F.when(F.col("_top"), F.col(col)).otherwise(other)).drop("_top")


def one_hot(df: DataFrame, col: str, categories: Sequence[str], prefix: str = "is_") -> DataFrame:
    """0/1 columns for a known list of categories."""
    return df.withColumns({f"{prefix}{c}": (F.col(col) == c).cast("int") for c in categories})


def entity_profile(windows: DataFrame, grp: str = "grp") -> DataFrame:
    """Modal group (smallest on a tie), window count, and whether the entity is its modal group's largest."""
    cells = windows.groupBy("entity", grp).agg(F.count(F.lit(1)).alias("_n"))
    prof = cells.groupBy("entity").agg(
        F.min_by(grp, F.struct(-F.col("_n"), F.col(grp))).alias("modal_grp"), F.sum("_n").alias("n")
    )
    top = prof.groupBy("modal_grp").agg(F.min_by("entity", F.struct(-F.col("n"), F.col("entity"))).alias("_top"))
    out = prof.join(top, "modal_grp")
    return out.select("entity", "modal_grp", "n", (F.col("entity") == F.col("_top")).alias("largest"))
