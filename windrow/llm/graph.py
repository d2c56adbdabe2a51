"""Connected components by alternating stars, as grouped aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (u, v of one orderable type, u <> v): the smallest id that it reaches.

    Each turn points the larger neighbours of a node at its least neighbour, then the smaller ones; the
    edges end as one star a component, after a number of turns that grows with the logarithm of the longest path.
    Edges that are such stars already take no turn.
    A node with any number of neighbours is one group of an aggregate that combines before its shuffle; the
    joins carry it as rows. Edges are dealt by their larger end once, for its least neighbour and for the join with it.
    """
    cur = shared(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(cur):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cur.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").repartition("u")
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u")
        nxt = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        cur = shared(nxt.select("e.*").where("u <> v").distinct(), "edges")
    root = cur.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return root.unionByName(root.select(F.col("root").alias("id"), "root").distinct())


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (id, root) after further ``edges`` (u, v) between ids: only what they connect is gone through again."""
    at = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    e = edges.join(at("u"), "u", "left").join(at("v"), "v", "left")
    e = shared(e.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).where("u <> v").distinct(), "joins")
    up = components(e).select(F.col("id").alias("root"), F.col("root").alias("top"))
    old = roots.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    new = up.select(F.col("root").alias("id"), F.col("top").alias("root")).join(roots.select("id"), "id", "left_anti")
    return old.unionByName(new)


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u > v) are stars around their least nodes: every u has one v, and no v is a u."""
    up = edges.select(F.col("u").alias("id"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    both = up.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    node = both.groupBy("id").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return node.where("ups + downs > 1").agg(F.count(F.lit(1))).first()[0] == 0
