"""Ingest steps on catalogues of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.ordered import top_n


def ingest_new(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has not been ingested yet (the batch form of ``streaming.ingest``)."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def prefer_source(
    df: DataFrame, keys: Sequence[str], prio: str | Column, size: str, ties: Sequence[str] = ()
) -> DataFrame:
    """One non-empty source per key: the best priority, then the first of the tie columns."""
    return top_n(df.filter(F.col(size) > 0), keys, 1, prio, *ties)


def source_mix(df: DataFrame, keys: Sequence[str], is_a: Column, cut: float = 0.5) -> DataFrame:
    """Share of segments from source A per key, and the label ``frac >= cut``."""
    out = df.groupBy(*keys).agg(F.avg(F.when(is_a, 1.0).otherwise(0.0)).alias("frac"))
    return out.withColumn("label", (F.col("frac") >= cut).cast("bigint"))


def ingest_audit(
    todo: DataFrame, rows: DataFrame, keys: Sequence[str], min_rows: int = 200, done: DataFrame | None = None
) -> DataFrame:
    """Status of every key of the catalogue: cached, fail (no rows), too_short or ok, with its row count."""
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = todo.select(*keys).join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "fail").when(F.col("n") < min_rows, "too_short").otherwise("ok")
    if done is not None:
        out = out.join(done.select(*keys).distinct().withColumn("_done", F.lit(True)), keys, "left")
        status = F.when(F.col("_done"), "cached").otherwise(status)
        return out.select(*keys, status.alias("status"), "n")
    return out.select(*keys, status.alias("status"), "n")


def status_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Add ``new`` as a copy of ``old`` where it is absent."""
    missing = {n: F.col(o) for n, o in aliases.items() if n not in df.columns and o in df.columns}
    return df.withColumns(missing) if missing else df


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema in order; a missing one is a typed null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def pivot_fields(
    samples: DataFrame, keys: Sequence[str], fields: Sequence[str], field: str = "field", value: str = "value"
) -> DataFrame:
    """Narrow samples to one column per field. The field list is given, so no pass looks for it."""
    picks = [F.max_by(value, F.when(F.col(field) == f, F.col("seq"))).alias(f) for f in fields]
    return samples.groupBy(*keys).agg(*picks)


def cap_per_group(df: DataFrame, grp: Sequence[str], order: Sequence[str], n: int = 6) -> DataFrame:
    """The first n rows of each group."""
    return top_n(df, grp, n, *order)
