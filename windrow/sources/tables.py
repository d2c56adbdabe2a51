"""The star-schema tables, and the telemetry views that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stage import ROWS_PER_BUCKET, tasks_for

ROUTE = ["entity", "route"]

# Parameters for the coarse (one frame per second) signals of the star schema.
# The operators' own defaults are for 10 Hz telemetry.
COARSE = dict(rate=1.0, max_gap=3, min_len=10, win=20, stride=10, min_n=20, calm_w=3, chunk_len=10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp column, whatever the session zone."""
    day = f"unix_date(CAST({ts} AS DATE)) * 86400000000L"
    clock = f"hour({ts}) * 3600000000L + minute({ts}) * 60000000L"
    sec = f"CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)"
    return F.expr(f"{day} + {clock} + {sec}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are NULL everywhere: Spark aggregates skip NULL but propagate NaN."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def dense_index(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "idx", tasks: int | None = None
) -> DataFrame:
    """0-based position within ``keys``; ``bucket`` (never falling along the order) slices a hot key.

    Rows are numbered inside a (keys, bucket) slice, and the slices' sizes are summed up. ``tasks`` is their number
    for tables of known size; else the session's.
    """
    slices = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*keys, bucket, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_p"))
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    df = df.repartition(tasks, *keys, bucket) if tasks else df
    numbered = df.withColumn("_r", F.row_number().over(w)).join(slices, [*keys, bucket])
    return numbered.withColumn(name, (F.col("_r") + F.col("_p") - 1).cast("bigint")).drop("_r", "_p")


# The columns of lineitem that a frame's telemetry is computed from.
RAW = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus"]


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per order line: entity = supplier, route = ship year, group = region, idx, and the line's own columns."""
    li = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, li.count())
    geo = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("grp"))
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    route = ["l_suppkey", "route"]
    li = li.select("l_suppkey", *order, *RAW).withColumn("route", F.year("l_shipdate").cast("bigint"))
    # A route is numbered and written in one task, so that it lies together for later groupings; one of many rows goes
    # by months. There are at most rows / ROWS_PER_BUCKET of these, so they are broadcast.
    long = li.groupBy(*route).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > ROWS_PER_BUCKET)
    li = li.join(F.broadcast(long.select(*route, F.lit(True).alias("_long"))), route, "left")
    li = li.withColumn("_month", F.when(F.col("l_shipdate").isNotNull(), F.when(F.col("_long"), F.month("l_shipdate")).otherwise(0))).drop("_long")
    li = dense_index(li, route, "_month", order, tasks=tasks).join(geo, "l_suppkey")
    return li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity"), "route", "grp", "idx", *RAW)


def telemetry() -> dict[str, Column]:
    """The telemetry of a frame of ``raw_frames``."""
    r6 = lambda c: F.round(c, 6)
    flag = lambda c: c.cast("double")
    lane = (F.col("l_tax") - 0.04) * 10
    no_lane = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    human = ~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    return {
        "time_s": F.col("idx").cast("double"),
        "vEgo": F.when(F.col("l_quantity") <= 3, 0.0).otherwise(r6(F.col("l_quantity") * 0.6)),
        "aEgo": r6((F.col("l_discount") - 0.05) * 60),
        "actual_curvature": r6((F.col("l_tax") - 0.04) * 0.5),
        "steeringAngleDeg": r6((F.col("l_tax") - 0.04) * 3000),
        "steeringRateDeg": r6((F.col("l_discount") - 0.05) * 1000),
        "brakePressed": flag(F.col("l_returnflag") == "R"),
        "gasPressed": flag(F.col("l_returnflag") == "A"),
        "leadOne_status": flag(F.col("l_linestatus") == "O"),
        "leadOne_dRel": r6(F.col("l_extendedprice") / 1500),
        "leadOne_vRel": r6((F.col("l_discount") - 0.05) * 100),
        "laneLeft_y": F.when(~no_lane, r6(-1.8 + lane)),
        "laneRight_y": F.when(~no_lane, r6(1.8 + lane)),
        "is_human": flag(human),
    }


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their telemetry; ``RAW`` comes last."""
    return with_telemetry(raw_frames(spark, sf_dir), ["entity", "route", "grp", "idx"], RAW)


def with_telemetry(frames: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    return frames.select(*before, *[x.alias(n) for n, x in telemetry().items()], *after)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow logged values: entity, route, field, t_us, value, seq (tie-break)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"),
        F.lit(0).cast("bigint").alias("route"),
        F.col("event_type").alias("field"),
        micros("ts").alias("t_us"),
        F.when(~F.isnan("value"), F.col("value")).alias("value"),
        F.col("event_id").alias("seq"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window embeddings: win_id, entity = label, route = vec_id % 6, grp = label % 3."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("win_id"),
        F.col("label").cast("bigint").alias("entity"),
        (F.col("vec_id") % 6).alias("route"),
        (F.col("label") % 3).cast("bigint").alias("grp"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curation table: one row per route (order) of an entity (customer)."""
    orders = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("seg"))
    return (
        orders.select(
            F.col("o_custkey").alias("entity"),
            F.col("o_orderkey").alias("route"),
            F.col("o_orderpriority").alias("multi_grp"),
            F.round(F.col("o_totalprice") / 50000, 6).alias("minutes"),
            F.col("o_orderstatus").alias("status"),
        )
        .join(cust, "entity")
        .withColumnRenamed("seg", "grp")
    )
