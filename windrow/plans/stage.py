"""Stage tables: intermediates that several branches or queries read are written once.

The written table lies in the session's ``spark.checkpoint.dir`` (a folder all executors
share), so it survives a lost executor, cuts the lineage, and is read back with column
pruning and known size. Only where the setting is unset and the master is local (tests) a temporary
folder is made; on a cluster that would be a folder of one machine, so it is an error.

``stage`` and ``materialize`` run a job when they are called, that is while a plan is built. ``release``
forgets the stage tables of an input, as is needed when its files have changed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

# Rows of a bucket, or of a task that sorts whole frames: some 50 MB, so that sorts stay in memory whatever the table's size.
ROWS_PER_BUCKET = 262_144

_FOLDERS: dict[str, str] = {}
_STAGES: dict[tuple[str, str], DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = tempfile.mkdtemp(prefix="windrow-stage-")
    return _FOLDERS[app]


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks (or buckets) for so many rows: every core, and at most ``ROWS_PER_BUCKET`` rows in each."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_BUCKET))


def materialize(
    df: DataFrame,
    name: str = "table",
    bucket_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    rows: int | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Write the table to the shared folder and read it back.

    With ``bucket_by`` (only for keys whose groups are small) it is written in hash buckets,
    so later windows, groupings and joins on that key need no shuffle and no sort. The number
    of buckets follows the expected ``rows``, but uses every core. ``finish`` adds columns that are
    functions of a row's others after the rows were shuffled to their buckets.
    """
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/windrow/{unique}"
    if not bucket_by:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = tasks_for(spark, rows or 0)
    df = df.repartition(n, *bucket_by)
    writer = (finish(df) if finish else df).write.bucketBy(n, *bucket_by).sortBy(*bucket_by, *sort_by)
    writer.option("path", path).format("parquet").saveAsTable(f"windrow_{unique}")
    return spark.table(f"windrow_{unique}")


def stage(
    spark: SparkSession,
    name: str,
    source: str,
    build: Callable[[], DataFrame],
    bucket_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    rows: Callable[[], int] | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The stage table ``name`` derived from ``source``, written on first use in this application."""
    key = (spark.sparkContext.applicationId, f"{name}@{source}")
    if key not in _STAGES:
        _STAGES[key] = materialize(build(), name, bucket_by, sort_by, rows() if rows else None, finish)
    return _STAGES[key]


def release(spark: SparkSession, source: str) -> None:
    """Forget the stage tables of ``source``: the next use writes them anew."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _STAGES if k[0] == app and k[1].endswith(f"@{source}")]:
        del _STAGES[key]
