"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import nan_to_null

# Fixed pattern of a corpus path: <group>/<entity>__<route>.parquet (a file or a folder of
# part files; a hive-style "name=" prefix is allowed).
CORPUS_PATH = r"/(?:[^/=]*=)?([^/=]+)/(?:[^/=]*=)?([^/=]+?)__([^/]+?)\.parquet(?:/|$)"


def corpus_keys(path: Column) -> list[Column]:
    """Keys from the file path, which is a URI: undo the percent escapes (a plus sign is itself)."""
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return [F.regexp_extract(path, CORPUS_PATH, i).alias(n) for i, n in enumerate(["grp", "entity", "route"], 1)]


def scan_corpus(spark: SparkSession, root: str, cols: list[str], schema: StructType | str | None = None) -> DataFrame:
    """All parquet files of a corpus, with the keys parsed from the path; only ``cols`` are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(f"{root}/*/*.parquet")
    return nan_to_null(df.select(*cols, *corpus_keys(F.col("_metadata.file_path"))))


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass over the data)."""
    return nan_to_null(spark.read.csv(path, header=True, schema=schema, escape='"'))


def scan_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines (or one JSON document per line) with a declared schema."""
    return nan_to_null(spark.read.json(path, schema=schema))


def scan_tolerant(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Skip corrupt files; of text formats also drop the corrupt records."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if fmt == "parquet":
        return nan_to_null(reader.schema(schema).parquet(path))
    reader = reader.option("mode", "DROPMALFORMED").schema(schema)
    return nan_to_null(reader.format(fmt).option("header", "true").load(path))


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    """Write parquet, csv (with header), json (lines) or orc."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.format(fmt).save(path)


def manifest(df: DataFrame, by: list[str], item: str, name: str = "items") -> DataFrame:
    """One JSON text per group: its keys and its sorted items (for split manifests of bounded groups)."""
    packed = df.groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias(name))
    return packed.select(F.to_json(F.struct(*by, name)).alias("value"))
