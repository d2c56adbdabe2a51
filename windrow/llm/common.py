"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import materialize

#: Words of 64 bits in a filter that is broadcast: a proven bound of about 20 MB. A fuller filter lets more
#: rows into the shuffle behind it; results stay the same.
FILTER_WORDS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, where the session has Spark's defaults: texts are long, and a task holds a batch several times."""
    for key, default, small in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")
    ):
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, small)


def shared(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts the lineage, survives lost executors."""
    return materialize(df, name)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have (in any case)."""
    have = {c.lower() for c in df.columns}
    while base in have:
        base += "_"
    return base


def text_key(text: str | Column) -> Column:
    """SHA-256 of a text (null: empty) as 32 bytes."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256))


def bloom(keys: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """A filter of at most ``words`` rows (word number, 64 bits) over a BIGINT hash column, two bits a key."""
    return keys.groupBy(_word(F.col(key), words).alias("filter_word")).agg(F.bit_or(_bits(F.col(key))).alias("filter_bits"))


def maybe_in(df: DataFrame, key: Column, filt: DataFrame, flag: str, words: int = FILTER_WORDS) -> DataFrame:
    """Add ``flag``: false only if the key is certainly not in the filter. No shuffle of ``df``."""
    h, w, b = (fresh(df, x) for x in ("filter_key", "filter_at", "filter_set"))
    f = filt.select(F.col("filter_word").alias(w), F.col("filter_bits").alias(b))
    out = df.withColumn(h, key).withColumn(w, _word(F.col(h), words)).join(F.broadcast(f), w, "left")
    bits = _bits(F.col(h))
    return out.withColumn(flag, F.coalesce(F.col(b).bitwiseAND(bits) == bits, F.lit(False))).drop(h, w, b)


def _word(h: Column, words: int) -> Column:
    return h.bitwiseAND(F.lit(words - 1).cast("bigint"))


def _bits(h: Column) -> Column:
    one = F.lit(1).cast("bigint")
    return F.expr("0L").bitwiseOR(_shift(one, F.shiftrightunsigned(h, 40))).bitwiseOR(_shift(one, F.shiftrightunsigned(h, 52)))


def _shift(one: Column, by: Column) -> Column:
    return F.call_function("shiftleft", one, by.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def only_with(df: DataFrame, key: Column, keys: DataFrame, name: str, how: str = "semi") -> DataFrame:
    """Rows whose key is among ``keys`` (how = semi) or not (anti), in the columns of ``df``.

    A filter of bounded size is broadcast first: rows that it excludes pass straight through (anti) or
    end there (semi), so that only rows with a possible match are shuffled. ``name`` is the key column of ``keys``.
    """
    k, flag = fresh(df, "row_key"), fresh(df, "row_maybe")
    filt = shared(bloom(keys.select(F.xxhash64(name).alias("h")), "h"), "filter")
    marked = maybe_in(df.withColumn(k, key), F.xxhash64(F.col(k)), filt, flag)
    right = keys.select(F.col(name).alias(k)).distinct()
    hit = marked.where(flag).join(right, k, "left_semi" if how == "semi" else "left_anti")
    out = hit if how == "semi" else marked.where(~F.col(flag)).unionByName(hit)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def attach(rows: DataFrame, per_key: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of a table with one row a key to rows of which any key may hold a large part.

    Keys with over a ten-thousandth of the ``total`` rows, of which there are fewer than 10,000, are
    broadcast; the others are shuffled, so no task gets a large key.
    """
    cols = [c for c in per_key.columns if c != key]
    flag = fresh(rows, "is_hot")
    hot = per_key.where(F.col(size) > total // 10_000 + 100).withColumn(flag, F.lit(True))
    both = rows.join(F.broadcast(hot), key, "left")
    done = both.where(F.col(flag)).drop(flag)
    rest = both.where(F.col(flag).isNull()).drop(flag, *cols).join(per_key, key, "left")
    return done.unionByName(rest)


def spread_join(rows: DataFrame, other: DataFrame, on: str, by: str, copies: int = 16) -> DataFrame:
    """Inner join of rows of which one key may hold a large part: each key's rows are dealt by a hash of ``by`` to ``copies`` parts, to each of which
    the rows of ``other`` are copied. ``other`` is small beside ``rows``, as it does not grow with the documents."""
    part = fresh(rows, "join_part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(by), F.lit(copies)))
    return dealt.join(other.withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint")))), [on, part]).drop(part)
