"""Exact duplicates with two passes of Bloom filtering, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_WORDS, attach, bloom, fresh, maybe_in, only_with, shared, text_key


def repeated_keys(hashed: DataFrame, total: int) -> DataFrame:
    """First pass: the Bloom positions (two a key) that keys set at least twice, as a filter to broadcast.

    Positions are counted before they are packed. The filter has 16 positions a row, up to a fixed bound; beyond
    that more single rows count as possibly repeated, and the exact comparison behind it lets them go.
    """
    words = 64
    while words < FILTER_WORDS and words * 4 < total:
        words *= 2
    one = bloom_positions(F.col("h"), words)
    twice = hashed.select(F.explode(one).alias("p")).groupBy("p").count().where("count > 1")
    word = F.shiftright("p", 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    return twice.groupBy(word.alias("filter_word")).agg(F.bit_or(bit).alias("filter_bits")), words


def bloom_positions(h: Column, words: int) -> Column:
    """The two positions (word * 64 + bit) that ``maybe_in`` tests for a hash."""
    base = F.shiftleft(h.bitwiseAND(F.lit(words - 1).cast("bigint")), 6)
    low = F.lit(63).cast("bigint")
    return F.array_distinct(
        F.array(*[base.bitwiseOR(F.shiftrightunsigned(h, s).bitwiseAND(low)) for s in (40, 52)])
    )


def copy_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, int]:
    """(rows, groups, number of rows). ``rows``: doc_id, key (SHA-256 of the text, null as empty), ``maybe``: whether the
    first pass thinks the key repeated. ``groups``: key, keep_id, size of the keys that really repeat.

    Only rows with ``maybe`` are shuffled, as (key, doc_id); the others are known to be alone. A group of any size
    is combined before the shuffle.
    """
    hashed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text).alias("key"))
    hashed = shared(hashed.withColumn("h", F.xxhash64("key")), "hashed")
    total = hashed.count()
    filt, words = repeated_keys(hashed, total)
    rows = maybe_in(hashed, F.col("h"), shared(filt, "repeated"), "maybe", words).drop("h")
    groups = rows.where("maybe").groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows, shared(groups, "groups"), total


def exact_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical; null counts as empty. Of equal texts the row of the largest doc_id stays
    (a null doc_id is less than any other); rows that repeat it, doc_id and all, share its verdict.
    """
    rows, groups, total = copy_groups(docs, text, id_col)
    alone = rows.where("not maybe").select("doc_id", "key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("size"))
    several = attach(rows.where("maybe").select("doc_id", "key"), groups, "key", "size", total)
    several = several.select(
        "doc_id", "key", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("size")
    )
    both = alone.unionByName(several)
    return both.select(
        "doc_id", "keep_id", F.col("size").cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` in its own columns with one row of each group of equal texts: the largest doc_id, ties by the other columns.

    Texts that do not repeat pass straight through; of the others each task sends on one row a group. Columns that have no order
    (maps, variants) take no part in ties.
    """
    _, groups, _ = copy_groups(docs, text, id_col)
    rest = only_with(docs, text_key(text), groups, "key", "anti")
    key, row = fresh(docs, "copy_key"), fresh(docs, "copy_row")
    ties = [f"`{c}`" for c, kind in docs.dtypes if c not in (id_col, text) and not any(x in kind for x in ("map<", "variant", "void"))]
    order = F.struct(F.col(f"`{id_col}`"), *[F.col(c) for c in ties])
    again = only_with(docs, text_key(text), groups, "key").withColumn(key, text_key(text))
    one = again.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(row))
    return rest.unionByName(one.select(f"{row}.*"))
