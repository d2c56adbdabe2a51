"""Benchmark passages in documents: a prefix-filtered set join of item windows and document shingles, verified word by word."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels
from .common import FILTER_WORDS, bloom, bounded_batches, only_with, shared, spread_join
from .neardup import row_key


def item_windows(items: DataFrame, window: int, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words, n, k, shingles): all runs of ``window`` words of every item, or the whole of a shorter one.

    ``shingles`` holds the hash of the k = min(size, n) words at each place; items without words have no window.
    """

    def run(batches):
        import pyarrow as pa

        finder = kernels.plain_words()
        for batch in batches:
            out = [[], [], [], [], []]
            ids = batch.column(0).to_pylist()
            for a, b, off, data in kernels.text_chunks(batch.column(1)):
                s, e, first = finder.find(off, data)
                h = finder.hashes(data, s, e)
                for i in range(b - a):
                    words = _spell(data, s, e, first[i], first[i + 1])
                    n = min(window, len(words))
                    k = min(size, n)
                    sh = kernels.shingles(h[first[i] : first[i + 1]], k).view(np.int64) if n else []
                    for j in range(len(words) - n + 1 if n else 0):
                        for c, v in zip(out, (ids[a + i], words[j : j + n], n, k, sh[j : j + n - k + 1])):
                            c.append(v)
            kinds = [batch.schema.field(0).type, pa.list_(pa.string()), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["item_id", "words", "n", "k", "shingles"])

    src = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["item_id"].dataType.simpleString()
    return src.mapInArrow(run, f"item_id {kind}, words array<string>, n int, k int, shingles array<bigint>")


def _spell(data: np.ndarray, s: np.ndarray, e: np.ndarray, a: int, b: int) -> list[str]:
    """Words a to b, A-Z lower-cased."""
    return [bytes(data[x:y]).lower().decode() for x, y in zip(s[a:b].tolist(), e[a:b].tolist())]


def _filter(keys: DataFrame) -> np.ndarray:
    """The filter of ``bloom`` as one array: of a fixed size, whatever the number of keys."""
    got = bloom(keys, "h").toArrow()
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[got["filter_word"].to_numpy()] = got["filter_bits"].to_numpy()
    return bits.view(np.uint64)


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    m = (one << ((h >> np.uint64(40)) & low)) | (one << ((h >> np.uint64(52)) & low))
    return bits[h & np.uint64(len(bits) - 1)] & m == m


def found_items(docs: DataFrame, items: DataFrame, window: int = 13, size: int = 3, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, hits). ``rows``: doc_id, row_key, n_words of every document; ``hits``: row_key, start, n, words, distinct: where
    a document holds a whole item window.

    Shingles are ordered by rarity, counted over all documents. A window is contained only if all its shingles are, so
    its necessary prefix is the one rarest. Documents yield the places of such shingles with the words around; those
    join with the windows on the shingle, must leave room for the window before and behind (length and
    position), and then equal it word for word. A shingle or passage that many documents share is dealt to several tasks. Which shingles are looked for is told to tasks by a filter of fixed size; what
    it lets pass in vain ends in the join. Null texts have no words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    wins = shared(item_windows(items, window, size).drop("item_id").groupBy("words", "n", "k").agg(F.first("shingles").alias("shingles")), "windows")
    sizes = sorted(r.k for r in wins.select("k").distinct().collect())  # at most ``size``
    each = wins.select("words", "n", "k", F.posexplode("shingles").alias("place", "h"))
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(text).alias("row_key"), F.col(text).cast("string").alias("text"))

    wanted = spark.sparkContext.broadcast(_filter(each.select("h")))

    def count(batches):
        import pyarrow as pa

        finder, bits = kernels.plain_words(), wanted.value
        for batch in batches:
            got = [np.zeros(0, np.uint64)]
            for _, _, off, data in kernels.text_chunks(batch.column(0)):
                h = finder.hashes(data, *finder.find(off, data)[:2])
                for k in sizes:
                    sh = kernels.shingles(h, k)
                    got.append(sh[_passes(bits, sh)])
            h, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    # A shingle over the end of one text and the start of the next may be counted too: rarity only orders.
    often = src.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("often"))
    rare = each.join(often, "h").groupBy("words", "n", "k").agg(
        F.min_by(F.struct("h", "place"), F.struct("often", "place")).alias("best"), F.count(F.lit(1)).alias("there")
    )
    rare = rare.where(F.col("there") == F.col("n") - F.col("k") + 1)  # a shingle that no document has rules the window out
    rare = shared(rare.select("words", F.col("n").alias("size"), "best.h", "best.place"), "prefix")
    prefix = spark.sparkContext.broadcast(_filter(rare.select("h")))

    def seek(batches):
        import pyarrow as pa

        finder, bits = kernels.plain_words(), prefix.value
        kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            hits, words = [], []
            for a, b, off, data in kernels.text_chunks(batch.column(2)):
                s, e, first = finder.find(off, data)
                h = finder.hashes(data, s, e)
                words.append(np.diff(first))
                mine = [[] for _ in range(b - a)]
                for k in sizes:
                    sh = kernels.shingles(h, k)
                    places = np.flatnonzero(_passes(bits, sh))
                    for p, i in zip(places.tolist(), (np.searchsorted(first, places, side="right") - 1).tolist()):
                        lo, hi = max(int(first[i]), p - window + k), min(int(first[i + 1]), p + window)
                        if p + k <= first[i + 1]:
                            mine[i].append({"h": int(sh[p].view(np.int64)), "at": p - int(first[i]), "first": lo - int(first[i]), "words": _spell(data, s, e, lo, hi)})
                hits += mine
            if words:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.concatenate(words)), pa.array(hits, kind)], names=["doc_id", "row_key", "n_words", "hits"]
                )

    schema = "doc_id bigint, row_key bigint, n_words bigint, hits array<struct<h: bigint, at: bigint, first: bigint, words: array<string>>>"
    rows = shared(src.mapInArrow(seek, schema), "places")
    place = rows.select("row_key", "n_words", F.explode("hits").alias("x")).select("row_key", "n_words", "x.h", "x.at", "x.first", F.col("x.words").alias("near"))
    start = F.col("at") - F.col("place")
    fits = (start >= F.col("first")) & (start + F.col("size") <= F.col("n_words"))
    same = F.slice("near", (start - F.col("first") + 1).cast("int"), F.col("size")) == F.col("words")
    hits = spread_join(place, rare, "h", "row_key").where(fits).where(F.when(fits, same)).select("row_key", start.alias("start"), F.col("size").alias("n"), "words").distinct()
    return rows.drop("hits"), shared(hits, "hits")


def covered(hits: DataFrame) -> DataFrame:
    """(row_key, n_hit): words under any hit, each once."""
    w = Window.partitionBy("row_key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    new = end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(w), F.lit(0)))
    return hits.withColumn("new", F.greatest(new, F.lit(0))).groupBy("row_key").agg(F.sum("new").alias("n_hit"))


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated (a twentieth of the words is hit).

    Rows equal in doc_id and text share their figures. Items of equal words are all reported.
    """
    rows, hits = found_items(docs, items, window)
    holds = item_windows(items, window, 3).select(F.col("item_id").cast("string").alias("item_id"), "words").distinct()
    names = spread_join(hits.select("row_key", "words").distinct(), holds, "words", "row_key").groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    per = covered(hits).join(names, "row_key", "left")
    out = rows.join(per, "row_key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("bigint"))
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), is_contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` in its own columns without contaminated rows; the others pass without a shuffle."""
    rows, hits = found_items(docs, items, window)
    bad = rows.join(covered(hits), "row_key").where(is_contaminated()).select("row_key").distinct()
    return only_with(docs, row_key(), shared(bad, "contaminated"), "row_key", "anti")
