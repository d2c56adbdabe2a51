"""Phrases of words that occur together: counts lie in streams sorted by their last and by their first words, joined in lockstep."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import exact_rank
from . import kernels
from .common import bounded_batches, shared
from .decontam import _filter, _passes

#: The bytes at which texts are cut into pieces, and pieces into words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
UNKNOWN = "und"
#: Bytes of text whose phrases a task counts before it sends them on.
BLOCK = 1 << 20


def _finder() -> tuple[np.ndarray, kernels.Words]:
    """The kind of each byte (0 of a word, 1 between words, 2 between pieces), and what finds and hashes words."""
    kind = np.zeros(256, np.uint8)
    kind[list(BLANKS)], kind[list(BREAKS)] = 1, 2
    return kind, kernels.Words(kind == 0)


def _salts(names) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in names.to_pylist()], np.uint64) << np.uint64(17)


def _word_hashes(finder: kernels.Words, words) -> np.ndarray:
    """Hashes of the strings of an Arrow array."""
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return finder.hashes(np.frombuffer(words.buffers()[2] or b"", np.uint8), off[:-1], off[1:])


def _hashed(batches):
    """(lang, phrase) to h, the hash of a phrase of a language that the filter holds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    _, finder = _finder()
    for batch in batches:
        if batch.num_rows:
            names = batch.column(0).dictionary_encode()
            words = pc.split_pattern(batch.column(1).cast(pa.large_string()), " ")
            size = np.diff(np.asarray(words.offsets))
            each = words.flatten().dictionary_encode()
            h = _word_hashes(finder, each.dictionary)[each.indices.to_numpy()]
            h = kernels.shingles(kernels.mix(h ^ np.repeat(_salts(names.dictionary)[names.indices.to_numpy()], size)), int(size[0]))
            yield pa.RecordBatch.from_arrays([pa.array(h[np.cumsum(size) - size].view(np.int64))], names=["h"])


def _distinct(codes: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of codes under ``sizes``, and how often each occurs."""
    key, room = codes[0].astype(np.int64), sizes[0]
    for c, n in zip(codes[1:], sizes[1:]):
        if room * max(1, n) >= 1 << 62:  # too many columns for one number: rows by their places
            _, at, f = np.unique(np.stack(codes, 1), axis=0, return_index=True, return_counts=True)
            return [c[at] for c in codes], f
        key, room = key * n + c, room * max(1, n)
    key, f = np.unique(key, return_counts=True)
    out = []
    for n in sizes[:0:-1]:
        key, c = np.divmod(key, max(1, n))
        out.append(c)
    return [key, *out[::-1]], f


def _tally(n: int, usual):
    """Counts of the n-word phrases of which both parts of n - 1 words pass the filter ``usual`` (n = 1: of all words).

    Yields lang, phrase (words with one space between), f. For n = 1 a row without phrase has the number of words of the language.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kind, finder = _finder()
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        for langs, texts in kernels.gathered(batches, 1, BLOCK):
            names = langs.dictionary_encode()
            of_row, salt = names.indices.to_numpy(), _salts(names.dictionary)
            for a, b, off, data in kernels.text_chunks(texts, BLOCK):
                data = low[data]
                s, e, first = finder.find(off, data)
                size = len(s) - n + 1
                if size < 1:
                    continue
                row = np.repeat(np.arange(a, b), np.diff(first))
                piece = np.cumsum(kind[data] == 2, dtype=np.int32)[s]
                linked = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
                lang = of_row[row]
                words = kernels.string_array(data, s, e).dictionary_encode()
                code, spelled = words.indices.to_numpy(), words.dictionary
                whole = np.ones(size, bool)
                for j in range(n - 1):
                    whole &= linked[j : j + size]
                if n > 1:
                    h = kernels.mix(_word_hashes(finder, spelled)[code] ^ salt[lang])
                    good = _passes(usual.value, kernels.shingles(h, n - 1))
                    whole &= good[:size] & good[1 : size + 1]
                    h = good = None
                at = np.flatnonzero(whole)
                keys, parts = [lang, *[code] * n], [at, *[at + j for j in range(n)]]
                own, f = _distinct([k[x] for k, x in zip(keys, parts)], [len(names.dictionary)] + [len(spelled)] * n)
                phrase = [spelled.take(pa.array(c)) for c in own[1:]]
                phrase = phrase[0] if n == 1 else pc.binary_join_element_wise(*phrase, pa.scalar(" ", pa.large_string()))
                cols = [names.dictionary.take(pa.array(own[0])), phrase.cast(pa.large_string()), pa.array(f.astype(np.int64))]
                if n == 1:
                    who, total = np.unique(lang, return_counts=True)
                    more = [names.dictionary.take(pa.array(who)), pa.nulls(len(who), pa.large_string()), pa.array(total.astype(np.int64))]
                    cols = [pa.concat_arrays([x.cast(y.type), y]) for x, y in zip(cols, more)]
                yield from pa.table(dict(zip(("lang", "phrase", "f"), cols))).to_batches(max_chunksize=1 << 16)

    return run


def counts(docs: DataFrame, longest: int, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(stream, totals): lang, words, f of every phrase of up to ``longest`` words that occurs ``least`` times; lang, n of all words.

    A phrase occurs no oftener than its parts, so phrases of n words are counted only where both parts of n - 1 words pass a
    filter of fixed size, made of the frequent ones; what it lets pass in vain is counted too and goes with the rare ones.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    usual, streams, totals = None, [], None
    for n in range(1, longest + 1):
        # A task sums up block by block, which leaves few rows to add up again before the shuffle.
        part = src.mapInArrow(_tally(n, usual), "lang string, phrase string, f bigint").repartition("lang", "phrase")
        total = part.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        total = shared(total.where(F.col("phrase").isNull() | (F.col("f") >= least)), f"phrases_{n}")
        known = total.where("phrase IS NOT NULL")
        if n == 1:
            totals = total.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
        streams.append(known.select("lang", F.split("phrase", " ").alias("words"), "f"))
        if n < longest:
            usual = spark.sparkContext.broadcast(_filter(known.select("lang", "phrase").mapInArrow(_hashed, "h bigint")))
    out = streams[0]
    for x in streams[1:]:
        out = out.unionByName(x)
    return out, totals


def lockstep(stream: DataFrame, longest: int, by_end: bool, name: str) -> DataFrame:
    """``stream`` (lang, words, f, ...) with the array ``name``: the counts of each phrase's first 1, 2, ... longest - 1 words.

    With ``by_end`` of its last words. The stream is sorted so that a phrase comes right after its own beginnings, shorter ones
    first, and is gone through once: of each length the last count seen belongs to the phrase at hand. It is cut into ranges of
    like size wherever a cut falls, so a word that begins a large part of all phrases is no group; each range starts with the
    counts of its first phrase's beginnings.
    """
    parts = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.reverse("words") if by_end else F.col("words")
    cut = stream.withColumn("at", key).repartitionByRange(parts, "lang", "at").withColumn("part", F.spark_partition_id())
    cut = shared(cut, "stream")
    first = cut.groupBy("part").agg(F.min(F.struct("lang", "at")).alias("x"))
    begins = first.select("part", "x.lang", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(longest - 1)), lambda k: F.slice("x.at", F.lit(1), k))).alias("k", "at"))
    carried = begins.join(cut.select("lang", "at", "f"), ["lang", "at"]).groupBy("part").agg(
        *[F.max(F.when(F.col("k") == k - 1, F.col("f"))).alias(f"before_{k}") for k in range(1, longest)]
    )
    w = Window.partitionBy("part").orderBy("lang", "at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.size("at")
    seen = [F.coalesce(F.last(F.when(size == k, F.col("f")), ignorenulls=True).over(w), F.col(f"before_{k}")) for k in range(1, longest)]
    out = cut.join(carried, "part").withColumn(name, F.array(*seen))
    return shared(out.select(*stream.columns, name), "joined")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts up to 10^15."""
    big = lambda c: c.cast("decimal(15,0)")
    top, low = (big(a) * big(a)) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right)
    return F.call_function("div", top, low)


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int | None = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Each language's phrases of 2 to ``longest`` words by score: lang, rank, phrase, a, l, r, n, score.

    A phrase that occurs a times, cut after k words into parts that occur l and r times, scores floor(10^6 a a / (l r)); its
    lowest cut counts, ties to the smallest k. Phrases with a < ``least`` are no candidates; nor are those whose words lie in a longer
    candidate that occurs ``inside`` percent as often or more (it is enough to look at those longer by one word, as a longer one
    holds such a one that occurs no less). Order: score, a (both falling), phrase; ``top`` of a language stay, all if None.
    Null texts are empty, null languages are one (``und``); rows that repeat count again. No text, no rows.
    """
    stream, totals = counts(docs, longest, least, text, lang)
    stream = lockstep(lockstep(stream, longest, True, "ends"), longest, False, "begins")
    rows = stream.where(F.size("words") > 1).withColumn("m", F.size("words"))
    cuts = [
        F.when(F.col("m") > k, F.struct(score(F.col("f"), F.col("begins")[k - 1], F.get("ends", F.col("m") - k - 1)).alias("score"), F.lit(k).alias("k"),
               F.col("begins")[k - 1].alias("l"), F.get("ends", F.col("m") - k - 1).alias("r")))
        for k in range(1, longest)
    ]
    longer = rows.where("m > 2")
    held = [
        longer.where(100 * F.col("f") >= inside * F.get(side, F.col("m") - 2)).select("lang", F.slice("words", start, F.col("m") - 1).alias("words"))
        for side, start in (("begins", F.lit(1)), ("ends", F.lit(2)))
    ]
    free = rows.join(held[0].unionByName(held[1]).distinct(), ["lang", "words"], "left_anti")
    best = free.withColumn("b", F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull())))
    out = best.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "b.l", "b.r", "b.score")
    out = exact_rank(out.withColumn("less", -F.col("a")), ["lang"], "score", ["less", "phrase"], descending=True, name="rank")
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
