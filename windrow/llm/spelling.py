"""Spelling variants: words one edit apart by asymmetric q-chunks, and the usual form that each word leads to."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import bounded_batches, shared

#: Of a word's hash numbers, one in so many loses a letter (see ``word_counts``).
EVERY = 199
BLOCK = 8 << 20


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


def crc_of(heads: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, carried on from the crc32 ``heads`` of what goes before it."""
    table, state = _crc_table(), heads ^ np.uint32(0xFFFFFFFF)
    size = e - s
    order = np.argsort(-size, kind="stable")
    s, size, state = s[order], size[order], state[order]
    long = int((size > 64).sum())
    for i in range(long):
        state[i] = zlib.crc32(data[s[i] : s[i] + size[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(size[long]) if long < len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))  # those longer than j
        part = state[long:n]
        state[long:n] = table[(part ^ data[s[long:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _runs(shortest: int, every: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        letter, low = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
        letter[65:91] = letter[97:123] = letter[0xC3] = True  # 0xC3 begins U+00C0 to U+00FF
        low[65:91] += 32
        for ids, texts in kernels.gathered(batches, 1, BLOCK):
            heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
            for a, b, off, data in kernels.text_chunks(texts, BLOCK):
                data = low[data]
                inside = letter[data]
                inside[1:] |= data[:-1] == 0xC3
                s, e = kernels.masked_runs(inside, off)
                at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                points = at[e] - at[s]
                keep = points >= shortest
                s, e, points = s[keep], e[keep], points[keep]
                h = crc_of(heads[a + np.searchsorted(off, s, side="right") - 1], data, s, e)
                cut = h % np.uint32(every) == 0 if every else np.zeros(len(s), bool)
                words = [kernels.string_array(data, s[~cut], e[~cut])]
                if cut.any():
                    less = []
                    for x, y, k, n in zip(s[cut], e[cut], h[cut], points[cut]):
                        word, k = data[x:y].tobytes().decode(), int(k) % int(n)
                        if n > shortest:
                            less.append(word[:k] + word[k + 1 :])
                    words.append(pa.array(less, pa.large_string()))
                n = pc.value_counts(pa.concat_arrays(words))
                yield pa.RecordBatch.from_arrays([n.field("values"), n.field("counts")], names=["word", "n"])

    return run


def word_counts(
    docs: DataFrame, shortest: int = 6, least: int = 5, every: int = EVERY, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(word, n): the words of ``shortest`` code points or more that occur ``least`` times in all documents.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where ``every`` divides the crc32 of "<id>:<run>", the run
    loses the code point at crc32 mod length (0: never); a null id counts as empty. Null texts have no words. Counts are combined in tasks first.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    part = src.mapInArrow(_runs(shortest, every), "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cuts(m: Column) -> list[Column]:
    """Where the two chunks of a word of m code points, and their halves, begin and end."""
    half = F.floor(m / 2)
    return [c.cast("int") for c in (F.lit(0), F.floor(half / 2), half, half + F.floor((m - half) / 2), m)]


def _without(word: Column, a: Column, b: Column, part: int, m: Column) -> Column:
    """The key and the rest of a word when the edit lies in code points a to b: all but those must be equal."""
    left, right = F.substring(word, F.lit(1), a), F.substring(word, b + 1, F.char_length(word))
    return F.struct(m.cast("int").alias("m"), F.lit(part).alias("part"), left.alias("left"), right.alias("right"), F.substring(word, a + 1, b - a).alias("rest"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): the pairs of distinct ``words`` (word, n) that differ by one inserted, deleted or replaced code point.

    Each pair once, the shorter word first (of equal length, the smaller). That word contributes its two halves as chunks; the other one
    all grams that such chunks can be, of words as long or shorter by one. One edit leaves a chunk as it is: in place if the edit comes after it, moved
    by the difference in length, one at most, if before. The rest, which holds the edit, is cut and joined in the same way, so that the
    words of a frequent chunk are no group. What is left over must be one edit apart. An inserted letter may be found in two neighbouring
    rests, as within a run of equal letters: the first counts.
    """
    size = F.char_length("word")
    cuts = _cuts(size)
    chunks = F.array(*[_without(F.col("word"), cuts[i], cuts[i + 1], i, size) for i in range(4)])
    short = words.select(F.col("word"), "n", F.explode(chunks).alias("x")).select("word", "n", "x.*")
    grams = []
    for d in (0, 1):
        m = size - d
        cuts = _cuts(m)
        grams += [_without(F.col("word"), cuts[i], cuts[i + 1] + d, i, m) for i in range(4)]
    long = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.explode(F.array(*grams)).alias("x"))
    long = long.select("other", "other_n", "x.m", "x.part", "x.left", "x.right", F.col("x.rest").alias("other_rest"))
    d = F.char_length("other_rest") - F.char_length("rest")
    one = F.levenshtein("rest", "other_rest", 1) == 1
    once = F.when(d == 0, F.col("word") < F.col("other")).otherwise((F.col("part") == 0) | (F.substring("other_rest", F.lit(2), F.char_length("rest")) != F.col("rest")))
    return short.join(long, ["m", "part", "left", "right"]).where(one & once).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``forms`` (word, form; a word never returns to itself) lead to in the end. Steps double each turn."""
    cur = shared(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = cur.join(cur.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = shared(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        cur = step.select("word", "root")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """For each of ``words`` (word, n; distinct): word, n, n_near, form, form_n, root.

    ``n_near`` words are one edit away. The one of largest n (ties: the smallest in code-point order) is the word's form, if it
    occurs ``times`` as often as the word or more; else form and form_n are null. ``root``: the end of the forms that begin at the word, itself without one.
    As each form occurs oftener than its word, there is an end.
    """
    words = shared(words, "words")
    pairs = near_pairs(words)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(f"{b}_n" if b == "other" else "n").alias("other_n"))
    both = pairs.select(F.explode(F.array(side("word", "other"), side("other", "word"))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("b"))
    found = words.join(near, "word", "left").withColumn("has", F.coalesce(-F.col("b.less") >= times * F.col("n"), F.lit(False)))
    found = shared(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("b.other")).alias("form"),
        F.when(F.col("has"), -F.col("b.less")).alias("form_n"),
    ), "variants")
    end = roots(found.where("form IS NOT NULL"))
    return found.join(end, "word", "left").withColumn("root", F.coalesce("root", "word"))
