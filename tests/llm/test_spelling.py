import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from plain import LOW
from pyspark.sql import functions as F

from windrow.llm import spelling


def plain_counts(rows, shortest=6, least=5, every=199):
    c = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (n[w], len(near), best if best is not None and n[best] >= 5 * n[w] else None)

    def root(w):
        return w if out[w][2] is None else root(out[w][2])

    return {(w, a, b, f, n.get(f), root(w)) for w, (a, b, f) in out.items()}


def found(df):
    got = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_crc_equals_zlib():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    s = rng.integers(0, 4000, 300)
    e = s + rng.integers(0, 120, 300)
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in range(300)], np.uint32)
    want = [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(s, e))]
    assert spelling.crc_of(heads, data, s, e).tolist() == want


@pytest.mark.parametrize("every", [199, 3, 0])
def test_counts_equal_plain(spark, ugly, every):
    more = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("concat('Éclairage abcdef', char(97 + id % 26), ' Straßen-abcdefg x ÿÿÿÿÿÿ × ', repeat('ab', 500))").alias("text"))
    df = ugly.select("doc_id", "text").unionByName(more)
    got = {r.word: r.n for r in spelling.word_counts(df, least=2, every=every).collect()}
    assert got == plain_counts([tuple(r) for r in df.collect()], least=2, every=every) and len(got) > 20


def test_variants_of_random_words(spark):
    """Few letters, so that repeats, runs of equal letters and several near words are common."""
    rng = random.Random(3)
    n = {}
    while len(n) < 1500:
        w = "".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 7, 8, 9])))
        n[w] = rng.choice([5, 5, 6, 25, 30, 125, 700, 3500])
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert found(df) == plain_variants(n)


def test_pairs_come_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abaaaa", "baaaaaa", "aaabaaa", "zaaaaaa", "aaaaaaz"]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    got = [frozenset((r.word, r.other)) for r in spelling.near_pairs(df).collect()]
    assert sorted(map(sorted, got)) == sorted(sorted((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b))


def test_a_chain_of_forms_and_a_hot_chunk(spark):
    n = {"abcdefgh"[:6] + "x" * i: 5 ** (i + 1) for i in range(7)}
    n |= {f"hotchunkhotchunk{chr(97 + i)}{chr(97 + j)}": 5 + i for i in range(26) for j in range(26)}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = found(df)
    assert got == plain_variants(n)
    assert {r[5] for r in got if r[0].startswith("abcdef")} == {"abcdefxxxxxx"}


def test_nothing(spark, nothing, ugly):
    assert spelling.variants(spelling.word_counts(nothing)).count() == 0
    assert spelling.variants(spelling.word_counts(ugly.where("text IS NULL"))).count() == 0
