import re
from collections import Counter, defaultdict

import pytest
from plain import LOW
from pyspark.sql import functions as F

from windrow.llm import phrases


def plain(rows, longest=3, least=10, inside=50, top=2000):
    """rows: (lang, text) -> set of (lang, rank, phrase, a, l, r, n, score), from the definition."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = {q[i : i + m] for q, b in cand.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= inside * c[q[i : i + m]]}
        best = []
        for p, a in cand.items():
            if p not in held:
                s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.add((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return out


def found(df, **kw):
    got = [tuple(r) for r in phrases.collocations(df, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("longest,least", [(2, 3), (3, 2), (4, 2)])
def test_equals_plain(spark, sf, longest, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert found(docs, longest=longest, least=least, top=None) == plain(rows, longest, least, top=None)


def test_ranges_may_end_anywhere(spark):
    """One word begins and ends nearly all phrases, and there are more ranges than phrases of some kinds: counts are carried over their ends."""
    texts = [(f"the w{i % 40} of the w{i % 7}, The the the w{i % 3}\x01 the",) for i in range(400)]
    df = spark.createDataFrame(texts, "text string").withColumn("lang", F.lit("en"))
    want = plain([("en", t) for (t,) in texts], 4, 5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert found(df, longest=4, least=5) == want and len(want) > 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_ugly_rows(ugly, nothing):
    rows = [(r.lang, r.text) for r in ugly.select("lang", "text").collect()]
    assert found(ugly, least=2) == plain(rows, least=2)
    assert found(nothing) == set() and phrases.collocations(nothing).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found(ugly.where("text IS NULL")) == set()


def test_null_language_pieces_and_overlaps(spark):
    rows = [(None, "a b\tc. A  B c\nd a b"), ("und", "x x x x"), ("de", "a b;c a b"), (None, "é-ü straße é-ü straße")] * 5
    df = spark.createDataFrame(rows, "lang string, text string")
    got = found(df, least=5)
    assert got == plain(rows, least=5) and {r[0] for r in got} == {"und", "de"}
    assert {r[2] for r in got if "x" in r[2]} == {"x x x"}  # it lies in most of "x x"


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 3 * 10**12 + 1, 10**12 + 9), (999_999_999_999_989, 999_999_999_999_990, 999_999_999_999_999), (10, 10, 10), (11, 10**15 - 1, 10**15 - 1)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in rows]
