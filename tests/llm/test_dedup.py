import duckdb
import pytest
from plain import near_components
from pyspark.sql import functions as F

from windrow.llm import dedup, graph, neardup, queries


def test_exact_on_ugly_rows(ugly):
    got = {}
    for r in dedup.exact_duplicates(ugly).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert got[1] == [(2, 3, False)] * 2 and got[2] == [(2, 3, True)]
    assert got[4] == [(5, 4, False)] and got[5] == [(5, 4, True)] * 2  # null and empty are equal
    assert got[8] == [(9, 2, False)] and got[9] == [(9, 2, True)]
    assert sorted(got[None], key=str) == [(5, 4, False), (None, 1, True)]


def test_drop_exact_keeps_one_row_of_each_text(ugly):
    out = dedup.drop_exact_copies(ugly)
    assert out.columns == ugly.columns
    rows = out.collect()
    texts = [r.text or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in ugly.collect()})
    assert {r.doc_id for r in rows} == {2, 3, 5, 6, 7, None, 9, 10, 11, 12, 13, 14}


def test_one_text_in_most_rows(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    r = dedup.exact_duplicates(df).groupBy("group_size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("k"), F.max("keep_id")).collect()
    assert {tuple(x) for x in r} == {(1, 10_000, 10_000, 29_997), (20_000, 20_000, 1, 29_999)}


@pytest.mark.parametrize("size", [2, 5])
def test_near_equals_brute_force(spark, sf, size):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, size=size).collect()}
    texts = dict(duckdb.connect().sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    comp, sets = near_components(texts, size)
    assert {d: (r.component_id, r.n_shingles) for d, r in got.items()} == {d: (comp[d], len(sets[d])) for d in texts}


def test_a_cluster_over_many_blocks(spark):
    """Copies that mostly, but not all, link: more than one block, and a rest that meets every block."""
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(300):
        w = list(base)
        for j in range(1 + d % 7):
            w[(7 * d + 11 * j) % 60] = f"x{d}_{j}"
        texts[d] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    comp, _ = near_components(texts, 2)
    assert len(set(comp.values())) > 5
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == comp


def _template(n, shared, own):
    """Texts of one template: ``shared`` words in common, then ``own`` words of their own; every ninth is a near copy of the one before it."""
    base = [f"w{i}" for i in range(shared)]
    texts, last = {}, []
    for d in range(n):
        if d % 9 == 8:
            tail = last[:-1] + [f"y{d}"]
        else:
            tail = last = [f"x{d}_{j}" for j in range(own)]
        texts[d] = " ".join(base + tail)
    return texts


def test_a_template_of_many_unlike_texts(spark, monkeypatch):
    """Similarity about 0.5 for all: bands are shared, yet only near copies may link; blocks of any size agree with the plain search."""
    texts = _template(400, 40, 20)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    comp, _ = near_components(texts, 2)
    assert 300 < len(set(comp.values())) < 400
    for block in (16, 100_000):
        monkeypatch.setattr(neardup, "BAND_BLOCK", block)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == comp


def test_links_across_a_large_band(spark, monkeypatch):
    """What lies outside the main cluster of one band meets all of it, in blocks or by the join: the same clusters are connected."""
    from windrow.llm.neardup import _across

    sig = neardup.signatures(spark.createDataFrame(list(_template(200, 30, 4).items()), "doc_id bigint, text string"))
    at = sig.select(F.lit(1).cast("bigint").alias("band"), "set_id", "bits", F.when(F.col("doc_id") < 90, F.lit(b"m")).otherwise(F.col("set_id")).alias("root"))
    at = at.select("*", F.lit(b"m").alias("main"), F.lit(200).cast("bigint").alias("n"), F.lit(110).cast("bigint").alias("rest")).cache()
    root = {r.set_id: r.root for r in at.collect()}
    found = []
    for block in (16, 1024):
        monkeypatch.setattr(neardup, "BAND_BLOCK", block)
        links = spark.createDataFrame([(root[r.u], root[r.v]) for r in _across(at, 0.72).collect()], "u binary, v binary")
        found.append({bytes(r.id): bytes(r.root) for r in graph.components(links).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) < len(found[0])
    assert _across(at.limit(0), 0.72).count() == 0


def test_near_on_ugly_rows(ugly, nothing):
    got = {}
    for r in neardup.near_duplicates(ugly).collect():
        got.setdefault(r.doc_id, set()).add((r.component_id, r.n_shingles > 0))
    assert got[1] == got[2] == got[3] == {(1, True)}
    assert got[4] == {(4, False)} and got[5] == {(5, False)} and got[6] == {(6, False)}
    assert got[8] == got[9] == got[10] == {(8, True)} and got[12] == {(11, True)}
    out = neardup.one_of_each(ugly, size=2)
    assert out.columns == ugly.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 4, 5, 5, 6, 7, None, None, 8, 11, 13, 14], key=str)
    assert neardup.one_of_each(nothing).count() == 0 and dedup.drop_exact_copies(nothing).count() == 0 and dedup.exact_duplicates(nothing).count() == 0


def test_estimate_is_close(spark, sf):
    sig = neardup.signatures(spark.read.parquet(f"{sf}/documents.parquet")).where("n > 100").limit(60).drop("bands")
    both = sig.join(sig.toDF("d2", "k2", "n2", "s2", "b2"), F.col("doc_id") < F.col("d2"))
    assert both.select(F.max(F.abs(neardup.estimate("bits", "bits") - 1))).first()[0] == 0
    assert abs(both.where("set_id <> s2").select(F.avg(neardup.estimate("bits", "b2"))).first()[0]) < 0.2


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(200, 201)]
    df = spark.createDataFrame(chain, "u bigint, v bigint")
    got = {r.id: r.root for r in graph.components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    more = graph.joined(graph.components(df), spark.createDataFrame([(150, 40), (149, 7), (300, 301)], "u bigint, v bigint"))
    got = {r.id: r.root for r in more.collect()}
    assert {got[i] for i in (1, 40, 100, 149, 150)} == {1} and got[301] == 300 and got[200] == 200 and len(got) == 95
    assert graph.components(df.where("u < 0")).count() == 0


def test_stars_take_no_turn(spark, monkeypatch):
    """Edges that are stars around their least nodes are the components: they are written once, and gone through in no further turn."""
    writes = []
    monkeypatch.setattr(graph, "shared", lambda df, name, real=graph.shared: writes.append(name) or real(df, name))
    df = spark.createDataFrame([(i, i % 7) for i in range(7, 300)], "u bigint, v bigint")
    assert {r.id: r.root for r in graph.components(df).collect()} == {i: i % 7 for i in range(300)}
    assert writes == ["edges"]


def test_a_block_gives_back_stars(spark):
    """Links within a block are stars around the least id of each component, whatever pairs are near."""
    base = [f"w{i}" for i in range(40)]
    text = lambda d: " ".join(base[:d] + [f"x{d}"] + base[d:])
    rows = spark.createDataFrame([(d, text(d)) for d in range(2, 36)] + [(90, "one two three"), (91, "one two three")], "doc_id bigint, text string")
    ids = neardup.signatures(rows).select("doc_id", F.col("set_id").alias("id"))
    met = rows.join(ids, "doc_id").where("doc_id <> 91").select(F.lit(1).alias("root"), F.lit(0).alias("block"), "id", "text")
    links = [(bytes(r.u), bytes(r.v)) for r in neardup._decide(met, ["root", "block"], 80, 2).collect()]
    assert len(links) == 33 and len({v for _, v in links}) == 1 and len({u for u, _ in links}) == 33
    assert all(v < u for u, v in links)


def test_queries(spark, sf):
    for name in ("op2_exact_dedup", "op9_minhash_near_dedup"):
        df = queries.QUERIES[name](spark, sf)
        assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_words_hold_what_their_texts_need():
    """A worker's tables of powers follow the bytes it has seen, and give the same hashes whatever their size."""
    import numpy as np

    from windrow.llm import kernels

    words, text = kernels.space_words(), np.frombuffer(b"one two three two " * 50, np.uint8)
    off = np.array([0, len(text)])
    s, e, _ = words.find(off, text)
    first = words.hashes(text, s, e)
    assert len(words.power) <= 2 * len(text) and len(np.unique(first)) == 3
    long = np.concatenate([text] * 3)
    s, e, _ = words.find(np.array([0, len(long)]), long)
    assert (words.hashes(long, s, e) == np.concatenate([first] * 3)).all() and len(words.power) <= 2 * len(long)
