import duckdb
import pytest
from compare import check
from plain import contamination, digest, item_windows, personal, secrets
from pyspark.sql import functions as F

from windrow.llm import decontam, licenses, pii, queries
from windrow.llm import secrets as scan


def texts_of(sf):
    return dict(duckdb.connect().sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, sf, name):
    n, result, _, diff = check(spark, duck, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert result == "ok", (result, diff)
    assert n > 0


def test_contamination_of_ugly_rows(spark, ugly, nothing):
    items = [(1, "the cat sat on the mat and the dog lay by the door of the old house"), (2, "One!"), (3, None), (4, ""), (5, "One!"), (6, "not here at all, nor anywhere else in any of these rows of words")]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    wins = item_windows(items)
    want = sorted((str(r.doc_id), *contamination(r.text, wins)) for r in ugly.select("doc_id", "text").collect())
    got = decontam.contamination(ugly, df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, {int(i) for i in r.item_ids}) for r in got) == want
    out = decontam.drop_contaminated(ugly, df)
    assert out.columns == ugly.columns
    bad = {r.doc_id for r in got if r.contaminated}
    assert bad == {1, 2, 3, 11, 12, 13}
    assert sorted((str(r.doc_id) for r in out.collect())) == sorted(str(r.doc_id) for r in ugly.collect() if r.doc_id not in bad)
    assert decontam.contamination(nothing, df).count() == 0
    assert not [r for r in decontam.contamination(ugly, df.where("item_id < 0")).collect() if r.contaminated]


def test_passages_over_the_ends(spark):
    """Windows do not reach over texts, overlap without counting twice, and are found at both ends."""
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, " ".join(f"w{i}" for i in range(10))), (2, " ".join(f"w{i}" for i in range(10, 20))), (3, item), (4, "x " + item + " y"), (5, item + " " + item), (6, " ".join(f"w{i}" for i in range(13)))]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, item)], "item_id bigint, text string"))
    assert {r.doc_id: r.n_hit for r in got.collect()} == {1: 0, 2: 0, 3: 20, 4: 20, 5: 40, 6: 13}


def test_secrets_equal_a_plain_scan(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op4_secret_scan"](spark, sf).collect()}
    for d, t in texts_of(sf).items():
        assert got[d].base_sha256 == digest(secrets(t)), d


def test_secrets_of_hand_made_rows(spark, nothing):
    rows = [
        (1, 'PassWord: "abcdefghijkl" token=short api_key = AAAABBBBCCCC'), (2, "AKIA" + "Z" * 14 + " AKIAshort"), (3, "0123456789abcdef0"), (4, None), (5, ""),
        (6, "éé secret='" + "x" * 12 + "'"), (6, "éé secret='" + "x" * 12 + "'"), (7, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop"), (None, "xoxb-1234567890-abc"), (8, "a" * 200_000 + " passwd:zzzzzzzzzzzz"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    base = tuple(r.kind for r in scan.BASE)
    got = [(r.doc_id, [tuple(s) for s in r.spans if s.kind in base]) for r in scan.secret_spans(df).collect()]
    want = [(d, [(a, rank, e, k) for a, rank, k, e in secrets(t)]) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    more = {r.doc_id: {s.kind for s in r.spans} for r in scan.secret_spans(df).collect()}
    assert more[None] == {"chat_token"} and scan.secret_spans(nothing).count() == 0


def test_trigram_queries():
    q = scan.trigram_query
    assert q("ab") is None and q("[0-9a-f]{16,}") is None and q("(abc)?") is None
    assert q("abcd") == [frozenset({"abc", "bcd"})]
    assert q("xab(c|de)f") == [frozenset({"xab", "abc", "bcf"}), frozenset({"xab", "abd", "bde", "def"})] or len(q("xab(c|de)f")) == 2
    assert all(any(a <= {t[i : i + 3] for i in range(len(t) - 2)} for a in q(scan.BASE[0].pattern)) for t in ('apikey="', "password", "api_key:"))


def test_personal_data_equals_a_plain_scan(spark, sf, ugly, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op6_pii"](spark, sf).collect()}
    for d, t in texts_of(sf).items():
        assert got[d].base_sha256 == digest(personal(t)), d
    field = pii.train(docs)
    spans = lambda t: [x for x in personal(t)]
    odd = ugly.unionByName(ugly.limit(1).withColumn("text", F.lit("a.b@c.de +1 (234) 555-6789 1.2.3.4 or 4845168114407329"))).cache()
    texts = {(str(r.doc_id), str(spans(r.text))) for r in odd.select("doc_id", "text").collect()}
    base = [[(x.start, x["rank"], x.kind, x.end) for x in r.spans if not x.kind.startswith("crf_")] for r in pii.personal_data(odd, field).collect()]
    assert {(str(r.doc_id), str(b)) for r, b in zip(pii.personal_data(odd, field).collect(), base)} == texts and sum(map(len, base)) == 4
    assert pii.personal_data(nothing, None).count() == 0 and pii.train(nothing) is None


def test_rules_in_linear_time_find_the_same():
    import random
    import time

    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("ab1@..-+ 2(9_") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == [(a, rank, e) for a, rank, _, e in personal(t)], t
    t0 = time.time()
    long = "a" * 300_000 + "@ " + "7" * 300_000 + " 000000255.1.1.1 " + "9" * 6000 + ".1.1.1 x@y.zz"
    assert [long[a:e] for a, _, e in pii.base_spans(long)] == ["000000255.1.1.1", "x@y.zz"]
    assert time.time() - t0 < 5


def test_licences_inherit_from_the_nearest_directory(spark, nothing):
    rows = [
        (1, "a/LICENSE", licenses.TEMPLATES["mit"]), (2, "a/x/y.py", "code"), (3, "a/x/z/LICENSE", "Licensed under the Apache License, Version 2.0."), (4, "a/x/z/w/q.py", None),
        (5, "a/x/z/own.py", "line\nThis work is licensed under the GNU General Public License, version 3.0.\n" + "word " * 100), (6, "b/c.py", ""), (7, None, "text"), (8, "/root.py", "x"),
        (9, "a/x/z/p.py", "text"), (2, "a/x/y.py", "code"),
    ]
    got = {r.file_id: (r.licence, r.basis, r.from_dir) for r in licenses.licences(spark.createDataFrame(rows, "file_id bigint, path string, text string")).collect()}
    assert got[1][:2] == ("mit", "notice") and got[2] == ("mit", "inherited", "a") and got[3][0] == "apache-2.0" and got[4] == ("apache-2.0", "inherited", "a/x/z")
    assert got[5][:2] == ("gpl-3.0", "notice") and got[9][0] == "apache-2.0" and got[6] == got[7] == got[8] == (None, None, None)
    empty = nothing.selectExpr("doc_id AS file_id", "source AS path", "text")
    assert licenses.licences(empty).count() == 0


def test_licences_in_a_tree_of_several_depths(spark):
    """The query's own paths: files above lend their licence to folders below; ties go to the first name; clashing columns and long texts do no harm."""
    notice = licenses.TEMPLATES
    text = {49: notice["mit"], 7: notice["apache-2.0"], 14: notice["apache-2.0"], 1001: notice["cc0-1.0"], 1050: "x " * 200_000 + "\n" + notice["gpl-3.0"]}
    rows = [(i, text.get(i, f"words of file {i}")) for i in range(1, 1100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.when(F.col("doc_id") < 1090, "web"))
    files = df.select(F.col("doc_id").alias("file_id"), queries.source_path().alias("path"), "text").withColumns({c: F.lit(c) for c in ("says", "dir", "key", "licence", "n", "above", "n_words")})
    got = {r.file_id: r for r in licenses.licences(files).collect()}
    assert len(got) == 1099 and got[49].basis == got[7].basis == got[1050].basis == "notice" and got[1050].licence == "gpl-3.0"
    assert (got[8].licence, got[8].basis, got[8].from_dir) == ("apache-2.0", "inherited", "web/0")  # two files at web/0, one folder above its own
    assert (got[21].licence, got[21].from_dir) == ("apache-2.0", "web/0") and (got[98].licence, got[98].from_dir) == ("mit", "web")
    assert (got[1002].licence, got[1002].from_dir) == ("cc0-1.0", "web/1") and (got[1060].licence, got[1060].from_dir) == ("cc0-1.0", "web/1")
    assert got[1095].licence is None


def test_a_passage_in_a_third_of_the_documents(spark):
    """Joins by shuffle only: the hot shingle and the hot passage are dealt to several tasks, and the figures stay the same."""
    item = " ".join(f"w{i}" for i in range(15))
    docs = [(i, f"{item if i % 3 == 0 else 'nothing'} x{i} y{i} z{i}" + " pad" * (i % 400)) for i in range(2400)]
    items = [(9, item), (8, item), (7, "x5 y5 z5 pad pad pad pad pad pad")]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.doc_id: (r.n_words, r.n_hit, {int(x) for x in r.item_ids}) for r in decontam.contamination(df, it).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    wins = item_windows(items)
    assert got == {i: contamination(t, wins) for i, t in docs}
