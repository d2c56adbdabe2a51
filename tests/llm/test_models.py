import re
import zlib
from html import unescape

import duckdb
import numpy as np
import pytest
from plain import contamination, item_windows, near_components
from pyspark.sql import functions as F

from windrow.llm import chat, html, langid, packing, queries

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def net(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_of_rows_never_seen(spark, net):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs, net).withColumn("held", langid.held_out()).where("held")
    n, right, low, high = out.select(F.count(F.lit(1)), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert n > 1500 and right > 0.97 and 0 <= low <= high <= 1


def test_language_of_ugly_rows(spark, ugly, nothing, net):
    got = [(r.doc_id, r.text, r.lang_pred, r.score) for r in langid.identify(ugly, net).collect()]
    for _, t, pred, score in got:
        assert (pred == "und") == (t is None or not any(c.isalpha() for c in t)) and 0 <= score <= 1 and (pred != "und" or score == 0)
    kept = langid.keep_known(ugly, net)
    assert kept.columns == ugly.columns and {4, 5, 6, 7}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.train(nothing) is None and langid.keep_known(nothing, None).count() == 0 and langid.identify(nothing, net).count() == 0
    assert {r.lang_pred for r in langid.identify(ugly, None).collect()} == {"und"}


def test_tables_of_byte_pairs_equal_the_convolution(net):
    rng = np.random.default_rng(0)
    b = rng.integers(0, 256, (5, langid.WINDOW), dtype=np.uint8)
    e = net.embed[b]
    pooled = []
    for w, f in zip(langid.WIDTHS, net.filters):
        v = np.stack([e[:, i : i + w].reshape(5, -1) for i in range(langid.WINDOW - w + 1)], 1)
        pooled.append((v @ f).max(1))
    logit = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias
    q = np.exp(logit - logit.max(1, keepdims=True))
    assert np.allclose(langid.window_probabilities(net, langid._tables(net), b), q / q.sum(1, keepdims=True), atol=1e-4)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers(sf):
    t, encode = tokenizer(), packing.encoder(None)
    own = [x for (x,) in duckdb.connect().sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()]
    odd = ["", " ", "  a", "a  b ", "a\n b", "a \tb", "don't  'll 's", "hi<|endoftext|>yo <|endoftext|>", "日本 語 é", "\x1c a \x85b", "a​ ​b", "x  y", "1 2　 3"]
    for x in own + odd:
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x[:80]
    assert np.frombuffer(encode("hi<|endoftext|>yo"), "<u4").tolist() == [5303, 50256, 8226]


def test_packing_rebuilds_every_document(spark, ugly, sf):
    t = tokenizer()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(ugly.select(F.col("doc_id") + 1_000_000, "text").toDF("doc_id", "text"))
    rows = packing.pack(packing.pieces(docs), group=100).collect()
    want = sorted(tuple(t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect())
    of_doc, got = {}, []
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        assert len(r.ids) == r.length <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.piece == 0 or r.length == 1024
        of_doc.setdefault(r.doc_id, []).append(r)
    for d, parts in of_doc.items():
        if len({(p.piece, p.start) for p in parts}) < len(parts):
            continue  # repeated ids: their pieces cannot be told apart
        assert [p.start for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        got.append(tuple(i for p in parts for i in p.ids))
    assert set(got) <= set(want) and len(rows) == sum(-(-len(w) // 1024) for w in want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(seqs) <= 1.05 * sum(r.length for r in rows) / 1024 + 20
    assert packing.pack(packing.pieces(docs.where("doc_id < -5"))).count() == 0


def test_packing_keeps_any_other_column(spark):
    parts = spark.createDataFrame([(i, 1 + 37 * i % 1024, "x", "y") for i in range(300)], "doc_id bigint, length bigint, pack_group string, key string")
    parts = parts.unionByName(parts.where("doc_id < 9")).withColumns({"offset": F.lit("old"), "sequence_id": F.lit("old")})
    rows = packing.pack(parts, group=50).collect()
    assert len(rows) == 309 and all(r.pack_group == "x" and r.key == "y" for r in rows)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
    whole = {}
    for r in packing.pack(parts, group=10**6).collect():
        whole[r.sequence_id] = 0
    assert len(whole) == packing.best_fit(np.array([r.length for r in rows]), 1024)[0].max() + 1


def test_best_fit_takes_the_tightest_bin():
    bins, offset = packing.best_fit(np.array([6, 7, 3, 4, 1]), 10)
    assert bins.tolist() == [1, 0, 0, 1, 2] and offset.tolist() == [0, 0, 7, 6, 0]
    rng = np.random.default_rng(1)
    for _ in range(30):
        size = int(rng.integers(2, 40))
        n = rng.integers(1, size + 1, 200)
        bins, _ = packing.best_fit(n, size)
        room = []
        for k in np.argsort(-n, kind="stable"):  # the plain way: look at every bin
            fits = [r for r in room if r >= n[k]]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n[k])
            else:
                room.append(size - n[k])
        assert bins.max() + 1 == len(room)


def test_chat_round_trip(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    t = lambda s: ("text", s, None, None, None, None, None)
    rows = [
        (1, 1, "assistant", [t("a <|im_end|> b <\\|x"), t("<|im_start|>")]), (1, 0, "us\\er\nx<|", [t("see "), ("image", None, "i.png", 280, 56, None, None), t(" & "), ("audio", None, "s.wav", None, None, 2.0, None)]),
        (1, 2, "user", [("document", None, "d.pdf", None, None, None, 3)]), (2, 0, None, None), (2, 0, None, None), (3, None, "assistant", [t(None)]), (None, 0, "user", [t("no id 😀")]), (4, 0, "assistant", [t("")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{part}>")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    one = got[1]
    assert [(m.role, m.text) for m in one.messages] == [("us\\er\nx<|", "see <|image_0|> & <|audio_1|>"), ("assistant", "a <|im_end|> b <\\|x<|im_start|>"), ("user", "<|document_2|>")]
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "i.png", 20), (0, "audio", "s.wav", 50), (2, "document", "d.pdf", 1536)]
    for i, a in enumerate(one.attachments):
        assert one.formatted[a.start :].startswith(f"<|{a.kind}_{i}|>")
    assert one.expanded_tokens == 1606 and [m.learned for m in one.messages] == [None, "a <|im_end|> b <\\|x<|im_start|>", None]
    for r in got.values():
        for s in r.turns:
            assert r.formatted[s.start : s.start + s.length].startswith("<|im_start|>") and r.formatted[s.body_start + s.body_length :].startswith("<|im_end|>\n")
    assert len(got[2].messages) == 2 and got[None].messages[0].text == "no id 😀" and got[4].messages[0].learned == ""
    assert chat.format_chat(df.where("conv_id < 0")).count() == 0


def article(page):
    a = page[page.index("<article>") + 9 :].split("</article>")[0]
    blocks = [" ".join(unescape(re.sub(r"<b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", a)]
    return "\n\n".join(x for x in blocks if x)


def test_pages_equal_their_articles(spark, sf):
    raw = dict(duckdb.connect().sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall())
    got = queries.QUERIES["op10_html_extraction"](spark, sf).collect()
    assert len(got) == len(raw) and all(r.n_chars == len(r.text) for r in got)
    assert [r.page_id for r in got if r.text != article(raw[r.page_id])] == []


def test_pages_with_more_around_the_article():
    pages = [h for (h,) in duckdb.connect().sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()]
    model = html.boost(*html.training_table(pages[:200]))
    draw = np.random.default_rng(99)
    prose = [x[5] for h in pages[:200] for x in html.parse(h) if len(x[5]) > 80]
    wrong = 0
    for h in pages[300:500]:
        nodes = html.parse(html.varied(h, draw, prose))
        want = {i for i, y in enumerate(html.weak_labels(nodes)) if y and nodes[i][0] == "#text"}
        for x in nodes:
            x[0] = "div" if x[0] == "article" else x[0]
        wrong += want != set(html.decode(nodes, model.probability(html.node_features([nodes]))))
    assert wrong <= 10


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain &amp; text"), (4, None, "<p>a<p>b<br>c&nbsp;d</div><ul><li>x<li>y</ul>"), (4, None, "<p>a"), (5, "u", "<script>if (a<b) '</p>'</script><!-- x --><p title='a>b'>in" + " long" * 50_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("old"))
    got = sorted((r.page_id, r.text) for r in html.extract(df, None).collect())
    assert got[0] == (1, "") and got[1] == (2, "") and got[2] == (3, "plain & text") and got[3:5] == [(4, "a"), (4, "a\n\nb c d\n\nx\n\ny")] and got[5][1].startswith("in long")
    assert html.extract(df.where("page_id < 0"), None).count() == 0 and html.train(df.drop("text")) is None
    assert html.train(df.where("html IS NULL")) is None


def test_text_within_foreign_elements_stays():
    page = "<article><p>An unclosed <canvas> here <b>and</b> on</p><p>x <math><mi>a</mi><mo>+</mo><mn>1</mn></math> y</p><noscript>no script</noscript><object>or <svg><text>t</text></svg></object></article><p>end"
    assert [x[5] for x in html.parse(page) if x[5]] == ["An unclosed here and on", "x a+1 y", "no script or t", "end"]


def test_without_marked_pages(spark):
    """No article element in the table: attribute tokens teach the model; without those too, surroundings still go."""
    body = lambda i, mark: f"<html><div class='menu'><ul><li><a href='/'>Home</a></li><li><a href='/x'>More {i}</a></li></ul></div><div {mark}><h1>Title {i}</h1><p>{'Some words of prose, told at length. ' * 6}</p></div><footer><p>Imprint {i}</p></footer></html>"
    for mark, learns in (("class='entry'", True), ("", False)):
        df = spark.createDataFrame([(i, body(i, mark)) for i in range(60)] + [(0, body(0, mark))], "page_id bigint, html string")
        model = html.train(df)
        assert (model is not None) == learns
        for r in html.extract(df, model).collect():
            assert r.text.startswith(f"Title {r.page_id}\n\nSome words") and "Home" not in r.text and "Imprint" not in r.text


def test_training_draws_do_not_depend_on_order_or_ids(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("page_id", F.lit(None).cast("bigint"))
    a, b = html.train(pages), html.train(pages.unionByName(pages).orderBy(F.desc("url")).repartition(5))
    assert (a.leaves == b.leaves).all() and (a.features == b.features).all()


def test_decoding_agrees_with_its_ancestors():
    nodes = html.parse("<div><p>one</p><p>two</p></div><div><p>three</p></div>")
    p = np.where([x[5] == "two" for x in nodes], 0.4, 0.9)  # a doubtful child goes with its parent
    assert [nodes[i][5] for i in html.decode(nodes, p)] == ["one", "two", "three"]
    assert html.decode(nodes, np.full(len(nodes), 0.1)) == []


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "best_fit_packing":
            assert docs.columns == cols
            seen.append({r.doc_id: r.text for r in docs.collect()})
    raw, known, exact, near, clean = seen
    assert all(any(c.isalpha() for c in raw[d] or "") for d in known) and len(known) >= 0.98 * len(raw)
    best = {}
    for d, t in known.items():
        best[t] = max(d, best.get(t, -1))
    assert set(exact) == set(best.values())
    comp, sets = near_components(exact, 5)
    assert set(near) == {d for d in exact if comp[d] == d}
    wins = item_windows(duckdb.connect().sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall())
    judged = {d: contamination(t, wins) for d, t in near.items()}
    assert set(clean) == {d for d, (n, hit, _) in judged.items() if not (hit > 0 and 20 * hit >= n)}
    assert {r.doc_id for r in docs.collect()} == set(clean) and "sequence_id" in docs.columns


def test_pipeline_on_ugly_rows(spark, ugly, nothing, sf, tmp_path):
    import corpus_pipeline

    for k, docs in enumerate((ugly.drop("tags"), nothing)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}_{i}")
            docs = spark.read.parquet(f"{tmp_path}/{k}_{i}")
        assert (docs.count() > 0) == (k == 0)
