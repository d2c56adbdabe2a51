"""Verification, retrieval, classification, distance and prediction-quality queries."""

from pyspark.sql import functions as F

from ..operators import distance as ds
from ..operators import metrics as mt
from ..operators import ml
from ..operators.features import STATS as STAT_NAMES
from ..operators.features import unpivot_labels
from ..sources import tables as tb
from . import common as c
from .common import SIG, STATS, labels_sql, query, rounded, rsel
from .q_curate import EMB, PAIRS, ROLES, emb, pairs
from .q_detect import ANCHORS, NEGATIVES, anchors, negatives

SCORED = "sc AS (SELECT doc_id, lang, (n_chars % 97)::DOUBLE AS score, quality AS y FROM documents JOIN labels USING (doc_id))"


def scored(spark, d):
    docs = tb.table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 97).cast("double").alias("score"))
    return docs.join(tb.table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


def roc_sql(src="sc", by="lang", score="score", y="y", name="roc", drop=True):
    """CTEs with one ROC point per distinct score, and per-slice auroc / eer / ap in <name>_m."""
    part = f"PARTITION BY {by} ORDER BY score DESC"
    keep = "r = 1 OR r = n_pts OR pos <> npos OR neg <> nneg" if drop else "true"
    return f"""
{name}0 AS (SELECT {by}, {score} AS score, sum({y}) AS pos, sum(1 - {y}) AS neg FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL),
{name} AS (SELECT *, sum(pos) OVER (PARTITION BY {by}) AS n_pos, sum(neg) OVER (PARTITION BY {by}) AS n_neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    row_number() OVER w AS r, count(*) OVER (PARTITION BY {by}) AS n_pts, lead(pos) OVER ({part}) AS npos, lead(neg) OVER ({part}) AS nneg
  FROM {name}0 WINDOW w AS ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_m AS (SELECT {by}, any_value(n_pos)::BIGINT AS n_pos, any_value(n_neg)::BIGINT AS n_neg,
    sum(neg * (tp - pos + 0.5 * pos))::DOUBLE / nullif(any_value(n_pos)::DOUBLE * any_value(n_neg), 0) AS auroc,
    count(*) FILTER (WHERE {keep}) AS points,
    arg_min((fp / nullif(n_neg, 0) + (n_pos - tp) / nullif(n_pos, 0)) / 2, (abs((n_pos - tp) * n_neg - fp * n_pos)::DOUBLE, -score)) FILTER (WHERE {keep}) AS eer,
    sum(pos / nullif(n_pos, 0) * (tp / (tp + fp))) AS ap
  FROM {name} GROUP BY {by})"""


@query("auroc", f"WITH {SCORED}, {roc_sql()} SELECT lang, n_pos, n_neg, {rsel('auroc')} FROM roc_m")
def auroc(spark, d):
    return rounded(mt.auroc(scored(spark, d), "score", "y", ["lang"]))


@query("roc_eer", f"WITH {SCORED}, {roc_sql()} SELECT lang, points, {rsel('eer')} FROM roc_m")
def roc_eer(spark, d):
    return rounded(mt.roc_eer(scored(spark, d), "score", "y", ["lang"]))


@query("average_precision", f"WITH {SCORED}, {roc_sql()} SELECT lang, n_pos, n_pos + n_neg AS n, {rsel('ap')} FROM roc_m")
def average_precision(spark, d):
    return rounded(mt.average_precision(scored(spark, d), "score", "y", ["lang"]))


COS = "list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-9) * (sqrt(list_dot_product({b}, {b})) + 1e-9))"


def cos_sql(a, b):
    return COS.format(a=a, b=b)


# Descriptors: the twelve window statistics, median-imputed and standardised.
def std_sql(src="stats"):
    imp = ", ".join(f"coalesce({s}, quantile_cont({s}, 0.5) OVER ()) AS {s}" for s in STAT_NAMES)
    z = ", ".join(f"({s} - avg({s}) OVER ()) / coalesce(nullif(stddev_pop({s}) OVER (), 0), 1)" for s in STAT_NAMES)
    return f"""
imp AS (SELECT win_id, entity, route, grp, scenario, {imp} FROM {src}),
descr AS (SELECT win_id, entity, route, grp, scenario, [{z}] AS vec FROM imp)"""


def descriptors(spark, d):
    """The descriptor representation of the windows, a stage of its own."""

    def build():
        z = ml.impute_standardize(c.stats(spark, d), STAT_NAMES)
        return z.select("win_id", "entity", "route", "grp", "scenario", F.array(*STAT_NAMES).alias("vec"))

    return c.stage(spark, "descriptors", d, build)


@query(
    "impute_standardize",
    f"""WITH {STATS}, {std_sql()} SELECT win_id, {", ".join(f"round(vec[{i + 1}], 6) + 0.0 AS {s}" for i, s in enumerate(STAT_NAMES))} FROM descr""",
)
def impute_standardize(spark, d):
    return rounded(ml.impute_standardize(c.stats(spark, d), STAT_NAMES).select("win_id", *STAT_NAMES))


PS = f"""{PAIRS}, {std_sql()}, pv AS (SELECT p.*, a.vec AS va, b.vec AS vb, a.scenario FROM pairs p JOIN descr a ON a.win_id = win_a
  JOIN descr b ON b.win_id = win_b)"""


@query("pair_cosine", f"WITH {PS} SELECT win_a, win_b, same_entity, round({cos_sql('va', 'vb')}, 6) + 0.0 AS score FROM pv")
def pair_cosine(spark, d):
    out = mt.pair_cosine(pairs(spark, d), descriptors(spark, d))
    return rounded(out.select("win_a", "win_b", "same_entity", "score"))


@query("pair_neg_l2", f"WITH {PS} SELECT win_a, win_b, same_entity, round(-list_distance(va, vb), 6) + 0.0 AS score FROM pv")
def pair_neg_l2(spark, d):
    out = mt.pair_neg_l2(pairs(spark, d), descriptors(spark, d))
    return rounded(out.select("win_a", "win_b", "same_entity", "score"))


@query(
    "verify_pairs",
    f"""WITH {PS}, ps AS (SELECT round({cos_sql('va', 'vb')}, 9) AS s, same_entity AS y, unnest(['all', scenario]) AS slice FROM pv),
    {roc_sql("ps", "slice", "s")} SELECT slice, n_pos, n_neg, {rsel("auroc eer")} FROM roc_m
    WHERE (n_pos + n_neg >= 20 OR slice = 'all') AND n_pos > 0 AND n_neg > 0""",
)
def verify_pairs(spark, d):
    side = descriptors(spark, d).select(F.col("win_id").alias("win_a"), "scenario")
    p = mt.pair_cosine(pairs(spark, d), descriptors(spark, d)).join(side, "win_a")
    return rounded(mt.verify_pairs(p.withColumn("score", F.round("score", 9)), min_n=20))


# Enrollment: prototypes per k from the support rows, genuine and impostor scores per query.
def enroll_sql(roles=ROLES, by="", src_by=""):
    """CTE chain ending in enr (one row per query and k). ``by`` = "setting, " for more than one representation."""
    b = by
    j = "".join(f" AND x.{k.strip()} = y.{k.strip()}" for k in by.split(",") if k.strip())
    return f"""{roles},
enough AS (SELECT entity FROM roles GROUP BY entity HAVING count(DISTINCT CASE WHEN role = 'query' THEN win_id END) >= 5
  AND count(*) FILTER (WHERE role = 'support') >= 1),
ords AS (SELECT entity, row_number() OVER (ORDER BY md5(concat_ws(':', '42-proto', entity)), entity) AS ord, count(*) OVER () AS e_n FROM enough),
dims AS (SELECT {b}k, entity, i, avg(v) AS m FROM (SELECT {b}k, entity, unnest(vec) AS v, unnest(range(len(vec))) AS i
  FROM roles, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE role = 'support' AND rank <= k AND entity IN (SELECT entity FROM ords WHERE e_n >= 5)) GROUP BY ALL),
protos AS (SELECT {b}k, entity, list(m ORDER BY i) AS p FROM dims GROUP BY ALL),
qs AS (SELECT {b}k, win_id, r.entity, vec, ord, e_n, ('0x' || substr(md5(concat_ws(':', '42-imp', win_id)), 1, 8))::BIGINT % e_n + 1 AS dr
  FROM roles r JOIN ords USING (entity), (SELECT unnest([1, 3, 5, 10]) AS k) WHERE role = 'query'),
sims AS (SELECT {"".join("x." + k.strip() + ", " for k in by.split(",") if k.strip())}x.k, x.win_id, x.entity, y.entity AS pe, o.ord AS po,
    round({cos_sql("x.vec", "y.p")}, 9) AS s, CASE WHEN dr = x.ord THEN x.ord % e_n + 1 ELSE dr END AS imp
  FROM qs x JOIN protos y ON x.k = y.k{j} JOIN (SELECT entity, ord FROM ords) o ON o.entity = y.entity),
enr AS (SELECT {b}k, win_id, entity, max(s) FILTER (WHERE pe = entity) AS own, max(s) FILTER (WHERE po = imp) AS imp,
    count(*) FILTER (WHERE s > own0) AS better, max(s) FILTER (WHERE pe <> entity) AS other
  FROM (SELECT *, max(CASE WHEN pe = entity THEN s END) OVER (PARTITION BY {b}k, win_id) AS own0 FROM sims) GROUP BY ALL),
gi AS (SELECT {b}k, own AS s, 1 AS y FROM enr UNION ALL SELECT {b}k, imp, 0 FROM enr)"""


def enroll_result(by=""):
    keys = f"{by}k"
    return f"""{roc_sql("gi", keys, "s")},
    tops AS (SELECT {keys}, count(DISTINCT entity) AS n_entities, count(*) AS n_queries, avg((better < 1)::INT) AS top1, avg((better < 5)::INT) AS top5
      FROM enr GROUP BY {keys})
    SELECT {keys}, n_entities, n_queries, {rsel("top1 top5 auroc eer")} FROM tops JOIN roc_m USING ({keys})"""


@query("enroll", f"WITH {enroll_sql()}, {enroll_result()}")
def enroll(spark, d):
    return rounded(mt.enroll(emb(spark, d)))


ABL = f"""{STATS}, {std_sql()},
emb AS (SELECT win_id, entity, route FROM descr),
rr AS (SELECT entity, route, row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws(':', '42', entity, route)), entity, route) AS r,
    count(*) OVER (PARTITION BY entity) AS n FROM (SELECT DISTINCT entity, route FROM emb)),
r0 AS (SELECT emb.*, role, row_number() OVER (PARTITION BY entity, role ORDER BY md5(concat_ws(':', '42-row', win_id)), win_id) AS rank
  FROM emb JOIN (SELECT entity, route, CASE WHEN r <= greatest(1, n // 2) THEN 'support' ELSE 'query' END AS role FROM rr WHERE n >= 2)
  USING (entity, route)),
ab AS (SELECT unnest(['full', 'no_accel', 'no_path']) AS setting, unnest([[]::INT[], [2, 3, 4, 9]::INT[], [5, 6, 11]::INT[]]) AS zero),
rep AS (SELECT setting, win_id, list_transform(vec, lambda x, i: CASE WHEN list_contains(zero, i - 1) THEN 0.0 ELSE x END) AS vec FROM descr, ab),
roles AS (SELECT setting, vec, r0.* FROM rep JOIN r0 USING (win_id))"""


@query("ablate_channels", f"WITH {enroll_sql(ABL, 'setting, ').replace('[1, 3, 5, 10]', '[5]')}, {enroll_result('setting, ')}")
def ablate_channels(spark, d):
    out = mt.ablate_channels(descriptors(spark, d), {"no_accel": (2, 3, 4, 9), "no_path": (5, 6, 11)}, 5)
    return rounded(out)


@query(
    "own_vs_best_other",
    f"""WITH {EMB}, dims AS (SELECT entity, i, avg(v) AS m FROM (SELECT entity, unnest(vec) AS v, unnest(range(64)) AS i FROM emb WHERE route < 3) GROUP BY ALL),
    protos AS (SELECT entity AS pe, list(m ORDER BY i) AS p FROM dims GROUP BY entity),
    s AS (SELECT win_id, entity, pe, {cos_sql("vec", "p")} AS s FROM emb, protos WHERE route >= 3),
    g AS (SELECT win_id, max(s) FILTER (WHERE pe = entity) AS own, max(s) FILTER (WHERE pe <> entity) AS best_other FROM s GROUP BY win_id)
    SELECT win_id, {rsel("own best_other")}, round(own, 9) > round(best_other, 9) AS correct FROM g""",
)
def own_vs_best_other(spark, d):
    from ..functions.vectors import mean_vector

    e = emb(spark, d)
    protos = mean_vector(e.filter(F.col("route") < 3), ["entity"], "vec", "vec")
    return rounded(mt.own_vs_best_other(e.filter(F.col("route") >= 3), protos))


CROSS = f"""{EMB.replace("emb AS", "raw AS", 1)},
emb AS (SELECT win_id, entity, route, grp, list_transform(vec, lambda x: x / (sqrt(list_sum(list_transform(vec, lambda y: y * y))) + 1e-9)) AS vec FROM raw),
cl AS (SELECT entity, grp, count(*) AS n FROM emb GROUP BY ALL HAVING count(*) >= 10),
cells AS (SELECT * FROM cl WHERE entity IN (SELECT entity FROM cl GROUP BY entity HAVING count(*) >= 2)),
rws AS (SELECT emb.*, n, row_number() OVER (PARTITION BY entity, grp ORDER BY md5(concat_ws(':', '42', win_id)), win_id) AS r FROM emb JOIN cells USING (entity, grp)),
capd AS (SELECT * FROM emb QUALIFY row_number() OVER (PARTITION BY grp, entity ORDER BY md5(concat_ws(':', '42-neg', win_id)), win_id) <= 40),
pool AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws(':', '42-neg', win_id)), win_id) AS nr FROM capd QUALIFY nr <= 80),
trials AS (SELECT 'cross' AS kind, a.entity, a.grp AS enroll_grp, b.grp AS query_grp FROM cells a JOIN cells b ON a.entity = b.entity AND a.grp <> b.grp
  UNION ALL SELECT 'same', entity, grp, grp FROM cells WHERE n >= 20),
dims AS (SELECT kind, t.entity, enroll_grp, query_grp, i, avg(v) AS m FROM (SELECT r.*, unnest(vec) AS v, unnest(range(64)) AS i FROM rws r) r JOIN trials t
  ON t.entity = r.entity AND t.enroll_grp = r.grp WHERE r <= CASE kind WHEN 'same' THEN least(n // 2, 12) ELSE 12 END GROUP BY ALL),
protos AS (SELECT kind, entity, enroll_grp, query_grp, list(m ORDER BY i) AS p FROM dims GROUP BY ALL),
sc AS (SELECT t.*, r.vec, 1 AS y FROM trials t JOIN rws r ON r.entity = t.entity AND r.grp = t.query_grp
    WHERE r > CASE kind WHEN 'same' THEN n // 2 ELSE 0 END AND r <= CASE kind WHEN 'same' THEN n // 2 ELSE 0 END + 30
  UNION ALL (SELECT t.*, q.vec, 0 FROM trials t JOIN pool q ON q.grp = t.query_grp AND q.entity <> t.entity
    QUALIFY row_number() OVER (PARTITION BY t.kind, t.entity, t.enroll_grp, t.query_grp ORDER BY q.nr) <= 40)),
ss AS (SELECT kind, entity, enroll_grp, query_grp, y, round({cos_sql("vec", "p")}, 9) AS s FROM sc JOIN protos USING (kind, entity, enroll_grp, query_grp))"""


def cross(spark, d):
    return mt.cross_group_verify(emb(spark, d), (12, 30, 40), 10)


@query(
    "cross_group_verify",
    f"""WITH {CROSS}, {roc_sql("ss", "kind, entity, enroll_grp, query_grp", "s")}
    SELECT kind, entity, enroll_grp, query_grp, n_pos, n_neg, {rsel("auroc eer")} FROM roc_m WHERE n_neg >= 10 AND n_pos > 0""",
)
def cross_group_verify(spark, d):
    return rounded(cross(spark, d))


def weights_sql(keys="entity"):
    """CTE bw of ``per`` (v and the keys): Poisson weights w of 2000 resamples b."""
    return f"""bw AS (SELECT *, list_sum(list_transform({list(mt.POISSON)}, lambda t: (u >= t)::INT)) AS w FROM (
  SELECT *, ('0x' || substr(md5(concat_ws(':', '42-boot', {keys}, b)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT *, unnest(range(1, 2001)) AS b FROM per)))"""


@query(
    "cross_group_summary",
    f"""WITH {CROSS}, {roc_sql("ss", "kind, entity, enroll_grp, query_grp", "s")},
    per AS (SELECT kind, entity, avg(auroc) AS v FROM roc_m WHERE n_neg >= 10 AND n_pos > 0 GROUP BY ALL),
    {weights_sql("kind, entity")},
    ms AS (SELECT kind, b, sum(w * v) / sum(w) AS m FROM bw GROUP BY kind, b HAVING sum(w) > 0),
    ci AS (SELECT kind, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM ms GROUP BY kind)
    SELECT kind, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(any_value(lo), 6) + 0.0 AS lo, round(any_value(hi), 6) + 0.0 AS hi FROM per JOIN ci USING (kind) GROUP BY kind""",
)
def cross_group_summary(spark, d):
    """Mean over entities and its interval, across groups and within one (the control)."""
    return rounded(mt.cluster_bootstrap(cross(spark, d), "entity", "auroc", by=["kind"]))


BOOT = f"""{weights_sql()},
ms AS (SELECT b, sum(w * v) / sum(w) AS m FROM bw GROUP BY b HAVING sum(w) > 0),
boot AS (SELECT (SELECT count(*) FROM per) AS n, (SELECT avg(v) FROM per) AS mean, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM ms)"""


@query(
    "cluster_bootstrap",
    f"""WITH per AS (SELECT o_custkey AS entity, avg(o_totalprice / 50000) AS v FROM orders GROUP BY 1), {BOOT} SELECT n, {rsel("mean lo hi")} FROM boot""",
)
def cluster_bootstrap(spark, d):
    o = tb.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), (F.col("o_totalprice") / 50000).alias("value"))
    return rounded(mt.cluster_bootstrap(o))


EVP = """ep AS (SELECT event_type AS y, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred, user_id, ts FROM events),
ev AS (SELECT * FROM ep WHERE pred IS NOT NULL)"""


def predicted(spark, d):
    """The class of an event as its truth, the class of the user's previous event as the prediction."""
    from ..plans.ordered import carry

    ev = tb.table(spark, d, "events").select("user_id", tb.micros("ts").alias("t"), "event_id", "event_type")
    # The previous event is the carried value of the row before: shift it with a half-step copy.
    here = ev.select("user_id", "t", F.lit(0).alias("_k"), "event_id", F.col("event_type").alias("y"), F.lit(None).cast("string").alias("_v"))
    after = ev.select("user_id", "t", F.lit(1).alias("_k"), "event_id", F.lit(None).cast("string").alias("y"), F.col("event_type").alias("_v"))
    line = carry(here.unionByName(after), ["user_id"], ["t", "_k", "event_id"], {"pred": "_v"}, chunk=86_400_000_000 * 30)
    return line.filter(F.col("y").isNotNull() & F.col("pred").isNotNull()).select("user_id", "y", "pred")


@query(
    "classification_report",
    f"""WITH {EVP}, cl AS (SELECT DISTINCT y AS cls FROM ev UNION SELECT DISTINCT pred FROM ev),
    p AS (SELECT cls, count(*) FILTER (WHERE y = cls) AS support, count(*) FILTER (WHERE pred = cls) AS predicted, count(*) FILTER (WHERE y = cls AND pred = cls) AS hit
      FROM cl, ev GROUP BY cls),
    f AS (SELECT *, CASE WHEN support > 0 THEN hit / support END AS recall, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS "precision",
      2 * hit / (support + predicted) AS f1 FROM p),
    a AS (SELECT * FROM f UNION ALL SELECT 'all', sum(support), sum(predicted), sum(hit), avg(recall), sum(hit) / sum(support), avg(f1) FROM f)
    SELECT cls, support::BIGINT AS support, predicted::BIGINT AS predicted, hit::BIGINT AS hit, {rsel("recall f1")},
      round("precision", 6) + 0.0 AS "precision" FROM a""",
)
def classification_report(spark, d):
    return rounded(mt.classification_report(predicted(spark, d), "y", "pred"))


@query(
    "majority_vote",
    """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, arg_min(event_type, (-n, event_type)) AS vote, max(n) AS votes FROM n GROUP BY user_id""",
)
def majority_vote(spark, d):
    return mt.majority_vote(tb.table(spark, d, "events"), ["user_id"], "event_type")


@query(
    "recall_lift",
    f"""WITH {EVP}, p AS (SELECT y AS cls, count(*) AS support, avg((y = pred)::INT) AS recall FROM ev GROUP BY y)
    SELECT cls, support, round(recall, 6) + 0.0 AS recall, round(recall * count(*) OVER (), 6) + 0.0 AS lift FROM p""",
)
def recall_lift(spark, d):
    return rounded(mt.recall_lift(predicted(spark, d), "y", "pred"))


@query(
    "loo_nn",
    f"""WITH {STATS}, {std_sql()}, dims AS (SELECT entity || '|' || route AS rid, entity, i, avg(v) AS m FROM (SELECT entity, route, unnest(vec) AS v,
      unnest(range(12)) AS i FROM descr) GROUP BY ALL), r AS (SELECT rid, entity, list(m ORDER BY i) AS vec FROM dims GROUP BY ALL),
    nn AS (SELECT a.rid, a.entity, b.rid AS nn, b.entity AS nn_entity, row_number() OVER (PARTITION BY a.rid ORDER BY
      round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), b.rid) AS k FROM r a JOIN r b ON a.rid <> b.rid)
    SELECT rid, entity, nn, nn_entity, entity = nn_entity AS same FROM nn WHERE k = 1""",
)
def loo_nn(spark, d):
    from ..functions.vectors import mean_vector

    z = descriptors(spark, d).withColumn("rid", F.concat_ws("|", "entity", "route"))
    return mt.loo_nn(mean_vector(z, ["rid", "entity"], "vec", "vec"))


@query(
    "recall_at_k",
    f"""WITH {EMB}, b AS (SELECT win_id, list_transform(vec, lambda x, i: x + 0.6 * (((win_id * 31 + i * 17) % 13) / 13.0 - 0.5)::DOUBLE) AS vec FROM emb),
    s AS (SELECT a.win_id AS ai, b.win_id AS bi, round({cos_sql("a.vec", "b.vec")}, 9) AS s FROM emb a, b),
    o AS (SELECT ai AS id, s AS own FROM s WHERE ai = bi),
    r AS (SELECT 'a_to_b' AS direction, ai AS id, count(*) FILTER (WHERE s > own) AS better FROM s JOIN o ON id = ai GROUP BY ai
      UNION ALL SELECT 'b_to_a', bi, count(*) FILTER (WHERE s > own) FROM s JOIN o ON id = bi GROUP BY bi)
    SELECT direction, count(*) AS n, round(avg((better < 1)::INT), 6) + 0.0 AS r1, round(avg((better < 5)::INT), 6) + 0.0 AS r5,
      round(avg((better < 10)::INT), 6) + 0.0 AS r10 FROM r GROUP BY direction""",
)
def recall_at_k(spark, d):
    a = emb(spark, d).select("win_id", "vec")
    noise = lambda x, i: x + 0.6 * (((F.col("win_id") * 31 + (i + 1) * 17) % 13) / 13.0 - 0.5)
    return rounded(mt.recall_at_k(a, a.withColumn("vec", F.transform("vec", noise))))


@query(
    "sliced_auroc",
    f"""WITH {SCORED}, sl AS (SELECT score AS s, y, unnest(list_filter(['all', CASE WHEN lang = 'en' OR y = 0 THEN 'en' END,
      CASE WHEN doc_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS slice FROM sc), {roc_sql("sl", "slice", "s")}
    SELECT slice, n_pos, n_neg, {rsel("auroc")} FROM roc_m WHERE n_pos > 20""",
)
def sliced_auroc(spark, d):
    slices = {"all": F.lit(True), "en": (F.col("lang") == "en") | (F.col("y") == 0), "even": F.col("doc_id") % 2 == 0}
    return rounded(mt.sliced_auroc(scored(spark, d), slices, min_pos=20))


ANS = """ans AS (SELECT lang AS label, CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'unsure' ELSE 'no' END END AS answer
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query(
    "audit_agreement",
    f"""WITH {ANS}, r AS (SELECT unnest(['all', label]) AS label, answer FROM ans), a AS (SELECT label, count(*) FILTER (WHERE answer = 'yes') AS yes,
      count(*) FILTER (WHERE answer = 'no') AS "no", count(*) FILTER (WHERE answer = 'unsure') AS unsure FROM r GROUP BY label)
    SELECT *, round(CASE WHEN yes + "no" > 0 THEN yes / (yes + "no") END, 6) + 0.0 AS agreement FROM a""",
)
def audit_agreement(spark, d):
    docs = tb.table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    q = F.when(F.col("quality") == 1, "yes").when((F.col("quality") == 0) & (F.col("doc_id") % 5 == 0), "unsure").when(F.col("quality") == 0, "no")
    a = docs.join(tb.table(spark, d, "labels"), "doc_id", "left").select("label", q.alias("answer"))
    return rounded(mt.audit_agreement(a))


@query(
    "annotator_agreement",
    """WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
    l AS (SELECT 'role' AS attr, (role IS NOT DISTINCT FROM prev)::INT AS eq FROM c UNION ALL SELECT 'long', ((length(text) > 300) IS NOT DISTINCT FROM (turn % 2 = 0))::INT FROM c)
    SELECT attr, count(*) AS n, round(avg(eq), 6) + 0.0 AS agreement FROM l GROUP BY attr""",
)
def annotator_agreement(spark, d):
    conv = tb.table(spark, d, "conversations").select("conv_id", "turn", "role", (F.length("text") > 300).alias("long"))
    prev = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), "role")
    b = conv.select("conv_id", "turn", (F.col("turn") % 2 == 0).alias("long")).join(prev, ["conv_id", "turn"], "left")
    key = lambda df: df.withColumn("id", F.concat_ws("|", "conv_id", "turn"))
    return rounded(mt.annotator_agreement(key(conv), key(b), "id", ["role", "long"]))


@query(
    "seed_summary",
    """SELECT l_returnflag AS name, count(l_tax) AS runs, round(avg(l_tax), 6) + 0.0 AS mean, round(stddev_pop(l_tax), 6) + 0.0 AS sd FROM lineitem GROUP BY 1""",
)
def seed_summary(spark, d):
    li = tb.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), "l_tax")
    return rounded(mt.seed_summary(li, ["name"], "l_tax"))


@query(
    "utility_leakage",
    """WITH u AS (SELECT l_returnflag AS name, avg(l_discount) * 8 AS utility FROM lineitem GROUP BY 1),
    l AS (SELECT l_returnflag AS name, avg((l_linestatus = 'O')::INT) AS leakage, 0.5::DOUBLE AS chance FROM lineitem GROUP BY 1)
    SELECT name, round(utility, 6) + 0.0 AS utility, round(leakage, 6) + 0.0 AS leakage, chance, round(leakage - chance, 6) + 0.0 AS leak_gap,
      round(utility - leakage, 6) + 0.0 AS gap FROM u JOIN l USING (name)""",
)
def utility_leakage(spark, d):
    li = tb.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "name").groupBy("name")
    u = li.agg((F.avg("l_discount") * 8).alias("utility"))
    leak = li.agg(F.avg((F.col("l_linestatus") == "O").cast("double")).alias("leakage"), F.lit(0.5).alias("chance"))
    return rounded(mt.utility_leakage(u, leak))


@query(
    "signal_agreement",
    f"""WITH {SIG}, f AS (SELECT grp, actual_curvature AS a, actual_curvature + steeringRateDeg / 20000 AS b FROM sig WHERE is_human > 0.5 AND vEgo > 3),
    g AS (SELECT grp, count(*) AS n, corr(a, b) AS r, regr_slope(a, b) AS slope, avg(a - b) AS bias, stddev_pop(a) AS std_a, stddev_pop(b) AS std_b FROM f GROUP BY grp)
    SELECT grp, n, {rsel("r slope bias std_a std_b")}, r >= 0.7 AS ok FROM g""",
)
def signal_agreement(spark, d):
    f = c.sig(spark, d).filter((F.col("is_human") > 0.5) & (F.col("vEgo") > 3))
    f = f.withColumn("curv_measured", F.col("actual_curvature") + F.col("steeringRateDeg") / 20000)
    return rounded(mt.signal_agreement(f, "actual_curvature", "curv_measured", ["grp"]))


@query(
    "distribution_gate",
    f"""WITH {SIG}, l AS (SELECT col, x, side FROM (SELECT route % 2 AS side, unnest(['vEgo', 'leadOne_dRel', 'aEgo', 'actual_curvature']) AS col, unnest([vEgo, leadOne_dRel, aEgo, actual_curvature]) AS x FROM sig)),
    m AS (SELECT col, avg(x) FILTER (WHERE side = 0) AS ma, avg(x) FILTER (WHERE side = 1) AS mb, stddev_pop(x) FILTER (WHERE side = 0) AS sa,
      stddev_pop(x) FILTER (WHERE side = 1) AS sb, quantile_cont(x, {[i / 100 for i in range(1, 100)]}) FILTER (WHERE side = 0) AS qa,
      quantile_cont(x, {[i / 100 for i in range(1, 100)]}) FILTER (WHERE side = 1) AS qb FROM l GROUP BY col),
    g AS (SELECT col, 100 * abs(ma - mb) / greatest(abs(mb), sb, 1e-6) AS mean_pct, 100 * abs(sa - sb) / greatest(sb, 1e-6) AS std_pct,
      list_max(list_transform(list_zip(qa, qb), lambda z: abs(z[1] - z[2]))) AS max_gap FROM m WHERE sa >= 1e-6 OR sb >= 1e-6)
    SELECT col, {rsel("mean_pct std_pct max_gap")}, mean_pct <= 1.5 AND std_pct <= 1.5 AS ok FROM g""",
)
def distribution_gate(spark, d):
    f = c.sig(spark, d)
    side = lambda r: f.filter(F.col("route") % 2 == r)
    return rounded(mt.distribution_gate(side(0), side(1), ["vEgo", "leadOne_dRel", "aEgo", "actual_curvature"]))


# ---- distances: even routes against odd routes, per region and signal ----------------------

AB = f"""{SIG}, ab AS (SELECT grp, leadOne_vRel + vEgo AS x, (route % 2)::INT AS side FROM sig)"""


def ab(spark, d):
    f = c.sig(spark, d).withColumn("v", F.col("leadOne_vRel") + F.col("vEgo"))
    return ds.two_sided(f.filter(F.col("route") % 2 == 0), f.filter(F.col("route") % 2 == 1), ["grp"], "v")


def w1_sql(src="ab", by="grp", name="w"):
    return f"""
{name}0 AS (SELECT {by}, x, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM {src} WHERE x IS NOT NULL GROUP BY ALL),
{name}1 AS (SELECT *, sum(na) OVER o AS ca, sum(nb) OVER o AS cb, sum(na) OVER (PARTITION BY {by}) AS ta, sum(nb) OVER (PARTITION BY {by}) AS tb,
    lead(x) OVER (PARTITION BY {by} ORDER BY x) AS nx FROM {name}0 WINDOW o AS (PARTITION BY {by} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (SELECT {by}, CASE WHEN any_value(ta) >= 5 AND any_value(tb) >= 5 THEN coalesce(sum(abs(ca / ta - cb / tb) * (nx - x)), 0.0) END AS w1 FROM {name}1 GROUP BY {by})"""


@query("w1", f"WITH {AB}, {w1_sql()} SELECT grp, {rsel('w1')} FROM w")
def w1(spark, d):
    return rounded(ds.w1(ab(spark, d), ["grp"]))


@query(
    "kl_hist",
    f"""WITH {AB}, r AS (SELECT grp, quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM ab GROUP BY grp),
    b AS (SELECT grp, least(floor(round((x - lo) / (hi - lo) * 30, 9)), 29)::BIGINT AS b, side FROM ab JOIN r USING (grp) WHERE x BETWEEN lo AND hi),
    n AS (SELECT grp, g.b, count(b.side) FILTER (WHERE side = 0) AS na, count(b.side) FILTER (WHERE side = 1) AS nb
      FROM (SELECT grp, unnest(range(30)) AS b FROM r) g LEFT JOIN b USING (grp, b) GROUP BY ALL),
    p AS (SELECT grp, (na + 1e-6) / (sum(na) OVER (PARTITION BY grp) + 30 * 1e-6) AS p, (nb + 1e-6) / (sum(nb) OVER (PARTITION BY grp) + 30 * 1e-6) AS q FROM n)
    SELECT grp, round(sum(p * ln(p / q)), 6) + 0.0 AS kl FROM p GROUP BY grp""",
)
def kl_hist(spark, d):
    return rounded(ds.kl_hist(ab(spark, d), ["grp"]))


#: CTEs k (grp, xx, yy, xy: kernel sums) and t (grp, a, b: sizes) of ``ab`` (grp, x, side).
MMD = """v AS (SELECT grp, x, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb, count(*) AS w FROM ab GROUP BY ALL),
    g AS (SELECT a.grp, abs(a.x - b.x) AS d, a.w * b.w AS w FROM v a JOIN v b ON a.grp = b.grp AND a.x < b.x),
    c AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY d) AS cum, sum(w) OVER (PARTITION BY grp) AS m FROM g),
    s AS (SELECT grp, (min(d) FILTER (WHERE cum > (m - 1) // 2) + min(d) FILTER (WHERE cum > m // 2)) / 2 + 1e-9 AS sigma FROM c GROUP BY grp),
    k AS (SELECT a.grp, sum(a.na * b.na * exp(-(a.x - b.x) * (a.x - b.x) / (2 * sigma * sigma))) AS xx, sum(a.nb * b.nb * exp(-(a.x - b.x) * (a.x - b.x) / (2 * sigma * sigma))) AS yy,
      sum(a.na * b.nb * exp(-(a.x - b.x) * (a.x - b.x) / (2 * sigma * sigma))) AS xy FROM v a JOIN v b ON a.grp = b.grp JOIN s ON s.grp = a.grp GROUP BY a.grp),
    t AS (SELECT grp, sum(na)::DOUBLE AS a, sum(nb)::DOUBLE AS b FROM v GROUP BY grp)"""


@query(
    "mmd_rbf",
    f"""WITH {AB}, {MMD}
    SELECT grp, round(xx / (a * a) + yy / (b * b) - 2 * xy / (a * b), 6) + 0.0 AS mmd FROM k JOIN t USING (grp)""",
)
def mmd_rbf(spark, d):
    return rounded(ds.mmd_rbf(ab(spark, d), ["grp"], block=64))


@query(
    "style_distance",
    f"""WITH {STATS}, st AS (SELECT scenario, feature, x, side FROM (SELECT scenario, (route % 2)::INT AS side, unnest(['jerk_rms', 'v_mean']) AS feature,
      unnest([jerk_rms, v_mean]) AS x FROM stats) WHERE scenario IN (SELECT scenario FROM stats WHERE route % 2 = 1 GROUP BY scenario HAVING count(*) >= 20)),
    {w1_sql("st", "scenario, feature")} SELECT count(w1) AS cells, round(avg(w1), 6) + 0.0 AS distance FROM w""",
)
def style_distance(spark, d):
    st = c.stats(spark, d)
    return rounded(ds.style_distance(st.filter(F.col("route") % 2 == 0), st.filter(F.col("route") % 2 == 1), ["jerk_rms", "v_mean"]))


@query(
    "style_distance_kl",
    f"""WITH {STATS}, st AS (SELECT scenario, feature, x, side FROM (SELECT scenario, (route % 2)::INT AS side, unnest(['jerk_rms', 'v_mean']) AS feature,
      unnest([jerk_rms, v_mean]) AS x FROM stats) WHERE x IS NOT NULL AND scenario IN (SELECT scenario FROM stats WHERE route % 2 = 1 GROUP BY scenario HAVING count(*) >= 20)),
    r AS (SELECT scenario, feature, quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM st GROUP BY ALL HAVING count(*) FILTER (WHERE side = 0) >= 5 AND count(*) FILTER (WHERE side = 1) >= 5),
    b AS (SELECT scenario, feature, least(floor(round((x - lo) / (hi - lo) * 30, 9)), 29)::BIGINT AS b, side FROM st JOIN r USING (scenario, feature) WHERE x BETWEEN lo AND hi),
    n AS (SELECT scenario, feature, g.b, count(b.side) FILTER (WHERE side = 0) AS na, count(b.side) FILTER (WHERE side = 1) AS nb
      FROM (SELECT scenario, feature, unnest(range(30)) AS b FROM r) g LEFT JOIN b USING (scenario, feature, b) GROUP BY ALL),
    p AS (SELECT scenario, feature, (na + 1e-6) / (sum(na) OVER o + 30 * 1e-6) AS p, (nb + 1e-6) / (sum(nb) OVER o + 30 * 1e-6) AS q FROM n WINDOW o AS (PARTITION BY scenario, feature)),
    k AS (SELECT sum(p * ln(p / q)) AS kl FROM p GROUP BY scenario, feature)
    SELECT count(*) AS cells, round(avg(kl), 6) + 0.0 AS distance FROM k""",
)
def style_distance_kl(spark, d):
    st = c.stats(spark, d)
    return rounded(ds.style_distance(st.filter(F.col("route") % 2 == 0), st.filter(F.col("route") % 2 == 1), ["jerk_rms", "v_mean"], "kl"))


@query(
    "style_distance_mmd",
    f"""WITH {STATS}, ab AS (SELECT concat_ws('|', scenario, feature) AS grp, x, side FROM (SELECT scenario, (route % 2)::INT AS side, unnest(['jerk_rms', 'v_mean']) AS feature,
      unnest([jerk_rms, v_mean]) AS x FROM stats) WHERE x IS NOT NULL AND scenario IN (SELECT scenario FROM stats WHERE route % 2 = 1 GROUP BY scenario HAVING count(*) >= 20)),
    {MMD} SELECT count(mmd) AS cells, round(avg(mmd), 6) + 0.0 AS distance FROM (SELECT xx / (a * a) + yy / (b * b) - 2 * xy / (a * b) AS mmd FROM k JOIN t USING (grp) WHERE a >= 5 AND b >= 5)""",
)
def style_distance_mmd(spark, d):
    st = c.stats(spark, d)
    return rounded(ds.style_distance(st.filter(F.col("route") % 2 == 0), st.filter(F.col("route") % 2 == 1), ["jerk_rms", "v_mean"], "mmd"))


# ---- prediction quality: true acceleration against a generic and a personal constant -------

PRED = f"""{SIG}, gm AS (SELECT grp, avg(aEgo) AS generic FROM sig WHERE route % 2 = 0 GROUP BY grp),
pm AS (SELECT entity, avg(aEgo) AS personal FROM sig WHERE route % 2 = 0 GROUP BY entity),
st AS (SELECT entity, route, grp, idx // 50 AS q, idx % 50 + 1 AS step, aEgo AS truth, generic, personal FROM sig JOIN gm USING (grp) JOIN pm USING (entity) WHERE route % 2 = 1),
qe AS (SELECT entity, route, q, grp, sqrt(avg((truth - generic) ** 2)) AS rmse_g, sqrt(avg((truth - personal) ** 2)) AS rmse_p FROM st GROUP BY ALL)"""


def predictions(spark, d):
    f = c.sig(spark, d)
    sup = f.filter(F.col("route") % 2 == 0)
    gm = sup.groupBy("grp").agg(F.avg("aEgo").alias("generic"))
    pm = sup.groupBy("entity").agg(F.avg("aEgo").alias("personal"))
    q = f.filter(F.col("route") % 2 == 1).join(gm, "grp").join(pm, "entity")
    return q.select(
        "entity", "route", "grp", F.floor(F.col("idx") / 50).alias("q"), (F.col("idx") % 50 + 1).alias("step"), F.col("aEgo").alias("truth"), "generic", "personal"
    )


def query_err(spark, d):
    sq = lambda p: (F.col("truth") - F.col(p)) ** 2
    return predictions(spark, d).groupBy("entity", "route", "q", "grp").agg(
        F.sqrt(F.avg(sq("generic"))).alias("rmse_g"), F.sqrt(F.avg(sq("personal"))).alias("rmse_p")
    )


@query(
    "personalization_gain",
    f"""WITH {PRED}, g AS (SELECT grp, avg(rmse_g) AS base, avg(rmse_p) AS alt FROM qe GROUP BY grp)
    SELECT grp, round(base, 6) + 0.0 AS base, round(alt, 6) + 0.0 AS alt, round(base - alt, 6) + 0.0 AS gain, round(100 * (base - alt) / base, 6) + 0.0 AS gain_pct FROM g""",
)
def personalization_gain(spark, d):
    return rounded(ds.personalization_gain(query_err(spark, d), "rmse_g", "rmse_p", ["grp"]))


@query(
    "rmse_by_query",
    f"""WITH {PRED}, h AS (SELECT *, unnest([10, 30, 50]) AS horizon FROM st) SELECT entity, route, q, horizon, round(sqrt(avg((personal - truth) ** 2)), 6) + 0.0 AS rmse
    FROM h WHERE step <= horizon GROUP BY ALL""",
)
def rmse_by_query(spark, d):
    return rounded(ds.rmse_by_query(predictions(spark, d), "personal", "truth", ["entity", "route", "q"]))


@query(
    "stratified_rmse",
    f"""WITH {PRED}, {STATS.replace(SIG + ",", "", 1).lstrip()}, {labels_sql()}, h AS (SELECT *, unnest([10, 30, 50]) AS horizon FROM st),
    r AS (SELECT entity, route, q, horizon, sqrt(avg((personal - truth) ** 2)) AS rmse FROM h WHERE step <= horizon GROUP BY ALL),
    lw AS (SELECT entity, route, wi0 // 50 AS q, unnest(['hard_braking', 'high_jerk']) AS prim, unnest([p_hard_braking, p_high_jerk]) AS label FROM lab)
    SELECT prim, horizon, count(*) AS n, round(avg(rmse), 6) + 0.0 AS rmse FROM r JOIN lw USING (entity, route, q) WHERE label = 1 GROUP BY ALL HAVING count(*) >= 5""",
)
def stratified_rmse(spark, d):
    lab = c.labelled(spark, d).withColumn("q", F.floor(F.col("wi0") / 50))
    spec = {"hard_braking": 0, "high_jerk": 0}
    long = unpivot_labels(lab, spec, ["entity", "route", "q"])
    err = ds.rmse_by_query(predictions(spark, d), "personal", "truth", ["entity", "route", "q"])
    return rounded(ds.stratified_rmse(err, long, ["entity", "route", "q"], min_n=5))


@query(
    "gain_per_entity",
    f"""WITH {PRED}, per AS (SELECT entity, avg(rmse_g) - avg(rmse_p) AS v FROM qe GROUP BY entity), {BOOT}
    SELECT n, {rsel("mean lo hi")}, round((SELECT avg((v > 0)::INT) FROM per), 6) + 0.0 AS share_pos FROM boot""",
)
def gain_per_entity(spark, d):
    return rounded(ds.gain_per_entity(query_err(spark, d), "rmse_g", "rmse_p"))


@query(
    "gaussian_nll",
    f"""WITH {PRED} SELECT grp, count(*) AS n, round(avg(0.5 * (ln(3.0::DOUBLE) + (truth - generic) ** 2 / 3.0 + ln(2 * pi()))), 6) + 0.0 AS nll FROM st GROUP BY grp""",
)
def gaussian_nll(spark, d):
    p = predictions(spark, d).withColumn("logv", F.ln(F.lit(3.0)))
    return rounded(ds.gaussian_nll(p, "truth", "generic", "logv").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("nll").alias("nll")))


@query(
    "mixture_nll",
    f"""WITH {PRED}, l AS (SELECT grp, -ln((exp(0.5) * exp(-0.5 * (0.2 + (truth - generic) ** 2 * exp(-0.2) + ln(2 * pi())))
      + exp(1.0) * exp(-0.5 * (1.0 + (truth - personal) ** 2 * exp(-1.0) + ln(2 * pi())))) / (exp(0.5) + exp(1.0))) AS nll FROM st)
    SELECT grp, round(avg(nll), 6) + 0.0 AS nll FROM l GROUP BY grp""",
)
def mixture_nll(spark, d):
    p = predictions(spark, d)
    p = p.withColumns({"w": F.lit([0.5, 1.0]), "m": F.array("generic", "personal"), "v": F.lit([0.2, 1.0])})
    return rounded(ds.mixture_nll(p, "truth", "w", "m", "v").groupBy("grp").agg(F.avg("nll").alias("nll")))


@query(
    "sampled_nll",
    f"""WITH {PRED} SELECT entity, route, q, round(-ln(avg(exp(-0.5 * ((truth - personal) ** 2 + ln(2 * pi()))))), 6) + 0.0 AS nll FROM st GROUP BY ALL""",
)
def sampled_nll(spark, d):
    p = predictions(spark, d).withColumn("ll", -0.5 * ((F.col("truth") - F.col("personal")) ** 2 + ds.LOG_2PI))
    return rounded(ds.sampled_nll(p, ["entity", "route", "q"], "ll"))


@query(
    "trajectory_stats",
    f"""WITH {SIG}, t AS (SELECT entity, route, idx // 50 AS q, avg(aEgo) AS a_mean, quantile_cont(aEgo, 0.05) AS a_p05, avg(abs(actual_curvature)) AS k_absmean FROM sig GROUP BY ALL)
    SELECT entity, route, q, {rsel("a_mean a_p05 k_absmean")} FROM t""",
)
def trajectory_stats(spark, d):
    f = c.sig(spark, d).withColumn("q", F.floor(F.col("idx") / 50))
    return rounded(ds.trajectory_stats(f, ["entity", "route", "q"], "aEgo", "actual_curvature"))


@query(
    "history_future",
    f"""WITH {ANCHORS}, a AS (SELECT win_id, a, a + k AS pos FROM (SELECT win_id, a, unnest(range(-5, 5)) AS k FROM (SELECT DISTINCT win_id, a FROM pos_a)))
    SELECT win_id, a, CASE WHEN pos < a THEN 'history' ELSE 'future' END AS part, CASE WHEN pos < a THEN pos - a + 6 ELSE pos - a + 1 END AS step, aEgo
    FROM a JOIN wf USING (win_id, pos)""",
)
def history_future(spark, d):
    f = c.win_frames(spark, d).select("win_id", "pos", "aEgo")
    a = anchors(c.win_frames(spark, d))[1].select("win_id", "a").distinct()
    return ds.history_future(f, a, 5, 5, bounded=True).select("win_id", "a", "part", "step", "aEgo")


@query(
    "ablation_table",
    f"""WITH {PRED}, s AS (SELECT unnest(['generic', 'personal', 'zero']) AS setting, unnest([(truth - generic) ** 2, (truth - personal) ** 2, truth ** 2]) AS e FROM st),
    g AS (SELECT setting, sqrt(avg(e)) AS rmse FROM s GROUP BY setting)
    SELECT setting, round(rmse, 6) + 0.0 AS rmse, round(100 * ((SELECT rmse FROM g WHERE setting = 'generic') - rmse) / (SELECT rmse FROM g WHERE setting = 'generic'), 6) + 0.0 AS gain_pct FROM g""",
)
def ablation_table(spark, d):
    sq = lambda p: (F.col("truth") - p) ** 2
    p = predictions(spark, d).select(
        sq(F.col("generic")).alias("g"), sq(F.col("personal")).alias("p"), sq(F.lit(0.0)).alias("z")
    )
    long = p.selectExpr("stack(3, 'generic', g, 'personal', p, 'zero', z) AS (setting, sq_err)")
    return rounded(ds.ablation_table(long, "generic"))


@query(
    "exemplars",
    f"""WITH {PRED}, g AS (SELECT concat_ws('|', entity, route, q) AS id, round(rmse_g - rmse_p, 9) AS gain FROM qe),
    r AS (SELECT *, row_number() OVER (ORDER BY gain DESC, id) AS r, count(*) OVER () AS n FROM g),
    x AS (SELECT CASE WHEN r = 1 THEN 'best' WHEN r = 2 THEN 'second' WHEN r = n // 2 + 1 THEN 'median' END AS role, id, gain FROM r)
    SELECT role, id, round(gain, 6) + 0.0 AS gain FROM x WHERE role IS NOT NULL""",
)
def exemplars(spark, d):
    e = query_err(spark, d).select(F.concat_ws("|", "entity", "route", "q").alias("id"), F.round(F.col("rmse_g") - F.col("rmse_p"), 9).alias("gain"))
    return rounded(ds.exemplars(e, "id"))
