"""Curation, split, sampling and pair queries."""

from pyspark.sql import functions as F

from ..operators import curate as cu
from ..operators import pairs as pr
from ..operators import sampling as sm
from ..operators import spans as sp
from ..sources import tables as tb
from . import common as c
from .common import COARSE, SIG, STATS, query, rounded, rsel
from .q_detect import NEGATIVES, anchors, negatives
from .q_spans import SESSIONS

NAMES = r"""names AS (SELECT concat_ws('_', upper(p_brand), upper(replace(p_name, ' ', '_')), p_type, CASE p_size % 5 WHEN 0 THEN '2019'
  WHEN 1 THEN 'MK4' WHEN 2 THEN 'GEN2' WHEN 3 THEN 'HYBRID' END) AS raw FROM part)"""
STRIP_SQL = ", ".join(f"'{t}'" for t in cu.STRIP_TOKENS)


@query(
    "canon_name",
    f"""WITH {NAMES}, r AS (SELECT raw, count(*) AS n FROM names GROUP BY raw),
    t AS (SELECT raw, n, string_split(replace(raw, '-', '_'), '_') AS tk FROM r)
    SELECT raw, CASE WHEN raw = 'BRAND#2_SMALL_RING_ECONOMY_MK4' THEN 'SPECIAL' ELSE concat_ws('_', upper(tk[1]),
      nullif(array_to_string(list_filter(list_transform(tk[2:], lambda x: upper(x)), lambda x: x <> ''
        AND NOT regexp_matches(x, '^(19|20)\\d{{2}}$') AND NOT regexp_matches(x, '^(MK\\d+|GEN\\d*|\\d+(ST|ND|RD|TH)|\\d+G|T\\d+)$')
        AND x NOT IN ({STRIP_SQL})), '_'), '')) END AS canon, n FROM t""",
)
def canon_name(spark, d):
    suffix = (
        F.when(F.col("p_size") % 5 == 0, "2019").when(F.col("p_size") % 5 == 1, "MK4")
        .when(F.col("p_size") % 5 == 2, "GEN2").when(F.col("p_size") % 5 == 3, "HYBRID")
    )
    raw = F.concat_ws("_", F.upper("p_brand"), F.upper(F.regexp_replace("p_name", " ", "_")), "p_type", suffix)
    names = tb.table(spark, d, "part").select(raw.alias("raw_name"))
    return cu.canon_name(names, "raw_name", special={"BRAND#2_SMALL_RING_ECONOMY_MK4": "SPECIAL"})


def _avail_sql():
    hm = "is_human > 0.5 AND vEgo > 2"
    src = {"yaw_rate": None, "brake": "brakePressed", "gas": "gasPressed"}
    flags = []
    for cap, cols in cu.CAPABILITIES.items():
        col = src.get(cols[0], cols[0])
        flags.append(
            f"0::BIGINT AS has_{cap}" if col is None
            else f"coalesce(stddev_pop({col}) FILTER (WHERE {hm}) >= 1e-6, false)::BIGINT AS has_{cap}"
        )
    return f"""{SIG}, avail AS (SELECT grp, entity, route, count(*) AS rows, count(*) FILTER (WHERE {hm}) AS human_move_rows,
      count(*) FILTER (WHERE {hm}) / 60.0 AS human_move_min, avg((is_human > 0.5)::INT) AS human_frac,
      avg((leadOne_status > 0.5)::INT) AS lead_rate, {", ".join(flags)} FROM sig GROUP BY ALL)"""


AVAIL = _avail_sql()
HAS = ", ".join("has_" + k for k in cu.CAPABILITIES)


def avail(spark, d):
    f = c.sig(spark, d).withColumn("brake", F.col("brakePressed")).withColumn("gas", F.col("gasPressed"))
    return cu.availability(f, rate=COARSE["rate"])


@query(
    "availability",
    f"""WITH {AVAIL} SELECT grp, entity, route, rows, human_move_rows, {rsel("human_move_min human_frac lead_rate")}, {HAS} FROM avail""",
)
def availability(spark, d):
    return rounded(avail(spark, d))


@query(
    "coverage_rollup",
    f"""WITH {AVAIL}, r AS (SELECT grp, count(DISTINCT entity) AS entities, count(*) AS routes, sum(human_move_min) / 60 AS hours,
      {", ".join(f"100 * avg(has_{k}) AS pct_{k}" for k in cu.CAPABILITIES)} FROM avail GROUP BY ROLLUP (grp))
    SELECT grp, entities, routes, {rsel("hours " + " ".join("pct_" + k for k in cu.CAPABILITIES))} FROM r""",
)
def coverage_rollup(spark, d):
    return rounded(cu.coverage_rollup(avail(spark, d)))


@query("regime_share", f"WITH {AVAIL} SELECT grp, entity, route, {rsel('human_frac human_move_min')} FROM avail")
def regime_share(spark, d):
    return rounded(cu.regime_share(avail(spark, d)))


ROUTES = """routes AS (SELECT o_custkey AS entity, o_orderkey AS route, o_orderpriority AS multi_grp,
  round(o_totalprice / 50000, 6) AS minutes, o_orderstatus AS status, c_mktsegment AS grp FROM orders JOIN customer ON c_custkey = o_custkey),
cur AS (SELECT * FROM routes WHERE minutes >= 3 AND entity IN (SELECT entity FROM routes WHERE minutes >= 3 GROUP BY entity
  HAVING round(sum(minutes), 6) >= 5))"""


def cur(spark, d):
    return cu.curate(tb.routes(spark, d))


@query("curate", f"WITH {ROUTES} SELECT entity, route, grp, round(minutes, 6) + 0.0 AS minutes FROM cur")
def curate(spark, d):
    return rounded(cur(spark, d).select("entity", "route", "grp", "minutes"))


@query(
    "within_group",
    f"""WITH {ROUTES}, m AS (SELECT grp, entity FROM cur GROUP BY ALL HAVING count(*) >= 2),
    g AS (SELECT grp, count(*) AS n_entities FROM m GROUP BY grp HAVING count(*) >= 4)
    SELECT grp, entity, route, n_entities FROM cur SEMI JOIN m USING (grp, entity) JOIN g USING (grp)""",
)
def within_group(spark, d):
    return cu.within_group(cur(spark, d)).select("grp", "entity", "route", "n_entities")


@query(
    "cross_route",
    f"""WITH {ROUTES} SELECT entity, route, CASE WHEN r <= greatest(1, n // 3) THEN 'test' ELSE 'train' END AS fold FROM (
      SELECT entity, route, row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws(':', '42', entity, route)), entity, route) AS r,
        count(*) OVER (PARTITION BY entity) AS n FROM cur) WHERE n >= 3""",
)
def cross_route(spark, d):
    return cu.cross_route(cur(spark, d))


@query(
    "cross_group",
    f"""WITH {ROUTES}, m AS (SELECT entity, count(DISTINCT multi_grp) AS n_groups FROM cur GROUP BY entity HAVING count(DISTINCT multi_grp) >= 2)
    SELECT entity, multi_grp, route, n_groups FROM cur JOIN m USING (entity)""",
)
def cross_group(spark, d):
    return cu.cross_group(cur(spark, d), "multi_grp")


@query(
    "entity_folds",
    f"""WITH {ROUTES}, e AS (SELECT DISTINCT entity FROM cur), r AS (SELECT entity, row_number() OVER (ORDER BY
      md5(concat_ws(':', '42', entity)), entity) AS r, count(*) OVER () AS n FROM e),
    k AS (SELECT *, floor(n * 0.15::DOUBLE) AS few, floor((n - floor(n * 0.15::DOUBLE)) * 0.15::DOUBLE) AS t FROM r)
    SELECT entity, CASE WHEN r <= few THEN 'few_shot' WHEN r <= few + t THEN 'test' WHEN r <= few + 2 * t THEN 'val' ELSE 'train' END AS fold
    FROM k""",
)
def entity_folds(spark, d):
    return cu.entity_folds(cur(spark, d))


@query(
    "cohort_counts",
    f"""WITH {ROUTES}, ce AS (SELECT DISTINCT entity, multi_grp FROM routes), s AS (SELECT multi_grp FROM ce GROUP BY 1 HAVING count(*) >= 2),
    p AS (SELECT entity, count(s.multi_grp) > 0 AS sh, count(*) AS g FROM ce LEFT JOIN s USING (multi_grp) GROUP BY entity)
    SELECT count(*) AS entities, count(*) FILTER (WHERE sh) AS shared, count(*) FILTER (WHERE g >= 2) AS multi FROM p""",
)
def cohort_counts(spark, d):
    return cu.cohort_counts(tb.routes(spark, d), "multi_grp")


EMB = """emb AS (SELECT vec_id AS win_id, label::BIGINT AS entity, vec_id % 6 AS route, vec_id % 3 AS grp, embedding::DOUBLE[] AS vec FROM embeddings)"""


def emb(spark, d):
    """Window embeddings with every entity on several groups (grp = vec_id % 3)."""
    return tb.embeddings(spark, d).withColumn("grp", F.col("win_id") % 3)


@query(
    "eligible_cells",
    f"""WITH {EMB}, ce AS (SELECT entity, grp, count(*) AS n FROM emb GROUP BY ALL HAVING count(*) >= 16)
    SELECT * FROM ce WHERE entity IN (SELECT entity FROM ce GROUP BY entity HAVING count(*) >= 2)""",
)
def eligible_cells(spark, d):
    return cu.eligible_cells(emb(spark, d), 16)


@query(
    "eligible_entities",
    f"WITH {STATS} SELECT entity, count(DISTINCT route) AS routes, count(*) AS n FROM stats GROUP BY entity HAVING count(DISTINCT route) >= 2 AND count(*) >= 40",
)
def eligible_entities(spark, d):
    return cu.eligible_entities(c.stats(spark, d), 2, 40)


@query(
    "shared_entity_pairs",
    f"""WITH {EMB}, ce AS (SELECT entity, grp FROM emb GROUP BY ALL HAVING count(*) >= 16)
    SELECT a.grp AS grp_a, b.grp AS grp_b, count(*) AS shared FROM ce a JOIN ce b ON a.entity = b.entity AND a.grp < b.grp
    GROUP BY ALL HAVING count(*) >= 2""",
)
def shared_entity_pairs(spark, d):
    return cu.shared_entity_pairs(emb(spark, d), 16, 2)


@query(
    "purity",
    f"""WITH {ROUTES}, p AS (SELECT entity, avg((status = 'O')::INT) AS f FROM routes GROUP BY entity)
    SELECT count(*) AS entities, round(avg((round(f, 9) > 0.6 OR round(f, 9) < 1 - 0.6::DOUBLE)::INT), 6) + 0.0 AS pure_share,
      round(avg(f), 6) + 0.0 AS mean_frac FROM p""",
)
def purity(spark, d):
    r = tb.routes(spark, d).withColumn("frac", F.when(F.col("status") == "O", 1.0).otherwise(0.0))
    return rounded(cu.purity(r, 0.6))


@query(
    "pseudonymise",
    """WITH m AS (SELECT c_custkey, 'E' || row_number() OVER (ORDER BY md5(concat_ws(':', 's', c_custkey)), c_custkey) AS alias
      FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'))
    SELECT o_orderkey, coalesce(alias, sha256('salt' || o_custkey)) AS pseudonym FROM orders LEFT JOIN m ON c_custkey = o_custkey""",
)
def pseudonymise(spark, d):
    known = tb.table(spark, d, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    m = cu.sequential_pseudonyms(known.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "s")
    return cu.pseudonymise(tb.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "salt", m)


@query(
    "topk_other",
    """WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5),
    k AS (SELECT CASE WHEN p_brand IN (FROM t) THEN p_brand ELSE 'OTHER' END AS brand FROM part) SELECT brand, count(*) AS n FROM k GROUP BY 1""",
)
def topk_other(spark, d):
    return cu.topk_other(tb.table(spark, d, "part"), "p_brand", 5, "brand").groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "one_hot",
    """WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 3),
    k AS (SELECT p_partkey, CASE WHEN p_brand IN (FROM t) THEN p_brand ELSE 'OTHER' END AS brand FROM part)
    SELECT p_partkey, (brand = 'OTHER')::INT AS is_other, (brand = 'Brand#11')::INT AS is_b11, (brand = 'Brand#23')::INT AS is_b23 FROM k""",
)
def one_hot(spark, d):
    k = cu.topk_other(tb.table(spark, d, "part"), "p_brand", 3, "brand")
    hot = cu.one_hot(k, "brand", ["OTHER", "Brand#11", "Brand#23"])
    return hot.select("p_partkey", F.col("is_OTHER").alias("is_other"), F.col("is_Brand#11").alias("is_b11"), F.col("is_Brand#23").alias("is_b23"))


@query(
    "entity_profile",
    f"""WITH {ROUTES}, ce AS (SELECT entity, multi_grp, count(*) AS n FROM routes GROUP BY ALL),
    p AS (SELECT entity, arg_min(multi_grp, (-n, multi_grp)) AS modal_grp, sum(n)::BIGINT AS n FROM ce GROUP BY entity)
    SELECT *, row_number() OVER (PARTITION BY modal_grp ORDER BY n DESC, entity) = 1 AS largest FROM p""",
)
def entity_profile(spark, d):
    return cu.entity_profile(tb.routes(spark, d), "multi_grp")


# ---- sampling ------------------------------------------------------------------------------


@query(
    "stratified_sample",
    f"""WITH {ROUTES}, s AS (SELECT grp, status, route FROM routes QUALIFY row_number() OVER (PARTITION BY grp, status
      ORDER BY md5(concat_ws(':', '42', route)), route) <= 15)
    SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42-blind', route)), route) AS pos FROM s""",
)
def stratified_sample(spark, d):
    return sm.stratified_sample(tb.routes(spark, d).select("grp", "status", "route"), ["grp", "status"], "route")


@query(
    "sample_per_class",
    f"""WITH {ROUTES} SELECT grp AS cls, route, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN grp = 'BUILDING' THEN -minutes END,
      CASE WHEN grp <> 'BUILDING' THEN md5(concat_ws(':', '42', route)) END, route) AS slot FROM routes
    QUALIFY grp = 'BUILDING' OR slot <= 50""",
)
def sample_per_class(spark, d):
    r = tb.routes(spark, d).select(F.col("grp").alias("cls"), "route", F.col("minutes").alias("score"))
    return sm.sample_per_class(r, "route", n=50, full=["BUILDING"]).select("cls", "route", "slot")


SLOTS = f"""{ROUTES}, pool AS (SELECT grp AS cls, route FROM routes WHERE minutes >= 3),
prev AS (SELECT cls, route, row_number() OVER (PARTITION BY cls ORDER BY md5(concat_ws(':', '7', route)), route) AS slot
  FROM (SELECT grp AS cls, route FROM routes) QUALIFY slot <= 40)"""


def slots(spark, d):
    r = tb.routes(spark, d).select(F.col("grp").alias("cls"), "route", "minutes")
    prev = sm.hash_top_n(r.drop("minutes"), ["cls"], 40, 7, "route", name="slot")
    return prev, r.filter(F.col("minutes") >= 3)


@query(
    "carry_slots",
    f"""WITH {SLOTS}, emp AS (SELECT cls, slot, row_number() OVER (PARTITION BY cls ORDER BY slot) AS r FROM prev ANTI JOIN pool USING (cls, route)),
    fresh AS (SELECT cls, route, row_number() OVER (PARTITION BY cls ORDER BY md5(concat_ws(':', '42', cls, route)), cls, route) AS r
      FROM pool ANTI JOIN prev USING (cls, route))
    SELECT cls, slot, route, false AS replaced FROM prev SEMI JOIN pool USING (cls, route)
    UNION ALL SELECT cls, slot, route, true FROM emp JOIN fresh USING (cls, r)""",
)
def carry_slots(spark, d):
    prev, pool = slots(spark, d)
    return sm.carry_slots(prev, pool, "route")


@query(
    "append_slots",
    f"""WITH {SLOTS}, kept AS (SELECT cls, route, row_number() OVER (PARTITION BY cls ORDER BY slot) AS slot, count(*) OVER (PARTITION BY cls) AS k
      FROM prev SEMI JOIN pool USING (cls, route)), ks AS (SELECT DISTINCT cls, k FROM kept)
    SELECT cls, route, slot, false AS appended FROM kept
    UNION ALL SELECT p.cls, p.route, coalesce(k, 0) + row_number() OVER (PARTITION BY p.cls ORDER BY minutes DESC, p.route), true
    FROM (SELECT grp AS cls, route, minutes FROM routes WHERE minutes >= 3) p ANTI JOIN prev USING (cls, route) LEFT JOIN ks ON ks.cls = p.cls""",
)
def append_slots(spark, d):
    prev, pool = slots(spark, d)
    return sm.append_slots(prev, pool, "route", "minutes")


@query(
    "carry_answers",
    """WITH a AS (SELECT conv_id AS id, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS chk, turn AS seq,
      CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS answer FROM conversations LEFT JOIN labels ON doc_id = conv_id + turn),
    l AS (SELECT id, chk, arg_max(answer, seq) AS answer FROM a WHERE answer IS NOT NULL GROUP BY ALL)
    SELECT conv_id, turn, answer FROM conversations JOIN l ON id = conv_id AND chk = role""",
)
def carry_answers(spark, d):
    conv = tb.table(spark, d, "conversations").select("conv_id", "turn", "role")
    lab = tb.table(spark, d, "labels").select("doc_id", "quality")
    prev = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("chk"))
    a = conv.join(prev, ["conv_id", "turn"], "left").join(lab, F.col("doc_id") == F.col("conv_id") + F.col("turn"), "left")
    answer = F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no")
    a = a.select("conv_id", F.col("chk").alias("role"), F.col("turn").alias("seq"), answer.alias("answer"))
    return sm.carry_answers(conv, a, "conv_id", "role").select("conv_id", "turn", "answer")


@query(
    "cap_per_entity",
    "SELECT o_custkey AS entity, o_orderkey AS route FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws(':', '42', o_orderkey)), o_orderkey) <= 3",
)
def cap_per_entity(spark, d):
    o = tb.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("route"))
    return sm.cap_per_entity(o, 3, "route")


@query(
    "pk_batches",
    f"""WITH {EMB}, r AS (SELECT entity, win_id, (row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws(':', '42', win_id)), win_id) - 1) // 4 AS round FROM emb),
    b AS (SELECT entity, round FROM r GROUP BY ALL HAVING count(*) = 4),
    k AS (SELECT *, (row_number() OVER (PARTITION BY round ORDER BY md5(concat_ws(':', '42-deal', entity, round)), entity, round) - 1) // 3 AS batch,
      count(*) OVER (PARTITION BY round) AS al FROM b)
    SELECT round, batch, entity, win_id FROM r JOIN k USING (entity, round) WHERE (batch + 1) * 3 <= al""",
)
def pk_batches(spark, d):
    return sm.pk_batches(emb(spark, d), "win_id", 3, 4)


@query(
    "enriched_sample",
    f"""WITH {NEGATIVES}, an AS (SELECT win_id, a, y, 'p' || onset || '-' || lead AS tag FROM pos_a UNION ALL SELECT win_id, a, y, 'n' || draw FROM neg_a),
    s AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', '42', win_id, tag)), win_id, tag)
      <= CASE y WHEN 1 THEN 300 ELSE 600 END)
    SELECT win_id, a, y, tag, row_number() OVER (ORDER BY md5(concat_ws(':', '42-shuffle', win_id, tag)), win_id, tag) AS pos, entity,
      (wi0 + a)::DOUBLE AS t_abs FROM s JOIN bounds USING (win_id)""",
)
def enriched_sample(spark, d):
    f = c.win_frames(spark, d)
    _, pos = anchors(f)
    p = pos.select("win_id", "a", "y", F.concat(F.lit("p"), "onset", F.lit("-"), "lead").alias("tag"))
    n = negatives(spark, d, f).select("win_id", "a", "y", F.concat(F.lit("n"), F.col("draw")).alias("tag"))
    meta = c.stats(spark, d).select("win_id", "entity", F.col("wi0").cast("double").alias("t0"))
    out = sm.enriched_sample(p.unionByName(n), meta, ["win_id", "tag"], 300, 600, rate=COARSE["rate"])
    return out.select("win_id", "a", "y", "tag", "pos", "entity", "t_abs")


ROLES = f"""{EMB}, rr AS (SELECT entity, route, row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws(':', '42', entity, route)), entity, route) AS r,
    count(*) OVER (PARTITION BY entity) AS n FROM (SELECT DISTINCT entity, route FROM emb)),
roles AS (SELECT emb.*, role, row_number() OVER (PARTITION BY entity, role ORDER BY md5(concat_ws(':', '42-row', win_id)), win_id) AS rank
  FROM emb JOIN (SELECT entity, route, CASE WHEN r <= greatest(1, n // 2) THEN 'support' ELSE 'query' END AS role FROM rr WHERE n >= 2)
  USING (entity, route))"""


@query("support_query", f"WITH {ROLES} SELECT win_id, entity, role, CASE role WHEN 'support' THEN rank END AS rank FROM roles WHERE role = 'query' OR rank <= 10")
def support_query(spark, d):
    return sm.support_query(emb(spark, d), "win_id", 10).select("win_id", "entity", "role", "rank")


@query(
    "expand_answers",
    f"""WITH {SESSIONS}, u AS (SELECT *, concat_ws('|', entity, i0) AS unit FROM sess),
    a AS (SELECT unit, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS answer FROM u JOIN labels ON doc_id = n + entity)
    SELECT ev.entity, ev.t, unit, answer FROM ev JOIN u ON u.entity = ev.entity AND ev.t BETWEEN i0 AND i1 JOIN a USING (unit)""",
)
def expand_answers(spark, d):
    ev = tb.samples(spark, d).select("entity", F.col("t_us").alias("t"))
    units = sp.session_merge(ev, 21_600_000_000, 0, chunk=86_400_000_000 * 30)
    units = units.withColumn("unit", F.concat_ws("|", "entity", "start"))
    lab = tb.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("answer"))
    a = units.join(lab, F.col("doc_id") == F.col("n") + F.col("entity")).select("unit", "answer")
    out = sm.expand_answers(ev, units, a, "unit", block=86_400_000_000)
    return out.select("entity", "t", "unit", "answer")


@query(
    "page_items",
    f"""WITH {ROUTES}, i AS (SELECT grp AS cls, route, status, row_number() OVER (PARTITION BY grp ORDER BY minutes, route) AS item FROM routes)
    SELECT cls, route, item, CASE WHEN status <> 'P' THEN ceil(item / 200)::BIGINT END AS page FROM i""",
)
def page_items(spark, d):
    r = tb.routes(spark, d).select(F.col("grp").alias("cls"), "route", "minutes", (F.col("status") != "P").alias("media"))
    return sm.page_items(r, "minutes", media="media", ties=["route"]).select("cls", "route", "item", "page")


# ---- pairs ---------------------------------------------------------------------------------

KEYED = f"""{STATS}, keyed AS (SELECT *, concat_ws('|', scenario, CASE WHEN v_mean > 0 AND v_mean <= 10 THEN 'v0' WHEN v_mean > 10 AND v_mean <= 20 THEN 'v1'
    WHEN v_mean > 20 AND v_mean <= 30 THEN 'v2' WHEN v_mean > 30 THEN 'v3' ELSE 'nan' END,
  CASE WHEN scenario = 'car_following' THEN CASE WHEN thw_median > 0 AND thw_median <= 1.2 THEN 't0' WHEN thw_median > 1.2 AND thw_median <= 2 THEN 't1'
    WHEN thw_median > 2 THEN 't2' ELSE 'nan' END ELSE 'na' END, grp) AS key FROM stats),
usable AS (SELECT key FROM keyed GROUP BY key HAVING count(*) >= 4 AND count(DISTINCT entity) >= 2)"""


def keyed(spark, d):
    return pr.match_key(c.stats(spark, d))


@query("match_key", f"WITH {KEYED} SELECT win_id, key FROM keyed")
def match_key(spark, d):
    return keyed(spark, d).select("win_id", "key")


def _pairs_sql(name, by, seed, last, cond, same):
    return f"""
{name}_r AS (SELECT key, entity, route, win_id, row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws(':', '42-{seed}', win_id)), win_id) AS r
  FROM keyed SEMI JOIN usable USING (key)),
{name}_c AS (SELECT DISTINCT a.key, least(a.win_id, b.win_id) AS win_a, greatest(a.win_id, b.win_id) AS win_b FROM {name}_r a JOIN {name}_r b
  ON {" AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in by.split(","))} AND b.r = a.r + 1 WHERE a.r <= {last} AND {cond}),
{name} AS (SELECT *, {same}::BIGINT AS same_entity FROM {name}_c QUALIFY row_number() OVER (PARTITION BY key
  ORDER BY md5(concat_ws(':', '42-{seed}cap', key, win_a, win_b)), key, win_a, win_b) <= 30)"""


POS = _pairs_sql("posp", "key, entity", "pos", 8, "a.route <> b.route", 1)
NEG = """
nk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat_ws(':', '42-neg', win_id)), win_id) AS r, count(*) OVER (PARTITION BY key) AS n FROM keyed
  WHERE key IN (SELECT key FROM keyed GROUP BY key HAVING count(*) >= 4 AND count(DISTINCT entity) >= 2)),
nd AS (SELECT key, n, unnest(range(1, least(2 * n, 200) + 1)) AS i FROM (SELECT key, any_value(n) AS n FROM nk GROUP BY key)),
ndraw AS (SELECT key, ('0x' || substr(md5(concat_ws(':', '42-nega', key, i)), 1, 8))::BIGINT % n + 1 AS ra,
  ('0x' || substr(md5(concat_ws(':', '42-negb', key, i)), 1, 8))::BIGINT % n + 1 AS rb FROM nd),
nc AS (SELECT DISTINCT d.key, least(a.win_id, b.win_id) AS win_a, greatest(a.win_id, b.win_id) AS win_b FROM ndraw d
  JOIN nk a ON a.key = d.key AND a.r = ra JOIN nk b ON b.key = d.key AND b.r = rb WHERE a.entity <> b.entity),
negp AS (SELECT key, win_a, win_b, 0::BIGINT AS same_entity FROM nc
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5(concat_ws(':', '42-negcap', key, win_a, win_b)), key, win_a, win_b) <= 30)"""
PAIRS = f"""{KEYED}, {POS}, {NEG}, allp AS (SELECT * FROM posp UNION ALL SELECT * FROM negp),
pairs AS (SELECT * FROM allp QUALIFY row_number() OVER (PARTITION BY same_entity ORDER BY md5(concat_ws(':', '42', key, win_a, win_b)), key, win_a, win_b)
  <= least((SELECT count(*) FROM posp), (SELECT count(*) FROM negp), 25000))"""


def mined(spark, d):
    k = keyed(spark, d)
    return pr.balance_pairs(pr.positive_pairs(k), pr.negative_pairs(k))


def pairs(spark, d):
    """The pair manifest, a stage that the pair queries read."""
    return c.stage(spark, "pairs", d, lambda: mined(spark, d))


@query("positive_pairs", f"WITH {KEYED}, {POS} SELECT * FROM posp")
def positive_pairs(spark, d):
    return pr.positive_pairs(keyed(spark, d))


@query("negative_pairs", f"WITH {KEYED}, {NEG} SELECT * FROM negp")
def negative_pairs(spark, d):
    return pr.negative_pairs(keyed(spark, d))


@query("balance_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def balance_pairs(spark, d):
    return mined(spark, d)


@query(
    "pair_report",
    f"""WITH {PAIRS}, pk AS (SELECT key, count(*) AS n FROM pairs GROUP BY key), s AS (SELECT split_part(key, '|', 1) AS scenario, n FROM pk UNION ALL SELECT 'all', n FROM pk)
    SELECT scenario, count(*) AS keys, sum(n)::BIGINT AS pairs, max(n) AS largest, round(quantile_cont(n::DOUBLE, 0.5), 6) + 0.0 AS median FROM s GROUP BY scenario""",
)
def pair_report(spark, d):
    return rounded(pr.pair_report(pairs(spark, d)))


@query(
    "contrast_pairs",
    f"""WITH {PAIRS}, sane AS (SELECT win_id, decel_p05 FROM stats WHERE v_mean > 8 AND jerk_rms > 0.15)
    SELECT DISTINCT key, win_a, win_b, round(abs(a.decel_p05 - b.decel_p05), 6) + 0.0 AS contrast FROM pairs JOIN sane a ON a.win_id = win_a
    JOIN sane b ON b.win_id = win_b WHERE round(abs(a.decel_p05 - b.decel_p05), 9) > 0.5""",
)
def contrast_pairs(spark, d):
    sane = (F.col("v_mean") > 8) & (F.col("jerk_rms") > 0.15)
    return rounded(pr.contrast_pairs(pairs(spark, d), c.stats(spark, d), "decel_p05", 0.5, sane))


@query(
    "band_pairs",
    f"""WITH {STATS} SELECT a.grp, a.win_id AS id_a, b.win_id AS id_b, round(abs(a.decel_p05 - b.decel_p05), 6) + 0.0 AS contrast
    FROM stats a JOIN stats b ON a.grp = b.grp AND a.win_id < b.win_id AND a.entity <> b.entity
    WHERE round(abs(a.curv_p95 - b.curv_p95) - 0.05 * greatest(a.curv_p95, b.curv_p95), 9) <= 0 AND a.curv_p95 > 0 AND b.curv_p95 > 0
      AND round(abs(a.v_mean - b.v_mean), 9) <= 0.5 AND round(abs(a.decel_p05 - b.decel_p05), 9) > 1.2
    QUALIFY row_number() OVER (PARTITION BY a.grp ORDER BY round(abs(a.decel_p05 - b.decel_p05), 9) DESC, a.win_id, b.win_id) <= 500""",
)
def band_pairs(spark, d):
    ev = c.stats(spark, d).select(
        "grp", "entity", F.col("win_id").alias("id"), F.col("curv_p95").alias("peak"), F.col("v_mean").alias("v0"), F.col("decel_p05").alias("pre_a")
    )
    return rounded(pr.band_pairs(ev, 0.05, 0.5, 1.2, top=500))


@query(
    "pair_hist_intersection",
    f"""WITH {PAIRS}, h AS (SELECT win_id, [stop_frac, lead_frac, brake_rate, 0.1] AS v FROM stats),
    n AS (SELECT win_id, list_transform(v, lambda x: x / list_sum(v)) AS v FROM h)
    SELECT win_a, win_b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: least(z[1], z[2]))), 6) + 0.0 AS sim
    FROM pairs JOIN n a ON a.win_id = win_a JOIN n b ON b.win_id = win_b""",
)
def pair_hist_intersection(spark, d):
    v = c.stats(spark, d).select("win_id", F.array("stop_frac", "lead_frac", "brake_rate", F.lit(0.1)).alias("vec"))
    return rounded(pr.pair_hist_intersection(pairs(spark, d), v))


@query(
    "matched_lift",
    f"""WITH {PAIRS}, rk AS (SELECT win_a, win_b, row_number() OVER (ORDER BY md5(concat_ws(':', '42', win_a, win_b)), win_a, win_b) AS r, count(*) OVER () AS n FROM pairs),
    kinds AS (SELECT 'm' AS kind, win_a, win_b FROM pairs UNION ALL SELECT 'r', x.win_a, y.win_b FROM rk x JOIN rk y ON x.r = y.r % y.n + 1),
    l AS (SELECT kind, unnest([{{'attr': 'scenario', 'eq': (a.scenario = b.scenario)::INT}}, {{'attr': 'entity', 'eq': (a.entity = b.entity)::INT}},
      {{'attr': 'grp', 'eq': (a.grp = b.grp)::INT}}]) AS s FROM kinds JOIN stats a ON a.win_id = win_a JOIN stats b ON b.win_id = win_b),
    m AS (SELECT s.attr AS attr, avg(s.eq) FILTER (WHERE kind = 'm') AS matched, avg(s.eq) FILTER (WHERE kind = 'r') AS random FROM l GROUP BY s.attr)
    SELECT attr, {rsel("matched random")}, round(CASE WHEN random > 0 THEN matched / random END, 6) + 0.0 AS lift FROM m""",
)
def matched_lift(spark, d):
    return rounded(pr.matched_lift(pairs(spark, d), c.stats(spark, d), ["scenario", "entity", "grp"]))
