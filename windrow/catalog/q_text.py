"""Text and JSON queries."""

from pyspark.sql import functions as F

from ..operators import sampling as sm
from ..operators import text as tx
from ..sources import tables as tb
from . import common as c
from .common import WF, query
from .q_detect import ANCHORS, NEGATIVES, anchors, negatives

H5 = "t,v,a,k,y,h"


def f1(x, digits):
    return f"printf('%.{digits}f', round({x}, {digits}) + 0.0)"


THW = "CASE WHEN leadOne_dRel > 0 AND vEgo > 2 THEN leadOne_dRel / greatest(vEgo, 2) END"


def with_yaw(f):
    return f.withColumn("yaw_rate", F.col("steeringRateDeg") / 10)


@query(
    "serialize_window",
    f"""WITH {WF}, m AS (SELECT win_id, pos // 5 AS t, avg(vEgo) AS v, avg(aEgo) AS a, avg(actual_curvature) AS k, avg(steeringRateDeg / 10) AS y, avg({THW}) AS h FROM wf GROUP BY ALL)
    SELECT win_id, '{H5}' || chr(10) || string_agg(concat_ws(',', t, {f1("v", 1)}, {f1("a", 2)}, {f1("k * 1000", 2)}, {f1("y", 2)}, {f1("least(coalesce(h, 9.9::DOUBLE), 9.9::DOUBLE)", 1)}),
      chr(10) ORDER BY t) AS text FROM m GROUP BY win_id""",
)
def serialize_window(spark, d):
    return tx.serialize_window(with_yaw(c.win_frames(spark, d)), 5, header=H5)


HIST = f"""string_agg(concat_ws(',', {f1("(pos - a)::DOUBLE", 1)}, {f1("vEgo", 1)}, {f1("aEgo", 2)}, {f1("actual_curvature * 1000", 2)}, {f1("steeringRateDeg / 10", 2)},
  {f1(f"least(coalesce({THW}, 9.9::DOUBLE), 9.9::DOUBLE)", 1)}), chr(10) ORDER BY pos)"""


@query(
    "serialize_history",
    f"""WITH {ANCHORS}, a AS (SELECT DISTINCT win_id, a FROM pos_a) SELECT win_id, a, {HIST} AS text FROM a JOIN wf USING (win_id)
    WHERE pos BETWEEN a - 5 AND a - 1 GROUP BY ALL""",
)
def serialize_history(spark, d):
    f = with_yaw(c.win_frames(spark, d))
    return tx.serialize_history(f, anchors(f)[1].select("win_id", "a").distinct(), 5, 1.0, bounded=True)


@query(
    "export_jsonl",
    f"""WITH {NEGATIVES}, an AS (SELECT DISTINCT win_id, a, y FROM (SELECT win_id, a, y FROM pos_a UNION ALL SELECT win_id, a, y FROM neg_a)),
    s AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', '42', win_id, a)), win_id, a) <= CASE y WHEN 1 THEN 200 ELSE 400 END),
    t AS (SELECT win_id, a, y, {HIST} AS text FROM s JOIN wf USING (win_id) WHERE pos BETWEEN a - 5 AND a - 1 GROUP BY ALL)
    SELECT to_json({{'id': concat(win_id, '@', a), 'label': y, 'text': text}})::VARCHAR AS value FROM t""",
)
def export_jsonl(spark, d):
    f = with_yaw(c.win_frames(spark, d))
    both = anchors(f)[1].select("win_id", "a", "y").unionByName(negatives(spark, d, f).select("win_id", "a", "y")).distinct()
    pick = lambda y, n: sm.hash_top_n(both.filter(F.col("y") == y), ["y"], n, 42, "win_id", "a")
    text = tx.serialize_history(f, pick(1, 200).unionByName(pick(0, 400)), 5, 1.0, bounded=True)
    return tx.jsonl_lines(text, F.concat("win_id", F.lit("@"), F.col("a").cast("string")), F.col("y"))


REPLY = """r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'no object here' WHEN 1 THEN '{broken ' || props WHEN 2 THEN '} reversed {'
  ELSE 'Sure! ' || props || chr(10) || 'Done.' END AS reply FROM events),
j AS (SELECT event_id, regexp_extract(reply, '(?s)\\{.*\\}') AS body FROM r),
p AS (SELECT event_id, CASE WHEN body <> '' AND json_valid(body) THEN (body::JSON ->> '$.k')::BIGINT END AS k, body <> '' AND json_valid(body) AS ok FROM j)"""


def replies(spark, d):
    m = F.col("event_id") % 7
    text = (
        F.when(m == 0, "no object here").when(m == 1, F.concat(F.lit("{broken "), "props")).when(m == 2, "} reversed {")
        .otherwise(F.concat(F.lit("Sure! "), "props", F.lit("\nDone.")))
    )
    return tb.table(spark, d, "events").select("event_id", text.alias("reply"))


@query("extract_json", f"WITH {REPLY} SELECT event_id, k, ok FROM p")
def extract_json(spark, d):
    p = tx.extract_json(replies(spark, d), "reply", "k bigint")
    return p.select("event_id", F.col("parsed.k").alias("k"), F.col("parsed").isNotNull().alias("ok"))


@query("json_counts", f"WITH {REPLY} SELECT count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS fail FROM p")
def json_counts(spark, d):
    return tx.json_counts(tx.extract_json(replies(spark, d), "reply", "k bigint"))


@query(
    "parse_keys",
    """SELECT p_partkey, p_type AS grp, 'E' || p_size AS entity, replace(p_name, ' ', '-') AS route, CASE WHEN p_partkey % 3 = 0 THEN 1073741824 ELSE p_size END::BIGINT AS segment FROM part""",
)
def parse_keys(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, "log.zst").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("--log.zst")))
    path = F.concat(
        F.lit("/data/"), "p_type", F.lit("/E"), F.col("p_size").cast("string"), F.lit("__"), F.regexp_replace("p_name", " ", "-"), F.lit(".parquet/"), name
    )
    out = tx.parse_keys(tb.table(spark, d, "part").select("p_partkey", path.alias("path")), "path")
    return out.select("p_partkey", "grp", "entity", "route", "segment")
