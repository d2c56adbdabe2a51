"""Scan, sink and ingest queries. What is scanned is first written from the given tables."""

import uuid

from pyspark.sql import functions as F

from ..plans.stage import shared_folder
from ..sources import ingest, scan
from ..sources import tables as tb
from .common import query, rounded


def scratch(spark, name):
    return f"{shared_folder(spark)}/windrow/{name}-{uuid.uuid4().hex}"


@query(
    "scan_corpus",
    """SELECT r_name AS grp, replace(n_name, ' ', '-') AS entity, year(l_shipdate)::VARCHAR AS route, count(*) AS n,
      round(sum(l_quantity), 6) + 0.0 AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def scan_corpus(spark, d):
    geo = tb.table(spark, d, "nation").join(tb.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = tb.table(spark, d, "supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
    li = tb.table(spark, d, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.concat(F.regexp_replace("n_name", " ", "-"), F.lit("__"), F.year("l_shipdate").cast("string"), F.lit(".parquet"))
    # Rebalancing splits a large (group, file) over several tasks and part files.
    root = scratch(spark, "corpus")
    out = li.select("l_quantity", "l_tax", F.col("r_name").alias("g"), name.alias("f"))
    scan.write_table(out.hint("rebalance", "g", "f"), root, "parquet", ["g", "f"])
    df = scan.scan_corpus(spark, root, ["l_quantity"], "l_quantity double")
    return rounded(df.groupBy("grp", "entity", "route").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")))


@query("scan_csv", "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders")
def scan_csv(spark, d):
    path = scratch(spark, "csv")
    scan.write_table(tb.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, "csv")
    return rounded(scan.scan_csv(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double"))


@query("scan_json", "SELECT event_id, event_type, round(value, 6) + 0.0 AS value, props FROM events")
def scan_json(spark, d):
    path = scratch(spark, "json")
    scan.write_table(tb.table(spark, d, "events").select("event_id", "event_type", "value", "props"), path, "json")
    return rounded(scan.scan_json(spark, path, "event_id bigint, event_type string, value double, props string"))


@query(
    "write_table",
    """SELECT fmt, count(*) AS n, round(sum(o_totalprice), 4) + 0.0 AS total FROM orders,
      (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS fmt) GROUP BY fmt""",
)
def write_table(spark, d):
    src = tb.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = None
    for fmt in ("csv", "json", "orc", "parquet"):
        path = scratch(spark, fmt)
        scan.write_table(src, path, fmt, ["o_orderstatus"])
        back = spark.read.format(fmt).schema("o_orderkey bigint, o_totalprice double").option("header", "true").load(path)
        part = back.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")).withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


DONE = "done AS (SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1997-01-01')"


@query("ingest_new", f"WITH {DONE} SELECT o_orderkey, o_custkey FROM orders ANTI JOIN done USING (o_orderkey)")
def ingest_new(spark, d):
    orders = tb.table(spark, d, "orders")
    done = orders.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return ingest.ingest_new(orders.select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query(
    "ingest_stream",
    """SELECT event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS value, count(*) FILTER (WHERE event_id % 3 = 0) AS in_first,
      (SELECT count(*) FROM events WHERE event_id % 3 = 0) AS first, (SELECT count(*) FROM events WHERE event_id % 3 <> 0) AS second FROM events GROUP BY 1""",
)
def ingest_stream(spark, d):
    """A folder that grows between two calls: each call adds what is new, in batches of one file."""
    from ..streaming.ingest import ingest_folder

    ev = tb.table(spark, d, "events").select("event_id", "event_type", "value")
    src, dst, ck = (scratch(spark, n) for n in ("stream-source", "stream-target", "stream-state"))
    counts = []
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
        ev.filter(part).repartition(4).write.mode("append").parquet(src)
        counts.append(ingest_folder(spark, src, ev.schema, dst, ck, files_per_batch=1))
    out = spark.read.parquet(dst).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.count_if(F.col("event_id") % 3 == 0).alias("in_first")
    )
    return rounded(out.withColumns({"first": F.lit(counts[0]).cast("bigint"), "second": F.lit(counts[1]).cast("bigint")}), 4)


@query(
    "prefer_source",
    """SELECT l_orderkey, l_linestatus, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(l_quantity, 6) + 0.0 AS l_quantity
    FROM lineitem WHERE l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linestatus, l_linenumber, l_partkey, l_suppkey, l_shipdate) = 1""",
)
def prefer_source(spark, d):
    li = tb.table(spark, d, "lineitem").withColumn("size", F.col("l_quantity") - 10)
    best = ingest.prefer_source(li, ["l_orderkey"], "l_linestatus", "size", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return rounded(best.select("l_orderkey", "l_linestatus", F.col("l_linenumber").cast("bigint"), "l_partkey", "l_quantity"))


@query(
    "source_mix",
    """SELECT l_orderkey, round(avg((l_linestatus = 'O')::INT), 6) + 0.0 AS frac, (avg((l_linestatus = 'O')::INT) >= 0.5)::BIGINT AS label
    FROM lineitem GROUP BY l_orderkey""",
)
def source_mix(spark, d):
    return rounded(ingest.source_mix(tb.table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_linestatus") == "O"))


@query(
    "ingest_audit",
    """WITH n AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT CASE WHEN o_orderstatus = 'F' THEN 'cached' WHEN n = 0 THEN 'fail' WHEN n < 4 THEN 'too_short' ELSE 'ok' END AS status,
      count(*) AS keys, sum(n)::BIGINT AS n FROM n GROUP BY ALL""",
)
def ingest_audit(spark, d):
    orders = tb.table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    rows = tb.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    audit = ingest.ingest_audit(orders, rows, ["k"], 4, orders.filter(F.col("o_orderstatus") == "F"))
    return ingest.status_counts(audit)


@query("scan_tolerant", "SELECT event_id, round(value, 6) + 0.0 AS value FROM events WHERE event_id % 3 <> 0")
def scan_tolerant(spark, d):
    # A third of the lines is broken on purpose; the others must all come through.
    path = scratch(spark, "broken")
    ev = tb.table(spark, d, "events").select("event_id", "value")
    line = F.to_json(F.struct("event_id", "value"))
    ev.select(F.when(F.col("event_id") % 3 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    from pyspark.sql.types import DoubleType, LongType, StructType

    schema = StructType().add("event_id", LongType()).add("value", DoubleType())
    return rounded(scan.scan_tolerant(spark, path, schema, "json"))


@query("with_aliases", "SELECT s_suppkey, s_name, s_nationkey, s_name AS route, s_nationkey AS model FROM supplier")
def with_aliases(spark, d):
    s = tb.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return ingest.with_aliases(s, {"route": "s_name", "model": "s_nationkey", "s_name": "s_nationkey", "x": "absent"})


@query(
    "pivot_fields",
    """WITH s AS (SELECT user_id AS entity, epoch_us(ts) // 86400000000 AS day, event_type, value, event_id FROM events)
    SELECT entity, day, round(arg_max(value, event_id) FILTER (WHERE event_type = 'click'), 6) + 0.0 AS click,
      round(arg_max(value, event_id) FILTER (WHERE event_type = 'view'), 6) + 0.0 AS view,
      round(arg_max(value, event_id) FILTER (WHERE event_type = 'error'), 6) + 0.0 AS error,
      round(arg_max(value, event_id) FILTER (WHERE event_type = 'signup'), 6) + 0.0 AS signup,
      round(arg_max(value, event_id) FILTER (WHERE event_type = 'purchase'), 6) + 0.0 AS purchase FROM s GROUP BY ALL""",
)
def pivot_fields(spark, d):
    s = tb.samples(spark, d).withColumn("day", F.floor(F.col("t_us") / 86_400_000_000))
    return rounded(ingest.pivot_fields(s, ["entity", "day"], ["click", "view", "error", "signup", "purchase"]))


@query(
    "cap_per_group",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 6",
)
def cap_per_group(spark, d):
    return ingest.cap_per_group(tb.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
