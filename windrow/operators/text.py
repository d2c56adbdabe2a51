"""Text and JSON: window serialisation, lenient JSON extraction, key parsing, JSONL export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scan import corpus_keys
from .distance import history_future

# Fixed text: the two header lines of a serialised window.
HEADER = "Driving sensor log, 1 Hz, 60 s.\nt,speed_mps,accel_mps2,curv_1e3,yaw_dps,headway_s"
# Fixed value: headway shown when there is no lead, and the cap.
NO_LEAD = 9.9
# Fixed value: segment number of a name that has none.
NO_SEGMENT = 1 << 30


def fixed(x: Column, digits: int) -> Column:
    """A number with a fixed count of decimals; negative zero loses its sign."""
    return F.format_string(f"%.{digits}f", F.round(x, digits) + F.lit(0.0))


def _headway() -> Column:
    d, v = F.col("leadOne_dRel"), F.col("vEgo")
    return F.when((d > 0) & (v > 2), d / F.greatest(v, F.lit(2.0)))


def serialize_window(
    frames: DataFrame, n: int = 10, keys: Sequence[str] = ("win_id",), order: str = "pos", header: str = HEADER
) -> DataFrame:
    """One CSV text per window: header, then one line per n frames with mean values."""
    sec = F.floor(F.col(order) / n).cast("bigint").alias("_t")
    f = frames.withColumn("_thw", _headway())
    m = f.groupBy(*keys, sec).agg(
        *[F.avg(c).alias("_" + c) for c in ("vEgo", "aEgo", "actual_curvature", "yaw_rate")], F.avg("_thw").alias("_thw")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    line = F.concat_ws(
        ",",
        F.col("_t").cast("string"),
        fixed(zero(F.col("_vEgo")), 1),
        fixed(zero(F.col("_aEgo")), 2),
        fixed(zero(F.col("_actual_curvature")) * 1000, 2),
        fixed(zero(F.col("_yaw_rate")), 2),
        fixed(F.least(F.coalesce("_thw", F.lit(NO_LEAD)), F.lit(NO_LEAD)), 1),
    )
    rows = m.select(*keys, F.struct("_t", line.alias("line")).alias("_l"))
    text = F.array_join(F.array_sort(F.collect_list("_l")).getField("line"), "\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit(header + "\n"), text).alias("text"))


def serialize_history(
    frames: DataFrame,
    anchors: DataFrame,
    hist: int = 50,
    rate: float = 10.0,
    keys: Sequence[str] = ("win_id",),
    order: str = "pos",
    bounded: bool = False,
) -> DataFrame:
    """One CSV text per anchor: the hist frames before it, with time relative to the anchor. ``bounded``: as in ``history_future``."""
    h = history_future(frames, anchors, hist, 0, keys, order, bounded)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    line = F.concat_ws(
        ",",
        fixed((F.col("step") - 1 - hist) / rate, 1),
        fixed(zero("vEgo"), 1),
        fixed(zero("aEgo"), 2),
        fixed(zero("actual_curvature") * 1000, 2),
        fixed(zero("yaw_rate"), 2),
        fixed(F.least(F.coalesce(_headway(), F.lit(NO_LEAD)), F.lit(NO_LEAD)), 1),
    )
    rows = h.select(*anchors.columns, F.struct("step", line.alias("line")).alias("_l"))
    text = F.array_join(F.array_sort(F.collect_list("_l")).getField("line"), "\n")
    return rows.groupBy(*anchors.columns).agg(text.alias("text"))


def extract_json(df: DataFrame, col: str, schema: StructType | str, out: str = "parsed") -> DataFrame:
    """Parse the text from the first "{" to the last "}"; null where that is no valid JSON object."""
    body = F.regexp_extract(col, r"(?s)\{.*\}", 0)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    ok = (body != "") & F.try_parse_json(body).isNotNull()
    return df.withColumn(out, F.when(ok, F.from_json(body, ddl)))


def json_counts(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Texts parsed and failed."""
    return df.agg(
        F.count_if(F.col(parsed).isNotNull()).alias("ok"), F.count_if(F.col(parsed).isNull()).alias("fail")
    )


def jsonl_lines(samples: DataFrame, id: Column, label: Column, text: str = "text") -> DataFrame:
    """JSON lines {id, label, text}."""
    return samples.select(F.to_json(F.struct(id.alias("id"), label.alias("label"), F.col(text).alias("text"))).alias("value"))


def export_jsonl(samples: DataFrame, path: str, id: Column, label: Column, text: str = "text") -> None:
    """Write the JSON lines as text files."""
    jsonl_lines(samples, id, label, text).write.text(path)


def parse_keys(df: DataFrame, path_col: str) -> DataFrame:
    """Group, entity and route from a corpus path; segment number from a name like "12--rest"."""
    keys = corpus_keys(F.col(path_col))
    name = F.element_at(F.split(path_col, "/"), -1)
    seg = F.expr("try_cast(nullif(regexp_extract(_name, '^([0-9]+)--', 1), '') AS BIGINT)")
    out = df.select("*", *keys, name.alias("_name"))
    return out.withColumn("segment", F.coalesce(seg, F.lit(NO_SEGMENT).cast("bigint"))).drop("_name")


def scenario_of_key(df: DataFrame, key: str = "key", out: str = "scenario") -> DataFrame:
    """First part of a match key."""
    return df.withColumn(out, F.split(key, r"\|")[0])
