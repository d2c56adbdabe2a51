"""Conversations of typed content parts as one training text each, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for: image patches, audio frames, tokens of a document's page."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 512


def text_part(text: Column) -> Column:
    """A message of plain text as its array of parts; null is empty."""
    rest = [F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages")]
    return F.array(F.struct(F.lit("text"), F.coalesce(text.cast("string"), F.lit("")), *rest)).cast(f"array<{PART}>")


def escaped(text: Column) -> Column:
    """No control string is left: each ``<|``, with any backslashes between, gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role within its line: backslashes are doubled and line ends written as ``\\n``."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    # Split at doubled backslashes first: what is left of them are line ends.
    return F.array_join(F.transform(F.split(unescaped(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _tokens(p: Column, e: Expansion) -> Column:
    n = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    image = F.greatest(F.lit(1), F.ceil(n(p["width"]) / e.patch) * F.ceil(n(p["height"]) / e.patch))
    audio = F.greatest(F.lit(1), F.ceil(n(p["seconds"]) * e.per_second))
    pages = F.greatest(F.lit(1), F.ceil(n(p["pages"])) * e.per_page)
    by = F.when(p["kind"] == "image", image).when(p["kind"] == "audio", audio).when(p["kind"] == "document", pages)
    return by.otherwise(F.lit(0)).cast("bigint")


def format_chat(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple = ("assistant",), expand: Expansion = Expansion()
) -> DataFrame:
    """One row a conversation: its text, where each turn lies in it, and what is attached.

    ``messages`` has one row a turn with ``parts`` (array of PART) in order. Text parts are escaped; image, audio
    and document parts (any other kind but text, too) become ``<|kind_i|>``, i counting a conversation's attachments from 0. Result:

    * conv_id, formatted: ``<|im_start|>role\\n...<|im_end|>\\n`` of each turn;
    * turns: array of (turn, role, start, length, body_start, body_length, loss), code points from 0 of ``formatted``; loss marks the roles in ``learn``;
    * attachments: array of (turn, kind, ref, start, tokens), start being the placeholder's place in ``formatted``; expanded_tokens: their sum.

    Null roles, parts and texts are empty. Turns go by ``turn`` (nulls first), equal ones by role and text; repeated rows are
    repeated turns. A null conv_id is a conversation of its own. A conversation is one row, so one task holds it whole.
    """
    m = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    media = lambda p: F.coalesce(p["kind"], F.lit("text")) != "text"
    plain = F.array_join(F.transform("parts", lambda p: F.when(media(p), F.concat(F.lit("\0"), p["kind"])).otherwise(F.coalesce(p["text"], F.lit("")))), "\0")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("plain", plain).withColumn("held", F.size(F.filter("parts", media)))
    m = m.withColumn("at", F.row_number().over(order)).withColumn("first", F.coalesce(F.sum("held").over(before), F.lit(0)))
    # The visitor: parts in order, with the number of attachments before each.
    seen = lambda i: F.size(F.filter(F.slice(F.col("parts"), F.lit(1), i), media))
    shown = F.transform(
        "parts",
        lambda p, i: F.struct(
            F.when(media(p), F.concat(F.lit("<|"), F.regexp_replace(p["kind"], r"[^A-Za-z0-9_]", "_"), F.lit("_"), (F.col("first") + seen(i)).cast("string"), F.lit("|>")))
            .otherwise(escaped(F.coalesce(p["text"], F.lit("")))).alias("out"),
            media(p).alias("media"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p, expand).alias("tokens"),
        ),
    )
    m = m.withColumn("shown", F.when(F.col("held") == 0, F.transform("parts", lambda p: F.struct(
        escaped(F.coalesce(p["text"], F.lit(""))).alias("out"), F.lit(False).alias("media"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.lit(0).cast("bigint").alias("tokens")
    ))).otherwise(shown))
    m = m.withColumn("body", F.array_join(F.transform("shown", lambda s: s["out"]), ""))
    m = m.withColumn("head", F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n")))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(CLOSE + "\n"))).withColumn("length", F.char_length("piece").cast("bigint"))
    m = m.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))
    body = F.col("start") + F.char_length("head")
    lead = lambda i: F.aggregate(F.slice(F.col("shown"), F.lit(1), i), F.lit(0).cast("bigint"), lambda a, s: a + F.char_length(s["out"]))
    held = F.when(F.col("held") > 0, F.filter(
        F.transform("shown", lambda s, i: F.struct(F.col("turn").alias("turn"), s["kind"].alias("kind"), s["ref"].alias("ref"), (body + lead(i)).alias("start"), s["tokens"].alias("tokens"), s["media"].alias("media"))),
        lambda a: a["media"],
    ))
    m = m.select(
        "conv_id", F.col("at"), "piece", held.alias("held"),
        F.struct("turn", "role", "start", "length", body.cast("bigint").alias("body_start"), F.char_length("body").cast("bigint").alias("body_length"), F.col("role").isin(*learn).alias("loss")).alias("span"),
    )
    out = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "span", "held"))).alias("t"))
    attached = F.flatten(F.transform(F.filter("t", lambda x: x["held"].isNotNull()), lambda x: x["held"]))
    attached = F.transform(attached, lambda a: F.struct(a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["start"].alias("start"), a["tokens"].alias("tokens")))
    return out.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.transform("t", lambda x: x["span"]).alias("turns"), attached.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """``messages`` array of (role, text, learned) from ``formatted`` alone and the loss marks of ``turns``; placeholders stay in the texts.

    The text is cut where a turn opens, which no escaped text can imitate.
    """
    piece = F.split("formatted", r"(?=<\|im_start\|>)")
    cut = F.transform(
        piece,
        lambda x, i: F.struct(
            F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1).alias("head"), x.alias("piece"), F.get(F.col("turns"), i).alias("span")
        ),
    )
    rest = lambda t: F.substr(t["piece"], F.lit(len(OPEN) + 2) + F.char_length(t["head"]))
    learned = lambda t: F.substr(t["piece"], (t["span"]["body_start"] - t["span"]["start"] + 1).cast("int"), t["span"]["body_length"].cast("int"))
    return formatted.withColumn("messages", F.transform(cut, lambda t: F.struct(
        unescaped_role(t["head"]).alias("role"), unescaped(F.substring_index(rest(t), CLOSE, 1)).alias("text"),
        F.when(t["span"]["loss"], unescaped(learned(t))).alias("learned"),
    )))
