"""Secrets in documents: regex rules behind a trigram inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, only_with, shared
from .neardup import row_key


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, non-overlapping) count if their group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough: runs are maximal either way
)
#: Further kinds of credentials with a fixed shape.
MORE = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("host_token", r"(?:ghp|gho|ghs)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
MAX_ALTERNATIVES = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """What a match must contain: one of the sets of (lower-cased ASCII) trigrams, whole. None if nothing can be said.

    Literal runs are followed through groups, alternatives and optional parts; anything else ends a run.
    """
    from re import _constants as c
    from re import _parser

    def walk(nodes, alts):
        # An alternative is (finished runs, open run).
        for op, arg in nodes:
            if op is c.LITERAL and arg < 128:
                alts = [(done, run + chr(arg).lower()) for done, run in alts]
            elif op is c.SUBPATTERN:
                alts = walk(arg[-1], alts)
            elif op is c.BRANCH:
                alts = [x for branch in arg[1] for x in walk(branch, alts)]
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
                alts = alts + walk(arg[2], alts)
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and 0 < arg[0] <= 8:
                for _ in range(arg[0]):
                    alts = walk(arg[2], alts)
                if arg[1] != arg[0]:
                    alts = [((*done, run), "") for done, run in alts]
            elif op is c.AT:
                continue
            else:
                alts = [((*done, run), "") for done, run in alts]
            alts = list(dict.fromkeys(alts))
            if len(alts) > MAX_ALTERNATIVES:
                alts = list(dict.fromkeys(((*done, run), "") for done, run in alts))
        return alts

    out = {frozenset(r[i : i + 3] for r in (*done, run) for i in range(len(r) - 2)) for done, run in walk(_parser.parse(pattern), [((), "")])}
    return None if frozenset() in out or len(out) > MAX_ALTERNATIVES else sorted((s for s in out if not any(t < s for t in out)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """Postings (trigram, row_key) of the trigrams that the rules' queries name, over every whole text."""
    low = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    marks = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(row_key(text).alias("row_key"), low.alias("low")).select("row_key", F.explode(marks).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(row_key, kinds): the rules of which a row has all trigrams of one alternative: postings intersected by key."""
    had = postings.groupBy("row_key").agg(F.collect_set("trigram").alias("had"))  # at most the trigrams of the rules
    test = lambda alts: F.exists(
        F.array(*[F.array(*[F.lit(t) for t in sorted(a)]) for a in alts]), lambda a: F.size(F.array_except(a, F.col("had"))) == 0
    )
    kinds = F.array_compact(F.array(*[F.when(test(a), F.lit(k)) for k, a in queries.items()]))
    return had.select("row_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def matches(rules: tuple[Rule, ...], text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the rule), code points."""
    import re

    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern, text):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append((m.start(), m.end(), i))
    return out


def _verify(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows: row_key, text, kinds (null: every rule) -> row_key, kind, start, end."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], []]
            for key, text, kinds in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                mine = rules if kinds is None else tuple(r for r in rules if r.kind in kinds)
                for start, end, i in matches(mine, text.as_py() or ""):
                    for c, v in zip(out, (key, mine[i].kind, start, end)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["row_key", "kind", "start", "end"])

    return rows.mapInArrow(run, "row_key bigint, kind string, start bigint, end bigint")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """Each row's doc_id, row_key and ``spans``: array of (start, order of the rule, end, kind), sorted; code points, end exclusive.

    Rules with mandatory trigrams are verified only on rows whose postings meet their query, so only those texts are
    fetched (behind a filter of fixed size); rules without scan every text. Null and empty texts have no spans;
    rows equal in doc_id and text have the same spans. Overlaps between rules stay.
    """
    bounded_batches(docs.sparkSession)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(text).alias("row_key"), F.col(text).cast("string").alias("text"))
    found = _verify(src.select("row_key", "text", F.lit(None).cast("array<string>").alias("kinds")), tuple(r for r in rules if r.kind not in indexed))
    if indexed:
        postings = trigram_index(docs, sorted({t for q in indexed.values() for a in q for t in a}), text)
        hits = shared(candidates(postings, indexed), "candidates")
        texts = only_with(src.select("row_key", "text"), F.col("row_key"), hits, "row_key").join(hits, "row_key")
        found = found.unionByName(_verify(texts, tuple(r for r in rules if r.kind in indexed)))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)]), F.col("kind"))
    spans = found.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    out = src.select("doc_id", "row_key").join(spans, "row_key", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def spans_text(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
