"""Exact top-k by inner product: an index of impact-ordered segments for each shard, gone through score at a time."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import ROWS_PER_BUCKET, materialize, shared_folder
from .common import shared

#: Rows of a shard (about, by hash of the id), queries of one pass over the index, and rows that give a first threshold.
SHARD, QUERIES, FIRST = 8192, 4096, 4096
#: Widths of the value classes (segments): a class is one step of quantised impact.
STEP = 32
#: Components this large are left out with their vector: their products could pass 64 bits.
LARGEST = 1 << 26
ROUNDS = 24


def integers(rows: DataFrame, vec: str, id_col: str, scale: int = 1024) -> DataFrame:
    """(id, v, d): floor(scale * x) of every component, and their number. Rows without id or vector, or with a component that is null,
    not finite or (scaled) of LARGEST or more in size, take no part."""
    x = F.transform(F.col(f"`{vec}`"), lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall(F.col(f"`{vec}`"), lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)))
    ok = rows.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(fine, F.lit(False)))
    return ok.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.cast("array<int>").alias("v")).withColumn("d", F.size("v"))


@dataclass
class Index:
    """Of one shard: ``segs`` (dimension, lowest and highest value, begin and end in ``rows``), and the vectors of its rows."""

    ids: np.ndarray
    vectors: np.ndarray
    dim: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    def top(self, q: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` rows of greatest inner product with ``q``, ties to smaller ids, leaving out the id ``own`` and scores under ``least``.

        Segments are taken by falling impact, the most that a value of theirs adds to the score. Each row holds the impact it has met and the
        number of its values met; one not yet met adds no more than the segment next in turn. The search stops once so few rows can still reach the
        threshold that the exact scores of them all are cheaper than more segments; the threshold rises with exact scores on the way.
        """
        n, used = len(self.ids), int(np.count_nonzero(q))
        slack = float(np.abs(q).sum()) * float(np.abs(self.vectors).max(initial=0)) * 2.0**-40  # sums of doubles may be off by less
        most = np.maximum(q[self.dim] * self.lo, q[self.dim] * self.hi)
        turn = np.argsort(-most, kind="stable")
        turn = turn[q[self.dim[turn]] != 0]
        size = (self.end - self.begin)[turn]
        stops = np.searchsorted(np.cumsum(size), np.arange(1, ROUNDS + 1) * (size.sum() / ROUNDS) - 1e-9) + 1 if len(turn) else []
        met, score, alive, at = np.zeros(n), np.zeros(n), np.arange(n), 0
        others = self.ids != own
        for stop in stops:
            stop = min(int(stop), len(turn))
            now = turn[at:stop]
            if len(now):
                rows = np.concatenate([self.rows[a:b] for a, b in zip(self.begin[now], self.end[now])])
                score += np.bincount(rows, np.repeat(most[now].astype(float), size[at:stop]), n)
                met += np.bincount(rows, minlength=n)
            at = stop
            ahead = float(most[turn[at]]) if at < len(turn) else 0.0
            reach = score[alive] + (used - met[alive]) * ahead
            if least is None:  # no threshold yet: exact scores of the most promising rows give one
                hopeful = alive[np.argsort(-reach, kind="stable")[: 4 * k + 1]]
                exact = np.sort((self.vectors[hopeful] @ q)[others[hopeful]])[::-1]
                least = int(exact[k - 1]) if len(exact) >= k else None
            if least is not None:
                alive = alive[reach >= least - slack]
            if len(alive) <= max(4 * k, n // 16):
                break
        alive = alive[others[alive]]
        exact = self.vectors[alive] @ q
        if least is not None:
            alive, exact = alive[exact >= least], exact[exact >= least]
        first = np.lexsort((self.ids[alive], -exact))[:k]
        return self.ids[alive[first]], exact[first]


def segments(step: int):
    """Vectors of one shard to its index: one row a segment (dimension, class of ``step`` values, its extremes, members), by falling class,
    and one (dim -1) with the ids. A member is the number of a row in the shard and its value, so the segments hold the vectors too."""

    def run(table):
        import pyarrow as pa

        ids, vectors = _distinct(table)
        shard, d = table["shard"][0].as_py(), table["d"][0].as_py()
        out = {c: [] for c in ("shard", "d", "dim", "level", "members", "vals")}

        def add(dim, level, members, vals):
            for c, x in zip(out, (shard, d, dim, level, members, vals)):
                out[c].append(x)

        add(-1, 0, ids, [])
        for j in range(d):
            order = np.argsort(-vectors[:, j], kind="stable")
            level = vectors[order, j] // step
            for part in np.split(order, np.flatnonzero(np.diff(level)) + 1):
                add(j, int(vectors[part[0], j] // step), part, vectors[part, j])
        longs = pa.list_(pa.int64())
        kinds = dict(shard=pa.int64(), d=pa.int32(), dim=pa.int32(), level=pa.int64(), members=longs, vals=longs)
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    return run


def _distinct(table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors by id; of rows that share an id the smallest vector stays."""
    ids, d = table["id"].to_numpy(), table["d"][0].as_py()
    flat = table["v"].combine_chunks()
    vectors = np.asarray(flat.flatten(), np.int64).reshape(len(ids), d)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    return ids[first], vectors[first]


def _index(table) -> Index:
    dim, begin = table["dim"].to_numpy(), None
    members, vals = table["members"].combine_chunks(), table["vals"].combine_chunks()
    at = np.flatnonzero(dim < 0)[0]
    ids = np.asarray(members[at].values, np.int64)
    segs = np.flatnonzero(dim >= 0)
    taken = members.take(segs), vals.take(segs)
    rows, flat = (np.asarray(x.flatten(), np.int64) for x in taken)
    size = np.diff(np.asarray(taken[0].offsets, np.int64))
    end = np.cumsum(size)
    begin = end - size
    d = table["d"][0].as_py()
    vectors = np.zeros((len(ids), d), np.int64)
    vectors[rows, np.repeat(dim[segs], size)] = flat
    hi = np.maximum.reduceat(flat, begin) if len(flat) else flat
    lo = np.minimum.reduceat(flat, begin) if len(flat) else flat
    return Index(ids, vectors, dim[segs], lo, hi, begin, end, rows)


def _searched(queries, k: int):
    """Answers of one shard to a block of queries: ``queries`` is a broadcast (ids, vectors, thresholds) by number of components."""

    def run(table):
        import pyarrow as pa

        index, out = _index(table), [[], [], []]
        for own, q, least in zip(*queries.value.get(table["d"][0].as_py(), ((), (), ()))):
            ids, scores = index.top(q, own, k, least)
            for c, x in zip(out, (np.full(len(ids), own), ids, scores)):
                c.append(x)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), flat)})

    return run


def _thresholds(sample, k: int):
    """Adds to each query the k-th best exact score among the rows of the sample, below which no answer can lie."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            least = []
            for own, v, d in zip(batch["id"].to_pylist(), batch["v"].to_pylist(), batch["d"].to_pylist()):
                ids, vectors = sample.value.get(d, (np.zeros(0, np.int64), np.zeros((0, d), np.int64)))
                s = np.sort((vectors @ np.array(v, np.int64))[ids != own])
                least.append(int(s[-k]) if len(s) >= k else None)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], batch["d"], pa.array(least, pa.int64())], names=["id", "v", "d", "least"])

    return run


def _by_size(table) -> dict:
    """Rows of a small Arrow table (id, v, d) as arrays, by number of components."""
    d = np.asarray(table["d"])
    return {int(x): _distinct(table.filter(d == x)) for x in np.unique(d)}


def search(
    rows: DataFrame, every: int = 100, k: int = 10, vec: str = "embedding", id_col: str = "vec_id", scale: int = 1024, shard: int = SHARD, block: int = QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, the ``k`` other rows of greatest integer inner product.

    Ties go to smaller ids; fewer rows are all given. Vectors become integers first (see ``integers``) and meet only those of as many
    components. Rows that share an id are one, with the smallest of their vectors. The index is written once, each shard's segments together;
    blocks of queries of bounded size go to its shards, and only ``k`` rows a query and shard come back. The first thresholds come from FIRST
    rows and only save work. Tasks hold one shard.
    """
    spark = rows.sparkSession
    known = shared(integers(rows, vec, id_col, scale), "vectors")
    total = known.count()
    shards = max(1, -(-total // shard))
    dealt = known.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    kinds = "shard bigint, d int, dim int, level bigint, members array<bigint>, vals array<bigint>"
    index = dealt.groupBy("shard", "d").applyInArrow(segments(STEP), kinds)
    index = materialize(index, "impact_index", ["shard"], ["d"], shards * ROWS_PER_BUCKET // 4)  # four shards a bucket: read without a shuffle
    asked = known.where(F.col("id") % every == 0)
    first = known.orderBy(F.xxhash64("id", F.lit("first")), "id").limit(FIRST)  # FIRST rows to the driver at most
    sample = spark.sparkContext.broadcast(_by_size(first.toArrow()))
    asked = shared(asked.mapInArrow(_thresholds(sample, k), "id bigint, v array<int>, d int, least bigint"), "queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    folder = f"{shared_folder(spark)}/windrow/topk_{uuid.uuid4().hex}"
    for b in range(blocks):
        # Queries of one block, about ``block`` by hash: a bounded number of rows.
        part = asked.where(F.col("block") == b).select("id", "v", "d", "least").toArrow()
        d, least = np.asarray(part["d"]), dict(zip(part["id"].to_pylist(), part["least"].to_pylist()))
        held = {}
        for x in np.unique(d):
            ids, vectors = _distinct(part.filter(d == x))
            held[int(x)] = ids, vectors, [least[i] for i in ids.tolist()]
        queries = spark.sparkContext.broadcast(held)
        found = index.groupBy("shard", "d").applyInArrow(_searched(queries, k), "query_id bigint, vec_id bigint, score bigint")
        found.write.mode("append").parquet(folder)
        queries.unpersist()
    found = spark.read.schema("query_id bigint, vec_id bigint, score bigint").parquet(folder)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
