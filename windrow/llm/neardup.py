"""Near-duplicate documents by b-bit MinHash: bands give candidates, packed low bits estimate, full sets decide."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import attach, bounded_batches, fresh, only_with, shared
from .graph import components, joined

BANDS, BAND_ROWS = 32, 5
#: Pairs whose estimate is under the threshold by more than four standard errors of it are not looked at.
ERRORS = 4.0
#: Members that meet in one task at a time, and members of a cluster that join every block of it.
BLOCK, HUBS = 64, 8
#: Members of one band whose packed minima meet in one task at a time.
BAND_BLOCK = 1024
#: Bytes of text, cells of a matrix, and rows of a block that a worker holds at a time: the arrays made of them stay at a few MB.
TEXT, CELLS, STRIP = 1 << 18, 1 << 20, 64


def signatures(docs: DataFrame, text: str = "text", size: int = 2) -> DataFrame:
    """(doc_id, row_key, n, set_id, bands, bits): one row a document.

    ``n`` distinct shingles of ``size`` words; ``set_id`` 16 bytes that are equal for equal sets, null without
    words; ``bands`` a hash of every five minima; ``bits`` the two low bits of all 160 minima, packed in five BIGINTs.
    """
    k = BANDS * BAND_ROWS

    def run(batches):
        import pyarrow as pa

        words = kernels.space_words()
        rng = np.random.default_rng(7)
        mul = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
        add = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        place = np.uint64(2) * np.arange(32, dtype=np.uint64)
        for batch in batches:
            parts = []
            for a, b, off, data in kernels.text_chunks(batch.column(2), TEXT):
                sets, at = kernels.bigram_sets(off, data, words, size)
                has = at[1:] > at[:-1]
                begin = at[:-1][has]
                x = (sets >> np.uint64(20)).astype(np.uint32)
                least = np.zeros((b - a, k), np.uint32)
                for i in range(k if len(begin) else 0):
                    least[has, i] = np.minimum.reduceat((x ^ add[i]) * mul[i], begin)
                h = np.zeros((b - a, BANDS), np.uint64)
                for j in range(BAND_ROWS):
                    h = kernels.mix(h + least[:, j::BAND_ROWS] + np.arange(BANDS, dtype=np.uint64))
                low = (least & 3).reshape(b - a, -1, 32).astype(np.uint64)
                bits = np.bitwise_or.reduce(low << place, axis=2).view(np.int64)
                parts.append((np.diff(at), _set_ids(sets, at), h.view(np.int64), bits))
            if not parts:
                continue
            n = np.concatenate([p[0] for p in parts])
            ids = [i for p in parts for i in p[1]]
            h, bits = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
            listed = lambda m: pa.ListArray.from_arrays(
                np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(ids, pa.binary()), listed(h), listed(bits)],
                names=["doc_id", "row_key", "n", "set_id", "bands", "bits"],
            )

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(text).alias("row_key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, row_key bigint, n bigint, set_id binary, bands array<bigint>, bits array<bigint>")


def row_key(text: str = "text"):
    """Tells rows apart by doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col(text).cast("string"), F.lit("")))


def _set_ids(sets: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits of every set: two sums of scrambled members."""
    has = at[1:] > at[:-1]
    out = np.zeros((len(at) - 1, 2), np.uint64)
    if has.any():
        out[has, 0] = np.add.reduceat(kernels.mix(sets), at[:-1][has])
        out[has, 1] = np.add.reduceat(kernels.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][has])
    raw = out.tobytes()
    return [raw[16 * i : 16 * i + 16] if h else None for i, h in enumerate(has)]


def estimate(a: str, b: str):
    """Similarity by the share of equal two-bit cells, corrected for cells that agree by chance (one in four)."""
    low = F.lit(0x5555555555555555).cast("bigint")
    unequal = F.lit(0)
    for i in range(BANDS * BAND_ROWS // 32):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
    return (F.lit(0.75) - unequal / F.lit(float(BANDS * BAND_ROWS))) / F.lit(0.75)


def least_estimate(similarity: float) -> float:
    p = similarity + (1 - similarity) / 4
    return similarity - ERRORS * (p * (1 - p) / (BANDS * BAND_ROWS)) ** 0.5 / 0.75


def near_duplicates(docs: DataFrame, similarity: int = 80, size: int = 2, text: str = "text") -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, set_id) of every row.

    Documents are linked if their sets of ``size``-word shingles (words between ASCII white space, A-Z
    lower-cased) have 100 * intersection >= ``similarity`` * union; ``component_id`` is the smallest doc_id
    that links reach. Null and wordless texts have no shingles and reach only their own doc_id; null doc_ids
    never become a component_id unless there is no other. Rows of equal sets are one class from the start.

    Candidates: classes that share a band (32 bands of 5 minima: a pair at 0.8 is missed once in 300,000) and whose
    two-bit estimate does not lie four standard errors under the threshold. They are gathered into clusters by
    links to one member of each bucket; links between clusters within a bucket are then added. In a cluster
    all pairs are decided on the full sets, in blocks: first each block with a few members that visit all
    blocks, then what did not yet join the main part against all blocks. Only pairs within one confirmed
    component are left out, and no pair leaves a task but the links of stars around the least members.

    Runs jobs while it is built: tables in the shared folder cut the lineage.
    """
    bounded_batches(docs.sparkSession)
    sig = shared(signatures(docs, text, size), "signatures")
    total = sig.count()
    classes = shared(
        sig.where("set_id is not null").groupBy("set_id").agg(
            F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"),
            F.first("bands").alias("bands"), F.first("bits").alias("bits"),
        ),
        "classes",
    )
    root = _roots(docs, classes, similarity, size, text)
    member = classes.select("set_id", "rows", "least_id").join(root.withColumnRenamed("id", "set_id"), "set_id", "left")
    member = shared(member.withColumn("root", F.coalesce("root", "set_id")), "members")
    least = member.where("root <> set_id or rows > 0").groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("parts"))
    named = attach(member.select("set_id", "rows", "root"), least, "root", "parts", total)
    out = attach(
        sig.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "set_id"),
        shared(named.select("set_id", "rows", "component_id"), "named"), "set_id", "rows", total,
    )
    return out.select(
        "doc_id", "row_key", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "set_id"
    )


def _roots(docs: DataFrame, classes: DataFrame, similarity: int, size: int, text: str) -> DataFrame:
    """(id, root) of the classes with links: the components of the graph of all confirmed links."""
    enough = least_estimate(similarity / 100)
    keyed = classes.select("set_id", F.explode("bands").alias("band"))
    # The least member leads: of a cluster it is the same one in most of its bands, so few links and turns are needed.
    buckets = shared(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("set_id").alias("lead")).where("n > 1"), "buckets")
    inside = shared(only_with(keyed, F.col("band"), buckets, "band"), "inside")
    bits = classes.select("set_id", "bits")
    star = inside.join(buckets, "band").where("lead <> set_id").select("set_id", "lead").repartition("set_id").distinct()
    star = star.join(bits, "set_id").join(bits.select(F.col("set_id").alias("lead"), F.col("bits").alias("lead_bits")), "lead")
    star = shared(star.where(estimate("bits", "lead_bits") >= enough).select(F.col("set_id").alias("u"), F.col("lead").alias("v")), "stars")
    cluster = components(star)
    # Pairs in one bucket that the leads did not bring together.
    at = inside.join(cluster.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = at.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = mixed.groupBy("band").agg(
        F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("rest")
    ).where("parts > 1")
    at = shared(at.join(mixed.drop("parts"), "band").join(bits, "set_id"), "mixed")
    more = shared(_across(at, enough), "across")
    if not more.isEmpty():
        cluster = joined(cluster, more)
    cluster = shared(cluster, "clusters")

    # Texts of the classes in clusters, dealt to blocks.
    want = shared(cluster.join(classes.select(F.col("set_id").alias("id"), "row_key"), "id"), "wanted")
    own = only_with(docs.select("doc_id", F.col(text).cast("string").alias("text")), row_key("text"), want, "row_key")
    rows = own.withColumn("row_key", row_key("text")).dropDuplicates(["row_key"]).join(want, "row_key")
    many = cluster.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    rows = rows.join(many.withColumn("blocks", F.ceil(F.col("members") / BLOCK)), "root")
    rows = shared(rows.select("root", "id", "text", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")), "texts")
    big = rows.where("blocks > 1")
    # Visitors to all blocks of a cluster: the members of least hash, about HUBS of them.
    hubs = big.where(F.pmod(F.xxhash64(F.lit("hub"), "id"), F.col("blocks") * (BLOCK // HUBS)) == 0)
    hubs = hubs.select("root", "id", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    met = rows.select("root", "block", "id", "text").unionByName(hubs.select("root", "block", "id", "text"))
    found = shared(components(_decide(met, ["root", "block"], similarity, size)), "parts")
    if big.isEmpty():
        return found
    part = found.withColumnRenamed("root", "part")
    left = big.drop("text").join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
    main = left.groupBy("root", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("root").agg(F.max_by("part", F.struct("k", "part")).alias("main"))
    left = shared(left.join(main, "root"), "left")
    rest = left.where("part <> main").groupBy("root").agg(F.count(F.lit(1)).alias("rest"))
    if rest.isEmpty():
        return found
    # What is not in the main part is dealt anew to blocks, and each meets every block of its cluster.
    rest = rest.withColumn("groups", F.ceil(F.col("rest") / BLOCK))
    whole = left.join(big.select("id", "text"), "id").join(rest, "root")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    visit = whole.where("part <> main").withColumn("group", F.pmod(F.xxhash64(F.lit("rest"), "id"), F.col("groups"))).withColumn("block", each("blocks"))
    host = whole.withColumn("group", each("groups"))
    cols = ["root", "block", "group", "id", "text", "part"]
    met = visit.select(*cols).unionByName(host.select(*cols))
    return joined(found, _decide(met, ["root", "block", "group"], similarity, size))


def _across(at: DataFrame, enough: float) -> DataFrame:
    """Links (u, v) between clusters: members of one band, of unlike ``root``, whose estimate is at least ``enough``.

    ``at``: band, set_id, bits, root, the band's ``main`` root, its members ``n`` and those outside main ``rest``. Only what lies outside main
    meets the others. Bands of up to ``BAND_BLOCK`` members are a join on the band; the members of larger ones are dealt to
    blocks, and what lies outside main to groups, each of which meets each block in a task of its own that gives back one star for all
    clusters it joins. So a band that most texts share, all of them unlike, makes no pair rows and no large key.
    """
    few = F.col("n") <= BAND_BLOCK
    other = at.where(few).select("band", F.col("set_id").alias("v"), F.col("root").alias("v_root"), F.col("bits").alias("v_bits"), F.col("main").alias("v_main"))
    pairs = at.where(few).where("root <> main").join(other, "band").where("root <> v_root and (v_root = v_main or set_id < v)")
    pairs = pairs.where(estimate("bits", "v_bits") >= enough).select(F.col("set_id").alias("u"), "v")
    many = at.where(~few).withColumn("blocks", F.ceil(F.col("n") / BAND_BLOCK)).withColumn("groups", F.ceil(F.col("rest") / BAND_BLOCK))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64(F.lit(c), "set_id"), F.col(c))
    cols = ["band", "group", "block", "set_id", "root", "bits", "visits"]
    visit = many.where("root <> main").select("*", dealt("groups").alias("group"), each("blocks").alias("block"), F.lit(True).alias("visits"))
    host = many.select("*", dealt("blocks").alias("block"), each("groups").alias("group"), F.lit(False).alias("visits"))
    met = visit.select(cols).unionByName(host.select(cols))

    def run(t):
        import pyarrow as pa

        ids, roots = t["set_id"].to_pylist(), t["root"].to_pylist()
        _, first, code = np.unique(np.array([int.from_bytes(r, "big") for r in roots], dtype=object), return_index=True, return_inverse=True)
        words = t["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        visits = t["visits"].to_numpy()
        a, b = np.flatnonzero(visits), np.flatnonzero(~visits)
        near = np.empty((len(a), len(b)), bool)
        for k in range(0, len(a), STRIP):
            strip = a[k : k + STRIP]
            unequal = np.zeros((len(strip), len(b)), np.int16)
            for w in words.T:
                x = w[strip][:, None] ^ w[b][None, :]
                unequal += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
            near[k : k + STRIP] = (0.75 - unequal / float(BANDS * BAND_ROWS)) / 0.75 >= enough
            near[k : k + STRIP] &= code[strip][:, None] != code[b][None, :]
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        # One link of each pair of clusters, then a star of what they join.
        width = int(code.max()) + 1 if len(code) else 1
        _, one = np.unique(np.minimum(code[i], code[j]) * width + np.maximum(code[i], code[j]), return_index=True)
        head = np.arange(width)

        def top(c):
            while head[c] != c:
                head[c] = head[head[c]]
                c = head[c]
            return c

        for k in one:
            x, y = top(code[i[k]]), top(code[j[k]])
            head[max(x, y)] = min(x, y)
        low = [c for c in range(len(first)) if head[c] != c]
        u, v = [ids[first[c]] for c in low], [ids[first[top(c)]] for c in low]
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    parts = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["band", "group", "block"]
    links = met.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, "u binary, v binary")
    return pairs.unionByName(links).distinct()


def _decide(met: DataFrame, keys: list[str], similarity: int, size: int) -> DataFrame:
    """Links (u, v) among the texts that meet under a key, decided on full sets: each component in it is a star around its least id.

    With a column ``part``, rows of one part count as joined already, and the links are between parts.
    """

    def run(t):
        import pyarrow as pa

        n = len(t)
        words = kernels.space_words()
        parts = [kernels.bigram_sets(off, data, words, size) for _, _, off, data in kernels.text_chunks(t["text"].combine_chunks(), TEXT)]
        sets = np.concatenate([p[0] for p in parts])
        count = np.concatenate([np.diff(p[1]) for p in parts])
        at = np.concatenate(([0], np.cumsum(count)))
        ids = t["id"].to_pylist()
        true = [i == j for i, j in zip(ids, _set_ids(sets, at))]  # another row with this row_key
        _, which = np.unique(sets, return_inverse=True)
        owner = np.repeat(np.arange(n), count)
        width = int(which.max()) + 1 if len(which) else 1
        step = max(1, CELLS // n)
        common = np.zeros((n, n), np.float64)
        order = np.argsort(which, kind="stable")
        which, owner = which[order], owner[order]
        for a in range(0, width, step):
            i, j = np.searchsorted(which, (a, a + step))
            m = np.zeros((n, min(step, width - a)), np.float32)
            m[owner[i:j], which[i:j] - a] = 1
            common += m @ m.T
        union = count[:, None] + count[None, :] - common
        near = np.argwhere(np.triu(100 * common >= similarity * union, 1))
        label = t["part"].to_pylist() if "part" in t.column_names else ids
        head = {}

        def top(x):
            while head.get(x, x) != x:
                head[x] = head.get(head[x], head[x])
                x = head[x]
            return x

        for i, j in near:
            a, b = top(label[i]), top(label[j])
            if a != b and true[i] and true[j]:
                head[max(a, b)] = min(a, b)
        u = list(head)
        v = [top(x) for x in u]
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    # The work is in Python, and much for few bytes: use every shuffle partition.
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, "u binary, v binary")


def one_of_each(docs: DataFrame, similarity: int = 80, size: int = 5, text: str = "text") -> DataFrame:
    """``docs`` in its own columns with one row of each group of near copies: that of the smallest doc_id.

    Rows with a null doc_id come last; rows equal in doc_id and text are repeats of which one stays;
    documents without words all stay.
    """
    found = shared(near_duplicates(docs, similarity, size, text).where("set_id is not null"), "found")
    rows = found.groupBy("component_id", "row_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    keep = shared(rows.groupBy("component_id").agg(F.min_by(F.struct("row_key", "n"), order).alias("k")).select("k.*"), "keep")
    lose = found.select("row_key").distinct().join(keep.select("row_key"), "row_key", "left_anti")
    twice = keep.where("n > 1").select("row_key")
    out = only_with(docs, row_key(text), lose.unionByName(twice), "row_key", "anti")
    if twice.isEmpty():
        return out
    k = fresh(docs, "row_key")
    again = only_with(docs, row_key(text), twice, "row_key").withColumn(k, row_key(text)).dropDuplicates([k]).drop(k)
    return out.unionByName(again)
