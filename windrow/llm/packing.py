"""Packing token sequences: best-fit decreasing with a segment tree over the remaining capacities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, shared

END = 2
#: Pieces of text whose ids a worker process remembers (about 200 bytes each).
MEMORY = 200_000
#: Items that one task packs at a time. Each group leaves one sequence partly filled at most, so the loss is about one in GROUP / 2.
GROUP = 8192


def encoder(path: str | None):
    """text -> its ids as little-endian 32-bit bytes, by the byte-level BPE file at ``path`` (default: the public 50k one).

    A text is cut at single spaces between non-spaces, where its pre-tokens end anyway; the ids of the pieces are
    remembered, since words repeat. New pieces go through tiktoken, with vocabulary and merges read from the same
    file (the tests compare whole texts with ``tokenizers``); texts with other white space beside a space, and those that hold
    a control string of the vocabulary, go through ``tokenizers`` whole.

    One encoder is kept in a worker process for all its tasks.
    """
    import sys
    import types

    kept = sys.modules.setdefault("windrow_piece_encoders", types.ModuleType("windrow_piece_encoders")).__dict__
    if path not in kept:
        kept[path] = _encoder(path)
    return kept[path]


def _encoder(path: str | None):
    import json
    from array import array
    from functools import cache

    import tiktoken
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    @cache  # seldom needed, and large
    def whole() -> Tokenizer:
        return Tokenizer.from_file(path)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of byte-level BPE files
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def raw(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    class Memory(dict):
        """Piece -> ids of a space and the piece; a bounded number of them."""

        def __missing__(self, piece: str) -> bytes:
            if not piece or piece.strip() != piece:  # white space beside a space
                raise LookupError
            if len(self) > MEMORY:
                self.clear()
            ids = self[piece] = raw(fast.encode_ordinary(" " + piece))
            return ids

    memory = Memory()

    def encode(text: str) -> bytes:
        head, *pieces = text.split(" ")
        try:
            if any(s in text for s in special):
                raise LookupError
            if pieces and (not head or head.rstrip() != head):
                raise LookupError
            return raw(fast.encode_ordinary(head)) + b"".join([memory[p] for p in pieces])
        except LookupError:
            return raw(whole().encode(text, add_special_tokens=False).ids)

    return encode


def pieces(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, text: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and the end id, in pieces of at most ``size``.

    Only longer documents are cut, into pieces of exactly ``size`` behind a first one that takes the remainder.
    A null or empty text is one piece of the end id alone. ``ids_crc32`` is over the ids as little-endian 32 bits.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        import zlib

        import pyarrow as pa

        encode = encoder(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows, arrays = [], []
            for i in range(len(ids)):
                raw = encode(texts[i].as_py() or "") + end
                n = len(raw) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                view = memoryview(raw)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = view[4 * a : 4 * b]
                    rows.append((ids[i], k, a, b - a, zlib.crc32(part)))
                    if with_ids:
                        arrays.append(np.frombuffer(part, "<i4"))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(arrays, pa.list_(pa.int32()))] * with_ids, names=names)

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return src.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each to the open bin with the least room that holds it, else to a new one.

    The segment tree has a leaf for each room size and counts open bins of that room; the tightest is found going up
    and down, in logarithmic time.
    """
    leaves = 1 << size.bit_length()
    tree = np.zeros(2 * leaves, np.int64).tolist()
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def add(room: int, by: int) -> None:
        i = leaves + room
        while i:
            tree[i] += by
            i >>= 1

    def tightest(need: int) -> int:
        i = leaves + need
        if tree[i]:
            return need
        while i > 1 and not (i % 2 == 0 and tree[i + 1]):
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < leaves:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - leaves

    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = tightest(need)
        if room < 0:
            b, room, opened = opened, size, opened + 1
        else:
            b = stacks[room].pop()
            add(room, -1)
        bins[k], offset[k] = b, size - room
        if room > need:
            stacks[room - need].append(b)
            add(room - need, 1)
    return bins, offset


def pack(parts: DataFrame, size: int = 1024, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (replacing columns of these names) to pieces (a ``length`` of 1 to ``size`` and any other columns).

    Repeated pieces are packed each; no pieces, no sequences.

    Full pieces are sequences of their own and stay where they are. The others are dealt by hash into groups of about
    ``group``, however many there are; a task packs one group at a time. Deterministic but for the numbers.
    """
    from pyspark.sql.types import LongType, StructType

    # The written rows fix the order of partitions, so that the numbers stay the same when a task is run again.
    parts = shared(parts.drop("sequence_id", "offset"), "pieces")
    full = parts.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    rest = parts.where(F.col("length") < size)
    groups = max(1, round(rest.count() / group))
    dealt = fresh(parts, "pack_group")
    rest = rest.withColumn(dealt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = StructType(parts.schema.fields).add("sequence_id", LongType()).add("offset", LongType())

    def run(key, t):
        import pyarrow as pa

        bins, offset = best_fit(t["length"].to_numpy(), size)
        t = t.drop_columns([dealt])
        return t.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    return full.select(*schema.names).unionByName(rest.groupBy(dealt).applyInArrow(run, schema))
