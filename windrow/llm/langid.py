"""Language of a text: a small byte convolutional network, trained in numpy, applied to windows of the whole text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 8, 8
#: Training bounds: rows of each language (about), languages, and windows of each row.
ROWS_PER_LANG, MAX_LANGS, WINDOWS_PER_ROW = 600, 200, 2
UNKNOWN = "und"


@dataclass
class Net:
    """Byte embeddings, filters of each width, and the softmax layer over the pooled maxima."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def training_rows(docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", rows: int = ROWS_PER_LANG) -> DataFrame:
    """(lang, text, id): of each language about ``rows`` labelled rows, of those with crc32(doc_id) mod 5 not 0.

    Rows are counted by language; then each stays by a hash of its id, at the rate that leaves ``rows`` of its language. The
    MAX_LANGS most frequent languages are learned.
    """
    crc = F.crc32(F.col(id_col).cast("string"))
    own = docs.where(f"`{lang}` is not null").where(crc % 5 != 0).select(
        F.col(lang).cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("string").alias("id")
    )
    rate = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).select("lang", (F.lit(float(rows)) / F.col("count")).alias("rate"))
    draw = F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 24)) / float(1 << 24)
    return own.join(F.broadcast(rate), "lang").where(draw < F.col("rate")).select("lang", "text", "id")


def train(docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", rows: int = ROWS_PER_LANG, epochs: int = 12) -> Net | None:
    """Fit the network on a bounded sample of labelled rows; None without any."""

    def windows(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            out = [[], []]
            for name, text, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                for j in range(min(WINDOWS_PER_ROW, 1 + len(raw) // WINDOW)):
                    at = zlib.crc32(f"{key}:{j}".encode()) % max(1, len(raw) - WINDOW + 1)
                    out[0].append(name)
                    out[1].append(raw[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], names=["lang", "bytes"])

    got = training_rows(docs, lang, id_col, rows).mapInArrow(windows, "lang string, bytes binary").orderBy("lang", "bytes").toPandas()
    return fit(list(got["lang"]), [bytes(b) for b in got["bytes"]], epochs) if len(got) else None


def _grid(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(b.ljust(WINDOW, b" ") for b in raw), np.uint8).reshape(-1, WINDOW)


def fit(labels: list[str], raw: list[bytes], epochs: int = 12, seed: int = 5) -> Net:
    """Adam on the cross entropy, classes weighted evenly. Some windows are cut short, as short texts are."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    x = _grid(raw).copy()
    weight = len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))[y]
    f, d = len(WIDTHS) * FILTERS, EMBED
    p = {"embed": rng.normal(0, 0.3, (256, d)), "bias": np.zeros(f), "out": rng.normal(0, 0.1, (f, len(langs))), "out_bias": np.zeros(len(langs))}
    p |= {w: rng.normal(0, (w * d) ** -0.5, (w * d, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 64):
            pick = order[a : a + 64]
            b = x[pick].copy()
            for i in np.flatnonzero(rng.random(len(pick)) < 0.4):
                b[i, rng.integers(8, WINDOW) :] = 32
            g = _gradient(p, b, y[pick], weight[pick].astype(np.float32))
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                p[k] -= 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Net(langs, p["embed"], [p[w] for w in WIDTHS], p["bias"], p["out"], p["out_bias"])


def _gradient(p: dict, b: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    n, d = len(b), EMBED
    e = p["embed"][b]
    pooled, best, views = [], [], []
    for w in WIDTHS:
        v = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
        r = v @ p[w]
        best.append(r.argmax(1))
        pooled.append(np.take_along_axis(r, best[-1][:, None], 1)[:, 0])
        views.append(v)
    z = np.concatenate(pooled, 1) + p["bias"]
    act = np.maximum(z, 0)
    logit = act @ p["out"] + p["out_bias"]
    q = np.exp(logit - logit.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    q[np.arange(n), y] -= 1
    q *= (weight / n)[:, None]
    g = {"out": act.T @ q, "out_bias": q.sum(0), "embed": np.zeros_like(p["embed"])}
    dz = (q @ p["out"].T) * (z > 0)
    g["bias"] = dz.sum(0)
    rows = np.arange(n)[:, None]
    for i, w in enumerate(WIDTHS):
        part = dz[:, i * FILTERS : (i + 1) * FILTERS]
        v = views[i][rows, best[i]]  # n, filters, w * d
        g[w] = np.einsum("nf,nfk->kf", part, v)
        back = part[:, :, None] * p[w].T[None]
        for j in range(w):
            np.add.at(g["embed"], b[rows, best[i] + j].ravel(), back[:, :, j * d : (j + 1) * d].reshape(-1, d))
    return g


def _tables(net: Net) -> list[list[np.ndarray]]:
    """For each width what one or two bytes add to every filter: pairs of bytes are looked up at once."""
    out = []
    for w, f in zip(WIDTHS, net.filters):
        one = [net.embed @ f[j * EMBED : (j + 1) * EMBED] for j in range(w)]
        two = [(one[j][:, None] + one[j + 1][None]).reshape(1 << 16, -1) for j in range(0, w - 1, 2)]
        out.append([np.ascontiguousarray(t, np.float32) for t in two + ([one[-1]] if w % 2 else [])])
    return out


def window_probabilities(net: Net, tables: list, b: np.ndarray) -> np.ndarray:
    """Softmax of every window (a row of WINDOW bytes)."""
    pair = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
    pooled = []
    for w, tabs in zip(WIDTHS, tables):
        n = WINDOW - w + 1
        r = tabs[0][pair[:, :n].T]  # position, window, filter: the maximum runs over whole slices
        for j, t in enumerate(tabs[1:], 1):
            r += t[(pair if len(t) > 256 else b)[:, 2 * j : 2 * j + n].T]
        pooled.append(r.max(0))
    act = np.maximum(np.concatenate(pooled, 1) + net.bias, 0)
    logit = act @ net.out + net.out_bias
    q = np.exp(logit - logit.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def identify(docs: DataFrame, net: Net | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to ``docs``, judging every window of the whole text.

    The score is the mean probability over windows, weighted by their bytes. ``und`` with score 0 for null texts,
    texts without a letter, and if nothing was there to learn from. Existing columns of these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    out = docs.drop("lang_pred", "score")
    names = out.columns
    at = names.index(text)
    schema = "lang_pred string, score double"
    from pyspark.sql.types import StructType

    whole = StructType(out.schema.fields + StructType.fromDDL(schema).fields)

    def run(batches):
        import pyarrow as pa
        import regex

        from_ = _judge(net, regex.compile(r"\p{L}"))
        for batch in batches:
            pred, score = from_(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return out.mapInArrow(run, whole)


def _judge(net: Net | None, letter):
    from . import kernels

    tables = _tables(net) if net else None

    def judge(column):
        pred, score = [], []
        for a, b, off, data in kernels.text_chunks(column):
            size = np.diff(off)
            count = np.maximum(1, -(-size // WINDOW))
            first = np.concatenate(([0], np.cumsum(count)))
            grid = np.full((first[-1], WINDOW), 32, np.uint8)
            flat = grid.reshape(-1)
            for i in range(b - a):
                flat[first[i] * WINDOW : first[i] * WINDOW + size[i]] = data[off[i] : off[i + 1]]
            ok = [net is not None and x is not None and letter.search(x) is not None for x in column.slice(a, b - a).to_pylist()]
            if net is not None:
                q = np.concatenate([window_probabilities(net, tables, grid[i : i + 512]) for i in range(0, len(grid), 512)])
                share = np.clip(size[np.repeat(np.arange(b - a), count)] - (np.arange(first[-1]) - np.repeat(first[:-1], count)) * WINDOW, 1, WINDOW)
                q = np.add.reduceat(q * share[:, None], first[:-1]) / np.add.reduceat(share, first[:-1])[:, None]
                best = q.argmax(1)
                for i, x in enumerate(ok):
                    pred.append(net.langs[best[i]] if x else UNKNOWN)
                    score.append(float(min(1.0, q[i, best[i]])) if x else 0.0)
            else:
                pred += [UNKNOWN] * (b - a)
                score += [0.0] * (b - a)
        return pred, score

    return judge


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: crc32(doc_id) mod 5 = 0, and null doc_ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def keep_known(docs: DataFrame, net: Net | None, least: float = 0.35) -> DataFrame:
    """``docs`` in its own columns without those of unknown language: ``und``, or a score under ``least``.

    Without a network (no labelled row) no language can be known; only texts without letters go.
    """
    if net is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    cols = [f"`{c}`" for c in docs.columns]
    mine = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    told = identify(mine, net, f"c{docs.columns.index('text')}")
    told = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return told.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
