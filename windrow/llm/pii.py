"""Personal data in documents: rules, and a skip-chain conditional random field over the number- and address-like tokens."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: The base patterns and what a match must satisfy.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Training bounds: documents, and tokens of them.
TRAIN_DOCS, TRAIN_TOKENS = 4000, 60_000
#: Message passing ends when no message moves by more than SETTLED, or after ROUNDS; a span is told if its tokens' labels are SURE on average.
ROUNDS, SETTLED, DAMPING, SURE = 100, 1e-4, 0.3, 0.9
#: Of the rules' matches in the training sample, one in HIDE is put so that no rule sees it, but keeps its label.
HIDE = 3
FIELDS = 9
BUCKETS = 64


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def holds(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in match.split(".")))
    digits = "".join(c for c in match if "0" <= c <= "9")
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted: the rules alone, in time linear in the text.

    ``email`` is sought around each @, as far back as its characters go but not into the match before; ``ip`` starts at the start
    of digits. Both find what a search from every place would find.
    """
    import re

    out, done = [], 0
    local, domain = (re.compile(x) for x in PATTERNS["email"].split("@"))
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and local.fullmatch(text, start - 1, start):
            start -= 1
        m = domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, KINDS.index("email"), m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for kind, mark, before in (("ip", ".", r"(?<![0-9])"), ("card", "", ""), ("phone", "+", "")):
        if mark in text:
            found = re.finditer(before + PATTERNS[kind], text)
            out += [(m.start(), KINDS.index(kind), m.end()) for m in found if holds(kind, m.group())]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or an @, without punctuation around them."""
    import re

    return [m.span() for m in re.finditer(r"(?:(?<=\s)|^)[^\s0-9@]*[0-9@]\S*", text)] if re.search("[0-9@]", text) else []


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Per token small integers: shape, digits, length, marks, the check digit of long numbers, and the words around, hashed."""
    import zlib

    out = np.zeros((len(spans), FIELDS), np.int64)
    for i, (a, b) in enumerate(spans):
        t = text[a:b]
        digits = sum("0" <= c <= "9" for c in t)
        letters = sum(c.isalpha() for c in t)
        shape = []
        for c in t:
            k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
            if not shape or shape[-1] != k:
                shape.append(k)
        before = text[max(0, a - 24) : a].split()[-1:] or [""]
        after = text[b : b + 24].split()[:1] or [""]
        kind_of = lambda w: "9" if any("0" <= c <= "9" for c in w) else w[-1:] if not w[-1:].isalpha() else "a"
        out[i] = (
            min(digits, 24) + 25 * (digits > 11 and luhn("".join(c for c in t if "0" <= c <= "9"))), min(letters, 12), min(t.count("."), 5), ("@" in t) + 2 * t.startswith("+") + 4 * ("-" in t) + 8 * ("(" in t) + 16 * ("=" in t or '"' in t),
            zlib.crc32("".join(shape).strip(".,;:!?|#&%$*").encode()) % BUCKETS, min(len(t) // 4, 15),
            zlib.crc32(kind_of(before[0]).encode()) % BUCKETS, zlib.crc32(kind_of(after[0]).encode()) % BUCKETS, zlib.crc32(before[0][-6:].lower().encode()) % BUCKETS,
        )
    return out


def likeness(token: str) -> list[tuple]:
    """What a token shares with similar ones: its letters and digits, its digits' grouping with the last four of them, the two sides of its @."""
    key = "".join(c for c in token.lower() if c.isalnum() or c == "@")
    digits = "".join(c for c in key if "0" <= c <= "9")
    out = [("same", key)]
    if len(digits) >= 7:
        groups = "".join(c if c in "-./()+" else "9" for c in token.strip(".,;:!?|#&%$*\"'<>[]{}") if c in "-./()+" or "0" <= c <= "9")
        out.append(("digits", groups, digits[-4:]))
    if key.count("@") == 1:
        local, domain = token.lower().strip(".,;:!?|#&%$*\"'()<>[]{}").split("@")
        out += [("local", local), ("domain", domain)]
    return out


def skip_classes(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Groups of repeated or similar tokens, anywhere in a document: each shares one more node of the field, so a label crosses in two rounds."""
    groups: dict[tuple, list[int]] = {}
    for i, (a, b) in enumerate(spans):
        for k in likeness(text[a:b]):
            groups.setdefault(k, []).append(i)
    return list(dict.fromkeys(tuple(g) for g in groups.values() if len(g) > 1))


@dataclass
class Field:
    """Node weights by field and value, and log potentials of neighbouring tokens and of a token with its class of similar ones; label 0 is none."""

    node: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, x: np.ndarray, classes: list) -> np.ndarray:
        """Label probabilities of a document's tokens by loopy belief propagation over neighbours and classes, damped, until messages settle.

        A class is a node of its own without features; its links to its members have the potential ``skip``.
        """
        n, k = len(x), len(self.bias)
        score = np.zeros((n + len(classes), k))
        score[:n] = self.bias + sum(self.node[f, x[:, f]] for f in range(FIELDS))
        u = np.concatenate([np.arange(n - 1), *[np.full(len(c), n + i) for i, c in enumerate(classes)]]).astype(np.int64)
        v = np.concatenate([np.arange(1, n), *map(np.array, classes)]).astype(np.int64)
        if not len(u):
            return _softmax(score)
        pot = np.where((u < n)[:, None, None], self.chain, self.skip)
        to, fro = np.concatenate([v, u]), np.concatenate([u, v])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])  # [message, label at its source, label at its target]
        back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
        msg = np.zeros((len(to), k))
        for _ in range(ROUNDS):
            belief = score.copy()
            np.add.at(belief, to, msg)
            inner = belief[fro] - msg[back]
            new = _logsum(inner[:, :, None] + pot)
            new -= new.max(1, keepdims=True)
            new = DAMPING * msg + (1 - DAMPING) * new
            moved, msg = np.abs(new - msg).max(), new
            if moved < SETTLED:
                break
        np.add.at(score, to, msg)
        return _softmax(score[:n])


def _logsum(a: np.ndarray) -> np.ndarray:
    m = a.max(1)
    return m + np.log(np.exp(a - m[:, None]).sum(1))


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def labels_of(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each token: 0, or 1 + the kind of the first of ``base`` that reaches into it."""
    y = np.zeros(len(spans), np.int64)
    for i, (a, b) in enumerate(spans):
        y[i] = next((1 + k for s, k, e in base if s < b and e > a), 0)
    return y


def hidden(text: str, every: int = HIDE) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with some of the rules' matches put so that no rule sees them, and where all of them are now: (start, number of the kind, end).

    Which ones hangs on the text alone. A phone loses its plus, or gets digits right behind it; a card's groups are set apart by two spaces; the dots of an
    address get spaces behind them; an e-mail address gets a space before its domain's last part.
    """
    import zlib

    out, where, at, done = [], [], 0, 0
    for i, (a, k, e) in enumerate(base_spans(text)):
        if a < at:
            continue
        piece, behind, h = text[a:e], "", zlib.crc32(f"{i}:{text[a:e]}".encode())
        if every and h % every == 0:
            if KINDS[k] == "phone":
                piece, behind = (piece[1:], "") if h // every % 2 else (piece, " 2003 10 11 2003")
            elif KINDS[k] == "card":
                piece = piece[:4] + "  " + piece[4:]
            else:
                j = piece.rindex(".") + 1
                piece = piece[:j] + " " + piece[j:]
        done += a - at
        where.append((done, k, done + len(piece)))
        out += [text[at:a], piece, behind]
        done += len(piece) + len(behind)
        at = e
    out.append(text[at:])
    return "".join(out), where


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> Field | None:
    """Piecewise training: nodes by multinomial regression, links by the odds of label pairs, on what the rules find, some of it hidden from them.

    The sample is bounded: of the different texts with a digit or @ the TRAIN_DOCS of least hash of id and text, whole and in that order, while TRAIN_TOKENS tokens
    are not exceeded. None without such texts.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for draw, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, where = hidden(t)
                s = tokens(t)
                if 0 < len(s) <= TRAIN_TOKENS:
                    groups = [list(c) for c in skip_classes(t, s)]
                    rows.append({"draw": draw, "x": features(t, s).ravel().tolist(), "y": labels_of(s, where).tolist(), "groups": groups})
            big = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("draw", pa.int64()), ("x", big), ("y", big), ("groups", pa.list_(big))]))

    own = F.col(f"`{text}`").cast("string")
    some = docs.select(F.xxhash64(F.lit("pii"), F.col(f"`{id_col}`"), own).alias("draw"), own.alias("t")).where("t rlike '[0-9@]'")
    draws = [r.draw for r in some.select("draw").distinct().orderBy("draw").limit(TRAIN_DOCS).collect()]
    if not draws:
        return None
    some = some.where(F.col("draw") <= draws[-1]).groupBy("draw").agg(F.min("t").alias("t"))  # as many rows as draws
    rows = some.mapInArrow(run, "draw bigint, x array<bigint>, y array<bigint>, groups array<array<bigint>>")
    size = rows.select("draw", F.size("y").alias("n")).orderBy("draw").collect()  # TRAIN_DOCS numbers
    keep, n = set(), 0
    for r in size:
        if n + r.n <= TRAIN_TOKENS:
            keep.add(r.draw)
            n += r.n
    got = rows.where(F.col("draw").isin(*keep)).orderBy("draw").collect() if keep else []
    docs_xy = [(np.array(r.x).reshape(-1, FIELDS), np.array(r.y), r.groups) for r in got]
    return fit(docs_xy) if docs_xy else None


def fit(docs_xy: list) -> Field:
    k = len(KINDS) + 1
    x = np.concatenate([d[0] for d in docs_xy])
    y = np.concatenate([d[1] for d in docs_xy])
    node, bias = np.zeros((FIELDS, BUCKETS, k)), np.zeros(k)
    grad_node, grad_bias = np.full_like(node, 1e-8), np.full_like(bias, 1e-8)
    rng = np.random.default_rng(3)
    for _ in range(12):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 256):
            b = order[a : a + 256]
            d = _softmax(bias + sum(node[f, x[b, f]] for f in range(FIELDS)))
            d[np.arange(len(b)), y[b]] -= 1
            d /= len(b)
            g = np.zeros_like(node)
            for f in range(FIELDS):
                np.add.at(g[f], x[b, f], d)
            g += 1e-5 * node
            grad_node += g * g
            grad_bias += d.sum(0) ** 2
            node -= 0.3 * g / np.sqrt(grad_node)
            bias -= 0.3 * d.sum(0) / np.sqrt(grad_bias)

    def odds(pairs: np.ndarray, prior: float) -> np.ndarray:
        joint = np.full((k, k), prior / k / k) + np.eye(k) * prior
        np.add.at(joint, (pairs[:, 0], pairs[:, 1]), 1.0)
        joint /= joint.sum()
        return np.clip(np.log(joint / (joint.sum(1)[:, None] * joint.sum(0)[None])), -3, 3)

    near = [np.stack([d[1][:-1], d[1][1:]], 1) for d in docs_xy if len(d[1]) > 1]
    far = [np.stack([d[1][g[:-1]], d[1][g[1:]]], 1) for d in docs_xy for g in map(np.array, d[2])]
    empty = np.zeros((0, 2), np.int64)
    return Field(node, bias, 0.5 * odds(np.concatenate(near or [empty]), 5.0), odds(np.concatenate(far or [empty]), 5.0))


def extra_spans(field: Field, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of tokens that the field gives one label and no rule found, if it is sure of them and they name somebody: seven digits or an @."""
    s = tokens(text)
    if not s:
        return []
    p = field.marginals(features(text, s), skip_classes(text, s))
    runs: list[list] = []
    at = 0
    for (a, b), q in zip(s, p):
        while at < len(base) and base[at][2] <= a and all(x[2] <= a for x in base[at : at + len(KINDS)]):
            at += 1
        k = int(q.argmax())
        if k == 0 or any(x < b and e > a for x, _, e in base[at : at + 2 * len(KINDS)]):
            continue
        if runs and runs[-1][1] == k and text[runs[-1][2] : a].strip() == "":
            runs[-1][2] = b
            runs[-1][3].append(q[k])
        else:
            runs.append([a, k, b, [q[k]]])
    out = []
    for a, k, b, sure in runs:
        core = text[a:b].strip(".,;:!?|#&%$*\"'<>[]{}")
        a += text[a:b].index(core)
        if np.mean(sure) >= SURE and (sum("0" <= c <= "9" for c in core) >= 7 or "@" in core):
            out.append((a, k - 1, a + len(core)))
    return out


def personal_data(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """Each row's doc_id and ``spans``: array of (start, rank, end, kind), sorted; code points, end exclusive.

    Kinds are those of the rules; what the field adds has ``crf_`` before its kind and never overlaps a rule's span. Every whole
    text is read; null and empty ones have no spans.
    """
    bounded_batches(docs.sparkSession)
    kind = "array<struct<start: bigint, rank: int, end: bigint, kind: string>>"

    def run(batches):
        import pyarrow as pa

        fields = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())])
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                more = extra_spans(field, t, base) if field else []
                all_ = [(s, k, e, KINDS[k]) for s, k, e in base] + [(s, len(KINDS) + k, e, "crf_" + KINDS[k]) for s, k, e in more]
                rows.append([dict(zip(("start", "rank", "end", "kind"), x)) for x in sorted(all_)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(fields))], names=["doc_id", "spans"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id bigint, spans {kind}")
