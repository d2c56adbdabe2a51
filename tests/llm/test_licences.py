import math
import re
from collections import Counter
from itertools import groupby
from pathlib import Path

import duckdb
import pytest

from windrow.llm import licenses, queries

FULL = Path(licenses.__file__).parent / "licence_texts"
COLS = "file_id bigint, path string, text string"


def known():
    return [*licenses.TEMPLATES.items(), *licenses.HEADERS, *((f.stem, f.read_text()) for f in FULL.glob("*.txt"))]


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(licenses.WORD, re.sub(r"(?<![0-9.])([0-9]+)(?:\.0)+(?![.]?[0-9a-z])", r"\1", low))


class Plain:
    """The scan of one text, from its definition: every part against every template."""

    def __init__(self):
        counts = [(k, Counter(plain_words(t))) for k, t in known()]
        df = Counter(w for _, c in counts for w in c)
        self.unknown = math.log(1 + len(counts)) + 1
        self.idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
        self.known = [(k, self.unit(c)) for k, c in counts]

    def unit(self, counts):
        v = {w: (1 + math.log(n)) * self.idf.get(w, self.unknown) for w, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    def best(self, words):
        v = self.unit(Counter(words))
        c = min((-round(sum(x * u.get(w, 0) for w, x in v.items()), 6), k) for k, u in self.known)
        return (c[1], -c[0]) if -c[0] >= 0.6 else None

    def scan(self, text):
        rows = text.split("\n")
        said = [plain_words(x) for x in rows]
        runs = lambda ok: [(g[0], g[-1] + 1) for t, g in ((t, [i for i, _ in g]) for t, g in groupby(enumerate(ok), key=lambda x: x[1])) if t]
        parts = {(0, len(rows))} | {(i, i + 1) for i in range(len(rows))} | set(runs([x.strip() != "" for x in rows]))
        parts |= set(runs([2 * sum(w in self.idf for w in ws) >= len(ws) for ws in said]))
        hits = {}
        for i, j in parts:
            ws = [w for x in said[i:j] for w in x]
            if len(ws) > 1 and (b := self.best(ws)):
                hits[i, j] = b
        top = {p: b for p, b in hits.items() if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in hits)}
        if not top:
            return None, 0
        name = min((-b[1], p[0], b[0]) for p, b in top.items())[2]
        return (name, max(b[1] for b in hits.values() if b[0] == name)), len(top)


def test_scan_equals_plain_scan_of_every_part(spark, sf):
    texts = dict(duckdb.connect().sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())
    plain = Plain()
    for r in queries.op7_license_scan(spark, sf).collect():
        want, n = plain.scan(texts[r.doc_id])
        assert r.n_notices == n and (r.basis == "notice") == (want is not None), (r, want)
        if want:
            assert r.licence == want[0] and r.cosine == pytest.approx(want[1], abs=2e-6)


def test_whole_files_headers_and_versions(spark):
    code = "\n".join(f"x{i} = compute(alpha{i}, beta{i})" for i in range(60))
    apache = "\n".join("# " + x for x in [
        "Licensed under the Apache License, Version 2.0 (the", '"License"); you may not use this file except in', "compliance with the License. You may obtain a copy",
        "of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0", "", "Unless required by applicable law or agreed to in",
        'writing, software distributed under the License is', 'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES', "OR CONDITIONS OF ANY KIND, either express or implied.",
    ])
    files = {
        1: "prose of words\nThis work is licensed under the GNU General Public License, version 3.", 2: "prose\nAll rights reserved.", 3: apache + "\n" + code,
        4: "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + (FULL / "mit.txt").read_text(), 5: (FULL / "gpl-3.0.txt").read_text(), 6: (FULL / "gpl-2.0.txt").read_text(),
        7: code, 8: "mit\ndem Hund und der Katze", 9: "the and of the\nto the and in", 10: (FULL / "bsd-3-clause.txt").read_text(),
        11: "This work is licensed under the GNU General Public License, version 2.", 12: code + "\n" + (FULL / "mit.txt").read_text().replace("\n", " "),
    }
    df = spark.createDataFrame([(k, f"d{k}/f", t) for k, t in files.items()], COLS)
    got = {r.file_id: r for r in licenses.licences(df).collect()}
    assert {k: r.licence for k, r in got.items()} == {
        1: "gpl-3.0", 2: "reserved", 3: "apache-2.0", 4: "mit", 5: "gpl-3.0", 6: "gpl-2.0", 7: None, 8: None, 9: None, 10: "bsd-3-clause", 11: "gpl-2.0", 12: "mit"
    }
    assert got[3].n_notices == got[4].n_notices == got[5].n_notices == 1 and got[5].cosine == 1 and got[3].cosine > 0.8
