"""Licences of files: TF-IDF cosine of lines, header blocks and whole files to licence texts, then inheritance from the nearest directory above.

DataFrame operations only.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, shared

#: The wording of short licence notices, by licence.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistributed under the terms of the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "Released into the public domain under CC0 1.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.0.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "reserved": "Copyright holder. All rights reserved. No permission is granted.",
}
#: Standard headers and other usual wordings; several a licence. The full texts lie in licence_texts, one file a licence.
HEADERS = (
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("cc0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    *[(f"gpl-{n}.0", f"""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see http://www.gnu.org/licenses/.""") for n in (2, 3)],
    *[(f"gpl-{n}.0", f"SPDX-License-Identifier: GPL-{n}.0-{end}") for n in (2, 3) for end in ("only", "or-later")],
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("reserved", "All rights reserved."),
)
#: Words of which most prose has some, the most frequent first; whether a text needs a closer look hangs on others where possible. No result depends on the list.
USUAL = (
    "the of and to a in is it that was for on as with be by an at are this from or not have had has but were they which one all we can her his him he she "
    "if there who more will no out so up what when mit my you your them then their its into do than only been does how i may any our here me rest"
).split()
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased, with dots or dashes only within; versions lose .0 at their end (3.0 and 3 are one word)."""
    low = F.regexp_replace(F.translate(text, UPPER, LOWER), r"(?<![0-9.])([0-9]+)(?:\.0)+(?![.]?[0-9a-z])", "$1")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def damped(tf: Column) -> Column:
    """1 + ln(count): else a line of articles and conjunctions alone is near any long text."""
    return 1 + F.log(tf)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _span(first: Column, last: Column) -> Column:
    return F.struct(first.alias("line"), (last + 1).alias("stop"))


def _stretches(ok: Column) -> Column:
    """(line, lines) of every longest run of true flags; lines count from 0."""
    at = F.filter(F.sequence(F.lit(0), F.size(ok)), lambda i: F.get(ok, i) & ~F.coalesce(F.get(ok, i - 1), F.lit(False)))
    end = F.filter(F.sequence(F.lit(0), F.size(ok)), lambda i: F.get(ok, i) & ~F.coalesce(F.get(ok, i + 1), F.lit(False)))
    return F.zip_with(at, end, _span)


def weights(known: DataFrame) -> tuple[DataFrame, dict[str, float], float]:
    """The templates' unit vectors (template, licence, word, w), the idf of each of their words, and that of a word in none.

    Document frequencies are those of the templates, so a file's cosine depends on its own words only. ``known`` is of known size.
    """
    each = known.select("licence", F.xxhash64("licence", "text").alias("template"), "text").distinct()
    own = each.select("licence", "template", F.explode(words(F.col("text"))).alias("word")).groupBy("licence", "template", "word").agg(F.count(F.lit(1)).alias("tf"))
    own = shared(own, "template_words")
    total = own.select("template").distinct().count()
    idf = {r["word"]: math.log((1 + total) / (1 + r["df"])) + 1 for r in own.groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    table = known.sparkSession.createDataFrame(sorted(idf.items()), "word string, idf double")
    w = own.join(table, "word").withColumn("w", damped(F.col("tf")) * F.col("idf"))
    size = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return shared(w.join(size, "template").select("template", "licence", "word", "idf", (F.col("w") / F.col("size")).alias("w")), "templates"), idf, math.log(1 + total) + 1


def telling_words(w: DataFrame, least: float) -> list[str]:
    """Words of which a text must hold one to reach a cosine of ``least`` with any template.

    Of each template words are taken, longer and rarer ones first and those of USUAL last, until the others together have a length under
    ``least``: without any of those taken, no part of a text comes nearer than that. ``w`` is of known size.
    """
    rank = {x: i for i, x in enumerate(USUAL)}
    rows = sorted(((r["template"], -rank.get(r["word"], len(USUAL)), len(r["word"]) <= 4, -r["idf"], r["word"], r["w"]) for r in w.collect()), key=lambda r: r[:5])
    left, out = {}, set()
    for t, *_, x in rows:
        left[t] = left.get(t, 0.0) + x * x
    for t, *_, word, x in rows:
        if left[t] >= least * least - 1e-6:
            out.add(word)
            left[t] -= x * x
    return sorted(out)


def candidates(files: DataFrame, idf: dict[str, float], unknown: float, least: float) -> DataFrame:
    """(file_id, line, stop, size, says, other): parts of the texts that may reach a cosine of ``least`` with a template.

    Parts are the whole text, each run of lines without a blank one, each run of lines of which half of the words are the templates', and
    each line. One word alone is no notice (mit is also a German word). ``other`` is the sum of squared damped counts of words of no template. A part is left out only if no template can reach ``least``:
    its cosine is at most the share of its length that lies in the templates' words, here with each word's weight at its greatest.
    """
    if not idf:
        return files.select("file_id").where("false").selectExpr("file_id", "0 AS line", "0 AS stop", "0 AS size", "'' AS says", "0L AS other")
    half = sorted(idf.values())[len(idf) // 2]
    usual, rare = [x for x in idf if idf[x] < half], [x for x in idf if idf[x] >= half]
    top, low = max(idf.values()), max([idf[x] for x in usual], default=0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("other"), F.lit(0.0).alias("own"))

    def marked(x: Column) -> Column:  # words of the templates get a mark
        return F.when(x.isin(*rare), F.concat(x, F.lit("!"))).when(x.isin(*usual), F.concat(x, F.lit("?"))).otherwise(x)

    def count(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1.0)
        more = F.when(run == 1, 1.0).otherwise(damped(run) * damped(run) - damped(run - 1) * damped(run - 1))  # a word's squared weight grows by this
        most = F.when(x.endswith("!"), top * top).when(x.endswith("?"), low * low).otherwise(0.0)
        return F.struct(x.alias("last"), run.alias("run"), (acc["other"] + F.when(most > 0, 0.0).otherwise(more)).alias("other"), (acc["own"] + more * most).alias("own"))

    def part(p: Column, said: Column) -> Column:
        return _let(
            F.flatten(F.slice(said, p["line"] + 1, p["stop"] - p["line"])),
            lambda ws: F.struct(p["line"].alias("line"), p["stop"].alias("stop"), ws.alias("ws"), F.aggregate(F.sort_array(ws), start, count).alias("c")),
        )

    def parts(rows: Column, said: Column) -> Column:
        n = F.size(rows)
        every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _span(i, i))
        blocks = _let(F.transform(rows, lambda x: F.trim(F.translate(x, "\t\r", "  ")) != ""), _stretches)
        alike = _let(F.transform(said, lambda ws: 2 * F.size(F.filter(ws, lambda x: x.rlike("[!?]$"))) >= F.size(ws)), _stretches)
        whole = F.array(_span(F.lit(0), n - 1))
        return F.array_distinct(F.concat(whole, blocks, alike, every))

    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = files.select("file_id", F.split(t, "\n").alias("rows")).withColumn("said", F.transform("rows", lambda x: F.transform(words(x), marked)))
    found = lines.select("file_id", F.transform(parts(F.col("rows"), F.col("said")), lambda p: part(p, F.col("said"))).alias("parts"))
    near = lambda c: (c["own"] > 0) & ((1 - least * least) * c["own"] >= least * least * unknown * unknown * c["other"] - 1e-6)
    found = found.select("file_id", F.explode(F.filter("parts", lambda p: (F.size(p["ws"]) > 1) & near(p["c"]))).alias("p"))
    return found.select("file_id", "p.line", "p.stop", F.size("p.ws").alias("size"), F.translate(F.array_join("p.ws", " "), "!?", "").alias("says"), F.col("p.c.other").alias("other"))


def best_template(parts: DataFrame, w: DataFrame, unknown: float, least: float) -> DataFrame:
    """(key, licence, cosine) of each distinct part (key, says, other): the template of greatest TF-IDF cosine, if ``least`` or more.

    Words of no template count in a part's length with the idf ``unknown``. Both sides are sparse and join on the word.
    Cosines are compared to six decimals; ties go to the first licence by name.
    """
    idf = w.select("word", "idf").distinct()
    mine = parts.select("key", "other", F.explode(F.split("says", " ")).alias("word")).join(F.broadcast(idf), "word")
    v = shared(mine.groupBy("key", "other", "word", "idf").agg((damped(F.count(F.lit(1))) * F.col("idf")).alias("v")), "part_words")
    long = v.groupBy("key", "other").agg(F.sum(F.col("v") * F.col("v")).alias("own"))
    long = long.select("key", F.sqrt(F.col("own") + F.col("other") * unknown * unknown).alias("long"))
    dot = v.join(F.broadcast(w.select("word", "template", "licence", "w")), "word").groupBy("key", "template", "licence").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    near = dot.join(long, "key").withColumn("cosine", F.round(F.col("dot") / F.col("long"), 6)).where(F.col("cosine") >= least)
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("far"), F.col("licence"))).alias("b"))
    return best.select("key", "b.licence", (-F.col("b.far")).alias("cosine"))


def licences(files: DataFrame, known: DataFrame | None = None, least: float = 0.6, share: float = 0.1) -> DataFrame:
    """One row for each of ``files`` (file_id, path, text): file_id, licence, cosine, basis, from_dir, n_notices.

    A notice is a part of the text (see ``candidates``) that reaches ``least`` and lies in no larger one that does. A file with notices has
    the licence of its best one (greatest cosine, then first line), with that licence's greatest cosine in any part: basis ``notice``. A file
    is a licence file of its directory if ``share`` of its words or more lie in notices; of several the greatest cosine counts, then the first
    licence by name. A file without a notice inherits from the nearest directory at or above its own that has one: basis ``inherited``, and
    from_dir names it. Others have nulls. Null texts are empty, a null path is the root; rows that share a file_id share their notices.

    Directories may hold any number of files: distinct directories are joined, never files with files.
    """
    spark = files.sparkSession
    known = templates(spark) if known is None else known
    w, idf, unknown = weights(known)
    directory = F.regexp_extract(F.coalesce("path", F.lit("")), "^(.*)/", 1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    telling = telling_words(w, least)
    says = _let(words(text), lambda ws: F.struct(F.size(ws).cast("bigint").alias("n_words"), F.exists(ws, lambda x: x.isin(*telling)).alias("may")))
    here = files.select("file_id", directory.alias("dir"), text.alias("text"), says.alias("says"))
    here = shared(here.select("file_id", "dir", "says.n_words", F.when(F.col("says.may"), F.col("text")).alias("text")), "files")
    parts = shared(candidates(here.where("text IS NOT NULL"), idf, unknown, least).withColumn("key", F.unhex(F.sha2("says", 256))), "parts")
    distinct = shared(parts.groupBy("key").agg(F.max("says").alias("says"), F.max("other").alias("other"), F.count(F.lit(1)).alias("n")), "distinct_parts")
    best = distinct.select("key", "n").join(best_template(distinct, w, unknown, least), "key")
    told = attach(parts.drop("says", "other"), shared(best, "best"), "key", "n", parts.count()).where("licence is not null")
    before = F.max("stop").over(Window.partitionBy("file_id").orderBy("line", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("whole", F.col("stop") > F.coalesce(before, F.lit(0)))
    each = told.groupBy("file_id", "licence").agg(
        F.min(F.when(F.col("whole"), F.struct((-F.col("cosine")).alias("far"), F.col("line")))).alias("top"), F.max("cosine").alias("cosine"),
        F.count(F.when(F.col("whole"), 1)).alias("n"), F.sum(F.when(F.col("whole"), F.col("size")).otherwise(0)).alias("size"),
    )
    own = each.groupBy("file_id").agg(F.min(F.when(F.col("top").isNotNull(), F.struct("top", "licence", "cosine"))).alias("b"), F.sum("n").alias("n_notices"), F.sum("size").alias("said"))
    own = shared(own.select("file_id", "b.licence", "b.cosine", "n_notices", "said"), "own")
    here = here.drop("text")
    rows = here.join(own, "file_id", "left")
    of_dir = rows.where(F.col("said") >= share * F.col("n_words")).groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), F.col("licence"))).alias("b"))
    of_dir = of_dir.select(F.col("dir").alias("above"), F.col("b.licence").alias("dir_licence"), (-F.col("b.col1")).alias("dir_cosine"))
    dirs = here.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))
    parts = F.split("dir", "/")
    up = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    near = up.join(of_dir, "above").groupBy("dir", "n_files").agg(F.max(F.struct("depth", "above", "dir_licence", "dir_cosine")).alias("x"))
    near = shared(near.select("dir", "n_files", "x.above", "x.dir_licence", "x.dir_cosine"), "directories")
    out = attach(rows, near, "dir", "n_files", here.count())
    lent = F.col("licence").isNull() & F.col("dir_licence").isNotNull()
    return out.select(
        "file_id", F.coalesce("licence", "dir_licence").alias("licence"), F.when(lent, F.col("dir_cosine")).otherwise(F.col("cosine")).alias("cosine"),
        F.when(F.col("licence").isNotNull(), F.lit("notice")).when(lent, F.lit("inherited")).alias("basis"), F.when(lent, F.col("above")).alias("from_dir"),
        F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"),
    )


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of TEMPLATES, HEADERS and the files in licence_texts."""
    return [*TEMPLATES.items(), *HEADERS, *((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))]


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(licence, text) of ``texts``; else of ``known_texts``. A licence may have several rows."""
    return spark.createDataFrame(list(texts.items()) if texts else known_texts(), "licence string, text string")
