"""Quality rules, licence scans and top-k search against brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import licenses, queries, topk_search
from pagelake.llm.quality_rules import base_failed, certified_cutoffs, document_stats, drop_rejected, log_binomial_tail, quality_verdicts
from pagelake.llm.topk_search import top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_document_stats(spark, odd, odd_rows):
    rng = random.Random(1)
    more = [(500 + i, " ".join(rng.choices("ab", k=rng.randint(0, 40))) + "\n" * rng.randint(0, 2) + rng.choice(["", "x\nx\n \n x", "a b c d e a b c d e"]), "en", "s", 1) for i in range(60)]
    rows = odd_rows + more
    docs = spark.createDataFrame(rows, odd.schema).withColumn("words", F.lit(1)).withColumn("places", F.lit(2))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in document_stats(docs).collect())
    assert got == Counter((r[0], *stats(r[1])) for r in rows)


def test_exact_binomial_tail(spark):
    cases = [(k, n) for n in (1, 50, 700, 20000) for k in (0, 1, 3, n // 200) if k <= n * 0.01 or k == 0]
    df = spark.createDataFrame(cases, "k int, n long")
    for (k, n), r in zip(cases, df.select(log_binomial_tail(F.col("k"), F.col("n"), 0.01).alias("x")).collect()):
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99) for i in range(k + 1)]
        top = max(terms)
        assert r.x == pytest.approx(top + math.log(sum(math.exp(t - top) for t in terms)), rel=1e-9)


def test_cutoffs_are_certified(spark):
    rng = random.Random(0)
    rows = []
    for i in range(4000):
        good = i % 4 != 0
        symbols = (900 if rng.random() < 0.002 else 0) if good else (rng.choice([0, 350, 400]))
        rows.append(("en", good, symbols, 0, 0, rng.randint(0, 60)))
    rows += [("few", True, 0, 0, 0, 0)] * 50 + [("few", False, 900, 0, 0, 0)] * 50
    got = {(r.stratum, r.rule): r.cutoff for r in certified_cutoffs(spark.createDataFrame(rows, "stratum string, good boolean, symbols int, dup_lines int, repeats int, capitals int")).collect()}
    assert got == {("en", "symbols"): 300}  # few labels certify nothing; capitals reject as many good as bad


def test_verdicts(spark, odd, odd_rows):
    good = [(1000 + i, f"clean words number {i} " + " ".join(f"w{i}x{j}" for j in range(20)), "en", "s", 1) for i in range(1500)]
    bad = [(5000 + i, f"junk ### {i} " + " ".join(f"v{i}x{j}###" for j in range(20)), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(odd_rows + good + bad, odd.schema)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad[:200]] + [(None, 1, 0), (1, None, 0), (bad[0][0], 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_verdicts(docs, labels)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[r[0]] for r in good) and not any(kept[r[0]] for r in bad)
    failed = {r.doc_id for r in document_stats(docs).where(base_failed()).collect()}
    assert {101, 102, 103} <= failed and not any(kept[k] for k in failed)
    left = drop_rejected(docs, labels)
    assert left.columns == docs.columns and left.count() == got.where("kept").count()
    assert quality_verdicts(docs.limit(0), labels).count() == 0
    assert quality_verdicts(docs, labels.limit(0)).where("kept AND doc_id >= 5000").count() == 300


SAY = licenses.SENTENCES


def _list(*names):
    return "\n\n".join(f" {i}. {SAY[x]}." for i, x in enumerate(names, 1))


def gnu(kind, version, sep, tail=", or (at your option) any later version."):
    return f"This program is free software{sep} you can redistribute it and/or modify\nit under the terms of the GNU {kind} as published by\nthe Free Software Foundation{',' if sep == ':' else ';'} either version {version} of the License{tail}\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."


#: Text, rules, licences: written by hand.
NOTICES = [
    ("Header\n\n" + _list("mit-grant", "mit-notice", "mit-warranty", "mit-liable"), "mit-text", "MIT"),
    ("# " + _list("mit-grant", "mit-notice", "mit-warranty").replace(", ", ",\n# "), "mit-text", "MIT"),
    (_list("mit0-grant", "mit-warranty"), "mit0-text", "MIT-0"),
    (_list("mit-grant", "mit-notice", "json-good", "mit-warranty"), "json-text", "JSON"),
    (_list("mit-grant", "mit-notice", "mit-warranty", "mit-liable", "x11-name"), "x11-text", "X11"),
    (_list("mit-warranty", "mit-notice", "mit-grant"), "", ""),
    (_list("mit-grant", "bsd-source", "mit-notice", "mit-warranty"), "", ""),
    (_list("isc-grant", "isc-warranty"), "isc-text", "ISC"),
    (_list("isc-grant-2", "isc-warranty"), "isc-text", "ISC"),
    (_list("0bsd-grant", "isc-warranty"), "0bsd-text", "0BSD"),
    (_list("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), "bsd2-text", "BSD-2-Clause"),
    (_list("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"), "bsd3-text", "BSD-3-Clause"),
    (_list("bsd-grant", "bsd-source", "bsd-binary") + "\n\nNeither the name of Example, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd3-text", "BSD-3-Clause"),
    (_list("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name"), "bsd4-text", "BSD-4-Clause"),
    (_list("bsd-grant", "bsd-source", "bsd-binary", "bsd-name") + "\n\n" + _list("bsd-grant", "bsd-source", "bsd-binary"), "bsd3-text,bsd2-text", "BSD-2-Clause,BSD-3-Clause"),
    (_list("zlib-warranty", "zlib-grant", "zlib-altered", "zlib-notice"), "zlib-text", "Zlib"),
    (SAY["unlicense-free"] + ".", "unlicense-text", "Unlicense"),
    (f'Licensed under the Apache License, Version 2.0 (the "License");\n{SAY["apache2-use"]}.\nYou may obtain a copy of the License at\n\n http://x\n\n{SAY["apache2-basis"]}.', "apache2-header", "Apache-2.0"),
    (f"{SAY['apache2-text']}.\n\n{SAY['apache2-basis']}.\n\n{SAY['apache2-patent']}.", "apache2-text", "Apache-2.0"),
    (gnu("General Public License", "3", ":"), "gpl-3-or-later-notice", "GPL-3.0-or-later"),
    (gnu("General Public License", "3", ";"), "gpl-3-or-later", "GPL-3.0-or-later"),
    (gnu("General Public License", "2", ";"), "gpl-2-or-later", "GPL-2.0-or-later"),
    (gnu("Lesser General Public License", "2.1", ";"), "lgpl-2.1-or-later", "LGPL-2.1-or-later"),
    (gnu("Lesser General Public License", "3", ":"), "lgpl-3-or-later-notice", "LGPL-3.0-or-later"),
    (gnu("Affero General Public License", "3", ":"), "agpl-3-or-later-notice", "AGPL-3.0-or-later"),
    (gnu("Library General Public License", "2", ";"), "lgpl-2.0-2-or-later", "LGPL-2.0-or-later"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gpl-2-only", "GPL-2.0-only"),
    (SAY["mpl2-head"] + ". If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl2-header", "MPL-2.0"),
    ("// SPDX-License-Identifier: Apache-2.0\nint x;", "spdx-Apache-2.0", "Apache-2.0"),
    ("/* SPDX-License-Identifier: (GPL-2.0+ WITH Linux-syscall-note) OR MIT */", "spdx-GPL-2.0-or-later,spdx-MIT", "GPL-2.0-or-later,MIT"),
    ("SPDX-License-Identifier: LicenseRef-mine", "", ""),
    ('Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION\n    OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.\n\n1. DEFINITIONS\n', "epl2-text", "EPL-2.0"),
    (_list("epl1-title", "epl-head"), "epl1-text", "EPL-1.0"), (_list("epl-head", "gpl2-text", "epl2-secondary"), "gpl2-text", "GPL-2.0-only"), (_list("epl-head", "epl2-secondary"), "epl2-body", "EPL-2.0"), (_list("epl-head"), "", ""),
    ('Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. "Contributor"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n\n1.2. "Contributor Version"\n    means the combination.\n\n1.4. "Covered Software"\n    means Source Code Form to which the initial Contributor has attached\n    the notice in Exhibit A, the Executable Form of such Source Code\n    Form, and Modifications of such Source Code Form, in each case\n    including portions thereof.\n', "mpl2-text", "MPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n", "gpl3-text", "GPL-3.0-only"),
    (_list("gnu-verbatim"), "", ""), (_list("gnu-verbatim", "artistic2-terms"), "artistic2-text", "Artistic-2.0"),
    ("            GNU Free Documentation License\n             Version 1.3, 3 November 2008\n\n\n" + _list("gnu-verbatim", "gfdl-purpose"), "gfdl13-text", "GFDL-1.3"),
    (_list("ms-governs", "ms-accept"), "mspl-text", "MS-PL"), (_list("ms-governs", "ms-accept") + f"\n\n3. Conditions and Limitations\n{SAY['msrl-grants']}.", "msrl-text", "MS-RL"),
    ('By exercising the Licensed Rights (defined below), You accept and agree\nto be bound by the terms and conditions of this Creative Commons\nAttribution-ShareAlike 4.0 International Public License ("Public\nLicense"). To the extent', "cc-by-sa-4.0-text", "CC-BY-SA-4.0"),
    (f"{SAY['osl3-text']}:\n\nLicensed under the Open Software License version 3.0\n\n1) Grant", "osl3-text", "OSL-3.0"),
    ("words words |\nReleased under the MIT License.", "reference-MIT", "MIT"),
    ("Licensed under the MIT license (see LICENSE).", "reference-MIT", "MIT"),
    ("This project is licensed under the terms of the MIT license.", "reference-MIT", "MIT"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://x/", "reference-EPL-2.0", "EPL-2.0"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "reference-BSL-1.0", "BSL-1.0"),
    ("Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "reference-CC-BY-NC-4.0,reference-Apache-2.0", "Apache-2.0,CC-BY-NC-4.0"),
    ("All content of this site is licensed\nunder a Creative Commons Attribution-ShareAlike 4.0 International License.", "reference-CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("The files in this folder are distributed under the ISC License, see COPYING.", "reference-ISC", "ISC"),
    ("Everything here is covered by the zlib/libpng license.", "reference-Zlib", "Zlib"),
    ("It is licensed under the Mozilla Public License, v. 2.0.", "reference-MPL-2.0", "MPL-2.0"),
    ("We like the MIT License and software.", "", ""), ("The driving licence is available under the desk.", "", ""), (None, "", ""), ("", "", ""),
]


def test_licenses(spark, odd):
    rows = [(i, t, "z") for i, (t, _, _) in enumerate(NOTICES)]
    rows += [(1000 + i, f"Some words.\n\nLicensed under the {names[0]}.", "z") for i, names in enumerate(licenses.NAMES.values())]
    rows += [(2000 + i, f"x /* SPDX-License-Identifier: {name} */", "z") for i, name in enumerate(licenses.NAMES)]
    got = {r.doc_id: (",".join(r.rules), ",".join(r.licenses)) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, hits string")).collect()}
    assert len(licenses.NAMES) > 60
    for i, (text, rules, found) in enumerate(NOTICES):
        assert got[i] == (rules, found), text
    for i, name in enumerate(licenses.NAMES):
        assert got[1000 + i] == (f"reference-{name}", name) and got[2000 + i] == (f"spdx-{name}", name)
    again = odd.unionByName(odd).withColumn("sentence_ids", F.lit(1)).withColumn("spdx", F.lit(2))
    assert licenses.scan_licenses(again).count() == 2 * odd.count() and licenses.scan_licenses(odd.limit(0)).count() == 0


def test_license_sql_agrees(spark, tmp_path):
    rows = [(i, t) for i, (t, _, _) in enumerate(NOTICES)] + [(500, "word " * 20_000 + "\n\nReleased under the MIT License."), (501, "LICENSED UNDER THE ISC LICENSE!\nLicensed under the ISC License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in queries.op4_license_scan(spark, str(tmp_path)).select("doc_id", "n_sentences", "sentence_ids", "rules", "licenses").collect()}
    assert got == set(con.sql(queries.ORACLE_SQL["op4_license_scan"]).fetchall())


def test_texts_of_licences_by_their_sentences(spark):
    """Every rule finds its licence in a text of its own sentences, other known ones where it allows them."""
    say = licenses.SENTENCES | licenses.gnu_sentences() | licenses.creative_sentences()
    rules = [r for r in licenses.RULES if "ref-" not in r[2]] + licenses.gnu_rules()
    said = [[x.split("|")[0] if x != "*" else "gpl-merchant" for x in r[2].split()] for r in rules]
    texts = [(i, "\n\n".join(f"{say[x]}." for x in names)) for i, names in enumerate(said)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, (rule, licence, _) in enumerate(rules):
        assert rule in got[i].rules and licence in got[i].licenses, (rule, got[i])
    assert len({r[1] for r in rules if r[0].endswith("-text")}) > 55


def test_each_known_sentence_alone(spark):
    names = list(licenses.SENTENCES)
    texts = [(i, mark.join(licenses.SENTENCES[x].split(" ")) + ".") for mark in (" ", "\n") for i, x in enumerate(names, len(names) * (mark == "\n"))]
    got = {r.doc_id: r.sentence_ids for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [[x] for x in names] * 2


def best_of(rows, k=5):
    """All result rows by brute force, from (id, vector) rows."""
    usable = []
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(256 * x) for x in v):
            usable.append((key, [math.floor(256 * x) for x in v]))
    want = Counter()
    for i, (key, q) in enumerate(usable):
        if key % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), other) for j, (other, c) in enumerate(usable) if j != i and len(c) == len(q))
            want.update((key, n + 1, other, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, other) in enumerate(scores[:k]))
    return want


@pytest.mark.parametrize("size,kind", [(7, "small"), (7, "repeated"), (7, "1e7"), (4096, "repeated"), (4096, "1e17"), (4096, "1e300")])
def test_top_k(spark, monkeypatch, size, kind):
    monkeypatch.setattr(topk_search, "CANDIDATES", size)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    monkeypatch.setattr(topk_search, "PASS_BYTES", 500 if size == 7 else 1 << 20)
    monkeypatch.setattr(topk_search, "BINS", 300 if size == 7 else 4096)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, [1.0] * 6) for i in range(30)] + [(None, [1.0] * 6), (400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (450, [1.0] * 3), (451, [2.0] * 3), (500, [1.0] * 2)]
    if kind == "repeated":
        rows += [(50, [9.0] * 6), (50, [9.0] * 6), (7, [1.0] * 6), (7, [2.0, 1.0, 1.0, 1.0, 1.0, 1.0]), (200, [1.0] * 6)]
    elif kind != "small":
        big = float(kind)
        rows += [(600 + i, [big * (1 + i), -big, *[float(x) for x in rng.normal(size=4)]]) for i in range(12)] + [(650, [-big, big / 3, 1.0, 2.0, big, 0.5]), (700, [1.7e308] * 6)]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, rank string, score int")
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df.repartition(3)).collect()) == best_of(rows)
    assert top_k(df.limit(0)).count() == 0
