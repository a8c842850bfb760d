"""License headers as files carry them; the expected licenses are written by hand."""

from seqspark.llm import licenses

REST = """
This is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the {0} for more details.

You should have received a copy of the {0} along with this; if not, see <https://www.gnu.org/licenses/>.
"""
HEADERS = [
    (["GPL-2.0"], "GNU General Public License", """\
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""),
    (["GPL-3.0"], "GNU General Public License", """\
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""),
    (["LGPL-2.0"], "GNU Library General Public License", """\
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Library General Public
 * License as published by the Free Software Foundation; either
 * version 2 of the License, or (at your option) any later version.
"""),
    (["LGPL-2.1"], "GNU Lesser General Public License", """\
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""),
    (["LGPL-3.0"], "GNU Lesser General Public License", """\
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Lesser General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""),
    (["AGPL-3.0"], "GNU Affero General Public License", """\
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""),
    # version 1 has no template
    ([], "GNU General Public License", """\
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 1, or (at your option)
 * any later version.
"""),
    # a word is missing next to the one that tells it from its siblings
    (["GPL-3.0"], "GNU General Public License", """\
# This program is free software: you can redistribute it and/or modify
# it under the terms of GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""),
]


def found(spark, texts, templates=None):
    out = {i: [] for i in range(len(texts))}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect():
        out[r["doc_id"]].append(r["license"])
    return [sorted(out[i]) for i in range(len(texts))]


def test_headers_of_sibling_licenses(spark):
    texts = [f"Copyright 2020 Acme\n\n{header}{REST.format(name)}\nimport os\n" for _, name, header in HEADERS]
    both = HEADERS[0][2] + "\nor, for the parts of others,\n\n" + HEADERS[5][2]
    assert found(spark, [*texts, both]) == [*[names for names, *_ in HEADERS], ["AGPL-3.0", "GPL-2.0"]]


def test_siblings_in_different_blocks(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BLOCK_WINDOWS", 1)
    three = [t for t in licenses.TEMPLATES if t[1].startswith("This program") and t[0] in ("GPL-2.0", "GPL-3.0", "AGPL-3.0")]
    assert found(spark, [HEADERS[k][2] for k in (0, 1, 5)], three) == [["GPL-2.0"], ["GPL-3.0"], ["AGPL-3.0"]]


def test_short_templates_inside_lines(spark):
    texts = [
        "Copyright 2020 Acme. All rights reserved.", "All rights reserved.", "a page, all rights\nreserved, by its owner", "all the rights are reserved",
        "one\n\nAll rights reserved.\nfour all rights reserved", "rights reserved", "reserved by GPLv9", "GPLv9\n",
    ]
    templates = [("Proprietary", "All rights reserved."), ("New", "GPLv9")]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()
    got = sorted((r["doc_id"], r["license"], r["n_places"], r["first_word"], r["containment"]) for r in rows)
    assert got == [
        (0, "Proprietary", 1, 3, 1.0), (1, "Proprietary", 1, None, 1.0), (2, "Proprietary", 1, 2, 1.0), (4, "Proprietary", 2, 5, 1.0),
        (6, "New", 1, 2, 1.0), (7, "New", 1, None, 1.0),
    ]


def test_a_long_template(spark):
    long = " ".join(f"w{i}" for i in range(1500))
    cut = " ".join(f"w{i}" for i in range(1000))
    assert found(spark, [f"before it {long} after it", long, cut], [("Long", long)]) == [["Long"], ["Long"], []]


def test_whole_licenses(spark):
    """The texts of this library, whole and without a tenth of their lines, between other words; and a table of templates made of a folder."""
    names = ["Apache-2.0", "GPL-2.0", "MPL-2.0"]
    whole = [(licenses.TEXTS / f"{n}.txt").read_text() for n in names]
    most = ["\n".join(x for i, x in enumerate(t.splitlines()) if i % 200 < 180) for t in whole]
    half = ["\n".join(t.splitlines()[: len(t.splitlines()) // 2]) for t in whole]
    assert all(len(t.split()) > 1500 for t in whole)
    table = licenses.read_templates(spark, str(licenses.TEXTS))
    got = found(spark, [f"some words before {whole[0]} and after", most[1], most[2], half[0], half[2]], table)
    assert got == [[n] for n in names] + [[]] * 2


def test_repeated_rows_and_templates_are_reported_each(spark):
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (2, notice), (None, notice), (None, notice), (3, None), (4, "")]
    templates = spark.createDataFrame([("MIT", notice), ("MIT", notice), ("None", None), ("Empty", "")], "license string, template string")
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), templates).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "2", "None", "None"] and all(r["license"] == "MIT" and r["containment"] == 1 for r in out)
