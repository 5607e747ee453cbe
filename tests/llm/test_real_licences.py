"""Licences in the form in which real texts have them: whole sentences, wrapped lines, comment marks."""

import textwrap

import duckdb

from sparkfen.llm import licenses, registry
from tests.differential import rows_of

MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE.
"""
APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
GPL2 = GPL.format(2).replace("software: you", "software; you").replace("Foundation, either", "Foundation; either")
TITLES = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n"
CASES = {
    "mit": (MIT, "MIT"), "apache": (APACHE, "Apache-2.0"), "gpl3": (GPL.format(3), "GPL-3.0"), "gpl2": (GPL2, "GPL-2.0"), "bsd": (BSD, "BSD"), "title": (TITLES, "GPL-3.0"),
    "hash": (textwrap.indent(APACHE, "# ", lambda _: True), "Apache-2.0"), "star": ("/*\n" + textwrap.indent(MIT, " * ", lambda _: True) + " */\n", "MIT"), "crlf": (MIT.replace("\n", "\r\n"), "MIT"),
    "long lines": ("\n\n".join(" ".join(p.split()) for p in MIT.split("\n\n")), "MIT"), "notice": ("Some words\nReleased under the MIT License\nother words", "MIT"), "after colon": ("License: Released under the MIT License.", "MIT"),
    "split": ("Released under\n\nthe MIT License.", ""), "within": ("Not released under the MIT License.", ""), "marks": ("a | b ~ released under the mit license", ""), "half": (MIT[: MIT.index("THE SOFTWARE IS")], ""),
}


BSD2 = BSD[: BSD.index("1.")] + """1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DAMAGES.
"""
CCBY = """This work is licensed under a Creative Commons
Attribution 4.0 International License. See the file.
"""
TEXTS = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0": GPL.format(3), "GPL-2.0": GPL2, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "LGPL-2.1": LGPL, "MPL-2.0": MPL, "ISC": ISC, "CC-BY-4.0": CCBY}


def test_usual_licences_in_any_layout(spark):
    """Each as written, unwrapped, wrapped anew at other widths, in comments, and below a heading without an end."""
    made = []
    for name, text in TEXTS.items():
        paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
        layouts = [text, "\n\n".join(paragraphs), *("\n\n".join(textwrap.fill(p, width) for p in paragraphs) for width in (30, 55, 100))]
        layouts += [textwrap.indent(text, "// ", lambda _: True), "A heading\n" + text, "word " * 30_000 + "\n" + text]
        made += [(name, i, t) for i, t in enumerate(layouts)]
    df = spark.createDataFrame([(f"{n}:{i}", t, 1) for n, i, t in made * 2], "doc_id string, text string, licenses int")
    got = licenses.digest(df).collect()
    assert len(got) == 2 * len(made) and [(r.doc_id, r.licenses) for r in got if r.doc_id.split(":")[0] != r.licenses] == []


def test_other_tags_and_titles(spark):
    cases = {"/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0-or-later", "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "x\nSPDX-License-Identifier: MPL-2.0\ny": "MPL-2.0", "CC0 1.0 Universal": "CC0-1.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007": "AGPL-3.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License": "CC-BY-SA-4.0", "see SPDX-License-Identifier: MIT": "", "": ""}
    df = spark.createDataFrame([(k, k) for k in cases], "doc_id string, text string")
    assert {r.doc_id: r.licenses for r in licenses.digest(df).collect()} == cases


def test_against_sql_on_real_texts(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*TEXTS.values(), MIT + APACHE + BSD3 + LGPL, *(t for t, _ in CASES.values()), "", " \n"])] + [(900, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want, got = con.sql(registry.oracle_sql()["op6_license_scan"]).df(), registry.op6_license_scan(spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(want) and got["licensed"].sum() > 15


def test_real_texts(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "doc_id string, text string")
    assert {r.doc_id: r.licenses for r in licenses.digest(df).collect()} == {k: v for k, (_, v) in CASES.items()}


def test_identifiers_come_in_text_order(spark):
    df = spark.createDataFrame([(1, APACHE + "\nReleased under the MIT License.\n" + BSD)], "doc_id long, text string")
    assert licenses.digest(df).first().sentence_ids == "apache-2.0-notice-real,apache-2.0-file,apache-2.0-asis-real,mit-notice,bsd-redistribute"


BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
"""
NAMES = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n   This product includes software developed by Example.\n"
FEE = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n"
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS. IN NO EVENT'
NAMED = {
    BSD_TERMS + NAMES.format("the copyright holder"): "BSD-3-Clause", BSD_TERMS + NAMES.format("Example Inc."): "BSD-3-Clause", BSD_TERMS + NAMES.format("the Regents of the University of\n   Example, Ltd."): "BSD-3-Clause",
    BSD_TERMS: "BSD-2-Clause", BSD_TERMS + ADVERT + NAMES.format("the University"): "BSD-4-Clause", FEE.format("and/or") + WARRANTY.format("THE AUTHOR"): "ISC", FEE.format("and") + WARRANTY.format("ISC"): "ISC",
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n": "GPL-2.0-only",
    "// SPDX-License-Identifier: GPL-2.0-or-later\n": "GPL-2.0-or-later", "# SPDX-License-Identifier: LGPL-2.1-only\n": "LGPL-2.1-only",
}


def test_names_in_sentences(spark):
    """Expected names are written here, not taken from the dictionary: organisations in gaps, and tags as they are."""
    df = spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.digest(df).collect()}
    assert [got[i] for i in range(len(NAMED))] == list(NAMED.values())
