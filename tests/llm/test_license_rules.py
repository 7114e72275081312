from __future__ import annotations

import re
import textwrap

from llm.conftest import docs_frame

from debtscope.llm import license_rules as L

MIT = """Copyright (c) 2020 A. Author

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
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
CASES = [
    (MIT, "MIT", "permissive"),
    ("Some words here\nReleased under the MIT License.", "MIT", "permissive"),
    ("Licensed under CC BY-NC 4.0. All rights reserved.", "CC-BY-NC-4.0,LicenseRef-all-rights-reserved", "noncommercial"),
    ("This work is licensed under the GNU General Public License,\n  version 3.", "GPL-3.0-only", "copyleft"),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "MIT,Apache-2.0", "permissive"),
    ("Released under the MIT License. Text. Released under the MIT License.", "MIT,MIT", "permissive"),
    ("He said: the MIT License is short.", "", "none"),
    ("Proprietary and confidential. All rights reserved.", "LicenseRef-proprietary", "proprietary"),
]


def test_cases(spark, edge_docs, no_docs):
    df = docs_frame(spark, [(i, t, "en", "s") for i, (t, _, _) in enumerate(CASES)])
    got = {r.doc_id: (r.licences, r.verdict) for r in L.scan(df).select("row.doc_id", "licences", "verdict").collect()}
    assert got == {i: (licences, verdict) for i, (_, licences, verdict) in enumerate(CASES)}
    edge = L.scan(edge_docs).select("row.*", "n_sentences", "sequence", "verdict").collect()
    assert len(edge) == edge_docs.count() and {(r.n_sentences, r.sequence, r.verdict) for r in edge} == {(0, "", "none")}
    assert L.scan(no_docs).count() == 0


def test_tables():
    ids = set(L.SENTENCES)
    assert len({s for forms in L.SENTENCES.values() for s in forms}) == sum(map(len, L.SENTENCES.values()))
    assert {k for _, _, _, k in L.RULES} <= set(L.CLASSES)
    used = {i for i in ids if any(f"<{i}>" in p for _, p, _, _ in L.RULES)}
    assert ids == used


MIT_REF = "This project is licensed under the MIT License."
BSD2 = """Copyright (c) 2020 The Authors

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
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
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
APACHE = """Copyright 2020 The Authors

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


def gnu(work, name, mark, version):
    return f"""Copyright (C) 2020 The Authors

This {work} is free software{mark[0]} you can redistribute it and/or modify
it under the terms of the GNU {name} Public License as published by
the Free Software Foundation{mark[1]} either version {version} of the License, or
(at your option) any later version.

This {work} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} Public License for more details.

You should have received a copy of the GNU {name} Public License
along with this {work}.  If not, see <https://www.gnu.org/licenses/>.
"""


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright 2020 A. Author

Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DAMAGES.
"""
CC = "This work is licensed under a Creative Commons {} 4.0 International License."
#: Published texts, with the sequence a rule has to see in them.
PUBLISHED = [
    (MIT, "MIT", "<mit_grant><mit_notice><mit_asis><mit_liability>"),
    (BSD2 + DISCLAIMER, "BSD-2-Clause", "<bsd_redistribution><bsd_source><bsd_binary>"),
    (BSD3 + DISCLAIMER, "BSD-3-Clause", "<bsd_redistribution><bsd_source><bsd_binary><bsd_endorse>"),
    (APACHE, "Apache-2.0", "<apache_header><apache_maynot><apache_copy><apache_unless>"),
    (gnu("program", "General", ":,", 3), "GPL-3.0-or-later", "<gpl3_later><gpl_hope><gpl_see>"),
    (gnu("program", "General", ";;", 2), "GPL-2.0-or-later", "<gpl2_later><gpl_hope><gpl_see>"),
    (gnu("library", "Lesser General", ";;", 3), "LGPL-3.0-or-later", "<lgpl3_later><gpl_hope><lgpl_see>"),
    (MPL, "MPL-2.0", "<mpl_notice>"),
    (MIT_REF, "MIT", "<mit_ref>"),
    (CC.format("Attribution"), "CC-BY-4.0", "<ccby_ref>"),
    (CC.format("Attribution-ShareAlike"), "CC-BY-SA-4.0", "<ccbysa_ref>"),
    (CC.format("Attribution-NonCommercial"), "CC-BY-NC-4.0", "<ccbync_ref>"),
    ("This work is in the public domain.", "CC0-1.0", "<public_domain>"),
    ("Proprietary and confidential. All rights reserved.", "LicenseRef-proprietary", "<confidential><reserved>"),
    (gnu("program", "Affero General", ":,", 3), "AGPL-3.0-or-later", "<agpl3_later><gpl_hope><agpl_see>"),
    (gnu("library", "Lesser General", ";;", "2.1"), "LGPL-2.1-or-later", "<lgpl21_later><gpl_hope><lgpl_see>"),
    (ISC, "ISC", "<isc_grant><isc_disclaimer>"),
    (CC.format("Attribution-NoDerivatives"), "CC-BY-ND-4.0", "<ccbynd_ref>"),
    (CC.format("Attribution-NonCommercial-ShareAlike"), "CC-BY-NC-SA-4.0", "<ccbyncsa_ref>"),
]


def forms(text):
    """The text as published, wrapped at several widths or not at all, and in comments."""
    paragraphs = [" ".join(p.split()) for p in text.strip().split("\n\n")]
    yield text
    for width in (31, 47, 66, 90, 10_000):
        lines = "\n\n".join(textwrap.fill(p, width) for p in paragraphs).split("\n")
        yield "\n".join(lines)
        for mark in ("# ", "// ", "-- ", ";; "):
            yield "\n".join((mark + x).rstrip() for x in lines) + "\n\ncode = 1\n"
        yield "/*\n" + "\n".join((" * " + x).rstrip() for x in lines) + "\n */\nint x;\n"
        yield "<!--\n" + "\n".join("  " + x for x in lines) + "\n-->\n"


def test_published_texts(spark):
    rows = [(text, licence, seq) for whole, licence, seq in PUBLISHED for text in forms(whole)]
    rows += [(" ".join(text.split("\n", 2)[2].split()), licence, seq) for text, licence, seq in PUBLISHED[1:3]]
    got = L.scan(docs_frame(spark, [(i, t, "en", "s") for i, (t, _, _) in enumerate(rows)])).select("row.doc_id", "licences", "sequence", "verdict").collect()
    kinds = {licence: kind for _, _, licence, kind in L.RULES}
    bad = [(rows[r.doc_id], r.licences, r.sequence, r.verdict) for r in got
           if r.licences != rows[r.doc_id][1] or rows[r.doc_id][2] not in r.sequence or r.verdict != kinds[r.licences]]
    assert bad == [] and len(got) == len(rows)


def test_every_licence_by_name_and_tag(spark):
    named = [("GNU GPL v3", "GPL-3.0-only"), ("GNU General Public License, version 2 or later", "GPL-2.0-or-later"),
             ("GNU Lesser General Public License, version 3", "LGPL-3.0-only"), ("Mozilla Public License, v. 2.0", "MPL-2.0"),
             ("Apache License, Version 2.0", "Apache-2.0"), ("BSD 3-Clause License", "BSD-3-Clause")]
    rows = [(f"Some words.\n{lead} the {name}.\n", lic) for name, lic in named for lead in ("Licensed under", "Released under", "This work is licensed under")]
    tags = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later",
            "AGPL-3.0-only", "AGPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "ISC", "Zlib", "BSL-1.0", "EPL-2.0", "Unlicense",
            "Artistic-2.0", "0BSD", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
    rows += [(form.format(t), t) for t in tags for form in (
        "SPDX-License-Identifier: {}", "// SPDX-License-Identifier: {}\n\nint x;", "# BY ACME\n# SPDX-License-Identifier: {}\n# Copyright 2020\nimport os\n",
        "/* SPDX-License-Identifier: {} */\nint x;\n")]
    rows += [("# SPDX-License-Identifier: GPL-2.0+\nx\n", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: AGPL-3.0+\nx\n", "AGPL-3.0-or-later"), ("This code is not\nlicensed under the MIT License.", "")]
    got = L.scan(docs_frame(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(rows)])).select("row.doc_id", "licences").collect()
    assert [(rows[r.doc_id], r.licences) for r in got if r.licences != rows[r.doc_id][1]] == []
    assert all(s == " ".join(re.findall("[a-z0-9]+", s.lower())) for forms in L.SENTENCES.values() for s in forms)


def verdicts(spark, texts):
    got = L.scan(docs_frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    return [(r.licences, r.verdict) for r in got.select("row.doc_id", "licences", "verdict").orderBy("doc_id").collect()]


def test_reserved_rights_do_not_outrank_a_licence(spark):
    head = "Copyright (c) 2020, The Authors\nAll rights reserved.\n\n"
    got = verdicts(spark, [head + BSD3.split("\n", 2)[2] + DISCLAIMER, head + MIT, "All rights reserved."])
    assert [v for _, v in got] == ["permissive", "permissive", "reserved"]
    assert "BSD-3-Clause" in got[0][0] and "MIT" in got[1][0]


def test_holders_of_their_own_name(spark):
    names = ["Google Inc.", "the University of California, Berkeley", "the <organization>", "Acme Ltd", "the copyright holder"]
    texts = [text for name in names for text in forms(BSD3.replace("the copyright holder", name) + DISCLAIMER)]
    texts.append((BSD3 + DISCLAIMER).replace("Neither the name of the copyright holder", "Neither the names of the copyright holders"))
    assert set(verdicts(spark, texts)) == {("BSD-3-Clause", "permissive")}
    other = BSD2 + "\nNeither the name of the game nor its rules matter.\n"
    assert verdicts(spark, [other]) == [("BSD-2-Clause", "permissive")]


def test_punctuation_beyond_ascii(spark):
    curly = MIT.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u00abAS IS\u00bb").replace("and/or", "and\u2044or")
    dashes = (BSD3 + DISCLAIMER).replace("and/or", "and\u2010or").replace("modification, are", "modification\u00a0\u2014 are")
    got = verdicts(spark, [curly, dashes, "Released\u00a0under the MIT\u2009License\u2026"])
    assert got == [("MIT", "permissive"), ("BSD-3-Clause", "permissive"), ("MIT", "permissive")]
    # letters are no punctuation
    assert verdicts(spark, ["Released under thé MIT License.", "ªReleased under the MIT License."]) == [("", "none")] * 2
