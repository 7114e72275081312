"""Licence recognition by sentences and ordered rules.

Comment marks and list numbers are taken out of a text, places where a sentence may start or
end are marked, and case and punctuation go.  A known licence sentence is found where it runs
from one mark to another, whatever marks lie inside it, so line wraps and ``;``, ``:`` or
``v.`` in its wording do not matter; of several that start at a mark the longest counts.  The
identifiers found, with ``?`` for what stands between them, form a sequence;
ordered rules match parts of it, longer and more exact ones first, and what a rule has
matched is taken out.  Rules name a licence and its class; the strictest class found is the
document's verdict.

All of it are expressions on the row, without a shuffle.  Defined results: null and empty
texts have no sentences and the verdict ``none``; repeated rows are answered one by one; a
licence that several parts name is listed once for each; other columns are carried in the
struct ``row``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.llm.common import packed, whole_text

#: Normalised sentences of public licences and notices, by identifier.
SENTENCES: dict[str, list[str]] = {
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "mit_notice": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the software",
    ],
    "mit_asis": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "mit_liability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an"
        " action of contract tort or otherwise arising from out of or in connection with the software or the use or other"
        " dealings in the software",
    ],
    "apache_header": ["licensed under the apache license version 2 0 the license"],
    "apache_maynot": ["you may not use this file except in compliance with the license"],
    "apache_copy": [
        "you may obtain a copy of the license at",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at https www apache org licenses license 2 0",
    ],
    "apache_unless": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on"
        " an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd_redistribution": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
    ],
    "bsd_source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following"
        " disclaimer",
    ],
    "bsd_binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
        " disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd_endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission",
    ],
    "gpl_hope": [
        f"this {work} is distributed in the hope that it will be useful but without any warranty without even the implied"
        " warranty of merchantability or fitness for a particular purpose"
        for work in ("program", "library", "software")
    ],
    "gpl_see": ["see the gnu general public license for more details"],
    "lgpl_see": ["see the gnu lesser general public license for more details"],
    "agpl_see": ["see the gnu affero general public license for more details"],
    "mpl_notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc_grant": [
        f"permission to use copy modify and {andor}distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies"
        for andor in ("or ", "")
    ],
    "isc_disclaimer": [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied"
        " warranties of merchantability and fitness",
    ],
    "zlib_grant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and"
        " redistribute it freely subject to the following restrictions",
    ],
    "unlicense_text": ["this is free and unencumbered software released into the public domain"],
    "public_domain": ["released into the public domain", "this work is in the public domain"],
    "reserved": ["all rights reserved"],
    "confidential": ["proprietary and confidential", "unauthorized copying of this file via any medium is strictly prohibited"],
}
#: Notices of the GNU licences, by identifier: name of the licence, version.
for _id, _name, _version in [("gpl3_later", "general", "3"), ("gpl2_later", "general", "2"), ("lgpl3_later", "lesser general", "3"),
                             ("lgpl21_later", "lesser general", "2 1"), ("agpl3_later", "affero general", "3")]:
    SENTENCES[_id] = [
        f"this {work} is free software you can redistribute it and or modify it under the terms of the gnu {_name} public"
        f" license as published by the free software foundation either version {_version} of the license or at your option"
        " any later version"
        for work in ("program", "library", "software")
    ]

#: Ways to name a licence, the same for all: a lead-in and a name, or the tag and an SPDX identifier.
LEADS = ["licensed under", "released under", "distributed under",
         *(f"this {work} is licensed under" for work in ("work", "project", "software", "program"))]
TAG = "spdx license identifier"


def _gnu(name: str, short: str, version: str, later: bool) -> list[str]:
    names = [f"the gnu {n} {v}{version}" for n in (name, short) for v in ("version ", "v")]
    ends = ("or later", "or any later version", "or at your option any later version") if later else ("", "only")
    return [f"{n} {end}".rstrip() for n in names for end in ends]


def _cc(kinds: str, short: str) -> list[str]:
    long = [f"{a} creative commons {kinds} 4 0 {rest}" for a in ("a", "the") for rest in ("international license", "license")]
    return [*long, f"{short} 4 0", f"the {short} 4 0 license"]


#: (names in sentences, SPDX identifiers) by identifier.
NAMES: dict[str, tuple[list[str], list[str]]] = {
    "mit_ref": (["the mit license", "mit license", "the terms of the mit license"], ["mit"]),
    "bsd2_ref": (["the bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license"], ["bsd 2 clause"]),
    "bsd3_ref": (["the bsd 3 clause license", "the 3 clause bsd license", "the new bsd license"], ["bsd 3 clause"]),
    "apache_ref": ([f"the apache license{v} 2 0" for v in ("", " version", " v")] + ["the apache 2 0 license", "the apache license v2 0"], ["apache 2 0"]),
    "gpl3_ref": (_gnu("general public license", "gpl", "3", False), ["gpl 3 0 only", "gpl 3 0"]),
    "gpl3_later_ref": (_gnu("general public license", "gpl", "3", True), ["gpl 3 0 or later"]),
    "gpl2_ref": (_gnu("general public license", "gpl", "2", False), ["gpl 2 0 only", "gpl 2 0"]),
    "gpl2_later_ref": (_gnu("general public license", "gpl", "2", True), ["gpl 2 0 or later"]),
    "lgpl_ref": (_gnu("lesser general public license", "lgpl", "3", False), ["lgpl 3 0 only", "lgpl 3 0"]),
    "lgpl_later_ref": (_gnu("lesser general public license", "lgpl", "3", True), ["lgpl 3 0 or later"]),
    "mpl_ref": ([f"the mozilla public license{v} 2 0" for v in ("", " version", " v")], ["mpl 2 0"]),
    "cc0_ref": (["cc0 1 0", "cc0 1 0 universal", "the cc0 1 0 universal license", "the creative commons cc0 1 0 universal license"], ["cc0 1 0"]),
    "ccby_ref": (_cc("attribution", "cc by"), ["cc by 4 0"]),
    "ccbysa_ref": (_cc("attribution sharealike", "cc by sa"), ["cc by sa 4 0"]),
    "ccbync_ref": (_cc("attribution noncommercial", "cc by nc"), ["cc by nc 4 0"]),
    "agpl_ref": (_gnu("affero general public license", "agpl", "3", False), ["agpl 3 0 only", "agpl 3 0"]),
    "agpl_later_ref": (_gnu("affero general public license", "agpl", "3", True), ["agpl 3 0 or later"]),
    "lgpl21_ref": (_gnu("lesser general public license", "lgpl", "2 1", False), ["lgpl 2 1 only", "lgpl 2 1"]),
    "lgpl21_later_ref": (_gnu("lesser general public license", "lgpl", "2 1", True), ["lgpl 2 1 or later"]),
    "isc_ref": (["the isc license", "isc license"], ["isc"]),
    "zlib_ref": (["the zlib license", "zlib license"], ["zlib"]),
    "boost_ref": (["the boost software license", "the boost software license version 1 0"], ["bsl 1 0"]),
    "epl_ref": (["the eclipse public license v 2 0", "the eclipse public license version 2 0", "the eclipse public license 2 0"], ["epl 2 0"]),
    "unlicense_ref": (["the unlicense"], ["unlicense"]),
    "artistic_ref": (["the artistic license 2 0"], ["artistic 2 0"]),
    "bsd0_ref": (["the zero clause bsd license", "the bsd zero clause license"], ["0bsd"]),
    "ccbynd_ref": (_cc("attribution noderivatives", "cc by nd"), ["cc by nd 4 0"]),
    "ccbyncsa_ref": (_cc("attribution noncommercial sharealike", "cc by nc sa"), ["cc by nc sa 4 0"]),
    "ccbyncnd_ref": (_cc("attribution noncommercial noderivatives", "cc by nc nd"), ["cc by nc nd 4 0"]),
}
SENTENCES |= {i: [f"{lead} {name}" for lead in LEADS for name in names] + [f"{TAG} {tag}" for tag in tags] for i, (names, tags) in NAMES.items()}

#: (rule, pattern over the identifiers, licence, class), applied in this order.
RULES: list[tuple[str, str, str, str]] = [
    ("mit_text", "<mit_grant><mit_notice>(?:<mit_asis>)?(?:<mit_liability>)?", "MIT", "permissive"),
    ("bsd3_text", "<bsd_redistribution><bsd_source><bsd_binary><bsd_endorse>", "BSD-3-Clause", "permissive"),
    ("bsd2_text", "<bsd_redistribution><bsd_source><bsd_binary>", "BSD-2-Clause", "permissive"),
    ("apache_text", "<apache_header><apache_maynot>(?:<apache_copy>)?(?:<[?]>)?(?:<apache_unless>)?", "Apache-2.0", "permissive"),
    ("gpl3_text", "<gpl3_later>(?:<gpl_hope>)?(?:<gpl_see>)?", "GPL-3.0-or-later", "copyleft"),
    ("gpl2_text", "<gpl2_later>(?:<gpl_hope>)?(?:<gpl_see>)?", "GPL-2.0-or-later", "copyleft"),
    ("lgpl3_text", "<lgpl3_later>(?:<gpl_hope>)?(?:<lgpl_see>)?", "LGPL-3.0-or-later", "copyleft"),
    ("agpl3_text", "<agpl3_later>(?:<gpl_hope>)?(?:<agpl_see>)?", "AGPL-3.0-or-later", "copyleft"),
    ("lgpl21_text", "<lgpl21_later>(?:<gpl_hope>)?(?:<lgpl_see>)?", "LGPL-2.1-or-later", "copyleft"),
    ("isc_text", "<isc_grant>(?:<isc_disclaimer>)?", "ISC", "permissive"),
    ("zlib_text", "<zlib_grant>", "Zlib", "permissive"),
    ("unlicense_text", "<unlicense_text>", "Unlicense", "permissive"),
    ("mit_ref", "<mit_ref>", "MIT", "permissive"),
    ("bsd3_ref", "<bsd3_ref>", "BSD-3-Clause", "permissive"),
    ("bsd2_ref", "<bsd2_ref>", "BSD-2-Clause", "permissive"),
    ("apache_ref", "<apache_ref>", "Apache-2.0", "permissive"),
    ("gpl3_ref", "<gpl3_ref>", "GPL-3.0-only", "copyleft"),
    ("gpl2_ref", "<gpl2_ref>", "GPL-2.0-only", "copyleft"),
    ("gpl3_later_ref", "<gpl3_later_ref>", "GPL-3.0-or-later", "copyleft"),
    ("gpl2_later_ref", "<gpl2_later_ref>", "GPL-2.0-or-later", "copyleft"),
    ("lgpl_later_ref", "<lgpl_later_ref>", "LGPL-3.0-or-later", "copyleft"),
    ("lgpl_ref", "<lgpl_ref>", "LGPL-3.0-only", "copyleft"),
    ("mpl_ref", "<mpl_ref>|<mpl_notice>", "MPL-2.0", "copyleft"),
    ("cc0_ref", "<cc0_ref>|<public_domain>", "CC0-1.0", "permissive"),
    ("ccby_ref", "<ccby_ref>", "CC-BY-4.0", "permissive"),
    ("ccbysa_ref", "<ccbysa_ref>", "CC-BY-SA-4.0", "copyleft"),
    ("ccbync_ref", "<ccbync_ref>", "CC-BY-NC-4.0", "noncommercial"),
    ("agpl_ref", "<agpl_ref>", "AGPL-3.0-only", "copyleft"),
    ("agpl_later_ref", "<agpl_later_ref>", "AGPL-3.0-or-later", "copyleft"),
    ("lgpl21_ref", "<lgpl21_ref>", "LGPL-2.1-only", "copyleft"),
    ("lgpl21_later_ref", "<lgpl21_later_ref>", "LGPL-2.1-or-later", "copyleft"),
    ("isc_ref", "<isc_ref>", "ISC", "permissive"),
    ("zlib_ref", "<zlib_ref>", "Zlib", "permissive"),
    ("boost_ref", "<boost_ref>", "BSL-1.0", "permissive"),
    ("epl_ref", "<epl_ref>", "EPL-2.0", "copyleft"),
    ("unlicense_ref", "<unlicense_ref>", "Unlicense", "permissive"),
    ("artistic_ref", "<artistic_ref>", "Artistic-2.0", "permissive"),
    ("bsd0_ref", "<bsd0_ref>", "0BSD", "permissive"),
    ("ccbynd_ref", "<ccbynd_ref>", "CC-BY-ND-4.0", "noderivatives"),
    ("ccbyncsa_ref", "<ccbyncsa_ref>", "CC-BY-NC-SA-4.0", "noncommercial"),
    ("ccbyncnd_ref", "<ccbyncnd_ref>", "CC-BY-NC-ND-4.0", "noncommercial"),
    ("proprietary", "<confidential>(?:<reserved>)?|<reserved><confidential>", "LicenseRef-proprietary", "proprietary"),
    ("reserved", "<reserved>", "LicenseRef-all-rights-reserved", "reserved"),
]
#: Classes from the strictest; a reservation of rights counts only where no licence is found.
CLASSES = ["proprietary", "noncommercial", "noderivatives", "copyleft", "permissive", "reserved"]

#: Taken out: comment marks that start a line, and list marks after a sentence or an empty line.
COMMENT = r"""(?m)^[ \t]*(?:<!--+|/\*+|\*+/?|//+!?|#+|--+|;+|%+|>+|"{3}|'{3}|(?:dnl|rem|REM|[.]{2})(?=[ \t\r\n]))[ \t]*"""
LISTED = r"(\A[ \t\n\r\f]*|[.!?;:][ \t\n\r\f]+|\n[ \t\r\f]*\n[ \t\n\r\f]*)(?:\(?(?:[0-9]{1,2}|[a-z])[.)]|[-*•])[ \t\n\r\f]+"
#: Marks where a sentence may start or end: at empty lines, after punctuation, and at line
#: breaks unless the line goes on, that is, ends with a comma or capital or is followed by a
#: small letter.
ENDS = [
    (r"([^ \t\n\r\f])[ \t\r\f]*\n[ \t\r\f]*\n[ \t\n\r\f]*(?=[^ \t\n\r\f])", "$1\x01"),
    (r"([.!?;:])[ \t\n\r\f]+", "$1\x01"),
    (r"([^,A-Z \t\n\r\f])[ \t\r\f]*\n[ \t\n\r\f]*([^a-z \t\n\r\f])", "$1\x01$2"),
]
#: A tag ends with its line; the + of an identifier is punctuation and would go.
TAGGED = [
    (r"([^ \t\n\r\f])[ \t\r\f]*\n[ \t\n\r\f]*(?=SPDX-License-Identifier:)", "$1\x01"),
    (r"(SPDX-License-Identifier:[^\n]*[^ \t\n\r\f])[ \t\r\f]*\n[ \t\n\r\f]*(?=[^ \t\n\r\f])", "$1\x01"),
    (r"(SPDX-License-Identifier:[ \t]*[AL]?GPL-[0-9.]+)\+", "$1-or-later"),
]
#: Characters that normalising turns into one space: all of ASCII but letters and digits, and
#: the signs, spaces, quotes and dashes of Latin-1 and of general and CJK punctuation.
NOISE = "[\\x00\\x02-\\x2F\\x3A-\\x60\\x7B-\\x7F\u0080-\u00A9\u00AB-\u00B4\u00B6-\u00B9\u00BB-\u00BF\u2000-\u206F\u3000-\u303F\uFEFF]+"
#: Wording that holds a name of one's own, and the known sentence it stands for.
HOLDERS = [
    ("neither the names? of [^\x02]{1,160}? (?:nor the names of (?:its|their|any|other|the)(?: other)? contributors|nor the names of contributors|nor contributors) may be used to endorse"
     " or promote products derived from this software without[ \x01]+(?:specific )?prior written permission",
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
     " from this software without specific prior written permission"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _loose(pattern: str) -> str:
    """Spaces between words may be marks; those inside brackets of a pattern stay."""
    return pattern.replace("[ \x01]+", "\x03").replace(" ", "[ \x01]").replace("\x03", "[ \x01]+")


def _known() -> str:
    """Pattern of all known sentences between marks, longer ones first, by their first words."""
    heads: dict[str, list[str]] = {}
    for form in sorted((s for forms in SENTENCES.values() for s in forms), key=len, reverse=True):
        heads.setdefault(form.split(" ", 1)[0], []).append(form)
    rest = ["(?:" + "|".join(f[len(h):].replace(" ", "[ \x01]") for f in forms) + ")" for h, forms in heads.items()]
    return "(?<=\x01)(" + "|".join(h + r for h, r in zip(heads, rest)) + ")(?=\x01)"


def sentences(text: Column) -> Column:
    """Known sentences of a text, and what stands before, between and after them.

    Where two of them, or one and an end of the text, meet, the mark alone is between.
    """
    tagged = text
    for pattern, mark in [(COMMENT, ""), *TAGGED]:
        tagged = F.regexp_replace(tagged, pattern, mark)
    text = F.when(text.contains("SPDX-License-Identifier:"), tagged).otherwise(F.regexp_replace(text, COMMENT, ""))
    text = F.regexp_replace(text, LISTED, "$1")
    for pattern, mark in ENDS:
        text = F.regexp_replace(text, pattern, mark)
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), NOISE, " ")
    plain = F.regexp_replace(F.concat(F.lit("\x01"), plain, F.lit("\x01")), " *\x01 *", "\x01")
    for pattern, known in HOLDERS:
        plain = F.regexp_replace(plain, _loose(pattern), known)
    return F.split(F.regexp_replace(plain, _known(), "\x02$1\x02"), "\x02")


def identifiers(found: Column) -> Column:
    """Identifiers of known sentences, null for what is none; without what is only a mark."""
    known = F.create_map(*[F.lit(x) for i, forms in SENTENCES.items() for s in forms for x in (s, i)])
    parts = F.filter(found, lambda s: s != "\x01")
    # what stands between starts with a mark
    return F.transform(parts, lambda s: F.when(~s.startswith("\x01"), F.try_element_at(known, F.translate(s, "\x01", " "))))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row``, ``n_sentences`` known, ``sequence``, ``licences`` and ``verdict`` of each document."""
    df = packed(docs, identifiers(sentences(whole_text(text_col))).alias("ids"))
    n = F.size(F.filter("ids", lambda x: x.isNotNull())).cast("long")
    marks = F.transform("ids", lambda x: F.concat(F.lit("<"), F.coalesce(x, F.lit("?")), F.lit(">")))
    whole = F.regexp_replace(F.array_join(marks, ""), r"(<[?]>)+", "<?>")
    df = df.select("row", n.alias("n_sentences"), F.when(n > 0, whole).otherwise("").alias("sequence"))
    df = df.withColumn("rest", F.col("sequence"))
    names = []
    for rule, pattern, _, _ in RULES:
        hits = F.size(F.split("rest", pattern, -1)) - 1
        df = df.withColumns({rule: F.when(F.col("n_sentences") > 0, hits).otherwise(0), "rest": F.regexp_replace("rest", pattern, "|")})
        names.append(rule)
    licences = F.array_join(F.flatten(F.array(*[F.array_repeat(F.lit(lic), F.col(r)) for r, _, lic, _ in RULES])), ",")
    verdict = F.lit("none")
    for kind in reversed(CLASSES):
        any_hit = sum((F.col(r) for r, _, _, k in RULES if k == kind), F.lit(0))
        verdict = F.when(any_hit > 0, kind).otherwise(verdict)
    return df.select("row", "n_sentences", "sequence", licences.alias("licences"), verdict.alias("verdict"))
