"""Licences by sentences, in DataFrame operations only.

Sentences of a text are normalised and mapped to the identifiers of known licence sentences, over line breaks too, and
the identifiers, in order, are matched against licence rules: a rule is a sequence of identifiers that must occur in
its order, with anything between.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfen.llm.common import bind

#: Known sentences as they are written, by identifier.
SENTENCES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-file": "you may not use this file except in compliance with the License.",
    "apache-2.0-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "mit-asis": "The software is provided \"as is\", without warranty of any kind, express or implied.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "rights-reserved": "All rights reserved.",
}

#: Sentences, titles and notices of licence texts, whole, by identifier.
REAL_SENTENCES = {
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "apache-2.0-notice-real": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-2.0-asis-real": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-grant-real": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-asis-real": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "gpl-2.0-only-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "isc-asis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND {12} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty-real": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "agpl-3.0-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0-title": "Mozilla Public License Version 2.0",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0-title": "Eclipse Public License - v 2.0",
    "bsl-1.0-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-1.0-title": "CC0 1.0 Universal",
}
#: The Creative Commons licences with their names, of which notices and titles are made, and the identifiers
#: that one-line tags give.
COMMONS = {"CC-BY": "Attribution", "CC-BY-SA": "Attribution-ShareAlike", "CC-BY-NC": "Attribution-NonCommercial", "CC-BY-ND": "Attribution-NoDerivatives", "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TAGGED = ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
REAL_SENTENCES |= {f"{k.lower()}-4.0-{n}": f"This work is licensed under {article} Creative Commons {name} 4.0 International License." for k, name in COMMONS.items() for n, article in (("real", "a"), ("the", "the"))}
REAL_SENTENCES |= {f"{k.lower()}-4.0-title": f"Creative Commons {name} 4.0 International Public License" for k, name in COMMONS.items()}
REAL_SENTENCES |= {f"tag-{t.lower()}": f"SPDX-License-Identifier: {t}" for t in TAGGED}


@dataclass(frozen=True)
class LicenseRule:
    """license: its name; sentences: identifiers in order; unless: identifiers none of which may occur. Earlier rules come first in the result."""

    license: str
    sentences: tuple[str, ...]
    unless: tuple[str, ...] = ()


RULES = (
    LicenseRule("Apache-2.0", ("apache-2.0-notice",)),
    LicenseRule("Apache-2.0", ("apache-2.0-file", "apache-2.0-asis")),
    LicenseRule("MIT", ("mit-notice",)),
    LicenseRule("MIT", ("mit-grant", "mit-asis")),
    LicenseRule("GPL-3.0", ("gpl-3.0-notice",)),
    LicenseRule("GPL", ("gpl-free", "gpl-warranty")),
    LicenseRule("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    LicenseRule("CC-BY-4.0", ("cc-by-4.0-notice",)),
    LicenseRule("CC-BY-SA-4.0", ("cc-by-sa-4.0-notice",)),
    LicenseRule("BSD", ("bsd-redistribute",), unless=("bsd-source",)),
)

REAL_RULES = (
    LicenseRule("Apache-2.0", ("apache-2.0-title",)),
    LicenseRule("Apache-2.0", ("apache-2.0-notice-real",)),
    LicenseRule("Apache-2.0", ("apache-2.0-file", "apache-2.0-asis-real")),
    LicenseRule("MIT", ("mit-grant-real", "mit-asis-real")),
    LicenseRule("ISC", ("isc-grant", "isc-asis")),
    LicenseRule("ISC", ("isc-grant-and", "isc-asis")),
    LicenseRule("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    LicenseRule("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names"), unless=("bsd-advertising",)),
    LicenseRule("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary"), unless=("bsd-names", "bsd-advertising")),
    LicenseRule("GPL-2.0-only", ("gpl-2.0-only-free",)),
    LicenseRule("GPL-3.0", ("gpl-3.0-title",)),
    LicenseRule("GPL-3.0", ("gpl-3.0-free", "gpl-warranty-real")),
    LicenseRule("GPL-2.0", ("gpl-2.0-title",)),
    LicenseRule("GPL-2.0", ("gpl-2.0-free", "gpl-warranty-real")),
    LicenseRule("AGPL-3.0", ("agpl-3.0-title",)),
    LicenseRule("AGPL-3.0", ("agpl-3.0-free", "gpl-warranty-real")),
    LicenseRule("LGPL-2.1", ("lgpl-2.1-title",)),
    LicenseRule("LGPL-2.1", ("lgpl-2.1-free", "lgpl-warranty")),
    LicenseRule("LGPL-3.0", ("lgpl-3.0-title",)),
    LicenseRule("LGPL-3.0", ("lgpl-3.0-free", "gpl-warranty-real")),
    LicenseRule("MPL-2.0", ("mpl-2.0-title",)),
    LicenseRule("MPL-2.0", ("mpl-2.0-notice",)),
    LicenseRule("EPL-2.0", ("epl-2.0-title",)),
    LicenseRule("BSL-1.0", ("bsl-1.0-title",)),
    LicenseRule("Zlib", ("zlib-asis", "zlib-grant")),
    LicenseRule("Unlicense", ("unlicense",)),
    LicenseRule("CC0-1.0", ("cc0-1.0-title",)),
    *(LicenseRule(f"{k}-4.0", (f"{k.lower()}-4.0-{n}",)) for k in COMMONS for n in ("real", "the", "title")),
    *(LicenseRule(t, (f"tag-{t.lower()}",)) for t in TAGGED),
)


def plain(text: str) -> str:
    """A sentence in the form in which sentences are compared: small ASCII letters and digits, single blanks."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def _marked(text: Column) -> Column:
    """Small ASCII letters and digits with single blanks, | where a sentence or paragraph ends and ~ at other line breaks."""
    t = F.translate(F.lower(text), "|~", "  ")
    for pattern, mark in ((r"[.!?:;](?=[\x20\x09-\x0D])", " | "), (r"\n(?:[^a-z0-9|\n]*\n)+", " | "), (r"\n", " ~ "), ("[^a-z0-9|~]+", " ")):
        t = F.regexp_replace(t, pattern, mark)
    return F.concat(F.lit("| "), F.trim(t), F.lit(" |"))


#: In a known sentence {n} is a gap of one to n words, a name for instance; ends and line breaks may lie in it.
GAP = re.compile(r"\{(\d+)\}")


def pattern(sentence: str, line: str = " ~", end: str = " [|~]") -> str:
    """A regular expression of a known sentence in marked text: line breaks may lie between its words, ends only where it has them
    and in its gaps."""
    rest, gaps = GAP.split(sentence)[::2], GAP.findall(sentence)
    made = [f"(?:{end})* ".join(f"(?:{line})? ".join(plain(p).split()) for p in re.split(r"(?<=[.!?:;])\s", part) if plain(p)) for part in rest]
    out = made[0]
    for n, part in zip(gaps, made[1:]):
        out += f"(?:(?: [|~])* [a-z0-9]+){{1,{n}}}(?: [|~])* {part}"
    return out


def anchors(sentences: dict[str, str]) -> tuple[str, ...]:
    """Few words of which each known sentence has one; a text without any of them has no known sentence."""
    left, out = {k: set(plain(v).split()) for k, v in sentences.items()}, []
    while left:
        count: dict[str, int] = {}
        for words in left.values():
            for w in words:
                count[w] = count.get(w, 0) + (len(w) >= 5)
        best = max(sorted(count), key=lambda w: (count[w], len(w)))
        out.append(best)
        left = {k: words for k, words in left.items() if best not in words}
    return tuple(out)


def scan(df: DataFrame, sentences: dict[str, str] = SENTENCES | REAL_SENTENCES, rules: Sequence[LicenseRule] = RULES + REAL_RULES, text: str = "text") -> DataFrame:
    """df with license_sentences (array of identifiers in text order) and licenses (array of the rules' licences, in rule order).

    A sentence starts and ends at . ! ? : ; before white space, at a blank line, at a line break or at an end of the
    text; single line breaks may also lie within it, as in wrapped texts. A missing or empty text has none. Equal
    sentences must not have two identifiers. The known sentences are literals of the plan, meant for up to some
    thousands. Nothing is shuffled; very long texts and repeated rows are treated like all others, columns of df with these
    names are replaced.
    """
    by = {plain(v): k for k, v in sentences.items()}
    if len(by) < len(sentences) or "" in by:
        raise ValueError("two known sentences are alike, or one is empty")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])
    words = "(?i)" + "|".join(anchors(sentences))
    longest = sorted(sentences.values(), key=len, reverse=True)
    hits = F.regexp_extract_all(_marked(whole), F.lit("(?<=[|~] )(?:" + "|".join(map(pattern, longest)) + ")(?= [|~])"), F.lit(0))
    gapped = [(k, f"^(?:{pattern(v)})$") for k, v in sentences.items() if GAP.search(v)]
    of_gaps = lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(k)) for k, p in gapped], F.lit(None).cast("string"))
    ids = F.transform(hits, lambda x: F.coalesce(F.element_at(names, F.regexp_replace(x, "[ |~]+", " ")), of_gaps(x)))
    found = F.when(whole.rlike(words), ids).otherwise(F.array().cast("array<string>"))
    joined = F.concat(F.lit("\n"), F.array_join("license_sentences", "\n"), F.lit("\n"))
    quoted = lambda s: "\\Q" + s + "\\E"
    has = lambda ids: joined.rlike("\\n" + "\\n(?:.*\\n)*".join(map(quoted, ids)) + "\\n")
    fits = [F.when(reduce(lambda test, i: test & ~has((i,)), r.unless, has(r.sentences)), F.lit(r.license)) for r in rules]
    made = F.when(F.size("license_sentences") > 0, F.array_distinct(F.array_compact(F.array(*fits)))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("license_sentences", bind(found, lambda x: x)).withColumn("licenses", made)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query over documents."""
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", F.size("license_sentences").cast("long").alias("n_license_sentences"), F.array_join("license_sentences", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"), (F.size("licenses") > 0).alias("licensed"),
    )
