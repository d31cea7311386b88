"""License scan by sentence rules, with DataFrame expressions only.

A text is cut into sentences, each is normalised and looked up among known licence sentences, and
the sequence of identifiers found is matched against ordered licence rules. A sentence that is not
known as it stands is looked up again by its slots: the licence names of a notice, whatever leads
in to them; the name of the program in a grant; the terms of an SPDX expression. A text that has
none of the anchor strings can hold no known sentence and is not cut at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import table

# Identifiers and sentences of well-known public licences and notices.
SENTENCES = (
    ("apache_notice", "Licensed under the Apache License, Version 2.0."),
    ("apache_notice", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache_notice_long", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache_copy", "You may obtain a copy of the License at"),
    ("apache_as_is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache_see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit_notice", "Released under the MIT License."),
    ("mit_notice", "Licensed under the MIT License."),
    ("mit_notice", "This project is licensed under the MIT License."),
    ("mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit_keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit_as_is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd_grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd_names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl3_notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3_notice", "Licensed under the GNU General Public License, version 3."),
    ("gpl3_grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl_warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("ccby_notice", "Licensed under CC BY 4.0."),
    ("ccbysa_notice", "Licensed under CC BY-SA 4.0."),
    ("ccbync_notice", "Licensed under CC BY-NC 4.0."),
    ("ccby_long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ccbysa_long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ccbync_long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("rights_reserved", "All rights reserved."),
    ("gpl2_notice", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl2_notice", "Licensed under the GNU General Public License, version 2."),
    ("gpl2_grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl21_notice", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl3_notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl3_notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl2_notice", "Licensed under the Mozilla Public License, version 2.0."),
    ("mpl2_notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),  # up to the stop in "v. 2.0"
    ("cc0_notice", "Licensed under CC0 1.0."),
    ("cc0_waiver", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense_notice", "This is free and unencumbered software released into the public domain."),
    ("spdx_gpl2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("spdx_gpl2", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("spdx_gpl3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("spdx_lgpl21", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("spdx_lgpl21", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("spdx_lgpl3", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("spdx_lgpl3", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("spdx_agpl3", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("spdx_agpl3", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("spdx_mpl2", "SPDX-License-Identifier: MPL-2.0"),
    ("spdx_cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("spdx_unlicense", "SPDX-License-Identifier: Unlicense"),
    ("spdx_apache", "SPDX-License-Identifier: Apache-2.0"),
    ("spdx_mit", "SPDX-License-Identifier: MIT"),
    ("spdx_gpl3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("lgpl21_grant", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl_warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl3_grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3_grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2_notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("bsd2_notice", "Licensed under the BSD 2-Clause License."),
    ("bsd2_notice", "BSD 2-Clause License"),
    ("bsd3_notice", "Licensed under the BSD 3-Clause License."),
    ("bsd3_notice", "BSD 3-Clause License"),
    ("bsd_as_is", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("mit_notice", "MIT License"),
    ("mit_notice", "The MIT License (MIT)"),
    ("mit_notice", "This code is licensed under the MIT License."),
    ("isc_notice", "ISC License"),
    ("isc_notice", "Licensed under the ISC License."),
    ("epl2_notice", "Licensed under the Eclipse Public License 2.0."),
    ("epl2_notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("zlib_as_is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib_grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost_notice", "Distributed under the Boost Software License, Version 1.0."),
    ("boost_notice", "Boost Software License - Version 1.0"),
    ("mpl2_notice", "Mozilla Public License Version 2.0"),
    ("cc0_notice", "Licensed under CC0 1.0 Universal."),
    ("ccbynd_notice", "Licensed under CC BY-ND 4.0."),
    ("ccbyncsa_notice", "Licensed under CC BY-NC-SA 4.0."),
    ("ccbyncnd_notice", "Licensed under CC BY-NC-ND 4.0."),
    ("ccbynd_long", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("ccbyncsa_long", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("ccbyncnd_long", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("spdx_bsd2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("spdx_bsd3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("spdx_isc", "SPDX-License-Identifier: ISC"),
    ("spdx_epl2", "SPDX-License-Identifier: EPL-2.0"),
    ("spdx_zlib", "SPDX-License-Identifier: Zlib"),
    ("spdx_boost", "SPDX-License-Identifier: BSL-1.0"),
    ("spdx_ccby", "SPDX-License-Identifier: CC-BY-4.0"),
    ("spdx_ccbysa", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("gpl2_notice", "Licensed under the GNU GPL v2."),
    ("gpl2_notice", "Licensed under the GPLv2."),
    ("gpl3_notice", "Licensed under the GNU GPL v3."),
    ("gpl3_notice", "Licensed under the GPLv3."),
    ("lgpl21_notice", "Licensed under the GNU LGPL v2.1."),
    ("lgpl3_notice", "Licensed under the GNU LGPL v3."),
    ("agpl3_notice", "Licensed under the GNU AGPL v3."),
    ("isc_notice", "Licensed under the ISC License (ISC)."),
    ("unlicense_notice", "Licensed under the Unlicense."),
    ("ccby_notice", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("ccbysa_notice", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ccbync_notice", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("spdx_gpl2", "SPDX-License-Identifier: GPL-2.0"),
    ("spdx_gpl3", "SPDX-License-Identifier: GPL-3.0"),
    ("spdx_lgpl21", "SPDX-License-Identifier: LGPL-2.1"),
    ("spdx_lgpl3", "SPDX-License-Identifier: LGPL-3.0"),
    ("spdx_agpl3", "SPDX-License-Identifier: AGPL-3.0"),
)

#: Ordered rules: the licence holds when these identifiers occur in this order, others between them or not, the first not again.
#: Where a longer rule with the same beginning holds at the same place, the shorter gives way.
RULES = (
    ("Apache-2.0", ("apache_notice",)),
    ("Apache-2.0", ("apache_notice_long",)),
    ("Apache-2.0", ("apache_copy", "apache_as_is", "apache_see")),
    ("Apache-2.0", ("spdx_apache",)),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_grant", "mit_keep", "mit_as_is")),
    ("MIT", ("spdx_mit",)),
    ("ISC", ("isc_grant",)),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("GPL-3.0", ("gpl3_notice",)),
    ("GPL-3.0", ("gpl3_grant", "gpl_warranty")),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("CC-BY-4.0", ("ccby_notice",)),
    ("CC-BY-4.0", ("ccby_long",)),
    ("CC-BY-SA-4.0", ("ccbysa_notice",)),
    ("CC-BY-SA-4.0", ("ccbysa_long",)),
    ("CC-BY-NC-4.0", ("ccbync_notice",)),
    ("CC-BY-NC-4.0", ("ccbync_long",)),
    ("All-rights-reserved", ("rights_reserved",)),
    ("GPL-2.0", ("gpl2_notice",)),
    ("GPL-2.0", ("gpl2_grant", "gpl_warranty")),
    ("GPL-2.0", ("spdx_gpl2",)),
    ("LGPL-2.1", ("lgpl21_notice",)),
    ("LGPL-2.1", ("spdx_lgpl21",)),
    ("LGPL-3.0", ("lgpl3_notice",)),
    ("LGPL-3.0", ("spdx_lgpl3",)),
    ("AGPL-3.0", ("agpl3_notice",)),
    ("AGPL-3.0", ("spdx_agpl3",)),
    ("MPL-2.0", ("mpl2_notice",)),
    ("MPL-2.0", ("spdx_mpl2",)),
    ("CC0-1.0", ("cc0_notice",)),
    ("CC0-1.0", ("cc0_waiver",)),
    ("CC0-1.0", ("spdx_cc0",)),
    ("Unlicense", ("unlicense_notice",)),
    ("Unlicense", ("spdx_unlicense",)),
    ("LGPL-2.1", ("lgpl21_grant", "lgpl_warranty")),
    ("LGPL-2.1", ("lgpl21_grant", "gpl_warranty")),
    ("LGPL-3.0", ("lgpl3_grant", "gpl_warranty")),
    ("AGPL-3.0", ("agpl3_grant", "gpl_warranty")),
    ("BSD-2-Clause", ("bsd2_notice",)),
    ("BSD-2-Clause", ("spdx_bsd2",)),
    ("BSD-2-Clause", ("rights_reserved", "bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd3_notice",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("BSD-3-Clause", ("rights_reserved", "bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("ISC", ("isc_notice",)),
    ("ISC", ("spdx_isc",)),
    ("EPL-2.0", ("epl2_notice",)),
    ("EPL-2.0", ("spdx_epl2",)),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("Zlib", ("spdx_zlib",)),
    ("BSL-1.0", ("boost_notice",)),
    ("BSL-1.0", ("spdx_boost",)),
    ("CC-BY-4.0", ("spdx_ccby",)),
    ("CC-BY-SA-4.0", ("spdx_ccbysa",)),
    ("CC-BY-ND-4.0", ("ccbynd_notice",)),
    ("CC-BY-ND-4.0", ("ccbynd_long",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa_notice",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa_long",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd_notice",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd_long",)),
)

#: Each known sentence has one of these, in lower case, within a single word.
ANCHORS = ("licens", "licenc", "warrant", "permission", "redistribut", "copyright", "reserved", "unencumbered", "gpl", "cc by", "cc0")

#: A sentence ends at a stop or mark before white space, or before ", see"; in the first reading also at a line end, in the second only at an empty line.
SENTENCE_ENDS = r"(?<=[.!?])[\x20\x09-\x0D]+|,[\x20\x09-\x0D]+(?=[Ss]ee )"
LINE_ENDS = SENTENCE_ENDS + r"|\n"
PARAGRAPH_ENDS = SENTENCE_ENDS + r"|\n[\x20\x09\x0B-\x0D]*\n"


#: Slots, over sentences in normal form. What a notice says before the names of licences, what can follow them, and what stands between them.
NOTICE = r"^(?:[a-z0-9 ]+ )?(?:licensed|released|distributed|redistributed|available|published|provided) under (?:the )?(?:terms of )?(?:either )?(?:of )?(?:the )?"
NOTICE_END = r" see [a-z0-9 ]+$| or (?:at your option )?(?:any )?later(?: versions?)?(?: see [a-z0-9 ]+)?$| only$"
BETWEEN_NAMES = r" (?:or|and) (?:the )?"
#: Words with which a sentence does not say that the licence holds.
DENIALS = r"\b(?:not|never|cannot|unless|longer|formerly|previously|neither|nor)\b"
#: A name is told by its other words and its version: "the MIT License" as "mit", "Apache License, Version 2.0" as "apache 2".
FILLERS = r"\b(?:licen[sc]e|version)\b|\bv(?=[0-9])"
#: Grants and warranties of programs by any name.
PROGRAM = r"^[a-z0-9 ]+ is (free software you can redistribute it and or modify it under the terms of the gnu |distributed in the hope that it will be useful but )"
VERSION = r" (?:either )?version ([0-9]+(?: [0-9]+)?) of the license(?: or at your option any later version)?$"
#: An SPDX expression: what comes before it, exceptions, and what stands between its terms ("or later" belongs to a term).
SPDX = "spdx license identifier "
EXCEPTIONS = r" with [a-z0-9]+(?: [a-z0-9]+)*? (?:exception|note)(?: [0-9]+)*"
BETWEEN_TERMS = r" or (?!later)| and "


def normal_sentence(sentence: str) -> str:
    """Lower-case ASCII letters and digits, anything else as one space."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _pieces(sentence: str) -> list[str]:
    """A listed sentence can hold stops of its own; its pieces are looked up in order."""
    return [p for p in map(normal_sentence, re.split(r"(?<=[.!?])\s+", sentence)) if p]


def sentence_map() -> dict[str, str]:
    """Normalised sentence to identifier. A sentence of k pieces gives k identifiers, name#1 .. name#k."""
    out: dict[str, str] = {}
    for name, sentence in SENTENCES:
        pieces = _pieces(sentence)
        for i, piece in enumerate(pieces):
            out.setdefault(piece, name if len(pieces) == 1 else f"{name}#{i + 1}")
    return out


def plain_name(name: str) -> str:
    """The name of a licence without fillers and a last zero of its version."""
    return re.sub(r" 0$", "", re.sub(r" +", " ", re.sub(FILLERS, "", name)).strip())


def name_map() -> dict[str, str]:
    """Licence name, in plain form, to the identifier of its notice: from all known sentences of the form "Licensed under ..."."""
    out: dict[str, str] = {}
    for sentence, name in sentence_map().items():
        if named := re.fullmatch("licensed under (?:the )?(.+)", sentence):
            out.setdefault(plain_name(named[1]), name)
    return out


def _program_form(sentence: str) -> str:
    return re.sub(VERSION, r" either version \1 of the license or at your option any later version", re.sub(PROGRAM, r"this program is \1", sentence))


def program_map() -> dict[str, str]:
    """Grants and warranties of "this program" to identifiers."""
    return {_program_form(s): name for s, name in reversed(sentence_map().items()) if re.match(PROGRAM, s)}


def _in_order(names: list[str]) -> str:
    """A pattern over identifiers, each with a space on either side."""
    return ".*".join(f" {x} " for x in names)


def matchers() -> list[tuple[str, str, str, list[str]]]:
    """Each rule as licence, first identifier, pattern of what follows it, and the patterns of the longer rules it gives way to."""
    known, rules = sentence_map(), []
    for licence, names in RULES:
        sentences = [next(s for n, s in SENTENCES if n == name) for name in names]
        rules.append((licence, [known[p] for s in sentences for p in _pieces(s)]))

    def inside(short: list[str], long: list[str]) -> bool:
        rest = iter(long)
        return len(short) < len(long) and short[0] == long[0] and all(x in rest for x in short)

    return [(licence, ids[0], _in_order(ids[1:]), [_in_order(other[1:]) for _, other in rules if inside(ids, other)]) for licence, ids in rules]


def _holds(ids: Column, first: str, rest: str, longer: list[str]) -> Column:
    """Whether the rule holds in one of the stretches that begin at its first identifier."""
    if not rest and not longer:
        return F.contains(ids, F.lit(f" {first} "))

    def one(stretch: Column) -> Column:
        ok = stretch.rlike(rest) if rest else F.lit(True)
        for pattern in longer:
            ok = ok & ~stretch.rlike(pattern)
        return ok

    return F.exists(F.slice(F.split(ids, f" {first} "), 2, 1 << 30), one)


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _by_slots(s: Column) -> Column:
    """Identifiers of a sentence, in normal form, by what fills its slots."""
    names, programs, known = _map(name_map()), _map(program_map()), _map(sentence_map())

    def plain(name: Column) -> Column:
        return F.regexp_replace(F.btrim(F.regexp_replace(F.regexp_replace(name, FILLERS, ""), " +", " ")), " 0$", "")

    listed = F.split(F.regexp_replace(F.regexp_replace(s, NOTICE, ""), NOTICE_END, ""), BETWEEN_NAMES)
    program = F.regexp_replace(F.regexp_replace(s, PROGRAM, "this program is $1"), VERSION, " either version $1 of the license or at your option any later version")
    terms = F.split(F.regexp_replace(F.substr(s, F.lit(len(SPDX) + 1)), EXCEPTIONS, ""), BETWEEN_TERMS)
    return (
        F.when(F.startswith(s, F.lit(SPDX)), F.transform(terms, lambda t: F.try_element_at(known, F.concat(F.lit(SPDX), t))))
        .when(s.rlike(PROGRAM), F.array(F.try_element_at(programs, program)))
        .when(F.contains(s, F.lit("under ")) & s.rlike(NOTICE) & ~s.rlike(DENIALS), F.transform(listed, lambda x: F.try_element_at(names, plain(x))))
        .otherwise(F.array().cast("array<string>"))
    )


def _ids(body: Column, ends: str) -> Column:
    known = _map(sentence_map())
    normal = F.transform(F.split(body, ends), lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    found = F.transform(normal, lambda s: F.when(F.map_contains_key(known, s), F.array(F.try_element_at(known, s))).otherwise(_by_slots(s)))
    return F.array_compact(F.flatten(found))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_sentences (known ones; one that names several licences counts for each), sentence_ids and licenses, one row per input row.

    sentence_ids joins the identifiers in text order by spaces, as read line by line; a licence
    text that is wrapped over several lines is also read paragraph by paragraph, and either reading
    can satisfy a rule. licenses joins the licences found by commas, in alphabetical order, and is
    empty where there is none. Null counts as empty. Repeated rows are scanned each on its own;
    other columns are ignored; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    lowered = F.lower(body)
    anchored = F.lit(False)
    for anchor in ANCHORS:
        anchored = anchored | F.contains(lowered, F.lit(anchor))
    none = F.array().cast("array<string>")
    read = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), anchored.alias("anchored"))
    read = read.select(
        "doc_id",
        F.when(F.col("anchored"), _ids(F.col("body"), LINE_ENDS)).otherwise(none).alias("by_line"),
        F.when(F.col("anchored"), _ids(F.col("body"), PARAGRAPH_ENDS)).otherwise(none).alias("by_paragraph"),
    )
    lines = F.concat(F.lit(" "), F.array_join("by_line", "  "), F.lit(" "))
    paragraphs = F.concat(F.lit(" "), F.array_join("by_paragraph", "  "), F.lit(" "))
    found = [F.when(_holds(lines, *how) | _holds(paragraphs, *how), F.lit(licence)) for licence, *how in matchers()]
    return read.select(
        "doc_id",
        F.greatest(F.size("by_line"), F.size("by_paragraph")).cast("long").alias("n_sentences"),
        F.array_join("by_line", " ").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), ",").alias("licenses"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
