"""Licence scan: sentences to known identifiers, identifier sequences to licence rules (op6).

Texts in lower case keep only letters and digits, and marks where a line or sentence may start
or end. A known licence sentence counts from one mark to another, whatever marks lie between, so
it may be wrapped, commented or hold "v." or a colon; what is found gives a sequence of identifiers
in text order, and ordered rules over that sequence name the licences. A rule higher in the list hides those that it implies.

Edge cases: a null text counts as empty; empty texts and tables give no licence; repeated rows
are scanned alike; further columns are ignored. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Normalised sentences of public licence texts and notices, each with its identifier.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "distributed under the mit license": "mit-notice",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "apache license version 2 0": "apache-title",
    "apache license": "apache-title",
    "version 2 0 january 2004": "apache-version",
    "terms and conditions for use reproduction and distribution": "apache-terms",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 2": "gpl2-notice",
    "this work is licensed under the gnu general public license version 2": "gpl2-notice",
    "gnu general public license": "gpl-title",
    "version 3 29 june 2007": "gpl-version-3",
    "version 2 june 1991": "gpl-version-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "gnu lesser general public license": "lgpl-title",
    "version 2 1 february 1999": "lgpl-version-21",
    "gnu affero general public license": "agpl-title",
    "version 3 19 november 2007": "agpl-version-3",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "licensed under the gnu lesser general public license version 3": "lgpl3-notice",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21-notice",
    "licensed under the gnu affero general public license version 3": "agpl3-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "released under the bsd license": "bsd-notice",
    "licensed under the bsd license": "bsd-notice",
    "licensed under the bsd 3 clause license": "bsd3-notice",
    "released under the bsd 3 clause license": "bsd3-notice",
    "licensed under the bsd 2 clause license": "bsd2-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-notice",
    "licensed under the mozilla public license version 2 0": "mpl-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby-notice",
    "this work is licensed under the creative commons attribution 4 0 international license": "ccby-notice",
    "licensed under cc by 4 0": "ccby-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa-notice",
    "licensed under cc by sa 4 0": "ccbysa-notice",
    "licensed under cc by nc 4 0": "ccbync-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync-notice",
    "this work is licensed under the creative commons attribution noncommercial 4 0 international license": "ccbync-notice",
    "licensed under cc by nd 4 0": "ccbynd-notice",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "ccbynd-notice",
    "this work is licensed under the creative commons attribution noderivatives 4 0 international license": "ccbynd-notice",
    "licensed under cc by nc sa 4 0": "ccbyncsa-notice",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "ccbyncsa-notice",
    "this work is licensed under the creative commons attribution noncommercial sharealike 4 0 international license": "ccbyncsa-notice",
    "licensed under cc by nc nd 4 0": "ccbyncnd-notice",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "ccbyncnd-notice",
    "this work is licensed under the creative commons attribution noncommercial noderivatives 4 0 international license": "ccbyncnd-notice",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "ccbysa-notice",
    "licensed under cc0 1 0": "cc0-notice",
    "this work is dedicated to the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "all rights reserved": "reserved",
    "spdx license identifier mit": "mit-notice",
    "spdx license identifier apache 2 0": "apache-notice",
    "spdx license identifier gpl 3 0 only": "gpl3-notice",
    "spdx license identifier gpl 3 0 or later": "gpl3-later",
    "spdx license identifier gpl 2 0 only": "gpl2-notice",
    "spdx license identifier bsd 3 clause": "bsd3-notice",
    "spdx license identifier bsd 2 clause": "bsd2-notice",
    "spdx license identifier mpl 2 0": "mpl-notice",
    "spdx license identifier gpl 2 0 or later": "gpl2-later",
    "spdx license identifier cc by 4 0": "ccby-notice",
    "spdx license identifier cc by sa 4 0": "ccbysa-notice",
    "spdx license identifier cc by nc 4 0": "ccbync-notice",
    "spdx license identifier cc by nd 4 0": "ccbynd-notice",
    "spdx license identifier cc by nc sa 4 0": "ccbyncsa-notice",
    "spdx license identifier cc by nc nd 4 0": "ccbyncnd-notice",
    "spdx license identifier isc": "isc-grant",
    "spdx license identifier zlib": "zlib-grant",
    "spdx license identifier bsl 1 0": "boost-notice",
    "spdx license identifier epl 2 0": "epl2-title",
    "spdx license identifier lgpl 2 1 or later": "lgpl21-later",
    "spdx license identifier lgpl 3 0 or later": "lgpl3-later",
    "spdx license identifier agpl 3 0 or later": "agpl3-later",
    "the artistic license": "artistic-title",
    "cc0 1 0 universal": "cc0-title",
    "gnu free documentation license version 1 2 november 2002": "gfdl12-title",
    "gnu free documentation license version 1 3 3 november 2008": "gfdl13-title",
    "version 1 february 1989": "gpl-version-1",
    "gnu library general public license": "library-title",
    "mozilla public license version 1 1": "mpl11-title",
    "mozilla public license version 2 0": "mpl-title",
    "eclipse public license v 2 0": "epl2-title",
    "boost software license version 1 0 august 17th 2003": "boost-title",
    "distributed under the boost software license version 1 0": "boost-notice",
    "how to apply these terms to your new programs": "gpl-appendix",
    "how to apply these terms to your new libraries": "gpl-appendix",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version": "gpl1-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version": "lgpl2-later",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0-grant",
}
#: Sentences in which a star stands for the name of a holder, of 1 to HOLDER_WORDS words.
TEMPLATES = {
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "neither the name of * nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "this product includes software developed by *": "bsd-acknowledgement",
    "in no event will * be held liable for any damages arising from the use of this software": "zlib-liability",
}
HOLDER_WORDS = 12
#: Ordered rules: a licence where its pattern occurs in the identifiers, written with a space before and after each; with the licences that it then hides.
#: The notice in the appendix of a full text shows how to apply it and is none of the text's own.
OWN_NOTICE = " (?<! gpl-appendix )"
RULES = (
    ("MIT", " (?:mit-notice|mit-grant(?: [a-z0-9-]+){0,2} mit-(?:condition|warranty)) ", ()),
    ("Apache-2.0", " (?:apache-notice|apache-title(?: [a-z0-9-]+){0,3} apache-(?:version|compliance|warranty)) ", ()),
    ("AGPL-3.0-or-later", OWN_NOTICE + "agpl3-later ", ("AGPL-3.0",)),
    ("LGPL-3.0-or-later", OWN_NOTICE + "lgpl3-later ", ("LGPL-3.0",)),
    ("LGPL-2.1-or-later", OWN_NOTICE + "lgpl21-later ", ("LGPL-2.1",)),
    ("AGPL-3.0", " (?:agpl3-notice|agpl-title agpl-version-3) ", ()),
    ("LGPL-3.0", " (?:lgpl3-notice|lgpl-title gpl-version-3) ", ()),
    ("LGPL-2.1", " (?:lgpl21-notice|lgpl-title lgpl-version-21) ", ()),
    ("GPL-3.0-or-later", OWN_NOTICE + "gpl3-later ", ("GPL-3.0",)),
    ("GPL-2.0-or-later", OWN_NOTICE + "gpl2-later ", ("GPL-2.0",)),
    ("GPL-3.0", " (?:gpl3-notice|gpl-title gpl-version-3) ", ()),
    ("GPL-2.0", " (?:gpl2-notice|gpl-title gpl-version-2) ", ()),
    ("GPL-1.0-or-later", OWN_NOTICE + "gpl1-later ", ("GPL-1.0",)),
    ("LGPL-2.0-or-later", OWN_NOTICE + "lgpl2-later ", ("LGPL-2.0",)),
    ("GPL-1.0", " gpl-title gpl-version-1 ", ()),
    ("LGPL-2.0", " library-title gpl-version-2 ", ()),
    ("GFDL-1.3", " gfdl13-title ", ()),
    ("GFDL-1.2", " gfdl12-title ", ()),
    ("BSD-4-Clause", " bsd-grant bsd-source bsd-binary bsd-advert ", ("BSD-3-Clause", "BSD-2-Clause", "BSD")),
    ("BSD-3-Clause", " (?:bsd3-notice|bsd-grant bsd-source bsd-binary bsd-name) ", ("BSD-2-Clause", "BSD")),
    ("BSD-2-Clause", " (?:bsd2-notice|bsd-grant bsd-source bsd-binary) ", ("BSD",)),
    ("BSD", " (?:bsd-notice|bsd-grant) ", ()),
    ("MPL-2.0", " mpl-(?:notice|title) ", ()),
    ("MPL-1.1", " mpl11-title ", ()),
    ("EPL-2.0", " epl2-title ", ()),
    ("BSL-1.0", " boost-(?:title|notice) ", ()),
    ("Artistic-1.0", " artistic-title ", ()),
    ("Zlib", " zlib-grant ", ()),
    ("CC-BY-NC-ND-4.0", " ccbyncnd-notice ", ()),
    ("CC-BY-NC-SA-4.0", " ccbyncsa-notice ", ()),
    ("CC-BY-ND-4.0", " ccbynd-notice ", ()),
    ("CC-BY-NC-4.0", " ccbync-notice ", ()),
    ("CC-BY-SA-4.0", " ccbysa-notice ", ()),
    ("CC-BY-4.0", " ccby-notice ", ()),
    ("CC0-1.0", " cc0-(?:notice|title) ", ()),
    ("ISC", " isc-grant ", ()),
    ("0BSD", " bsd0-grant ", ()),
    ("Unlicense", " unlicense-grant ", ()),
    ("Public-domain", " public-domain ", ()),
)
#: Every known sentence holds one of these words, so a text without any needs no look-up.
HINTS = ("licen", "public domain", "permi", "warrant", "redistribut", "compliance", "version", "apache", "rights", "neither the name", "free software", "notice", "terms", "the name", "universal", "advertising", "this product includes", "in no event")


def _pattern(sentence: str) -> str:
    """Words that may lie on both sides of a boundary ("v. 2.0", "software: you", a wrapped line), and a holder's for a star."""
    return sentence.replace(" ", "[ |]").replace("*", "[a-z0-9]+(?:[ |][a-z0-9]+){0,%d}?" % (HOLDER_WORDS - 1))


#: A known sentence from one boundary to another, longest first.
KNOWN = r"(?<=\|)(?:" + "|".join(_pattern(x) for x in sorted([*SENTENCES, *TEMPLATES], key=len, reverse=True)) + r")(?=\|)"


def bounded(text: Column) -> Column:
    """Only letters and digits: a bar where a line or sentence may start or end, a space between other words."""
    mark = "\x01"
    steps = (
        (r"[^\S\n]+", " "),
        (r"\n|[.!?:;](?=\s|$)", mark),
        (mark + r"[\x20\x01]*", mark),
        (mark + r"[#*/;>-]*\x20?[(]?[a-z0-9][)]\x20", mark),
        (r"[^a-z0-9\x01]+", " "),
        (r"\x20?\x01[\x20\x01]*", "|"),
    )
    out = F.concat(F.lit(mark), F.translate(text, mark, " "), F.lit(mark))
    for pattern, into in steps:
        out = F.regexp_replace(out, pattern, into)
    return out


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text in lower case, in text order."""
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])

    def name(found: Column) -> Column:
        out = F.try_element_at(known, found)
        for template, identifier in TEMPLATES.items():
            out = F.coalesce(out, F.when(found.rlike(f"^(?:{_pattern(template)})$"), F.lit(identifier)))
        return out

    return F.transform(F.regexp_extract_all(bounded(text), F.lit(KNOWN), F.lit(0)), lambda x: name(F.translate(x, "|", " ")))


def licences_of(ids: Column) -> Column:
    """Names of the licences whose rules match, in rule order."""
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    spaced = F.regexp_replace(line, "  ", " ")
    hit = {name: spaced.rlike(pattern) for name, pattern, _ in RULES}
    hidden = {name: [hit[n] for n, _, hides in RULES if name in hides] for name, _, _ in RULES}
    out = []
    for name, _, _ in RULES:
        keep = hit[name]
        for h in hidden[name]:
            keep = keep & ~h
        out.append(F.when(keep, F.lit(name)))
    return F.array_compact(F.array(*out))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licences (arrays) of every whole text."""
    low = F.lower(text_of())
    hint = F.lit(False)
    for h in HINTS:
        hint = hint | F.contains(F.col("text"), F.lit(h))
    none = F.array().cast("array<string>")
    d = docs.select("doc_id", low.alias("text")).select("doc_id", F.when(hint, identifiers(F.col("text"))).otherwise(none).alias("sentence_ids"))
    return d.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, licences_of(F.col("sentence_ids"))).otherwise(none).alias("licences"))
