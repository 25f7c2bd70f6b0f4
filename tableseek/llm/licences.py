"""Licence scan by sentence rules. DataFrame functions only.

A text becomes a sequence of normalised sentences. Sentences of known licences have identifiers, others have none.
A rule is an ordered list of identifiers; it matches where they follow each other without gap.

Licence texts come wrapped, in comments and with numbered clauses. So a text is also read as one run of words, without
line ends, comment marks and punctuation, in which the wordings of public licences are looked up, and as paragraphs,
whose lines are joined before they are cut into sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, normalised (ASCII lower case, other characters as single blanks).
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "released under the mit license",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "all rights reserved",
    6: "licensed under the apache license version 2 0 the license",
    7: "you may not use this file except in compliance with the license",
    8: "you may obtain a copy of the license at",
    9: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    10: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    11: "the software is provided as is without warranty of any kind express or implied",
    12: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    13: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    14: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    15: "either version 3 of the license or at your option any later version",
    16: "this work is licensed under a creative commons attribution 4 0 international license",
    17: "licensed under the mit license",
    18: "this work is dedicated to the public domain",
}
# Ordered rules over these identifiers.
RULES = {
    "apache-2.0": ((1,), (6, 7, 8), (6, 7)),
    "mit": ((2,), (17,), (9, 10, 11), (9, 10)),
    "gpl-3.0": ((3,), (14, 15)),
    "cc-by-nc-4.0": ((4,),),
    "cc-by-4.0": ((16,),),
    "bsd": ((12, 13),),
    "public-domain": ((18,),),
    "proprietary": ((5,),),
}
# Wordings of public licences as runs of words (regular expressions); ~ is an optional list mark.
_GPL = "it under the terms of the gnu {}general public license(?: version {})? as published by the free software foundation (?:either )?version {}(?: of the license)?"
_CC = ("licensed under (?:a|the) creative commons {} 4 0 international(?: public)? license", "bound by the terms and conditions of this creative commons {} 4 0 international public license")
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_ISC = "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"
WORDINGS = {
    "0bsd": (_ISC + " the software is provided as is",),
    "agpl-3.0": (_GPL.format("affero ", 3, 3), "gnu affero general public license version 3 19 november 2007"),
    "apache-2.0": (
        "under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "apache license version 2 0 january 2004 https? www apache org licenses terms and conditions for use reproduction and distribution",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met~ redistributions of source code must retain the(?: above)? copyright notice this list of conditions and the following disclaimer",),
    "bsl-1.0": (
        "distributed under the boost software license version 1 0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ),
    "cc-by-4.0": tuple(x.format("attribution") for x in _CC),
    "cc-by-nc-4.0": tuple(x.format("attribution noncommercial") for x in _CC),
    "cc-by-nc-nd-4.0": tuple(x.format("attribution noncommercial noderivatives") for x in _CC),
    "cc-by-nc-sa-4.0": tuple(x.format("attribution noncommercial sharealike") for x in _CC),
    "cc-by-nd-4.0": tuple(x.format("attribution noderivatives") for x in _CC),
    "cc-by-sa-4.0": tuple(x.format("attribution sharealike") for x in _CC),
    "cc0-1.0": (
        "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s",
        "dedicated all copyright and related and neighboring rights to this (?:software|work) to the public domain worldwide",
    ),
    "epl-2.0": (
        "made available under the terms of the eclipse public license(?: version| v)? 2 0",
        "eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license",
    ),
    "gfdl": ("gnu free documentation license version 1 [123] (?:march 2000|november 2002|3 november 2008)", "under the terms of the gnu free documentation license version 1 [123] or any later version"),
    "gpl-2.0": (_GPL.format("", 2, 2), "under the terms of version 2 of the gnu general public license as published by the free software foundation", "gnu general public license version 2 june 1991"),
    "gpl-3.0": (_GPL.format("", 3, 3), "under the terms of version 3 of the gnu general public license as published by the free software foundation", "gnu general public license version 3 29 june 2007"),
    "isc": (_ISC + " provided that the above copyright notice and this permission notice appear in all copies",),
    "lgpl-2.0": (_GPL.format("(?:lesser|library) ", 2, "2(?! 1 )"), "gnu library general public license version 2 june 1991"),
    "lgpl-2.1": (_GPL.format("lesser ", "2 1", "2 1"), "gnu lesser general public license version 2 1 february 1999"),
    "lgpl-3.0": (_GPL.format("lesser ", 3, 3), "gnu lesser general public license version 3 29 june 2007"),
    "mit": (_MIT + " subject to the following conditions~ the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software",),
    "mit-0": (_MIT + " the software is provided as is without warranty of any kind",),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "mozilla public license version 2 0~ definitions",
    ),
    "psf-2.0": ("psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly prepare derivative works distribute and otherwise use python alone or in any derivative version",),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",),
    "zlib": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions~ the origin of this software must not be misrepresented you must not claim that you wrote the original software",),
}
SIGNS = ("licens", "permission", "permitted", "domain", "reserved", "jurisdictions")  # each wording and rule holds one
MARKS = "(?m)^[\\x20\\x09]*(?:@?rem(?=[\\x20\\x09\\x0D\\n])|dnl(?=[\\x20\\x09\\x0D\\n])|c(?=[\\x20\\x09])|[^a-z0-9\\s\"'(]+)[\\x20\\x09]*|&(?:quot|apos|amp|lt|gt|nbsp|#[0-9]{1,5}|#x[0-9a-f]{1,4});"
END = "[.!?]+([\\x20\\x09-\\x0D]+|\\z)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences(text: Column) -> Column:
    """Normalised sentences, empty ones left out; they end at a full stop before a blank, or at a line's end."""
    lines = F.split(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), END, "\n"), "\n")
    return F.filter(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def unmarked(text: Column) -> Column:
    """The text in lower case without comment marks and character references."""
    return F.regexp_replace(F.translate(text, UPPER, LOWER), MARKS, " ")


def words(text: Column) -> Column:
    """All words of an unmarked text, each between single blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), F.lit(" "))


def joined(text: Column) -> Column:
    """An unmarked text with the lines of each paragraph joined; blank lines part paragraphs."""
    lines = F.regexp_replace(text, "[\\x20\\x09\\x0D]*\n[\\x20\\x09\\x0D]*", "\n")
    return F.regexp_replace(lines, "(?<!\n)\n(?!\n)", " ")


def scan_licences(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with n_sentences long, sentence_ids string and licences string added.

    sentence_ids lists the identifiers in order, 0 for an unknown run of sentences; licences lists the licences with a
    matching rule, a wording in the run of words, or a rule of one sentence in a joined paragraph, sorted, joined by
    `|`. Null and empty texts have no sentence and no licence.
    """
    keep = [c for c in keep if c not in ("n_sentences", "sentence_ids", "licences")]
    number = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, str(i))])
    longest = max(map(len, SENTENCES.values()))
    sign = F.translate(F.col(text), UPPER, LOWER).rlike("|".join(SIGNS))
    cut = docs.select(*keep, sentences(F.col(text)).alias("__sentences"), F.when(sign, unmarked(F.col(text))).alias("__text"))
    known = F.transform("__sentences", lambda s: F.when(F.length(s) <= longest, F.coalesce(number[s], F.lit("0"))).otherwise("0"))
    named = cut.select(*keep, F.size("__sentences").cast("long").alias("n_sentences"), F.regexp_replace(F.concat(F.lit(" "), F.array_join(known, " "), F.lit(" ")), "( 0)+ ", " 0 ").alias("__ids"), words(F.col("__text")).alias("__words"), F.when(F.col("__text").isNotNull(), sentences(joined(F.col("__text")))).alias("__joined"))
    matches = []
    for licence in sorted({*RULES, *WORDINGS}):
        any_way = F.lit(False)
        for way in RULES.get(licence, ()):
            any_way = any_way | F.col("__ids").contains(f" {' '.join(map(str, way))} ")
            if len(way) == 1:
                any_way = any_way | F.array_contains("__joined", SENTENCES[way[0]])
        if licence in WORDINGS:
            any_way = any_way | F.col("__words").rlike(f" (?:{'|'.join(WORDINGS[licence])}) ".replace("~", "(?: [0-9a-z]{1,3})?"))
        matches.append(F.when(any_way, F.lit(licence)))
    return named.select(*keep, "n_sentences", F.trim("__ids").alias("sentence_ids"), F.array_join(F.array_compact(F.array(*matches)), "|").alias("licences"))
