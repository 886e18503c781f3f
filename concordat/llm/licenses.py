"""Licence scans by canonical digest (DataFrame expressions only).

A text is brought to a canonical form: lower case; lines that state a copyright dropped; equivalent
spellings replaced by one; all but letters and digits turned into single spaces. Its SHA-256 is joined
by hash with the digests of known licences, so only entire texts match. The units looked up are the
whole document, each of its lines and each of its paragraphs (parted by lines without a letter or digit),
so that a notice or a file header is found as well. A line or paragraph is hashed only if a known text
has its canonical length, which leaves out almost all and nothing that could match. The known digests
are broadcast up to ``MAX_BROADCAST`` rows and joined by a shuffle beyond.

Defined results: a null or blank text has the canonical form of an empty text, which no licence has;
each row is a document of its own, whatever its id (nulls and repeats too); a text that is known under
several ids gives all of them, sorted; known texts without an id or without a word are left out; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, let

MAX_BROADCAST = 100_000
#: With more different lengths of known texts than this, only the longest bounds what is hashed.
MAX_LENGTHS = 5_000

#: Spellings that licence texts use alike, each with the one that stands for them.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "copyright holder": "copyright owner",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "noncommercial": "non commercial",
    "optimisation": "optimization",
    "organisation": "organization",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "wilful": "willful",
}

_APACHE_HEAD = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at"
)
_GPL_HEAD = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
#: Notices that stand in documents as lines or paragraphs of their own.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", _APACHE_HEAD],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "GPL-2.0-or-later": [_GPL_HEAD.format("2")],
    "GPL-3.0-or-later": [_GPL_HEAD.format("3")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the 3-Clause BSD License."],
}

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n\n"
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence texts that are short enough to state here; longer ones are given as a table.
TEXTS = {
    "BSD-2-Clause": _BSD_TERMS + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
    "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
    "3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any "
    "person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
    '"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe "
    "copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
    "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
    "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
    'language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
    "or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment "
    'in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", '
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>",
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted.\n\n" + _ISC_WARRANTY,
}


#: Lines that state a copyright: the word with a year, a sign or an owner, a sign with a year, or the usual claim.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b[^\n]*(?:\(c\)|©|[0-9]{4}|\bby\b)|\(c\)[^\n]*[0-9]{4}|©|all rights reserved)[^\n]*$"
)


def spelling_patterns(group_sign: str) -> list[tuple[str, str]]:
    """Pattern and replacement of each spelling; words of a phrase may stand on two lines, and stay so if both have two."""
    kept = lambda a, b: " " in a and " " in b
    return [(a.replace(" ", r"(\s)" if kept(a, b) else r"\s"), b.replace(" ", f"{group_sign}1") if kept(a, b) else b) for a, b in SPELLINGS.items()]


def canonical_lines(text: Column) -> Column:
    """The canonical form of every line, still one to a line."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, COPYRIGHT_LINE, "")
    x = F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n")
    any_other = r"\b(?:" + "|".join(p for p, _ in spelling_patterns("$")) + r")s?\b"

    def respelt(y: Column) -> Column:
        z = y
        for pattern, one in spelling_patterns("$"):
            z = F.regexp_replace(z, rf"\b{pattern}(?=s?\b)", one)
        return F.when(F.regexp_like(y, F.lit(any_other)), z).otherwise(y)

    return let(x, respelt)


def digest_of(canonical: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(canonical, r"\s+", " ")), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id and text of the notices and texts stated above."""
    pairs = [(i, t) for i, ts in NOTICES.items() for t in ts] + list(TEXTS.items())
    rows = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in pairs))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, whole_license and notice_licenses (ids, sorted and joined by ``,``; null if none)."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    lib = known.filter("license_id IS NOT NULL").select("license_id", flat(canonical_lines(F.col("text"))).alias("c"))
    lib = lib.filter("c <> ''").groupBy(F.sha2("c", 256).alias("digest"), F.length("c").alias("n")).agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    lib = durable(lib)
    rows = lib.count()
    lengths = [r["n"] for r in lib.select("n").distinct().limit(MAX_LENGTHS + 1).collect()]
    longest = lib.agg(F.max("n")).first()[0] or 0
    able = (lambda n: n.isin(lengths)) if 0 < len(lengths) <= MAX_LENGTHS else (lambda n: n.between(1, longest))
    side = lib.select("digest", "ids")
    side = F.broadcast(side) if rows <= MAX_BROADCAST else side
    # Texts are read and brought to their canonical form once; both joins then start from the digests.
    canon = docs.select("doc_id", canonical_lines(F.col("text")).alias("c"))
    line = F.transform(F.split("c", "\n"), lambda x: F.trim(x))
    paragraph = F.transform(F.split("c", "\n\n+"), flat)
    units = F.transform(F.array_distinct(F.concat(*(F.filter(x, lambda u: able(F.length(u))) for x in (line, paragraph)))), lambda u: F.sha2(u, 256))
    whole = durable(canon.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest_of(F.col("c")).alias("canonical_sha256"), units.alias("units")))
    notices = whole.select("row", F.explode("units").alias("digest")).join(side, "digest").select("row", F.explode("ids").alias("id"))
    notices = notices.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("notice_licenses"))
    named = whole.select("row", "doc_id", "canonical_sha256").join(side.select(F.col("digest").alias("canonical_sha256"), F.array_join("ids", ",").alias("whole_license")), "canonical_sha256", "left")
    return named.join(notices, "row", "left").select("doc_id", "canonical_sha256", "whole_license", "notice_licenses")
