"""License scans by sentence rules.

Texts are cut into sentences at blank lines (lines without a word) and after . ! ? ; : with white space (but for a lone v.); a single line end is a
space, as licences are mostly hard-wrapped. A normalised sentence (lower case, letters,
digits and inner dots only, single spaces) that equals a known one, or holds it between word ends, gets its identifier;
longer known sentences first. A sentence that speaks of licences but is not known is `?`. The sequence of identifiers of a
text is matched against ordered rules: each rule is a sequence of identifiers that stand next to each other, and replaces
them by its licence; earlier rules win. Identifiers left over that name a licence alone give it; others are unmatched.

Null and empty texts have no licence. Repeated rows get equal results; all columns but doc_id and text are left alone. Ids may be
null or repeated, an empty table gives an empty table, a text of any length is a step of its own. Ties: of rules and sentences
that both match the earlier rule and the longer sentence win.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: Known sentences as they are normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-notice",
    "the software is provided as is and the author disclaims all warranties": "isc-as-is",
    "licensed under the isc license": "isc-name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-head",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of": "bsd-name",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "this software is provided by the copyright holders and contributors as is": "bsd-as-is",
    "this software is provided by the author and contributors as is": "bsd-as-is",
    "licensed under the apache license version 2.0": "apache-2-name",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing": "apache-as-is",
    "this program is free software": "gpl-free",
    "this library is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu library general public license": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl-terms",
    "either version 3 of the license": "version-3",
    "either version 2.1 of the license": "version-2.1",
    "either version 2 of the license": "version-2",
    "version 3 of the license": "version-3-alone",
    "version 2.1 of the license": "version-2.1-alone",
    "version 2 of the license": "version-2-alone",
    "any later version": "later",
    "licensed under the gnu general public license version 3": "gpl-3-name",
    "licensed under the gnu general public license version 2": "gpl-2-name",
    "licensed under the gnu affero general public license version 3": "agpl-3-name",
    "licensed under the gnu lesser general public license": "lgpl-name",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl-2-name",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl-2-name",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-copy",
    "licensed under the mozilla public license version 2.0": "mpl-2-name",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "distributed under the boost software license version 1.0": "boost-name",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "epl-2-name",
    "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-head",
    "licensed under cc by nc 4.0": "cc-by-nc-4-name",
    "licensed under cc by sa 4.0": "cc-by-sa-4-name",
    "licensed under cc by 4.0": "cc-by-4-name",
    "all rights reserved": "rights",
}
#: Identifier sequences and their licences, in the order in which they are tried.
RULES = (
    (("mit-grant", "mit-notice", "as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("isc-grant", "isc-notice", "isc-as-is"), "ISC"),
    (("isc-grant", "isc-notice"), "ISC"),
    (("bsd-head", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name", "bsd-as-is"), "BSD-4-Clause"),
    (("bsd-head", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is"), "BSD-3-Clause"),
    (("bsd-head", "bsd-source", "bsd-binary", "bsd-as-is"), "BSD-2-Clause"),
    (("apache-2-name", "apache-comply", "apache-copy", "apache-2-name", "apache-as-is"), "Apache-2.0"),
    (("apache-2-name", "apache-comply", "apache-copy", "apache-as-is"), "Apache-2.0"),
    *((("gpl-free", f"{kind}-terms", f"version-{version}", "later"), f"{kind.upper()}-{version if '.' in version else version + '.0'}-or-later") for kind, version in (("gpl", "3"), ("gpl", "2"), ("agpl", "3"), ("lgpl", "3"), ("lgpl", "2.1"), ("lgpl", "2"))),
    *((("gpl-free", f"{kind}-terms", f"version-{version}"), f"{kind.upper()}-{version if '.' in version else version + '.0'}-or-later") for kind, version in (("gpl", "3"), ("gpl", "2"), ("agpl", "3"), ("lgpl", "3"), ("lgpl", "2.1"), ("lgpl", "2"))),
    *((("gpl-free", f"{kind}-terms", f"version-{version}-alone"), f"{kind.upper()}-{version if '.' in version else version + '.0'}-only") for kind, version in (("gpl", "3"), ("gpl", "2"), ("agpl", "3"), ("lgpl", "3"), ("lgpl", "2.1"), ("lgpl", "2"))),
    (("mpl-2-name", "mpl-copy"), "MPL-2.0"),
    (("zlib-as-is", "zlib-altered", "zlib-notice"), "Zlib"),
    (("mit-name",), "MIT"),
    (("isc-name",), "ISC"),
    (("apache-2-name",), "Apache-2.0"),
    (("gpl-3-name",), "GPL-3.0"),
    (("gpl-2-name",), "GPL-2.0"),
    (("agpl-3-name",), "AGPL-3.0"),
    (("lgpl-name",), "LGPL"),
    (("mpl-2-name",), "MPL-2.0"),
    (("unlicense-head",), "Unlicense"),
    (("boost-name",), "BSL-1.0"),
    (("epl-2-name",), "EPL-2.0"),
    (("cc0-head",), "CC0-1.0"),
    (("cc-by-nc-4-name",), "CC-BY-NC-4.0"),
    (("cc-by-sa-4-name",), "CC-BY-SA-4.0"),
    (("cc-by-4-name",), "CC-BY-4.0"),
)
CUT = re.compile(r"(?>\r\n?|\n)[^\w\r\n]*(?>\r\n?|\n)|(?<=[.!?;:])(?<!\sv\.)\s+")
NOT_WORD = re.compile(r"[^\w.]+|\.(?!\d)|(?<!\d)\.")
#: Both are looked for in lower-cased text.
ABOUT = re.compile(r"licen[cs]|copyright|\brights\b|redistribut|warrant|permission")
#: The longest word of each known sentence: a text without any of them has no known sentence.
ANY = re.compile("|".join(sorted({max(s.split(), key=len) for s in SENTENCES})))
#: A text that holds none of these speaks of no licence and holds no known sentence.
HINTS = tuple(sorted({max(s.split(), key=len) for s in SENTENCES} | {"licens", "licenc", "copyright", "rights", "redistribut", "warrant", "permission"}))
KNOWN = sorted(SENTENCES.items(), key=lambda x: (-len(x[0]), x[0]))
FIND = re.compile(r"\b(" + "|".join(re.escape(s) for s, _ in KNOWN) + r")\b")


def normal(sentence: str) -> str:
    return " ".join(NOT_WORD.sub(" ", sentence.lower()).split())


def identifiers(text: str) -> list[str]:
    """Identifiers of the licence sentences of a text, in order."""
    out = []
    for sentence in CUT.split(text) if hinted(text) else ():
        low = sentence.lower()
        about = ABOUT.search(low)
        if about or ANY.search(low):
            found = [SENTENCES[x] for x in FIND.findall(normal(sentence))]
            out += found or ["?"] * bool(about)
    return out


def hinted(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in HINTS)


def matched(ids: list[str]) -> tuple[list[str], list[str]]:
    """(licences in order of appearance, identifiers that no rule took)."""
    left: list[tuple[str, bool]] = [(x, False) for x in ids]
    for sequence, licence in RULES:
        i = 0
        while i + len(sequence) <= len(left):
            if tuple(left[i : i + len(sequence)]) == tuple((x, False) for x in sequence):
                left[i : i + len(sequence)] = [(licence, True)]
            i += 1
    return [x for x, done in left if done], [x for x, done in left if not done]


def licences(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences (licence sentences), identifiers, licences, n_unmatched. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.steps(batches):
            ids = [identifiers(t or "") for t in part.column(1).to_pylist()]
            found = [matched(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([";".join(x) for x in ids], pa.string()), pa.array([";".join(x) for x, _ in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64())],
                ["doc_id", "n_sentences", "identifiers", "licences", "n_unmatched"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_sentences long, identifiers string, licences string, n_unmatched long")


def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(base.documents(spark, sf_dir))
