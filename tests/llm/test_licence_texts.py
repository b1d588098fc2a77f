"""Licences of texts as they are usually wrapped."""

import random
import re

import pytest

from tessellate.llm import licences

MIT = """MIT License

Copyright (c) 2020 Somebody

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


BSD2 = BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFTWARE") :]
GPL2 = GPL.replace("version 3", "version 2")
GPL2_ONLY = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; version 2 of the License.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""
ALL = [(MIT, "MIT"), (BSD, "BSD-3-Clause"), (BSD2, "BSD-2-Clause"), (GPL, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (GPL2_ONLY, "GPL-2.0-only"), (LGPL, "LGPL-2.1-or-later"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"), (ISC, "ISC")]


@pytest.mark.parametrize("text, licence", ALL)
def test_wrapped_texts(text, licence):
    comment = "".join(f" * {line}".rstrip() + "\n" for line in text.splitlines())
    for form in (text, text.replace("\n", "\r\n"), comment, "Some prose first.\n\n" + text + "\nSome prose after."):
        assert licences.matched(licences.identifiers(form))[0] == [licence]


def test_blank_lines_still_cut():
    assert licences.identifiers("This program\n\nis free software.") == []


def test_no_known_sentence_is_skipped(spark):
    texts = ["This program is free software.", "Neither the name of X"]
    rows = licences.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.identifiers for r in rows} == {0: "gpl-free", 1: "bsd-name"}


def plainly(text):
    """The scan by hand: every place of every normalised sentence is tried with every known sentence, the longest first."""
    out = []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines, sentences, held = text.split("\n"), [], []
    for line in [*lines, ""]:
        if re.search(r"\w", line):
            held.append(line)
        else:
            sentences += re.split(r"(?<=[.!?;:])(?<!\sv\.)\s+", "\n".join(held)) if held else []
            held = []
    for sentence in sentences:
        words = licences.normal(sentence).split()
        at, found = 0, []
        while at < len(words):
            hit = next((s for s in sorted(licences.SENTENCES, key=lambda s: (-len(s), s)) if words[at : at + len(s.split())] == s.split()), None)
            found += [licences.SENTENCES[hit]] if hit else []
            at += len(hit.split()) if hit else 1
        out += found or ["?"] * bool(licences.ABOUT.search(sentence.lower()))
    return out


def test_identifiers_equal_a_scan_by_hand():
    rng = random.Random(3)
    known = [t for t, _ in ALL] + ["Some prose. With a copyright notice! Licence unknown; and more.", "All rights reserved.", "Released under the MIT License.\n", "plain words\n\nno more"]
    for _ in range(60):
        text = "\n\n".join(rng.choice(known)[rng.randrange(5) :] for _ in range(rng.randrange(1, 5)))
        assert licences.identifiers(text) == plainly(text)
