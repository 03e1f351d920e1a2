"""Licence texts as files hold them: wrapped, indented, behind comment signs; Spark and SQL alike."""

import duckdb
import pytest

from tidepanel.llm.licences import SENTENCES, licences_sql, scan_licences

MIT = """MIT License

Copyright (c) 2020 A. Person and others

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
HOLDER = "the " + "Very Long Named Foundation of " * 5 + "Somewhere"
BSD = f"""Copyright 1999 B
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
%sRedistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
%sRedistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
%sNeither the name of {HOLDER}
   nor the names of its contributors may be used to endorse or promote
   products derived from this software without specific prior written
   permission."""
APACHE = """Copyright 2020 The Authors
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2").replace("software; you", "software: you")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEXTS = {"MIT": [MIT], "BSD-3-Clause": [BSD % m for m in (("1. ", "2. ", "3. "), ("(a) ", "(b) ", "(c) "), ("* ", "* ", "* "), ("1) ", "2) ", "3) "))],
         "Apache-2.0": [APACHE], "GPL-3.0-or-later": [GPL3], "GPL-2.0-or-later": [GPL2], "MPL-2.0": [MPL]}


def _forms(text):
    yield text
    yield text.replace("\n", "\r\n")
    for sign in ("# ", "// ", " * ", "-- ", ";; ", "    "):
        yield "\n".join((sign + line).rstrip() for line in text.split("\n"))
    yield "int main() {}\n\n/*\n" + "\n".join(" * " + line for line in text.split("\n")) + "\n */\nint x = 1;\n"


CASES = [(want, form) for want, texts in TEXTS.items() for text in texts for form in _forms(text)]
CASES += [("MIT", "Title without an end\nReleased under the MIT License\nmore words without an end"), ("", "permission is\n\nhereby granted"), ("", None), ("", ""),
          ("ISC", "SPDX-License-Identifier: ISC\nint x"), ("", "\n" * 50_000 + "licence"), ("", "licence " * 50_000 + "\n")]


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(CASES)], "doc_id long, text string")
    return scan_licences(docs).select("doc_id", "sentence_ids", "licences", "unresolved").orderBy("doc_id").collect()


def test_wrapped_texts_are_found(scanned):
    got = [",".join(r["licences"]) for r in scanned]
    assert [(i, g) for i, ((w, _), g) in enumerate(zip(CASES, got)) if w != g] == []


def test_whole_licences_use_every_sentence(scanned):
    assert {i for r in scanned for i in r["unresolved"]} <= {"bsd-warranty"}
    assert all(set(r["sentence_ids"]) <= set(SENTENCES) for r in scanned)


def test_sql_finds_the_same(scanned):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(CASES)])
    want = sorted(con.execute(licences_sql()).fetchall())
    assert want == [(r["doc_id"], ",".join(r["sentence_ids"]), ",".join(r["licences"]), ",".join(r["unresolved"])) for r in scanned]
