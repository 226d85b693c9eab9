import re

import duckdb

from ballotry.llm import licenses as lc

MIT = """MIT License

Copyright (c) 2021 A. Person
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
SOFTWARE.
"""
APACHE = """# Copyright 2020 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""
BSD = """Copyright (c) 2019, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def brute(text):
    def known(s):
        return lc.SENTENCES.get(re.sub("[^a-z0-9]+", " ", s).strip())

    low = (text or "").translate(str.maketrans(lc.UPPER, lc.LOWER)).replace("identifier: ", "identifier ")
    lines = []
    for line in low.split("\n"):
        lines += ["", line, ""] if "copyright (c)" in line else [line]
    ids = []
    for s in re.split(lc.SPLIT, "\n".join(lines)):
        ids += [known(s)] if known(s) else map(known, s.splitlines())
    ids = [i for i in ids if i]
    left, names = list(ids), []
    for name, rule in lc.RULES:
        i = 0
        while i + len(rule) <= len(left):
            if tuple(left[i : i + len(rule)]) == rule:
                left[i : i + len(rule)] = ["#"]
                if name not in names:
                    names.append(name)
            i += 1
    return len(ids), ",".join(ids), ",".join(names), sum(x != "#" for x in left)


def texts():
    full = ". ".join(next(s for s, i in lc.SENTENCES.items() if i == x) for x in ("MITPermission", "MITNotice", "MITAsIs"))
    return [
        None, "", "No words about it.", "Licensed under the Apache License, Version 2.0.\nMore text. Released under the MIT License. End",
        full + ".", "Released under the MIT License.\n" * 7, "This work is licensed under the GNU General Public License, version 3. " + full, "x " * 200_000 + "\nLicensed under CC BY-NC 4.0.",
        ". ".join(next(s for s, i in lc.SENTENCES.items() if i == x) for x in ("BSDRedistribution", "BSDSource", "BSDBinary", "BSDEndorse", "BSDSource")),
        "See the GNU General Public License for more details.", "Words without an end\nAll rights reserved.\n", "/* SPDX-License-Identifier: BSD-3-Clause */\nint x;\n",
        MIT, APACHE, GPL, BSD, MIT + GPL + "// SPDX-License-Identifier: MIT",
    ]


def test_every_sentence_has_a_hint_and_is_normal():
    for s in lc.SENTENCES:
        assert re.search(lc.HINT, s) and s == re.sub("[^a-z0-9]+", " ", s).strip()


def test_scan_equals_plain_python_and_sql(spark):
    rows = [(i, t, "k") for i, t in enumerate(texts())] + [(None, texts()[3], "k"), (3, texts()[3], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = sorted(map(tuple, lc.license_scan(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, _ in rows), key=str)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    assert sorted(con.sql(lc.license_sql()).fetchall(), key=str) == got
    assert lc.license_scan(df.limit(0)).count() == 0


def test_wrapped_licences_are_found(spark):
    cases = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "BSD-2-Clause": BSD, "Proprietary": "Text without a point\nAll rights reserved.", "ISC": "-- SPDX-License-Identifier: ISC"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases.values())], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_unmatched) for r in lc.license_scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [(name, 0) for name in cases]
