"""Licence notices as they stand in files: wrapped, in comments, in lists."""

import re

import pytest

from tidelog.llm import licenses

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD2 = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CLAUSE3 = """3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
NOTICES = {
    "mit": """MIT License

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
""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "gpl-3.0": GPL,
    "gpl-2.0": GPL.replace("software: you", "software; you").replace("version 3", "version 2"),
    "lgpl-3.0": GPL.replace("General", "Lesser General"),
    "lgpl-2.1": GPL.replace("General", "Lesser General").replace("This program", "This library").replace("version 3", "version 2.1"),
    "agpl-3.0": GPL.replace("General", "Affero General"),
    "bsd-2-clause": BSD2,
    "bsd-3-clause": BSD2 + CLAUSE3.format("the copyright holder"),
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.
""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
}


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["licenses"] for r in sorted(licenses.scan_licenses(df).collect())]


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", ";; "])
def test_wrapped_notices_are_found(spark, prefix):
    wrapped = [re.sub("(?m)^", prefix, n) for n in NOTICES.values()]
    assert scanned(spark, wrapped) == list(NOTICES)
    # wrapped elsewhere, with carriage returns, inside other text
    narrow = [re.sub(r"(?<=[a-z,]) (?=[a-z])", "\r\n" + prefix, n) for n in wrapped]
    assert scanned(spark, ["Some words before\n" + n + "\nand some behind" for n in wrapped]) == list(NOTICES)
    assert scanned(spark, ["Some words before.\n\n" + n + "\nand some behind" for n in narrow]) == list(NOTICES)


def test_order_and_parts_of_notices_matter(spark):
    m, first, second = BSD2.partition("\n\n")[2].partition("\n\n")[0], "Redistributions of source code" + BSD2.partition("1. Redistributions of source code")[2].partition("2.")[0], "Redistributions in binary form" + BSD2.partition("Redistributions in binary form")[2]
    texts = [f"{m}\n\n{first}\n{second}", f"{m}\n\n{second}\n{first}", f"{m}\n\n{first}", f"{first}\n{second}", f"{second}\n{first}\n\n{m}", NOTICES["isc"].partition("\n\n")[0], NOTICES["isc"].partition("\n\n")[2], BSD2 + CLAUSE3.format("the University of Somewhere"), "This program is free software."]
    assert scanned(spark, texts) == ["bsd-2-clause", "", "", "", "", "", "", "bsd-3-clause", ""]


def test_every_sentence_has_a_hint_and_one_identifier():
    known = licenses._known()
    assert all(re.search(licenses.HINTS, s) for s in known) and len(set(known)) == len(known)
    assert all(len(mark) == 1 for mark in licenses.SENTENCES)


def test_long_repeated_null_and_empty_texts(spark):
    texts = ["word " * 300_000 + "\n" + GPL, "a.\n" * 300_000 + "Licensed under the MIT License", GPL, GPL, None, "", "\x01licensed\x01under"]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, license_marks int, licenses string")
    assert [r["licenses"] for r in sorted(licenses.scan_licenses(df).collect())] == ["gpl-3.0", "mit", "gpl-3.0", "gpl-3.0", "", "", ""]
    assert licenses.scan_licenses(df.where("false")).count() == 0
