import os

import duckdb

from glintdex.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. More."""


def test_texts(spark):
    rows = [
        (1, "Words.\nLicensed under the Apache License, Version 2.0.\nMore words."),
        (2, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (3, MIT),
        (4, "\n\n".join(reversed(MIT.split("\n\n")))),
        (5, None),
        (6, ""),
        (7, "This work is licensed under the GNU General Public License, version 3."),
        (8, "We licensed under the MIT License nothing."),
        (9, "text " * 100_000 + "\nAll rights reserved."),
        (1, "Words.\nLicensed under the Apache License, Version 2.0.\nMore words."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sentences string")
    found = licences.recognise(docs)
    assert found.columns == ["doc_id", "text", "sentences", "sentences_", "licences"]
    got = {r["doc_id"]: r["licences"] for r in found.collect()}
    assert got == {1: ["Apache-2.0"], 2: ["MIT", "CC-BY-NC-4.0"], 3: ["MIT"], 4: [], 5: [], 6: [], 7: ["GPL-3.0"], 8: [], 9: ["Proprietary"]}
    assert found.count() == len(rows)
    assert licences.scan(docs.where("false")).count() == 0


APACHE = """Licensed under the Apache License,
Version 2.0 (the "License");
you may not use this file except in
compliance with the License.

Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied."""


def test_mixed_cuts(spark):
    """Bare lines and wrapped sentences in one text: neither hides the other."""
    bare = "Licensed under CC BY 4.0\nReleased under CC0 1.0\nAll rights reserved\n"
    parts = ["apache-2.0/grant", "apache-2.0/comply", "apache-2.0/as-is"]
    texts = [
        f"Released under the MIT License\nother text\n\n{APACHE}",
        f"Released under the MIT License\n{APACHE}",
        f"{APACHE}\nReleased under the MIT License\nother text",
        f"{bare}\n{MIT}",
        f"{bare}{MIT}",
        "Licensed under the Apache License, Version 2.0\n(the 'License')",
        "a line\r\n# Released under\r\n# the MIT License\r\nmore",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["sentences"], r["licences"]) for r in licences.recognise(docs).collect()}
    assert got[0] == got[1] == (["mit/notice", *parts], ["Apache-2.0", "MIT"])
    assert got[2] == ([*parts, "mit/notice"], ["Apache-2.0", "MIT"])
    # The reservation of rights counts only where there is no licence.
    assert got[3] == got[4] == (["cc-by-4.0/notice", "cc0-1.0/notice", "rights/all", "mit/grant", "mit/include", "mit/as-is"], ["MIT", "CC-BY-4.0", "CC0-1.0"])
    assert got[5] == (["apache-2.0/notice", "apache-2.0/grant"], ["Apache-2.0"])
    assert got[6] == (["mit/notice"], ["MIT"])


BSD = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This {what} is free software{mark} you can redistribute it and/or modify
    it under the terms of the GNU {kind}General Public License as published by
    the Free Software Foundation{then} either version {version} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
REAL = [
    (BSD + ENDORSE, ["BSD-3-Clause"]),
    (BSD, ["BSD-2-Clause"]),
    (BSD + ENDORSE + BSD, ["BSD-3-Clause", "BSD-2-Clause"]),
    (BSD + ENDORSE + BSD + ENDORSE, ["BSD-3-Clause"]),
    (GPL.format(what="program", mark=":", kind="", then=",", version=3), ["GPL-3.0-or-later"]),
    (GPL.format(what="program", mark=";", kind="", then=";", version=2), ["GPL-2.0-or-later"]),
    (GPL.format(what="program", mark=":", kind="", then=",", version=2), ["GPL-2.0-or-later"]),
    (GPL.format(what="library", mark=";", kind="Lesser ", then=";", version="2.1"), ["LGPL-2.1-or-later"]),
    (GPL.format(what="program", mark=":", kind="Lesser ", then=",", version=3), ["LGPL-3.0-or-later"]),
    (GPL.format(what="program", mark=":", kind="Affero ", then=",", version=3), ["AGPL-3.0-or-later"]),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; version 2 of the License.", ["GPL-2.0-only"]),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", ["MPL-2.0"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ["0BSD"]),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", ["EPL-2.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("Copyright 2020 Some Body. All rights reserved.", ["Proprietary"]),
    (APACHE + "\n\nAll rights reserved.", ["Apache-2.0"]),
    ("we see the license and all rights reserved for now", []),
]


def test_real_notices(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(REAL)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.recognise(docs).collect()}
    assert [got[i] for i in range(len(REAL))] == [want for _, want in REAL]


def test_no_rule_is_dead(spark):
    """The notices of each rule, one after the other, show its licence."""
    docs = spark.createDataFrame([(k, "\n\n".join(licences.NOTICES[n] for n in rule)) for k, (_, rule) in enumerate(licences.RULES)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.recognise(docs).collect()}
    assert [got[k] for k in range(len(licences.RULES))] == [[name] for name, _ in licences.RULES]


def test_oracle(spark, sf):
    sf = os.path.join(os.path.dirname(sf), "sf0.01")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = duck.execute(licences.ORACLE).df().set_index("doc_id").sort_index()
    got = licences.scan(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().set_index("doc_id").sort_index()
    assert got.equals(want[got.columns])
    assert (got.licences != "").sum() > 10
