"""Licence recognition by sentence rules.

A text is cut into sentences; each is normalised and looked up among known licence sentences, which gives the text's
sequence of sentence ids.  A licence's rule is a sequence of ids; it matches where its ids occur in the text's sequence
in that order, other known sentences between them or not.  Rules with more sentences come first and use up what they
match, so a licence whose sentences are part of another's is found only where they stand for themselves.  A weak rule,
such as a bare reservation of rights, counts only in texts that no other rule fits.

Known sentences are made by the same cutter from notices, so each of them is one that it can find.  Both tables are
small and fixed.  Sentences are found in the JVM, by expressions; rules are matched in Python on the ids alone, which
most texts have none of.  Every row is read once, without a shuffle.

Defined results: null and empty texts have no sentences and no licences; texts are read whole; a sentence found again
counts again in the sequence, a licence found again is given once; repeated rows are read alike; other columns stay,
whatever their names, and the result columns are ``sentences`` and ``licences`` (with underscores added if the table
has these).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintdex.llm.shared import fresh

# Sentences of public licence texts and notices, by id; the cutter may make several of one.
NOTICES = {
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0/grant": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-2.0/comply": "you may not use this file except in compliance with the License",
    "apache-2.0/copy": "You may obtain a copy of the License at",
    "apache-2.0/as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-2.0/see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit/notice": "Released under the MIT License",
    "mit/licensed": "Licensed under the MIT License",
    "mit/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit/include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit/as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl/program": "This program is free software:",
    "gpl/library": "This library is free software:",
    "gpl/3-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl/2-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl/terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "lgpl/terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl/3-or-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl/3-or-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl/terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation;",
    "gnu/either-2": "either version 2 of the License, or (at your option) any later version.",
    "gnu/either-2.1": "either version 2.1 of the License, or (at your option) any later version.",
    "gnu/either-3": "either version 3 of the License, or (at your option) any later version.",
    "gnu/version-2": "version 2 of the License.",
    "gnu/version-3": "version 3 of the License.",
    "gpl/hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl/details": "See the GNU General Public License for more details.",
    "bsd/redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd/source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd/binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd/endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "zlib/as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib/grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0/grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "mpl-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2.0/notice-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "epl-1.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "cc-by-4.0/notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0/notice": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0/work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0/work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0/work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-1.0/notice": "Released under CC0 1.0",
    "unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "rights/all": "All rights reserved.",
}

# A licence and the sentences, in order, that show it.
RULES = [
    ("Apache-2.0", ("apache-2.0/grant", "apache-2.0/comply", "apache-2.0/as-is")),
    ("Apache-2.0", ("apache-2.0/notice",)),
    ("MIT", ("mit/grant", "mit/include", "mit/as-is")),
    ("MIT", ("mit/notice",)),
    ("MIT", ("mit/licensed",)),
    ("GPL-3.0", ("gpl-3.0/notice",)),
    ("GPL-3.0-or-later", ("gpl/program", "gpl/3-or-later")),
    ("GPL-3.0-or-later", ("gpl/program", "gpl/terms", "gnu/either-3")),
    ("GPL-3.0-only", ("gpl/program", "gpl/terms", "gnu/version-3")),
    ("GPL-2.0-or-later", ("gpl/program", "gpl/2-or-later")),
    ("GPL-2.0-or-later", ("gpl/program", "gpl/terms", "gnu/either-2")),
    ("GPL-2.0-only", ("gpl/program", "gpl/terms", "gnu/version-2")),
    ("LGPL-2.1-or-later", ("gpl/library", "lgpl/terms", "gnu/either-2.1")),
    ("LGPL-3.0-or-later", ("lgpl/3-or-later",)),
    ("LGPL-3.0-or-later", ("lgpl/terms", "gnu/either-3")),
    ("AGPL-3.0-or-later", ("gpl/program", "agpl/3-or-later")),
    ("AGPL-3.0-or-later", ("gpl/program", "agpl/terms", "gnu/either-3")),
    ("BSD-3-Clause", ("bsd/redistribute", "bsd/source", "bsd/binary", "bsd/endorse")),
    ("BSD-2-Clause", ("bsd/redistribute", "bsd/source", "bsd/binary")),
    ("ISC", ("isc/grant",)),
    ("0BSD", ("0bsd/grant",)),
    ("Zlib", ("zlib/as-is", "zlib/grant")),
    ("BSL-1.0", ("bsl-1.0/grant",)),
    ("MPL-2.0", ("mpl-2.0/notice",)),
    ("EPL-2.0", ("epl-2.0/notice",)),
    ("EPL-2.0", ("epl-2.0/notice-v",)),
    ("EPL-1.0", ("epl-1.0/notice",)),
    ("CC-BY-4.0", ("cc-by-4.0/notice",)),
    ("CC-BY-4.0", ("cc-by-4.0/work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0/notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0/work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0/notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0/work",)),
    ("CC0-1.0", ("cc0-1.0/notice",)),
    ("Unlicense", ("unlicense/notice",)),
    ("Proprietary", ("rights/all",)),
]
#: Licences of weak rules.
WEAK = ("Proprietary",)

#: A sentence ends at a line feed that a blank line or a list mark follows, or at . ! ? ; : before a blank or the end.
ENDS = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)|\n[\x20\x09]*\n|\n"
#: What a normalised sentence keeps: ASCII letters and digits, lower case, by single spaces.
OTHER = "[^a-z0-9]+"


def cut(text: str) -> list[str]:
    """A notice's sentences, normalised, as the expressions of ``ids_of`` cut it."""
    parts = (re.sub(OTHER, " ", x.lower()).strip() for x in re.split(ENDS, text))
    return [x for x in parts if x]


def _known() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Id by normalised sentence, and each notice's ids; a sentence that several notices share has its first one's id."""
    sentences: dict[str, str] = {}
    notices = {}
    for name, text in NOTICES.items():
        for k, x in enumerate(cut(text)):
            sentences.setdefault(x, name if k == 0 else f"{name}-{k + 1}")
        notices[name] = tuple(sentences[x] for x in cut(text))
    return sentences, notices


SENTENCES, SEQUENCES = _known()
#: Licence and ids, those of more sentences first.
MATCHED = sorted(((name, tuple(i for n in rule for i in SEQUENCES[n])) for name, rule in RULES), key=lambda r: -len(r[1]))


def ids_of(text: Column) -> Column:
    """The ids of a text's known sentences, in order; a sentence may also span whole lines of one paragraph.

    At each line, the sentence that is this line comes before the longest one that goes on over further lines.
    """
    known = F.create_map(*(F.lit(x) for s, i in SENTENCES.items() for x in (s, i)))
    spread = "|".join(s.replace(" ", r"[ \n]") for s in sorted(SENTENCES, key=len, reverse=True))
    # One match for each line: the longest known sentence from its start to the end of a line, or nothing.
    runs = F.lit(rf"(?:\A|\n)(?=({spread})(?=\n|\z)|)")

    def found(part: Column) -> Column:
        each = lambda line, run: F.array(F.try_element_at(known, line), F.when((run != "") & (run != line), F.try_element_at(known, F.translate(run, "\n", " "))))
        return F.flatten(F.zip_with(F.split(part, "\n", -1), F.regexp_extract_all(part, runs, F.lit(1)), each))

    parts = F.split(F.coalesce(text, F.lit("")), ENDS.removesuffix(r"|\n"), -1)
    plain = F.transform(parts, lambda s: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9\n]+", " "), r" *\n[ \n]*", "\n"), F.lit(" \n")))
    return F.filter(F.flatten(F.transform(plain, found)), lambda i: i.isNotNull())


def licences_of(ids: list[str]) -> list[str]:
    """The licences whose rules a sequence of ids matches, each once, those by longer rules first."""
    left: list[str | None] = list(ids)
    found: dict[str, None] = {}
    for name, rule in MATCHED:
        if name in WEAK and found:
            continue
        while True:
            at, places = -1, []
            for i in rule:
                try:
                    at = left.index(i, at + 1)
                except ValueError:
                    break
                places.append(at)
            if len(places) < len(rule):
                break
            found[name] = None
            for k in places:
                left[k] = None
    return list(found)


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text's ``sentences`` (ids in order) and ``licences`` (each once, those by longer rules first)."""
    sentences, licences = fresh(docs, "sentences", "licences")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _licences(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: licences_of(list(x)) if len(x) else [])

    return docs.withColumn(sentences, ids_of(F.col(text))).withColumn(licences, _licences(F.col(sentences)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with its sentence ids and licences as joined text."""
    found = recognise(docs.select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


#: For texts whose licences are notices of one line: what each line says, stated by hand.
ORACLE = r"""
WITH notices(k, line, id, licence) AS (VALUES
  (1, 'Licensed under the Apache License, Version 2.0.', 'apache-2.0/notice', 'Apache-2.0'), (2, 'Released under the MIT License.', 'mit/notice', 'MIT'),
  (3, 'Licensed under the MIT License.', 'mit/licensed', 'MIT'), (4, 'This work is licensed under the GNU General Public License, version 3.', 'gpl-3.0/notice', 'GPL-3.0'),
  (5, 'Licensed under CC BY 4.0.', 'cc-by-4.0/notice', 'CC-BY-4.0'), (6, 'Licensed under CC BY-SA 4.0.', 'cc-by-sa-4.0/notice', 'CC-BY-SA-4.0'),
  (7, 'Licensed under CC BY-NC 4.0.', 'cc-by-nc-4.0/notice', 'CC-BY-NC-4.0'), (8, 'Released under CC0 1.0.', 'cc0-1.0/notice', 'CC0-1.0'), (9, 'All rights reserved.', 'rights/all', 'Proprietary')),
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM cut),
found AS (SELECT doc_id, place, k, id, licence FROM each JOIN notices ON trim(each.line) = notices.line),
sequence AS (SELECT doc_id, string_agg(id, ',' ORDER BY place) AS sentences, bool_or(k < 9) AS strong FROM found GROUP BY doc_id),
named AS (SELECT doc_id, licence, min(k) AS k FROM found GROUP BY doc_id, licence),
listed AS (SELECT doc_id, string_agg(licence, ',' ORDER BY k) AS licences FROM named JOIN sequence USING (doc_id) WHERE k < 9 OR NOT strong GROUP BY doc_id)
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(licences, '') AS licences
FROM cut LEFT JOIN sequence USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
