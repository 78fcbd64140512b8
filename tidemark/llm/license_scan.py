"""Licence scan by sentence rules.

A text is cut into sentences, which are normalised: lower case, words only. A table maps known licence sentences
to identifiers, so that a text becomes a sequence of identifiers with their places. Ordered rules then match this
sequence: a rule is a list of identifiers that must follow each other with few other sentences between them, and
names a licence. Rules are tried from the most specific to the least, and a sentence serves one match only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import cells, mapped, spread

#: Sentences of public licences, and their identifiers.
SENTENCES = {
    "MIT-GRANT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MIT-GRANT-SHORT": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "MIT-NOTICE": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "AS-IS-MIT": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "MIT-NAMED": "Licensed under the MIT License",
    "MIT-NAMED-2": "Released under the MIT License",
    "MIT-NAMED-3": "This project is licensed under the MIT License",
    "ISC-GRANT": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-AS-IS": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "BSD-GRANT": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BSD-BINARY": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSD-NAMES": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "APACHE-GRANT": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "APACHE-NAMED": "Licensed under the Apache License, Version 2.0",
    "APACHE-COPY": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "APACHE-AS-IS": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "GPL-2-PLUS": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3-PLUS": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL-HOPE": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "GPL-NAMED": "Licensed under the GNU General Public License",
    "LGPL-21-PLUS": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "AGPL-3-PLUS": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "MPL-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MPL-2-COPY": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "UNLICENSE": "This is free and unencumbered software released into the public domain",
    "CC-BY-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "EPL-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC-BY-NC-4": "Licensed under CC BY-NC 4.0",
    "GPL-3-NAMED": "This work is licensed under the GNU General Public License, version 3",
    "PROPRIETARY": "All rights reserved",
}

#: Fixed values: (licence, identifiers in their order). The first rule that matches at a place wins.
RULES = (
    ("MIT", ("MIT-GRANT", "MIT-NOTICE", "AS-IS-MIT")),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE")),
    ("Apache-2.0", ("APACHE-GRANT", "APACHE-COPY", "APACHE-AS-IS")),
    ("Apache-2.0", ("APACHE-GRANT", "APACHE-AS-IS")),
    ("BSD-3-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES")),
    ("BSD-2-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY")),
    ("ISC", ("ISC-GRANT", "ISC-AS-IS")),
    ("GPL-2.0-or-later", ("GPL-2-PLUS", "GPL-HOPE")),
    ("GPL-3.0-or-later", ("GPL-3-PLUS", "GPL-HOPE")),
    ("AGPL-3.0-or-later", ("AGPL-3-PLUS", "GPL-HOPE")),
    ("MPL-2.0", ("MPL-2", "MPL-2-COPY")),
    ("MIT", ("MIT-GRANT",)),
    ("MIT", ("MIT-GRANT-SHORT",)),
    ("MIT", ("MIT-NAMED",)),
    ("MIT", ("MIT-NAMED-2",)),
    ("MIT", ("MIT-NAMED-3",)),
    ("Apache-2.0", ("APACHE-GRANT",)),
    ("Apache-2.0", ("APACHE-NAMED",)),
    ("BSD-like", ("BSD-GRANT",)),
    ("ISC", ("ISC-GRANT",)),
    ("GPL-2.0-or-later", ("GPL-2-PLUS",)),
    ("GPL-3.0-or-later", ("GPL-3-PLUS",)),
    ("GPL-3.0-only", ("GPL-3-NAMED",)),
    ("GPL", ("GPL-NAMED",)),
    ("LGPL-2.1-or-later", ("LGPL-21-PLUS",)),
    ("AGPL-3.0-or-later", ("AGPL-3-PLUS",)),
    ("MPL-2.0", ("MPL-2",)),
    ("Unlicense", ("UNLICENSE",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4",)),
    ("CC-BY-4.0", ("CC-BY-4",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4",)),
    ("CC0-1.0", ("CC0",)),
    ("EPL-2.0", ("EPL-2",)),
    ("Proprietary", ("PROPRIETARY",)),
)

#: Other sentences that may stand between two of a rule.
GAP = 3

WORDS = re.compile(r"[^\W_]+")
#: Where a sentence may end: a mark before white space, or an empty line. A line end alone does not end it, as
#: licence notices are wrapped; comment signs vanish with the words-only form.
ENDS = re.compile(r"[.!?:;](?=\s|$)|\n\s*\n")
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*)")


def normal(sentence: str) -> str:
    return " ".join(WORDS.findall(sentence.lower()))


@dataclass(frozen=True)
class Recogniser:
    """Known sentences by their first three words, so that a text is searched once for all of them."""

    sentences: dict
    rules: tuple
    gap: int = GAP

    def __post_init__(self):
        starts: dict[str, list] = {}
        for name, text in self.sentences.items():
            words = normal(text).split()
            starts.setdefault(" ".join(words[:3]), []).append((words, name))
        for known in starts.values():
            known.sort(key=lambda x: -len(x[0]))
        object.__setattr__(self, "starts", starts)
        # A text without any sentence's longest word has no known sentence.
        object.__setattr__(self, "anchors", tuple(sorted({max(normal(t).split(), key=len) for t in self.sentences.values()})))

    def identifiers(self, text: str) -> list[tuple[int, int, int, str, int]]:
        """(number of the sentence it starts in, start, end, identifier, number of the one it ends in) of known sentences.

        A known sentence may stand anywhere within a text's sentence, for the words before it, such as a name or
        a year, differ; it may also run over marks inside it, which the cut into sentences takes for ends. So the
        words of the whole text are matched, and the sentence numbers only serve to count what lies between. Only
        sentences with a word count.
        """
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return []
        tokens = [(m.group(), m.start(), m.end()) for m in WORDS.finditer(low)] if len(low) == len(text) else [(m.group().lower(), m.start(), m.end()) for m in WORDS.finditer(text)]
        words = [t[0] for t in tokens]
        ends = [m.start() for m in ENDS.finditer(text)]
        out, at, number, seen, past = [], 0, 0, 0, 0  # number: of the sentence of the last word before seen
        while at < len(words) - 2:
            hit = None
            for known, name in self.starts.get(" ".join(words[at : at + 3]), ()):
                if words[at : at + len(known)] == known:
                    hit = (len(known), name)
                    break
            if not hit:
                at += 1
                continue
            numbers = []
            for place in (at, at + hit[0] - 1):
                while seen <= place:
                    ended = past < len(ends) and ends[past] < tokens[seen][1]
                    while past < len(ends) and ends[past] < tokens[seen][1]:
                        past += 1
                    number += ended and seen > 0
                    seen += 1
                numbers.append(number)
            out.append((numbers[0], tokens[at][1], tokens[at + hit[0] - 1][2], hit[1], numbers[1]))
            at += hit[0]
        return out

    def matches(self, found: list[tuple[int, int, int, str, int]]) -> list[tuple[int, int, str, str]]:
        """(start, end, licence, identifiers joined) of rules that match the sequence, in order of place.

        Each identifier has the list of its places and, for each place, the next one that no rule has used, so that a
        rule costs no more than the places of its first identifier.
        """
        places: dict[str, list[int]] = {}
        for k, f in enumerate(found):
            places.setdefault(f[3], []).append(k)
        unused = {name: list(range(len(p) + 1)) for name, p in places.items()}

        def free(name: str, i: int) -> int:
            steps, root = unused[name], i
            while steps[root] != root:
                root = steps[root]
            while steps[i] != root:
                steps[i], i = root, steps[i]
            return root

        out = []
        for licence, wanted in self.rules:
            if any(name not in places for name in wanted):
                continue
            i = free(wanted[0], 0)
            while i < len(places[wanted[0]]):
                taken = [(wanted[0], i)]
                last = places[wanted[0]][i]
                for name in wanted[1:]:
                    j = free(name, bisect_right(places[name], last))
                    if j == len(places[name]) or found[places[name][j]][0] - found[last][4] - 1 > self.gap:
                        break
                    last = places[name][j]
                    taken.append((name, j))
                if len(taken) == len(wanted):
                    for name, j in taken:
                        unused[name][j] = j + 1
                    out.append((found[places[wanted[0]][i]][1], found[last][2], licence, "+".join(wanted)))
                i = free(wanted[0], i + 1)
        return sorted(out)

    def scan(self, text: str | None) -> list[tuple[int, int, str, str]]:
        text = text or ""
        out = self.matches(self.identifiers(text))
        if "SPDX-License-Identifier:" in text:
            out += [(m.start(), m.end(), m[1], "SPDX") for m in SPDX.finditer(text)]
        return sorted(out)


MATCH = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("license", T.StringType()), T.StructField("rule", T.StringType())])


def scan_licenses(docs: DataFrame, *, sentences: dict | None = None, rules: tuple | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and matches (array of start, end, license, rule) for each row of docs.

    Places are code points of the whole text, end exclusive. At most GAP other sentences stand between two of a
    rule. Null and empty texts have no match; repeated rows get equal results; of rules that fit one place the first
    wins. A text costs time linear in its length, but for a logarithm. Other columns are ignored. An empty table gives an empty one.
    """
    recogniser = Recogniser(SENTENCES if sentences is None else sentences, RULES if rules is None else rules)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("matches", T.ArrayType(MATCH))])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("rule", pa.string())]))
        for batch in batches:
            got = [[dict(zip(("start", "end", "license", "rule"), m, strict=True)) for m in recogniser.scan(text)] for (text,) in cells([batch], text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(got, kind)], [f.name for f in schema])

    return mapped(spread(docs.select(id_col, text_col)), run, schema)
