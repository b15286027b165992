"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

1. Document frequencies of the templates' words are counted over all texts (a fixed vocabulary, so the result is
   a few hundred rows); words outside it are as rare as can be.
2. Texts that hold any licence word are cut into lines, paragraphs and the whole; each part's sparse TF-IDF
   vector is compared to every template, and the best cosine of at least the threshold is the text's own licence;
   vectors count only if the part also holds enough of the template's pairs of words; among licences of nearly the same words (versions of a licence, BSD with two or three clauses) the words that tell
   them apart decide. An SPDX identifier is taken at its word, with its AND and OR. Names of licences, versions and
   variants that no template has give no licence, and a long text that such a name heads has none at all.
3. A directory's licence is that of the licence files in it. A file without an own licence takes that of its
   nearest ancestor directory that has one: distinct directories are exploded to their ancestors and joined.

Texts aren't shuffled; the joins carry paths. A null or empty text has no licence of its own; long texts are read
whole; equal rows give equal rows; ties go to the licence that sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, quoted, slices, table

# Statements, standard headers and clauses of common licences. A licence has several texts.
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_MPL1 = 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.'
_MPL2 = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."


def _gnu(name: str, version: str, date: str) -> list[str]:
    """The GNU licences' headers: with the version or a later one, with this version only, and short statements."""
    start = f"you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
    end = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program."
    later, only = f"either version {version} of the License, or (at your option) any later version.", f"version {version}."
    out = [f"This work is licensed under the GNU {name}, version {version}.", f"This work is licensed under the GNU {name}, version {version} or later.", f"GNU {name.upper()} Version {version}", f"GNU {name.upper()} Version {version}, {date}"]
    for tail in (later, only):
        for lead in ("This program is free software: ", "This program is free software; "):
            out += [f"{lead}{start}, {tail}", f"{lead}{start}, {tail} {end}"] if lead.endswith(": ") else [f"{lead}{start}; {tail}"]
    return out


TEMPLATES = {
    "AGPL-3.0": _gnu("Affero General Public License", "3", "19 November 2007"),
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE.partition(" Unless")[0], _APACHE, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD_START, f"{_BSD_START} {_BSD_END}"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", f"{_BSD_START} {_BSD_NAMES}", f"{_BSD_START} {_BSD_NAMES} {_BSD_END}"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal public domain dedication.", "Creative Commons Legal Code CC0 1.0 Universal"],
    "GPL-2.0": _gnu("General Public License", "2", "June 1991"),
    "GPL-3.0": _gnu("General Public License", "3", "29 June 2007"),
    "ISC": ["Released under the ISC License.", _ISC_GRANT],
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "February 1999"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "29 June 2007"),
    "MIT": ["Released under the MIT License.", _MIT_GRANT],
    "MPL-1.1": ["This work is licensed under the Mozilla Public License, version 1.1.", _MPL1],
    "MPL-2.0": ["This work is licensed under the Mozilla Public License, version 2.0.", _MPL2],
    "Unlicense": ["Released under the Unlicense.", _UNLICENSE],
}
# Words that tell a licence from those whose texts are nearly the same. A text that names one is that one's.
MARKS = {
    "AGPL-3.0": r"affero",
    "BSD-2-Clause": r"\bbsd[ -]?2|2[ -]clause|simplified bsd",
    "BSD-3-Clause": r"\bbsd[ -]?3|3[ -]clause|(?:new|revised|modified) bsd|neither the names?\b",
    "CC-BY-NC-4.0": r"non-?commercial|\bby-nc\b",
    "CC-BY-SA-4.0": r"share-?alike|\bby-sa\b",
    "GPL-2.0": r"\bgpl(?:[ -]?v?| version )2|(?<!lesser )(?<!affero )general public license(?: as published by the free software foundation)?[,;(]* ?(?:either )?(?:version|v\.?) ?2(?![.]1)",
    "GPL-3.0": r"(?<![al])gpl(?:[ -]?v?| version )3|(?<!lesser )(?<!affero )general public license(?: as published by the free software foundation)?[,;(]* ?(?:either )?(?:version|v\.?) ?3",
    "LGPL-2.1": r"\blgpl[ -]?v?2\.1|(?:lesser|library) general public license(?: as published by the free software foundation)?[,;(]* ?(?:either )?(?:version|v\.?) ?2\.1",
    "LGPL-3.0": r"\blgpl[ -]?v?3|lesser general public license(?: as published by the free software foundation)?[,;(]* ?(?:either )?(?:version|v\.?) ?3",
    "MPL-1.1": r"(?:mozilla public license,? |mpl[ -]?)(?:version |v\.? ?)?1\.1",
    "MPL-2.0": r"(?:mozilla public license,? |mpl[ -]?)(?:version |v\.? ?)?2\.0",
}
#: Licences of which a text is at most one; within a family the marks decide, where there are any.
FAMILIES = [["AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"], ["BSD-2-Clause", "BSD-3-Clause"], ["CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0"], ["MPL-1.1", "MPL-2.0"]]
SPDX = r"spdx-license-identifier:\s*([a-z0-9.+ ()-]+)"
# Names of licences, versions and variants that no template has. A part that names one is not of a licence of like words.
OTHER = re.compile(
    r"artistic license|academic free license|open software license|eclipse public license|common (?:public|development and distribution) license|boost software license|zlib license|python software foundation license|postgresql license|european union public licen[cs]e|microsoft (?:public|reciprocal) license|mit no attribution|\bmit-0\b|(?:free documentation|\bfdl|\bgfdl)|"
    r"library general public license(?!.{0,60}2\.1)|lesser general public license[,;(]* ?(?:either )?(?:version|v\.?) ?2(?!\.1)|(?<!lesser )(?<!library )(?<!affero )general public license[,;(]* ?(?:either )?(?:version|v\.?) ?1\b|affero general public license[,;(]* ?(?:either )?(?:version|v\.?) ?[12]\b|"
    r"apache (?:software )?license[,;(]* ?(?:version|v\.?) ?1|mozilla public license[,;(]* ?(?:version|v\.?) ?1\.0|"
    r"no-?deriv|non-?commercial[ -]?share-?alike|\bby(?:-nc)?-nd\b|\bby-nc-sa\b|creative commons attribution[a-z -]* [123]\.[0-9]|\bcc[ -]by(?:-[a-z]+)*[ -][123]\.[0-9]"
)
#: A statement of so few words that says "BSD" without telling which is of none; a text of so many words is a licence's own, named by its first characters.
STATEMENT, WHOLE, HEADING = 40, 200, 400
#: Share of a template's pairs of words that a text must hold.
SHARED = 0.4
LICENSE_WORDS = r"(?i)licen[sc]|\bcc0\b|copyright|permission|redistribut|spdx|public domain|creative commons|waived"
LICENSE_FILE = r"(?i)^(?:licen[sc]e|unlicense|copying)(?:[.-].*)?$"
_WORD = re.compile(r"[a-z0-9]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words[:-1], words[1:], strict=True))


def vocabulary() -> list[str]:
    return sorted({w for ts in TEMPLATES.values() for t in ts for w in _words(t)})


def _family(name: str) -> list[str]:
    return next((f for f in FAMILIES if name in f), [name])


class Scorer:
    """Cosines to the templates under the idf of a corpus.

    Licences of one family have nearly the same texts: there the cosine finds the family, and the words that tell its
    licences apart (MARKS) the licence. A text that names a version or licence which no template has is of none.
    """

    def __init__(self, frequencies: dict[str, int], texts: int):
        self.top = math.log(2 + texts)
        self.idf = {w: math.log((2 + texts) / (1 + frequencies.get(w, 0))) + 1e-3 for w in vocabulary()}
        self.templates = [(name, self.vector(t), _pairs(_words(t))) for name, ts in sorted(TEMPLATES.items()) for t in ts]
        self.marks = {name: re.compile(p) for name, p in MARKS.items()}
        self.names = {name.lower(): name for name in TEMPLATES}

    def vector(self, text: str) -> tuple[dict[str, float], float]:
        weights = {w: n * self.idf.get(w, self.top) for w, n in Counter(_words(text)).items()}
        return weights, math.sqrt(sum(x * x for x in weights.values()))

    def cosines(self, text: str) -> dict[str, float]:
        """Per licence the greatest cosine to one of its texts of which the text holds SHARED of the pairs of words.

        Long legal texts have nearly all the words of any licence, but not its phrases.
        """
        mine, size = self.vector(text)
        near = _pairs(_words(text))
        out: dict[str, float] = {}
        for name, (other, length), pairs in self.templates:
            dot = sum(x * mine[w] for w, x in other.items() if w in mine)
            if dot and len(pairs & near) < SHARED * len(pairs):
                dot = 0.0
            out[name] = max(out.get(name, 0.0), min(1.0, dot / (size * length)) if dot else 0.0)
        return out

    def part(self, text: str) -> tuple[float, str]:
        """Cosine and licence of one part."""
        low = " ".join(text.lower().split())
        spdx = re.search(SPDX, low)
        if spdx:
            name = self.expression(spdx[1])
            return (1.0, name) if name else (0.0, "")
        if OTHER.search(low) or (re.search(r"\bbsd\b", low) and len(low.split()) < STATEMENT and not any(self.marks[n].search(low) for n in _family("BSD-2-Clause"))):
            return 0.0, ""
        cosine = self.cosines(text)
        name = min(cosine, key=lambda n: (-cosine[n], n))
        family = _family(name)
        marked = [n for n in family if n in self.marks and self.marks[n].search(low)]
        if marked:
            return min((-cosine[n], n) for n in marked)[0] * -1, min((-cosine[n], n) for n in marked)[1]
        plain = [n for n in family if n not in self.marks or n == "BSD-2-Clause"]  # that of a family which nothing marks
        if len(family) > 1:
            return (cosine[plain[0]], plain[0]) if plain else (0.0, "")
        return cosine[name], name

    def expression(self, said: str) -> str:
        """Licences of an identifier, in order, with the AND or OR between them; empty if one of them has no template.

        Exceptions (WITH) don't change the licence. Words after the identifier's end are another sentence's.
        """
        words, out = re.findall(r"[a-z0-9.+-]+", said), []
        for i in range(0, len(words), 2):
            name = self.names.get(re.sub(r"(?:-only|-or-later|\+)$", "", words[i].rstrip(".")))
            after = words[i + 1] if i + 1 < len(words) else ""
            if i and words[i - 1] == "with":
                name = None
            elif name is None:
                return ""
            if name is not None:
                out += [name] if not out or name not in out[::2] else []
            if after not in ("and", "or", "with"):
                break
            if after != "with" and out and i + 2 < len(words):
                out = out[:-1] if out[-1] in ("AND", "OR") else out
                out.append(after.upper())
        return " ".join(out[:-1] if out and out[-1] in ("AND", "OR") else out)

    def best(self, text: str) -> tuple[float, str]:
        """The greatest cosine of any part to any template (ties: the licence that sorts first)."""
        if OTHER.search(" ".join(text[:HEADING].lower().split())) and len(text.split()) >= WHOLE:
            return 0.0, ""  # another licence's own text; what it shares with these is a part of it only
        parts, top = dict.fromkeys([*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]), (0.0, "")
        has = re.compile(LICENSE_WORDS)
        found = [self.part(x) for x in parts if has.search(x)]
        for cosine, name in found:
            if name and (cosine > top[0] + 1e-12 or abs(cosine - top[0]) <= 1e-12 and name < top[1]):
                top = cosine, name
        # A clause that is in every licence of a family doesn't overrule the whole text, which holds what tells them apart.
        same = [(c, n) for c, n in found if n and _family(n) == _family(top[1]) and c >= 0.7 and n in self.marks and n != "BSD-2-Clause"]
        return max(same, key=lambda x: (x[0], [-ord(k) for k in x[1]]), default=top) if top[1] == "BSD-2-Clause" else top


def frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """Over all rows: texts that hold each word of the vocabulary, and rows with text."""
    held = F.array_intersect(F.split(F.lower(quoted(text)), "[^a-z0-9]+"), F.array(*map(F.lit, vocabulary())))
    rows = docs.where(quoted(text).isNotNull()).select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()  # a row a word of the vocabulary
    counts = {r["w"]: r["count"] for r in rows}
    return counts, counts.pop("", 0)


def own_licenses(files: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """files without the text, with own (licence or null) and cosine (0 without a licence word)."""
    kept = [c for c in files.columns if c.lower() not in (text.lower(), "own", "cosine")]
    scorer = files.sparkSession.sparkContext.broadcast(Scorer(*frequencies(files, text)))
    fields = files.select(*map(quoted, kept)).schema.fields
    schema = T.StructType([*fields, T.StructField("own", T.StringType()), T.StructField("cosine", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = [scorer.value.best(t) if t else (0.0, "") for t in part.column(text).to_pylist()]
                own, cosine = [n if c >= threshold else None for c, n in found], [c for c, _ in found]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(own, pa.string()), pa.array(cosine, pa.float64())], names=schema.names)

    some = F.when(quoted(text).rlike(LICENSE_WORDS), quoted(text)).alias(text)
    return files.select(*map(quoted, kept), some).mapInArrow(run, schema)


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "")


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """files (path, own, cosine, ...) with license and inherited_from (a directory, null for own licences).

    Directories with several licence files take the licence of the greatest cosine, then the first by name.
    A file without a path inherits nothing.
    """
    d, depth = free_name([*files.columns, "license", "inherited_from"], "__dir"), "depth"
    folders = files.withColumn(d, _folder(quoted(path)))
    name = F.substring_index(quoted(path), "/", -1)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own").alias("l")))["l"].alias("l")
    held = table(folders.where(F.col("own").isNotNull() & name.rlike(LICENSE_FILE)).groupBy(F.col(d).alias("a")).agg(best), "folders")
    parts = F.split(F.col("x"), "/")
    up = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    lost = folders.where(F.col("own").isNull() & F.col(d).isNotNull()).select(F.col(d).alias("x")).distinct()
    above = lost.select("x", F.posexplode(F.when(F.col("x") == "", F.array(F.lit(""))).otherwise(up)).alias(depth, "a")).join(held, "a")
    near = above.groupBy("x").agg(F.max(F.struct(depth, "a", "l")).alias("n")).select("x", "n.a", "n.l")
    out = folders.join(near, F.col("own").isNull() & (F.col(d) == F.col("x")), "left")
    kept = [quoted(c) for c in files.columns if c not in ("license", "inherited_from")]
    return out.select(*kept, F.coalesce("own", "l").alias("license"), F.col("a").alias("inherited_from"))


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """files without the text, with own, cosine, license and inherited_from; one row a row of files.

    A null or empty text has no licence of its own; equal rows give equal rows; columns of the new names are replaced.
    """
    return inherit(table(own_licenses(files, text, threshold), "licenses"), path)


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path and text: documents laid out as files of a tree by source and doc_id, some named LICENSE.

    Documents have no paths; this tree stands in for one, so what they inherit in it exercises the joins and says
    nothing about their licences.
    """
    source, i = F.coalesce("source", F.lit("none")), F.col("doc_id")
    d, e, slot = F.concat(F.lit("/d"), F.floor(i / 4096)), F.concat(F.lit("/e"), F.pmod(F.floor(i / 256), F.lit(16))), F.pmod(i, F.lit(64))
    path = F.when(slot == 0, F.concat(source, d, e, F.lit("/LICENSE"))).when(slot == 1, F.concat(source, d, F.lit("/LICENSE.txt"))).when(slot == 2, F.concat(source, F.lit("/COPYING"))).otherwise(F.concat(source, d, e, F.lit("/f"), i.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def digest(docs: DataFrame) -> DataFrame:
    return scan(document_paths(docs)).select("doc_id", "path", "own", F.round("cosine", 6).alias("cosine"), "license", "inherited_from")
