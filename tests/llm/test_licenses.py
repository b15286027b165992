import math
import re
from collections import Counter
from pathlib import Path

import pytest

from rippleflow.llm import licenses

FILES = "path string, text string"


def test_cosine_equals_a_plain_one():
    scorer = licenses.Scorer({"license": 5, "the": 90}, 100)
    idf = lambda w: math.log(102 / (1 + {"license": 5, "the": 90}.get(w, 0))) + 1e-3 if w in licenses.vocabulary() else math.log(102)
    vec = lambda t: {w: n * idf(w) for w, n in Counter(re.findall("[a-z0-9]+", t.lower())).items()}
    line = "This file is released under the MIT license, see below"
    a, best = vec(line), 0
    for ts in licenses.TEMPLATES.values():
        for t in ts:
            b = vec(t)
            best = max(best, sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
    got = scorer.best("nothing here\n" + line + "\nmore")
    assert got[1] == "MIT" and got[0] == pytest.approx(best)


WORDED = {
    "BSD-2-Clause": "Copyright (c) 2019, A. Person\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this\n  list of conditions and the following disclaimer.\n* Redistributions in binary form must reproduce the above copyright notice,\n  this list of conditions and the following disclaimer in the documentation\n  and/or other materials provided with the distribution.\n* Neither the name of the Institute nor the names of its contributors may be\n  used to endorse or promote products derived from this software without\n  specific prior written permission.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This file is part of Thing.\n\nThing is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    "MPL-1.1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
}


@pytest.mark.parametrize("name", sorted(WORDED))
def test_licences_of_like_words_are_told_apart(name):
    for scorer in (licenses.Scorer({}, 1000), licenses.Scorer({w: 300 for w in "the of to and in this".split()}, 1000)):
        score, got = scorer.best(f"some words\n\n{WORDED[name]}\n\nother words")
        assert got == name and score >= 0.7


def test_unlisted_licences_and_identifiers():
    scorer = licenses.Scorer({}, 1000)
    assert scorer.best("SPDX-License-Identifier: GPL-2.0-or-later\nint main;") == (1.0, "GPL-2.0")
    assert scorer.best("// SPDX-License-Identifier: EUPL-1.2")[1] == ""
    for text in ("This software is licensed under the Example Source Licence, edition 7, by Example Works.", "Permission to enter the park is granted to visitors with a ticket.", "licensed under the GNU General Public License, version 1."):
        assert scorer.best(text)[0] < 0.7


def test_every_template_is_its_own_best():
    scorer = licenses.Scorer({}, 1000)
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            assert re.search(licenses.LICENSE_WORDS, t) and scorer.best(f"words before\n{t}\nwords after")[1] == name


def test_nearest_ancestor_wins(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("LICENSE", mit), ("a/LICENSE", gpl), ("a/b/c/f.txt", "x"), ("a/b/g.txt", f"x\n{mit}"), ("z/q/f.txt", "y"), ("f.txt", None), ("a/LICENSES.md", "no"), (None, "w"), ("a/b/c/f.txt", "x"), ("k/COPYING.txt", mit), ("k/LICENSE", gpl)]
    got = {(r.path, r.own): (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got["a/b/c/f.txt", None] == ("GPL-3.0", "a") and got["a/b/g.txt", "MIT"] == ("MIT", None)
    assert got["z/q/f.txt", None] == ("MIT", "") and got["f.txt", None] == ("MIT", "") and got[None, None] == (None, None)


def test_odd_rows(spark):
    from helpers import documents, empty, odd_rows

    out = licenses.digest(documents(spark, odd_rows()))
    assert out.count() == len(odd_rows()) and licenses.digest(empty(spark)).count() == 0
    clash = documents(spark, odd_rows()).withColumnRenamed("lang", "own").withColumnRenamed("source", "__dir").withColumnRenamed("doc_id", "path")
    assert licenses.scan(clash.withColumn("path", clash["path"].cast("string"))).count() == len(odd_rows())


WHOLE_TEXTS = {"Apache-2.0": "Apache-2.0", "Artistic": "", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "", "GFDL-1.3": "", "GPL-1": "", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
STATEMENTS = {
    "Artistic License 2.0": "",
    "Released under the Artistic License 2.0.": "",
    "Licensed under the Academic Free License, Version 3.0": "",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "",
    "Licensed under CC BY-ND 4.0.": "",
    "Released under the BSD license.": "",
    "Released under the BSD 3-Clause License.": "BSD-3-Clause",
    "Licensed under the Apache License, Version 1.1": "",
    "This work is licensed under the GNU Lesser General Public License, version 2.": "",
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0",
    "SPDX-License-Identifier: (MIT AND BSD-3-Clause)": "MIT AND BSD-3-Clause",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": "GPL-2.0",
    "SPDX-License-Identifier: MIT OR Zlib": "",
    "SPDX-License-Identifier: MIT\nmore text and words": "MIT",
}


@pytest.mark.parametrize("seen", [0, 10_000])
def test_statements_of_other_licences_and_variants(seen):
    """Whatever the corpus says about words: nothing seen, or words that are in half of the texts."""
    scorer = licenses.Scorer({w: seen // 2 for w in ("the", "of", "license", "software", "to", "and")}, seen)
    for text, want in STATEMENTS.items():
        cosine, name = scorer.best(text)
        assert (name if cosine >= 0.7 else "") == want, text


@pytest.mark.skipif(not Path("/usr/share/common-licenses").is_dir(), reason="no licence texts")
@pytest.mark.parametrize("seen", [0, 10_000])
def test_whole_licence_texts(seen):
    scorer = licenses.Scorer({w: seen // 2 for w in ("the", "of", "license", "software", "to", "and")}, seen)
    for file, want in WHOLE_TEXTS.items():
        path = Path("/usr/share/common-licenses") / file
        if path.exists():
            cosine, name = scorer.best(path.read_text(errors="replace"))
            assert (name if cosine >= 0.7 else "") == want, file
