"""License scans on notices that are neither templates nor variants, and on rows that are awkward."""

import collections

import pytest

pytest.importorskip("quillon.llm")

from quillon.llm import licenses  # noqa: E402

# families under unknown are in none of the training's lists
NOTICES = {
    "agpl": ["The server part is offered under the GNU Affero General Public License (AGPL) 3", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Source files are under Apache License 2.0, documentation under another", "/* SPDX-License-Identifier: Apache-2.0 */", "you may not use this file except in compliance with the Apache License"],
    "bsd": ["* Redistributions of source code must retain the above copyright notice and this list", "Available under a 3-clause BSD license", "Redistributions in binary form must reproduce the above copyright notice in the documentation"],
    "cc-by": ["Photos by Ann, CC BY 4.0", "Images: Creative Commons Attribution 4.0"],
    "cc-by-nc": ["Drawings by the author, CC BY-NC 4.0, on request", "shared with a Creative Commons Attribution-NonCommercial license"],
    "cc-by-sa": ["Text available under CC BY-SA 4.0.", "Maps are published with a Creative Commons Attribution-ShareAlike license"],
    "cc0": ["The dataset has a CC0 1.0 Universal dedication"],
    "gpl": ["You can redistribute the tool and modify it under the GNU General Public License v3 or newer", "hello is licensed under GPLv2", "# SPDX-License-Identifier: GPL-2.0-only"],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["The library is covered by the GNU Lesser General Public License (LGPL) 2.1", "// SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["This project is MIT licensed.", "Code in this folder is made available by Jane Doe under the MIT licence, see LICENSE.txt", "Files here carry the MIT license unless a header says something else", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF NONINFRINGEMENT"],
    "mpl": ["This file is governed by the Mozilla Public License 2.0"],
    "reserved": ["Copyright 2019 Example Ltd. All rights reserved.", "(c) by Foo and sons, all rights reserved"],
    "unlicense": ["This is free and unencumbered software which was released into the public domain."],
    "unknown": ["Released under the Artistic License 2.0.", "Licensed under the Boost Software License, version 1.0.", "Released under the CDDL license", "Licensed under the terms of the Do What You Want Licence", "This work is licensed under a Design Science License."],
    "none": ["The driver lost his license in the public house", "She reserved all of the rooms for the version of the play", "General terms of war and peace in a free country", "Mit freundlichen Gruessen und Dank", "Software is fun to write and to read", "This.", "erth anse oulind thatou"],
}


def test_confusion_table():
    known = licenses.model()
    table = collections.Counter((family, known.classify(text)) for family, texts in NOTICES.items() for text in texts)
    n = sum(table.values())
    print(sorted(table.items()))
    assert sum(k for (a, b), k in table.items() if a == b) >= 0.9 * n
    assert not any(b not in (a, "unknown", "none") for a, b in table), "no licence is taken for another"
    assert all(table["none", "none"] == len(NOTICES["none"]) for _ in [0])


def test_training_texts():
    known = licenses.model()
    for family, texts in licenses.TEXTS.items():
        assert [known.classify(t) for t in texts] == [family] * len(texts)
    assert {known.classify(t) for t in licenses.ORDINARY} == {"none"}


def test_the_bound_loses_nothing():
    """What the bound settles would be ``none`` by the whole model too."""
    import numpy as np

    known = licenses.model()
    lines = [t for texts in (*NOTICES.values(), *licenses.TEXTS.values(), licenses.ORDINARY) for t in texts]
    with_bound = [known.classify(t) for t in lines]
    start, known.start = known.start, 1e9
    try:
        assert [known.classify(t) for t in lines] == with_bound
        assert np.isfinite(start)
    finally:
        known.start = start


GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""




def test_wrapped_notices(spark):
    texts = [
        GNU, "title of a tool\n" + GNU + "\nand code below\n" * 50, "a\n\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files\n\nb",
        GNU + "\nReleased under the zlib License.", "Released under the MIT License.\nprose of the day", "x\nReleased under the MIT License.\n\ny", "Licensed under the Apache License, Version 2.0.\n\nReleased under the MIT License.", None, "",
    ]
    got = [r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]
    assert [r.families for r in got] == ["gpl", "gpl", "mit", "gpl", "mit", "mit", "apache,mit", "", ""]
    assert [r.n_license for r in got] == [1, 1, 1, 1, 1, 1, 2, 0, 0]
    assert [r.n_unknown for r in got] == [0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert [r.paragraphs for r in got][:3] == ["0:gpl", "1:gpl", "1:mit"] and [r.n_paragraphs for r in got] == [4, 55, 5, 5, 2, 3, 2, 0, 0]


def test_awkward_rows(spark):
    long = "some words of prose " * 40_000 + "\nReleased under the MIT License.\n" + "é" * 100_000
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate([long, "Released under the MIT License.", "Released under the MIT License.", "\n\n\x00\n---"])], "doc_id long, text string, families string, paragraphs string, n_license int")
    got = sorted((r.doc_id, r.n_paragraphs, r.families, r.paragraphs) for r in licenses.scan(df).collect())
    assert got == [(0, 3, "mit", "1:mit"), (1, 1, "mit", "0:mit"), (2, 1, "mit", "0:mit"), (3, 0, "", "")]
