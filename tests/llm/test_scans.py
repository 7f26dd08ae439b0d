"""Licence scans and decontamination against brute force, with odd inputs."""

import hashlib
import random
import re

from voxframe.llm import decontaminate, licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


TEXTS = [
    (1, "Released under the MIT License. And again: under\nthe mit-license, UNDER THE MIT LICENSE"),
    (2, "Licensed under the Apache License, Version 2.0; CC BY-NC 4.0"),
    (3, None),
    (4, ""),
    (5, "ünder the mit license élan"),
    (6, "x " * 40000 + NOTICE),
    (6, "x " * 40000 + NOTICE),
    (None, "This work is licensed under the GNU General Public License, version 3."),
    (7, "the license of the software is the license " * 50),
]


def test_licences(spark):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in TEXTS], "doc_id long, text string, labels string, n_words int")
    got = licences.licence_report(docs).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    for i, text in TEXTS:
        w, r = words(text), by[i]
        places = [(k, label) for phrase, label in licences.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert r.n_words == len(w) and r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by[6].labels == "mit" and by[6].n_base == 0 and by[6].score > 0.9
    assert by[None].labels == "gpl-3"
    assert by[7].labels == "" and by[3].score == 0
    assert licences.licence_report(docs.where("false")).collect() == []


#: Notices as they stand in files, with the licence that each names; they share no rule or list with the scanner.
NOTICES = [
    ("mit", NOTICE),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License - see the LICENSE.md file for details"),
    ("mit", "// Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("mit", "# SPDX-License-Identifier: MIT"),
    ("mit-0", "/* SPDX-License-Identifier: MIT-0 */"),
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "* SPDX-License-Identifier: Apache-2.0"),
    ("apache-2", "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd-3", "// SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-3", "Released under the BSD 3-Clause License"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2", "// SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl-2", "This software is licensed under the terms of the GNU General Public License version 2, as published by the Free Software Foundation, and may be copied"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "Licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl-1", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("artistic-2", "This module is released under the Artistic License 2.0."),
    ("artistic", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("wtfpl", "This is released under the WTFPL, do as you like."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Text is available under CC BY 4.0; it is licensed under CC BY 4.0."),
    ("cc-by-sa", "This article is licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-sa", "Photos are licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 licence"),
    ("cc0-1", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("zlib", "SPDX-License-Identifier: Zlib"),
]
#: Texts that name no licence of their own, or talk about some.
PLAIN = [
    "The General Public License, version 3, and how the free software movement came to write it.",
    "any person obtaining documentation may deal without restriction in the associated files " * 40,
    "You can redistribute the work and modify it; the terms of the license agreement are those of the publisher.",
    "A driver's license is granted free of charge, subject to the following conditions, to any person.",
    "version 2 of the license plate reader, version 3 of the license server, public license, general terms",
    "We compared MIT, BSD and Apache projects; licences differ in clauses on patents and in warranty terms.",
    "Permission to use the hall is granted provided that the notice appear in all rooms with or without fee",
]


def test_labels_of_real_notices(spark):
    """Precision and recall over notices alone, changed in places, in pairs, and beside texts that only talk about licences."""
    draw = random.Random(9)
    cases = [({label}, t) for label, t in NOTICES] + [(set(), t) for t in PLAIN]
    for label, t in NOTICES:
        lines = t.split(" ")
        cases.append(({label}, "\n * ".join(" ".join(lines[k : k + 7]) for k in range(0, len(lines), 7)).upper()))
        if len(lines) > 14:
            k = draw.choice((0, 1, len(lines) - 1))
            cases.append(({label}, " ".join([*lines[:k], *lines[k + 1 :]])))
        cases.append(({label}, f"{draw.choice(PLAIN)}\n{t}\n{draw.choice(PLAIN)}"))
    for _ in range(150):
        (a, x), (b, y) = draw.sample(NOTICES, 2)
        cases.append(({a, b}, f"{x}\n\n{draw.choice(PLAIN)}\n{y} and version 3 or version 2"))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licences.licence_report(docs).collect()}
    right = sum(len(got[i] & want) for i, (want, _) in enumerate(cases))
    assert right / sum(len(g) for g in got.values()) >= 0.97, [(w, got[i], t) for i, (w, t) in enumerate(cases) if got[i] - w][:5]
    assert right / sum(len(w) for w, _ in cases) >= 0.97, [(w, got[i], t) for i, (w, t) in enumerate(cases) if w - got[i]][:5]
    assert all(got[i] == want for i, (want, _) in enumerate(cases[: len(NOTICES) + len(PLAIN)]))


def test_one_licence_is_not_taken_for_another(spark):
    """What a notice lacks or has besides decides between licences that share most words, wherever the file names others."""
    texts = [t for label, t in NOTICES if label in ("gpl-2", "gpl-3", "lgpl", "agpl-3")]
    docs = spark.createDataFrame([(i, f"version 3 of, version 2 of, gnu general public license. {t} See also the gnu general public license, version 3 of") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.licence_report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [label for label, _ in NOTICES if label in ("gpl-2", "gpl-3", "lgpl", "agpl-3")]


def test_all_notices_of_a_long_file_are_found(spark):
    gpl, sa = "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-SA 4.0"
    prose = "any person obtaining documentation may deal without restriction in the associated files " * 300
    texts = [f"{NOTICE}. {prose} {sa}. {prose} {gpl}", prose + gpl, prose + sa, prose, "\n".join(t for _, t in NOTICES)]
    # the notices that are commonest in the corpus have the least idf
    texts += [gpl, sa] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licences.licence_report(docs).collect()}
    assert got[0] == {"mit", "cc-by-sa", "gpl-3"} and got[1] == {"gpl-3"} and got[2] == {"cc-by-sa"} and got[3] == set()
    assert got[4] == {label for label, _ in NOTICES}


def test_labels_outlast_a_word_put_in_or_lost(spark):
    """Of every notice, with one word put in or lost anywhere outside its key phrases, the label stays."""
    texts, want = [], []
    for label, t, phrases in licences.NOTICES:
        w = t.split()
        safe = {i for p in phrases for a in range(len(w)) if w[a : a + len(p.split())] == p.split() for i in range(a, a + len(p.split()))}
        for k in range(len(w)):
            if k not in safe:
                texts += [" ".join([*w[:k], *w[k + 1 :]])]
                want.append(label)
            if k - 1 not in safe or k not in safe:
                texts.append(" ".join([*w[:k], "extra", *w[k:]]))
                want.append(label)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licences.licence_report(docs).collect()}
    assert sum(w in got[i] for i, w in enumerate(want)) / len(want) > 0.97, [(w, got[i], texts[i]) for i, w in enumerate(want) if w not in got[i]][:4]


def brute_hits(doc, items):
    w, hit, held = words(doc), set(), set()
    for item, text in items:
        v = words(text)
        n = min(13, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == v[s : s + n]:
                    hit |= set(range(k, k + n))
                    held.add(str(item))
    return len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, monkeypatch):
    long = " ".join(f"tok{i} éa{i % 7}" for i in range(20))
    items = [(1, long), (10, "short item"), (2, "Short, ITEM"), (3, None), (4, "..."), (5, long.upper()), (None, "left out")]
    docs = [(1, f"before {long} after"), (2, "a short item, here. short item item short item"), (3, None), (4, ""), (5, " ".join(long.split()[3:18])), (5, " ".join(long.split()[3:18])), (None, "x " * 30000 + "short item"), (6, "left out short"), (7, long + " " + long)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, row string")
    want = sorted(((i, *brute_hits(t, [x for x in items if x[0] is not None])) for i, t in docs), key=str)
    assert sorted((tuple(r) for r in decontaminate.decontamination_report(d, b).collect()), key=str) == want
    blocks = decontaminate.contamination(d, b, block_bytes=60).select("row.doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((r[0], r[1], r[2], len(r[3])) for r in blocks if r[0]) == sorted(w[:4] for w in want if w[0])
    monkeypatch.setattr(decontaminate, "PART", 5)
    parts = decontaminate.contamination(d, b, block_bytes=40).select("row.doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((r[0], r[1], r[2], len(r[3])) for r in parts if r[0]) == sorted(w[:4] for w in want if w[0])
    kept = decontaminate.remove_contaminated(d, b)
    assert kept.columns == d.columns and sorted((r[0] for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)
    spans = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b).collect()}
    assert words(spans[1]) == ["before", "after"] and spans[3] is None
    assert decontaminate.decontamination_report(d.where("false"), b).collect() == []
    assert [r.n_hit for r in decontaminate.decontamination_report(d, b.where("false")).collect()] == [0] * len(docs)
