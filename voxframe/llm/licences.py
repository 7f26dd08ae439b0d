"""License scans: a positional index of rare template words, intersected by relative position."""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import ALNUM, as_bytes, bounded_batches

#: Phrases and the labels they give.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Fixed values: (label, words of a public licence or its notice, phrases that must stand at their place in it).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "obtaining a copy of this software and associated")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("substantial portions of the software",)),
    ("mit", "use of this source code is governed by an mit style license that can be found in the license file", ("mit style license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license version 2 0",)),
    ("apache-2", "the asf licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", ("bsd style license",)),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties", ("source and binary forms", "provided with the distribution this software is provided")),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("source and binary forms", "endorse or promote")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", ("gnu general public license version 2 as",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation", ("gnu library general public license",)),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3 of")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("alter it and redistribute it freely",)),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", ("person or organization",)),
    ("bsl-1", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt", ("boost software license version 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software",)),
    ("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("related or neighboring rights",)),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution", ("eclipse public license v1 0",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0", ("eclipse public license v 2 0",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ("eclipse public license 2 0",)),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", ("common development and distribution license",)),
    ("artistic", "this library is free software you can redistribute it and or modify it under the same terms as perl itself", ("same terms as perl itself",)),
    ("wtfpl", "this program is free software it comes without any warranty you can redistribute it and or modify it under the terms of the do what the fuck you want to public license version 2", ("do what the fuck you want to public license",)),
    ("ofl-1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license version 1 1",)),
    ("eupl-1", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", ("eupl version 1 2",)),
)
#: Names under which a work is licensed; each is looked for after the words that lead to it.
NAMES_OF = (
    ("mit", "mit license"), ("apache-2", "apache license version 2 0"), ("apache-2", "apache license 2 0"), ("apache-2", "apache 2 0 license"), ("bsd-2", "bsd 2 clause license"), ("bsd-2", "simplified bsd license"), ("bsd-3", "bsd 3 clause license"), ("bsd-3", "new bsd license"), ("bsd", "bsd license"),
    ("gpl-2", "gnu general public license version 2"), ("gpl-2", "gnu gpl v2"), ("gpl-2", "gnu general public license v2 0"), ("gpl-3", "gnu general public license version 3"), ("gpl-3", "gnu gpl v3"), ("gpl-3", "gnu general public license v3 0"), ("lgpl", "gnu lesser general public license"), ("lgpl", "gnu library general public license"), ("agpl-3", "gnu affero general public license version 3"), ("agpl-3", "gnu affero general public license v3 0"),
    ("mpl-2", "mozilla public license version 2 0"), ("mpl-2", "mozilla public license 2 0"), ("epl-1", "eclipse public license version 1 0"), ("epl-2", "eclipse public license version 2 0"), ("artistic-2", "artistic license 2 0"), ("artistic-2", "artistic license version 2 0"), ("isc", "isc license"), ("zlib", "zlib license"), ("bsl-1", "boost software license version 1 0"), ("unlicense", "unlicense"),
    ("cddl-1", "common development and distribution license version 1 0"), ("ms-pl", "microsoft public license"), ("ofl-1", "sil open font license version 1 1"), ("eupl-1", "european union public licence version 1 2"), ("postgresql", "postgresql license"), ("gfdl-1", "gnu free documentation license version 1 3"), ("wtfpl", "wtfpl"), ("wtfpl", "do what the fuck you want to public license"),
    ("cc0-1", "cc0 1 0 universal"), ("cc-by", "cc by 4 0"), ("cc-by", "cc by 3 0"), ("cc-by-sa", "cc by sa"), ("cc-by-nd", "cc by nd"), ("cc-by-nc", "cc by nc 4 0"), ("cc-by-nc", "cc by nc 3 0"), ("cc-by-nc-sa", "cc by nc sa"), ("cc-by-nc-nd", "cc by nc nd"),
    ("cc-by", "creative commons attribution 4 0 international license"), ("cc-by", "creative commons attribution 3 0 unported license"), ("cc-by-sa", "creative commons attribution sharealike"), ("cc-by-sa", "creative commons attribution share alike"), ("cc-by-nd", "creative commons attribution noderivatives"), ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"), ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike"), ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives"),
)
LEADS, SHORT_LEADS = ("licensed under the", "under the terms of the", "released under the"), ("licensed under", "released under")
#: Identifiers of the lines that name a file's licence.
SPDX = "mit=MIT mit-0=MIT-0 apache-2=Apache-2.0 bsd-2=BSD-2-Clause bsd-3=BSD-3-Clause gpl-2=GPL-2.0 gpl-3=GPL-3.0 lgpl=LGPL-2.0 lgpl=LGPL-2.1 lgpl=LGPL-3.0 agpl-3=AGPL-3.0 mpl-2=MPL-2.0 epl-1=EPL-1.0 epl-2=EPL-2.0 isc=ISC zlib=Zlib bsl-1=BSL-1.0 unlicense=Unlicense wtfpl=WTFPL artistic-2=Artistic-2.0 cddl-1=CDDL-1.0 eupl-1=EUPL-1.2 ofl-1=OFL-1.1 ms-pl=MS-PL postgresql=PostgreSQL ncsa=NCSA cc0-1=CC0-1.0 cc-by=CC-BY-4.0 cc-by-sa=CC-BY-SA-4.0 cc-by-nd=CC-BY-ND-4.0 cc-by-nc=CC-BY-NC-4.0 cc-by-nc-sa=CC-BY-NC-SA-4.0 cc-by-nc-nd=CC-BY-NC-ND-4.0"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def _templates() -> tuple:
    """Notices; each name after each lead (its whole name is the phrase); identifier lines, word for word."""
    named = [(label, f"{lead} {name}", (name,)) for label, name in NAMES_OF for lead in LEADS + SHORT_LEADS * (name.count(" ") < 2)]
    lines = [(label, line, (line,)) for label, _, code in (x.partition("=") for x in SPDX.split()) for line in (f"spdx license identifier {' '.join(w.decode() for w in words_of(code.encode()))}",)]
    return (*NOTICES, *named, *lines)


TEMPLATES = _templates()
#: The share of a template's words, and of the file's words that stand among them, that must align; words put in or lost
#: may move the rest by one in so many of its words, and by LEAST_DRIFT in any case.
SHARE, DRIFT, LEAST_DRIFT = 0.8, 5, 2
#: A notice that shares this part of its place with a better one is that one's.
SAME_PLACE = 0.5


def licence_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t, _ in templates for w in t.split()})


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each licence word. Counted per partition over all whole texts."""
    vocab = {w.encode() for w in vocabulary}

    def count(batches):
        n, seen = 0, Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                n += 1
                seen.update(vocab.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(["", *[w.decode() for w in seen]]), pa.array([n, *seen.values()], pa.int64())], names=["w", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("_bytes")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n")).collect()
    found = {r[0]: r[1] for r in rows}
    return found.pop("", 0), found


class Index:
    """Postings of template words: their positions by template and word; idf of each word in the corpus."""

    def __init__(self, n_docs: int, frequency: dict[str, int], templates=TEMPLATES, base=BASE):
        self.templates = [(label, [w.encode() for w in t.split()], [b" " + p.encode() + b" " for p in phrases]) for label, t, phrases in templates]
        self.base = [(b" " + p.encode() + b" ", label) for p, label in base]
        # by template, a word's positions from the last
        self.postings: list[dict[bytes, list[int]]] = []
        for _, words, _ in self.templates:
            places = defaultdict(list)
            for p in range(len(words) - 1, -1, -1):
                places[words[p]].append(p)
            self.postings.append(dict(places))
        def at(words: list[bytes], phrase: list[bytes]) -> list[int]:
            return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]

        # by template, key phrases and their places
        self.phrases = [[(v, at(words, v)) for v in (p.split() for p in phrases)] for _, words, phrases in self.templates]
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w.decode(), 0) + 1)) for places in self.postings for w in places}

    def openers(self, share: float) -> dict[bytes, list[int]]:
        """Words to the templates that they open: of each template its rarest, until they fill more places than may miss.

        A template that aligns in ``share`` of its words thus holds one of them at its place, so no other way is needed.
        """
        out: dict[bytes, list[int]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            # one more than the places that may miss
            places = sum(n / len(words) >= share for n in range(1, len(words) + 1))
            for w, n in sorted(Counter(words).items(), key=lambda x: (-self.idf[x[0]], x[0])):
                if places > 0:
                    out[w].append(t)
                places -= n
        return out

    def base_places(self, flat: bytes) -> list[tuple[int, str]]:
        """(word position, label) of all places of base phrases in words joined by single spaces, spaces at both ends."""
        out = []
        for phrase, label in self.base:
            at = flat.find(phrase)
            while at >= 0:
                out.append((flat.count(b" ", 0, at), label))
                at = flat.find(phrase, at + 1)
        return out

    def spans(self, words: list[bytes], flat: bytes, openers: dict[bytes, list[int]], share: float = SHARE) -> list[tuple[int, float, int, int, str]]:
        """(aligned words, score, first, end, label) of the places where a template aligns with the file.

        A template's rare words say where it may begin; around such a beginning, its words that stand in the file in
        its order, none further off than the drift, are counted. The score is their share of the template's words or
        of the file's from the first to the last of them, whichever is less. Each key phrase must stand there, whole,
        within the drift of its place.
        """
        opened = defaultdict(list)
        for w in openers.keys() & set(words):
            for t in openers[w]:
                opened[t].append(w)
        opened = {t: ws for t, ws in opened.items() if all(p in flat for p in self.templates[t][2])}
        out: list[tuple[int, float, int, int, str]] = []
        if not opened:
            return out
        rare = {w for ws in opened.values() for w in ws}
        where: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in rare:
                where[w].append(i)
        for t, ws in sorted(opened.items()):
            label, template, _ = self.templates[t]
            m = len(template)
            drift = max(LEAST_DRIFT, m // DRIFT)
            places = self.postings[t]
            least = next(n for n in range(1, m + 1) if n / m >= share)
            mine = np.concatenate([[0], np.cumsum([w in places for w in words])])
            found: list[tuple[int, float, int, int, str]] = []
            for start in sorted({i - p for w in ws for i in where[w] for p in places[w]}):
                lo, hi = max(0, start - drift), min(len(words), start + m + drift)
                if mine[hi] - mine[lo] < least:
                    continue
                n, first, end = _chain(words[lo:hi], lo - start, places, drift)
                score = n / max(m, end - first)
                if n < least or score < share or not self.phrased(t, words, start, drift):
                    continue
                one = (n, score, start + first, start + end, label)
                if found and one[2] < found[-1][3]:
                    found[-1] = max(found[-1], one)
                else:
                    found.append(one)
            out += found
        return out

    def phrased(self, t: int, words: list[bytes], start: int, drift: int) -> bool:
        """Whether each key phrase of a template that begins at ``start`` stands within the drift of one of its places."""
        for phrase, at in self.phrases[t]:
            k = len(phrase)
            if not any(words[i : i + k] == phrase for p in at for i in range(max(0, start + p - drift), start + p + drift + 1)):
                return False
        return True

    def aligned(self, words: list[bytes], flat: bytes, openers: dict[bytes, list[int]], share: float = SHARE) -> dict[str, float]:
        """Labels of the file's notices with their best scores. Of notices at one place the one with most words holds."""
        out: dict[str, float] = {}
        taken = bytearray(len(words))
        for _, score, first, end, label in sorted(self.spans(words, flat, openers, share), key=lambda x: (-x[0], -x[1], x[4], x[2])):
            if sum(taken[first:end]) < SAME_PLACE * (end - first):
                taken[first:end] = bytes([1]) * (end - first)
                out[label] = max(out.get(label, 0.0), score)
        return out


def _chain(words: list[bytes], first: int, places: dict[bytes, list[int]], drift: int) -> tuple[int, int, int]:
    """The most words that stand in the template's order, each within the drift of its place, and where they begin and end.

    ``first`` is where the words begin, seen from the template's beginning.
    """
    tails: list[int] = []
    ends: list[tuple[int, int]] = []  # (from, to) of the chain that each tail ends
    for i, w in enumerate(words, first):
        for p in places.get(w, ()):  # from the last place, so that one word counts once
            if abs(i - p) <= drift:
                k = bisect.bisect_left(tails, p)
                began = ends[k - 1][0] if k else i
                if k < len(tails) and tails[k] == p and ends[k][0] >= began:
                    continue  # the same words, sooner done or begun later
                tails[k : k + 1] = [p]
                ends[k : k + 1] = [(began, i + 1)]
    return (len(tails), *ends[-1]) if tails else (0, 0, 0)


def scan_licences(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """All rows of docs in ``row`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Whole texts are read, twice: once to count in how many documents each licence word stands (the vocabulary is the
    templates', a fixed bound), once to scan. Base places are consecutive words of a phrase. The score is 1 with a base
    place, else the best score of a notice, else 0. Words put into a notice or lost from it leave its label as long as the
    share stands and its key phrases stand whole at their places. A file may hold any number of notices; where one is part
    of another, or both fit one place, the one with more words holds, and base labels stay in any case. Null text is
    empty; repeated rows are scanned alike; an empty table gives no rows; other columns may have any name. Memory is bound
    by one document.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    index = spark.sparkContext.broadcast(Index(*document_frequency(docs, licence_words())))

    def run(batches):
        ix = index.value
        openers = ix.openers(share)
        for batch in batches:
            out = []
            for text in as_bytes(batch.column("_bytes")):
                words = words_of(text)
                flat = b" ".join([b"", *words, b""])
                base = ix.base_places(flat)
                more = ix.aligned(words, flat, openers, share)
                labels = {label for _, label in base}
                at = [p for p, _ in base]
                out.append((len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more.keys())), 1.0 if base else min(1.0, max(more.values(), default=0.0))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["row", *NAMES])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("binary").alias("_bytes"))
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType()]
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *[T.StructField(n, k) for n, k in zip(NAMES, kinds, strict=True)]]))


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def licence_report(docs: DataFrame) -> DataFrame:
    """The digest of op4: doc_id and what the scan found."""
    return scan_licences(docs.select("doc_id", "text")).select("row.doc_id", *NAMES)
