"""Licences in texts, recognised by the sentences they are made of.

Sentences are normalised and looked up among known licence sentences, each of which has an
identifier. A licence is an ordered rule of identifiers: they have to follow each other in a text,
with only a few other sentences between. Where a sentence names a holder, any name will do.
"""

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 4  # other sentences allowed between those of one rule
RUN = 1000  # characters after which text without a stop counts as one more sentence

# Sentences of licences in the wording of their publishers, and licence names.
SENTENCES = {
    "copyright": (
        "All rights reserved.",
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT.",
    ),
    "mit-liability": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    "zero-bsd-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted.",
    ),
    "isc-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission.",
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "apache-licensed": (
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
    ),
    "apache-comply": (
        "you may not use this file except in compliance with the License.",
    ),
    "apache-copy": (
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at",
    ),
    "apache-warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied.",
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ),
    "gpl-implied": (
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "gpl2-grant": (
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation;",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation;",
    ),
    "gpl2-version": (
        "either version 2 of the License, or (at your option) any later version.",
    ),
    "gpl3-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "mpl-subject": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
    "public-domain": (
        "This work is in the public domain.",
        "This text is in the public domain.",
        "Released into the public domain.",
        "Dedicated to the public domain.",
    ),
}
NAMES = {
    "MIT": ("MIT License", "MIT licence", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License",
                   "Apache-2.0 license", "Apache Software License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License",
                     "Modified BSD License"),
    "ISC": ("ISC License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0",
                "GNU GPL version 2", "GPLv2", "GPL-2.0 license"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0",
                "GNU GPL version 3", "GPLv3", "GPL-3.0 license"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",
                 "GNU Lesser General Public License v2.1", "LGPL-2.1 license"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",
                 "GNU Lesser General Public License v3.0", "LGPL-3.0 license"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",
                 "GNU Affero General Public License v3.0", "AGPL-3.0 license"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0",
                "MPL 2.0 license"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0 license", "CC0 license", "Creative Commons Zero v1.0 Universal license"),
    "CC-BY-4.0": ("CC BY 4.0 license", "CC-BY-4.0 license",
                  "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0 license",
                     "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0 license",
                     "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0 license",
                     "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": (
        "CC BY-NC-SA 4.0 license",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": (
        "CC BY-NC-ND 4.0 license",
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
SUBJECTS = ("", "This work is ", "This text is ", "This document is ", "This file is ",
            "This software is ", "This project is ", "This program is ", "This code is ",
            "This content is ", "This article is ", "This page is ", "It is ", "The text is ",
            "The code is ", "Content is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "available under ",
         "published under ", "made available under ", "provided under ", "shared under ",
         "licensed under the terms of ", "distributed under the terms of ",
         "released under the terms of ")
#: Licence, and the sentences that make it, in order. Earlier rules take sentences first.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("zero-bsd-grant", "isc-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-licensed", "apache-comply", "apache-copy", "apache-warranty")),
    ("Apache-2.0", ("apache-licensed", "apache-comply")),
    ("Apache-2.0", ("apache-licensed",)),
    ("GPL-2.0", ("gpl2-grant", "gpl2-version", "gpl-warranty", "gpl-implied")),
    ("GPL-2.0", ("gpl2-grant", "gpl2-version")),
    ("GPL-3.0", ("gpl3-grant", "gpl-warranty", "gpl-implied")),
    ("GPL-3.0", ("gpl3-grant",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense",)),
    ("public-domain", ("public-domain",)),
    *((name, (f"named:{name}",)) for name in NAMES),
)

MARKS = ("licen", "copyright", "permission", "warrant", "redistribut", "liable",
         "rights reserved", "compliance", "under", "public domain")  # every known sentence has one
STOP = r"(?<=[.!?;])[)\"'”]*\s+|(?<=:)[^\S\n]*\n\s*"
BREAK = re.compile(STOP + r"|\n[^\S\n]*\n\s*")
LINE = re.compile(STOP + r"|\n")
WORD = re.compile(r"[a-z0-9]+")
DROPPED = {"the", "a", "an"}
LETTERS = re.compile(r"[^\W\d_]{2}")  # numbers and letters of list items are no sentences

#: What stands before and after the holder's name, and both around the known one, normalised.
HOLDERS = (
    (r"neither\W+the\W+names?\W+of", r"nor\W+the\W+names?\W+of",
     r"neither names? of .+ nor names? of (?:(?:its|their|any|other) )?contributors",
     "neither name of copyright holder nor names of its contributors"),
    (r"this\W+software\W+is\W+provided\W+by", r"as\W+is\W+and\W+any",
     r"this software is provided by .+ as is and any",
     "this software is provided by copyright holders and contributors as is and any"),
    (r"software\W+is\W+provided\W+as\W+is\W+and", r"disclaims?\W+all\W+warranties",
     r"software is provided as is and .+ disclaims? all warranties",
     "software is provided as is and author disclaims all warranties"),
)
NAMED = [(re.compile(rf"^{full}\b"), known) for _, _, full, known in HOLDERS]
AROUND = re.compile("|".join([rf"(?P<to{i}>\b{after}\b)" for i, (_, after, _, _) in enumerate(HOLDERS)] + [
    rf"(?P<of{i}>\b{before}\b)" for i, (before, _, _, _) in enumerate(HOLDERS)] + [
    r"(?P<empty>\n[^\S\n]*\n)"]), re.IGNORECASE)


def normalised(sentence: str) -> str:
    """Words and numbers in small letters, without articles and spelling variants."""
    words = WORD.findall(sentence.lower().replace("licence", "license"))
    return " ".join(w for w in words if w not in DROPPED)


def with_known_holder(words: str) -> str:
    """A normalised sentence with the holder that the known sentence has."""
    for full, known in NAMED:
        words = full.sub(known, words)
    return words


def _table() -> dict[str, str]:
    """Normalised sentence -> identifier: the listed ones, and references to licences by name."""
    found = {normalised(s): key for key, listed in SENTENCES.items() for s in listed}
    for key, names in NAMES.items():
        for name in names:
            bare = re.sub(r" licen[sc]e$", "", name, flags=re.IGNORECASE)
            for full in {name, bare}:
                for subject in SUBJECTS:
                    for verb in VERBS:
                        found.setdefault(normalised(subject + verb + full), f"named:{key}")
            found.setdefault(normalised("License: " + name), f"named:{key}")
        found[normalised("SPDX-License-Identifier: " + key)] = f"named:{key}"
    return found


class Found(NamedTuple):
    start: int
    end: int
    key: str
    nth: int = 0  # among all sentences of the text, known or not


def _pieces(text: str, breaks: re.Pattern):
    begin = 0
    for cut in breaks.finditer(text):
        yield begin, cut.start()
        begin = cut.end()
    yield begin, len(text)


def _around_names(text: str, pieces: list[tuple[int, int]]):
    """Pieces joined where a stop between them is inside of a holder's name, as after "Inc."."""
    starts, begin, kind = [p[0] for p in pieces], None, None
    for m in AROUND.finditer(text):
        group = m.lastgroup
        if group.startswith("of"):
            begin, kind = m.start(), group[2:]
        elif group == "empty":
            begin = None
        elif begin is not None and group[2:] == kind:
            first, last = (bisect_right(starts, i) - 1 for i in (begin, m.start()))
            if first < last:
                yield pieces[first][0], pieces[last][1]
            begin = None


def _others(text: str, pieces: list[tuple[int, int]], starts: list[int], a: int, b: int) -> int:
    """How many sentences there are from a to b."""
    n = 0
    for i in range(max(bisect_right(starts, a) - 1, 0), bisect_right(starts, b)):
        start, end = max(a, pieces[i][0]), min(b, pieces[i][1])
        if start < end and LETTERS.search(text, start, end):
            n += 1 + (end - start) // RUN
    return n


def sentences(text: str, table: dict[str, str]) -> list[Found]:
    """Known sentences in order, as they stand between sentence ends or empty lines, or, where
    that finds none, on single lines. Each has its number among all sentences of the text."""
    whole, found, kept = list(_pieces(text, BREAK)), [], []
    for pieces in (_around_names(text, whole), whole, _pieces(text, LINE)):
        for start, end in pieces:
            low = text[start:end].lower()
            if any(m in low for m in MARKS):
                words = normalised(low)
                key = table.get(words) or table.get(with_known_holder(words))
                if key:
                    found.append(Found(start, end, key))
    for one in found:  # the wider reading came first; those kept don't overlap and are in order
        place = bisect_left(kept, one)
        if (place == 0 or kept[place - 1].end <= one.start) and (
                place == len(kept) or one.end <= kept[place].start):
            kept.insert(place, one)
    starts, at, nth, numbered = [p[0] for p in whole], 0, 0, []
    for one in kept:
        nth += 1 + _others(text, whole, starts, at, one.start)
        numbered.append(one._replace(nth=nth))
        at = one.end
    return numbered


def licences(found: list[Found]) -> list[Found]:
    """Rules that match: their sentences in order, at most ``GAP`` others between two of them.

    A rule takes one pass: what follows a sentence is looked for among those close to it only.
    """
    used, matched = [False] * len(found), []
    for name, keys in RULES:
        for begin, one in enumerate(found):
            if used[begin] or one.key != keys[0]:
                continue
            taken = [begin]
            for key in keys[1:]:
                at, last = taken[-1] + 1, found[taken[-1]].nth + 1 + GAP
                while at < len(found) and found[at].nth <= last and (used[at] or found[at].key != key):
                    at += 1
                if at == len(found) or found[at].nth > last:
                    break
                taken.append(at)
            if len(taken) == len(keys):
                matched.append(Found(found[begin].start, found[taken[-1]].end, name))
                for i in taken:
                    used[i] = True
    return sorted(matched)


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row for each document: known sentences, their identifiers, licences and their spans.

    ``sentence_ids`` are in text order, ``licenses`` distinct and sorted, both joined by commas;
    ``spans`` has ``licence:start:end`` in characters, ends exclusive, from the first to the last
    sentence of the rule. Sentences of no complete rule count, but make no licence. Null and empty
    texts have none; repeated rows have rows of their own.
    """
    def scan(batches):
        table = _table()
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                low = text.lower()
                known = sentences(text, table) if any(m in low for m in MARKS) else []
                whole = licences(known)
                rows.append((doc, len(known), ",".join(f.key for f in known),
                             ",".join(sorted({w.key for w in whole})),
                             ",".join(f"{w.key}:{w.start}:{w.end}" for w in whole)))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                    ["doc_id", "n_sentences", "sentence_ids", "licenses", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        scan, "doc_id long, n_sentences long, sentence_ids string, licenses string, spans string")
