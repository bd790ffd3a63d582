"""Licence scan by sentences and ordered rules (operator 4).

Texts are cut into sentences at line ends, full stops and the colon before a list of conditions, sentences are normalised
(case, punctuation and spaces), and each known one has an identifier; of known ones that begin alike the longest counts. A
document's identifiers, in order, are matched against rules: a rule names identifiers that must follow each other with at
most `gap` other sentences between two. Of rules that start at one sentence the longest wins, and its sentences are used up.

Names of licences are known in the sentences that notices put them in, with each way of writing their versions. A line
`SPDX-License-Identifier:` names a licence or an expression of AND, OR and WITH over known identifiers, which comes out as it is
written. `licence` and `license` are one word.

Null or empty text holds nothing. Rows with equal doc_id are scanned one by one. Extra columns are ignored. Nothing leaves its
task; the known sentences and rules are constants of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of notices that name them, by identifier.
SENTENCES = {
    "mit-name": ("Released under the MIT License", "The MIT License (MIT)", "MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "as-is": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT', 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    "apache-name": ("Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")', "SPDX-License-Identifier: Apache-2.0"),
    "apache-compliance": ("you may not use this file except in compliance with the License",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "apache-as-is": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "gpl3-name": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "bsd-redistribution": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "cc-by-nc-name": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "cc-by-name": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "cc-by-sa-name": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "cc0-name": ("CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    "bsd-disclaimer": ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',),
    "gpl-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "lgpl-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "agpl-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "either-2": ("either version 2 of the License, or (at your option) any later version",),
    "either-2.1": ("either version 2.1 of the License, or (at your option) any later version",),
    "either-3": ("either version 3 of the License, or (at your option) any later version",),
    "mpl-subject": ("This Source Code Form is subject to the terms of the Mozilla Public License, v",),
    "two-zero": ("2.0",),
    "mpl-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    "unlicense-public": ("This is free and unencumbered software released into the public domain",),
    "zlib-as-is": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-liable": ("In no event will the authors be held liable for any damages arising from the use of this software",),
    "boost-grant": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',),
    "isc-as-is": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',),
    "apache-or-mit": ("Licensed under either of Apache License, Version 2.0 or MIT license at your option", "Licensed under either the MIT License or the Apache License, Version 2.0", "Dual licensed under the MIT and Apache 2.0 licenses", "Licensed under the Apache License, Version 2.0 or the MIT license, at your option"),
    "at-your-option": ("at your option",),
    "classpath": ("As a special exception, the copyright holders of this library give you permission to link this library with independent modules to produce an executable, regardless of the license terms of these independent modules",),
}
# Names of licences by SPDX identifier; versions are written as `_versions` tells.
TITLES = {
    "GPL-2.0": ("GNU General Public License", "GNU GPL", "GPL"), "GPL-3.0": ("GNU General Public License", "GNU GPL", "GPL"),
    "LGPL-2.1": ("GNU Lesser General Public License", "GNU LGPL", "LGPL"), "LGPL-3.0": ("GNU Lesser General Public License", "GNU LGPL", "LGPL"),
    "AGPL-3.0": ("GNU Affero General Public License", "GNU AGPL", "AGPL"), "MPL-2.0": ("Mozilla Public License", "MPL"), "MPL-1.1": ("Mozilla Public License", "MPL"),
    "EPL-1.0": ("Eclipse Public License",), "EPL-2.0": ("Eclipse Public License",), "EUPL-1.2": ("European Union Public Licence", "EUPL"),
    "Artistic-2.0": ("Artistic License",), "BSL-1.0": ("Boost Software License",), "Apache-2.0": ("Apache License", "Apache Software License"), "CDDL-1.0": ("Common Development and Distribution License",),
    "CC-BY-3.0": ("CC BY", "Creative Commons Attribution"), "CC-BY-SA-3.0": ("CC BY-SA", "Creative Commons Attribution-ShareAlike"), "CC-BY-ND-4.0": ("CC BY-ND", "Creative Commons Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA", "Creative Commons Attribution-NonCommercial-ShareAlike"), "CC-BY-NC-ND-4.0": ("CC BY-NC-ND", "Creative Commons Attribution-NonCommercial-NoDerivatives"),
}
# Names without versions.
PLAIN_TITLES = {
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License"), "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "FreeBSD License"),
    "ISC": ("ISC License",), "Unlicense": ("The Unlicense", "Unlicense"), "Zlib": ("zlib License",), "0BSD": ("BSD Zero Clause License",), "WTFPL": ("Do What The F*ck You Want To Public License",), "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal"),
}
# The sentences of notices around a name, and exceptions of SPDX expressions.
NOTICES = ("{}", "Licensed under {}", "Licensed under the {}", "This project is licensed under the {}", "This work is licensed under the {}", "This work is licensed under {}", "This software is licensed under the {}", "This program is licensed under the {}", "This file is licensed under the {}", "The code is licensed under the {}", "Released under the {}", "This software is released under the {}", "Distributed under the {}", "Distributed under the terms of the {}", "Available under the {}", "Code is available under the {}")
EXCEPTIONS = ("Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "Linux-syscall-note", "OpenSSL-exception")
# Fixed values: (licence, kind, identifiers in order).
RULES = (
    ("MIT", "text", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", "text", ("mit-grant", "mit-notice")),
    ("MIT", "notice", ("mit-name",)),
    ("Apache-2.0", "text", ("apache-name", "apache-compliance", "apache-copy", "apache-as-is")),
    ("Apache-2.0", "text", ("apache-name", "apache-compliance")),
    ("Apache-2.0", "notice", ("apache-name",)),
    ("GPL-3.0", "text", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", "notice", ("gpl3-name",)),
    ("GPL-3.0", "notice", ("gpl-free",)),
    ("BSD-3-Clause", "text", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "text", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("ISC", "text", ("isc-grant",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc-name",)),
    ("CC-BY-4.0", "notice", ("cc-by-name",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-name",)),
    ("CC0-1.0", "notice", ("cc0-name",)),
    ("BSD-3-Clause", "text", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer")),
    ("BSD-2-Clause", "text", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("GPL-2.0", "text", ("gpl-redistribute", "either-2", "gpl-hope")),
    ("GPL-2.0", "notice", ("gpl-redistribute", "either-2")),
    ("GPL-3.0", "text", ("gpl-redistribute", "either-3", "gpl-hope")),
    ("GPL-3.0", "notice", ("gpl-redistribute", "either-3")),
    ("GPL-2.0 WITH Classpath-exception-2.0", "text", ("gpl-redistribute", "either-2", "gpl-hope", "classpath")),
    ("LGPL-2.1", "notice", ("lgpl-redistribute", "either-2.1")),
    ("LGPL-3.0", "notice", ("lgpl-redistribute", "either-3")),
    ("AGPL-3.0", "notice", ("agpl-redistribute", "either-3")),
    ("MPL-2.0", "text", ("mpl-subject", "two-zero", "mpl-copy")),
    ("MPL-2.0", "notice", ("mpl-subject", "two-zero")),
    ("Unlicense", "text", ("unlicense-public",)),
    ("Zlib", "text", ("zlib-as-is", "zlib-liable")),
    ("BSL-1.0", "text", ("boost-grant",)),
    ("ISC", "text", ("isc-grant", "isc-as-is")),
    ("Apache-2.0 OR MIT", "notice", ("apache-or-mit",)),
    ("Apache-2.0 OR MIT", "notice", ("apache-name", "mit-name", "at-your-option")),
)
#: Other sentences that may stand between two of a rule.
GAP = 3
#: Words of the longest known sentence that a hard-wrapped text is joined over.
_CUT = re.compile(r"[\n\r]+|(?<=[^\d\s])\.(?=\s|$)|(?<=\d)\.(?=\s|$)|;|(?<=conditions):|(?<=conditions are met):", re.I)
_DROP = re.compile(r"[^a-z0-9]+")
_SPDX, _TOKEN = "spdx license identifier ", re.compile(r"[A-Za-z0-9.+-]+|[()]")
#: What begins the identifier of a licence that a sentence names.
_NAMES = "name:"

SCHEMA = "doc_id long, licence string, kind string, rule_sentences int, first_sentence int, last_sentence int, start long, end long"


def normalise(sentence: str) -> str:
    return _DROP.sub(" ", sentence.lower().replace("licence", "license")).strip()


def _versions(name: str, number: str) -> Iterator[str]:
    """A versioned name as people write it."""
    for n in {number, number.removesuffix(".0")}:
        for form in ("{} {}", "{} v{}", "{}v{}", "{}, version {}", "{} {} or later", "{}, version {} or later", "{}, version {}, or any later version", "{} v{} or later"):
            yield form.format(name, n)
        if name.startswith("Creative"):
            yield f"{name} {n} International License"
            yield f"{name} {n} Unported License"
            yield f"{name} {n} License"


def named() -> dict[str, str]:
    """Normalised sentences that name a licence, with its identifier."""
    out = {}
    forms = [(spdx, v) for spdx, names in TITLES.items() for name in names for v in _versions(name, spdx.rsplit("-", 1)[1])]
    for spdx, name in [*forms, *((spdx, name) for spdx, names in PLAIN_TITLES.items() for name in names)]:
        for notice in NOTICES:
            if notice != "{}" or "License" in name:
                out[normalise(notice.format(name))] = _NAMES + spdx
    return out


def spdx_expression(text: str) -> str | None:
    """The expression of a line `SPDX-License-Identifier: ...`, if it is one over known identifiers."""
    known = {*TITLES, *PLAIN_TITLES, "MIT", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"}
    tokens = _TOKEN.findall(text.split(":", 1)[-1])
    depth, wants, after_with, out = 0, True, False, []
    for t in tokens:
        if t == "(" and wants and not after_with:
            depth += 1
        elif t == ")" and not wants and depth:
            depth -= 1
        elif wants and t.upper() not in ("AND", "OR", "WITH"):
            base = t.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
            if (t not in EXCEPTIONS) if after_with else (base not in known):
                return None
            t, wants, after_with = t if after_with else base, False, False
        elif not wants and t.upper() in ("AND", "OR", "WITH"):
            t, wants, after_with = t.upper(), True, t.upper() == "WITH"
        else:
            return None
        out.append(t)
    return " ".join(out).replace("( ", "(").replace(" )", ")") if out and not wants and not depth else None


def _known(sentences: dict[str, tuple[str, ...]]) -> tuple[dict[str, str], int, set[str]]:
    known = named() if sentences is SENTENCES else {}
    for name, forms in sentences.items():
        for form in forms:
            # A known sentence may itself hold a cut (a semicolon); its first part stands for it.
            first = next(p for p in _CUT.split(form) if normalise(p))
            known[normalise(first)] = name
    words = [k.split() for k in known]
    return known, max(map(len, words)), {" ".join(w[:n]) for w in words for n in range(1, len(w) + 1)}


def sentences_of(text: str) -> list[tuple[str, int, int]]:
    """(normalised sentence, start, end), empty ones left out."""
    out, at = [], 0
    for m in [*_CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        norm = normalise(text[at:end])
        if norm:
            out.append((norm, at, end))
        at = m.end() if m else end
    return out


def identify(text: str, known: dict[str, str], longest: int, heads: set[str]) -> list[tuple[int, str, int, int, int]]:
    """(number, identifier, start, end, last number) of known sentences; one may be wrapped over several lines."""
    parts, found, i = sentences_of(text), [], 0
    while i < len(parts):
        norm, start, end = parts[i]
        step, name = 1, known.get(norm)
        if name is None and norm.startswith(_SPDX) and (spdx := spdx_expression(text[start:end])) is not None:
            name = _NAMES + spdx
        # What is joined goes on while it begins a known sentence; the longest one counts.
        words, j = norm, i + 1
        while j < len(parts) and words in heads and words.count(" ") < longest:
            words = f"{words} {parts[j][0]}"
            j += 1
            if words in known:
                step, name, end = j - i, known[words], parts[j - 1][2]
        if name is not None:
            found.append((i, name, start, end, i + step - 1))
        i += step
    return found


def _place(found: list, used: set[int], k: int, wanted: tuple[str, ...], gap: int) -> list[int] | None:
    """The first places, from k on, of a rule's identifiers, each near enough to the one before; None if there are none."""
    if len(wanted) == 1:
        return [k]
    j = k + 1
    while j < len(found) and found[j][0] - found[k][4] <= gap + 1:
        if j not in used and found[j][1] == wanted[1] and (rest := _place(found, used, j, wanted[1:], gap)) is not None:
            return [k, *rest]
        j += 1
    return None


def match_rules(found: list[tuple[int, str, int, int, int]], rules=RULES, gap: int = GAP) -> list[tuple[str, str, int, int, int, int, int]]:
    """(licence, kind, sentences, first, last, start, end) of the rules that the identifiers meet, from left to right."""
    ordered = sorted(rules, key=lambda r: -len(r[2]))
    out, used = [], set()
    for k, (number, name, start, _, last) in enumerate(found):
        if k in used:
            continue
        if name.startswith(_NAMES):
            used.add(k)
            out.append((name.removeprefix(_NAMES), "notice", 1, number, last, start, found[k][3]))
            continue
        for licence, kind, wanted in ordered:
            if wanted[0] != name:
                continue
            taken = _place(found, used, k, wanted, gap)
            if taken is not None:
                used.update(taken)
                out.append((licence, kind, len(wanted), number, found[taken[-1]][4], start, found[taken[-1]][3]))
                break
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, longest, heads = _known(SENTENCES)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                rows += [(doc, *m) for m in match_rules(identify(text, known, longest, heads))]
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def find_licences(docs: DataFrame) -> DataFrame:
    """doc_id, licence, kind, rule_sentences, first_sentence, last_sentence, start, end: one row for each match."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, SCHEMA)
