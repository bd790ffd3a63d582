"""Families of licences, their versions, expressions, and the matching of rules against brute force."""

import itertools
import random

import pytest

from spindrift.llm import licences
from tests.llm.test_licences import found

CASES = {
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": [("GPL-2.0", "text", 3)],
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": [("LGPL-2.1", "notice", 2)],
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": [("MPL-2.0", "text", 3)],
    "This is free and unencumbered software released into the public domain.": [("Unlicense", "text", 1)],
    "This project is licensed under the GNU Affero General Public License v3.0.": [("AGPL-3.0", "notice", 1)],
    "Released under the GPL-2.0.\nLicensed under the BSD 3-Clause Licence": [("GPL-2.0", "notice", 1), ("BSD-3-Clause", "notice", 1)],
    "// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR Apache-2.0": [("(GPL-2.0 WITH Classpath-exception-2.0) OR Apache-2.0", "notice", 1)],
    "SPDX-License-Identifier: MIT OR Apache-2.0": [("MIT OR Apache-2.0", "notice", 1)],
    "SPDX-License-Identifier: MIT OR": [], "SPDX-License-Identifier: Private-1.0": [], "SPDX-License-Identifier: GPL-2.0)": [], "SPDX-License-Identifier: MIT WITH Apache-2.0": [],
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": [("Apache-2.0 OR MIT", "notice", 1)],
    "Licensed under the Apache License, Version 2.0\nMIT License\nat your option.": [("Apache-2.0 OR MIT", "notice", 3)],
    "We licensed the GPL song. The licence of the boat is 2.0.": [],
}


@pytest.mark.parametrize("text", CASES)
def test_families(text):
    got = found(text.removeprefix("// "))
    assert got == CASES[text]


def test_every_named_sentence_is_found():
    known = licences.named()
    for sentence in random.Random(1).sample(sorted(known), 500):
        got = found(f"Words before.\n{sentence}\nWords after.")
        assert len(got) == 1 and got[0][1] == "notice", sentence


def brute(found_, rules, gap):
    """Every rule at every start in every way, the longest first, sentences used once."""
    out, used = [], set()
    for k, (_, name, _, _, _) in enumerate(found_):
        if k in used:
            continue
        for licence, kind, wanted in sorted(rules, key=lambda r: -len(r[2])):
            ways = [w for w in itertools.combinations(range(k, len(found_)), len(wanted)) if w[0] == k and not used & set(w) and all(found_[i][1] == n for i, n in zip(w, wanted, strict=True)) and all(found_[b][0] - found_[a][4] <= gap + 1 for a, b in itertools.pairwise(w))]
            if ways:
                out.append((licence, kind, len(wanted)))
                used |= set(min(ways))
                break
    return out


def test_rules_by_brute_force():
    rnd = random.Random(3)
    for _ in range(400):
        rules = [(f"L{k}", "text", tuple(rnd.choice("abc") for _ in range(rnd.randrange(1, 4)))) for k in range(4)]
        at, seq = 0, []
        for _ in range(rnd.randrange(1, 9)):
            at += rnd.randrange(1, 5)
            seq.append((at, rnd.choice("abc"), 0, 0, at))
        got = [m[:3] for m in licences.match_rules(seq, rules, 2)]
        want = brute(seq, rules, 2)
        assert got == want
