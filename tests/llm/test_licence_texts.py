"""Licences as they are printed, in full, at other widths and on one line."""

import textwrap

import pytest

from tests.llm.test_licences import found

MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


@pytest.mark.parametrize("text,want", [(MIT, ("MIT", "text", 3)), (BSD, ("BSD-2-Clause", "text", 3))])
def test_whole_texts(text, want):
    paragraphs = text.split("\n\n")
    assert found(text) == [want]
    assert found("\n\n".join(" ".join(p.split()) for p in paragraphs)) == [want]
    assert found(" ".join(text.split())[text.startswith("Copyright") and len(paragraphs[0]) :]) == [want]
    for width in range(30, 120):
        assert found("\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in paragraphs)) == [want], width
    assert found("\n".join("# " + line for line in text.split("\n"))) == [want]
