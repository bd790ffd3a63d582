"""Licence rules on texts written out, wrapped, interrupted, and absent."""

from spindrift.llm import licences
from tests.llm.data import frame

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""


def found(text):
    known, longest, heads = licences._known(licences.SENTENCES)
    return [m[:3] for m in licences.match_rules(licences.identify(text, known, longest, heads))]


def test_rules():
    assert found(MIT) == [("MIT", "text", 3)]
    assert found(MIT.replace("\n\nTHE", "\nOne. Two. Three.\nTHE")) == [("MIT", "text", 3)]
    assert found(MIT.replace("\n\nTHE", "\nOne. Two. Three. Four. Five.\nTHE")) == [("MIT", "text", 2)]
    assert found("Words. Licensed under the Apache License, Version 2.0. Words.\nRELEASED UNDER THE MIT   LICENSE!") == [("Apache-2.0", "notice", 1), ("MIT", "notice", 1)]
    assert found("Licensed under CC BY-NC 4.0.") == [("CC-BY-NC-4.0", "notice", 1)]
    assert found("We like the MIT License a lot. Not licensed.") == []
    assert found("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.") == []


def test_order_matters():
    parts = MIT.split("\n\n")
    assert found("\n\n".join([parts[1], parts[0]])) == []


def test_every_form_is_known():
    known, longest, heads = licences._known(licences.SENTENCES)
    for name, forms in licences.SENTENCES.items():
        for form in forms:
            assert [f[1] for f in licences.identify(f"Before. {form}. After.", known, longest, heads)] == [name], form


def test_documents(spark):
    rows = [(1, MIT, "en", "s", 1, 1, 1, "a", "b", "c", "d", "e"), (2, None, "en", "s", 1, 1, 1, "a", "b", "c", "d", "e"), (3, "", "en", "s", 1, 1, 1, "a", "b", "c", "d", "e"), (4, "word " * 50_000 + "\nReleased under the MIT License.", "en", "s", 1, 1, 1, "a", "b", "c", "d", "e")]
    got = licences.find_licences(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["licence"], r["kind"]) for r in got} == {(1, "MIT", "text"), (4, "MIT", "notice")}
    text = {r[0]: r[1] for r in rows}
    assert all(text[r["doc_id"]][r["start"] : r["end"]].strip().lower().startswith(("permission", "released")) for r in got)
    assert licences.find_licences(frame(spark, [])).count() == 0
