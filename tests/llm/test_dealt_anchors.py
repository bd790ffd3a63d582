"""Slices of a dealt anchor: equal windows meet, and neighbouring windows travel together."""

import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import substring_dedup as S


@pytest.mark.parametrize("deal", [12, 40, 600])
def test_dealt_slices_meet_and_stay_together(deal):
    import zstandard

    rnd = np.random.default_rng(5)
    letters = lambda k: rnd.integers(97, 123, k).astype(np.uint8).tobytes()
    common = letters(130)
    texts = [(letters(19) + common + letters(19)).decode() for _ in range(200)]
    asked = [[{"start": 0, "n": 69, "anchor": 7, "deal": deal}]] * len(texts)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("deal", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts), pa.array(asked, kind)], names=[S._DOC, S._ROW, "text", "asked"])
    found, windows, size = {}, 0, 0
    for out in S._cut(1000)(iter([batch])):
        for bucket, body in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            m = int.from_bytes(body[:4], "little")
            raw = zstandard.ZstdDecompressor().decompress(body[4:])
            n = np.frombuffer(raw, np.uint8, m, 24 * m).astype(int)
            text, at = raw[25 * m :], 0
            for k in n.tolist():
                for w in range(k):
                    found.setdefault(text[at + w : at + w + S.LENGTH], set()).add(bucket)
                at += k + S.LENGTH - 1
            windows, size = windows + int(n.sum()), size + len(text)
    assert windows == 69 * len(texts)
    assert all(len(b) == 1 for b in found.values())
    assert set(found) == {t[i : i + S.LENGTH].encode() for t in texts for i in range(69)}
    # One by one, a window takes LENGTH bytes.
    assert size < windows * S.LENGTH / 3
