"""What the other tests leave open: verdicts of repetition, and damage to a stored file."""

import re

import public_tokenizers
import pytest

from spindrift.llm import repetition, token_store
from tests.llm.data import documents, frame, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest(words):
    """Words of the longest string of words that comes twice, overlapping or not."""
    best = 0
    for i in range(len(words)):
        for j in range(i):
            n = 0
            while i + n < len(words) and words[j + n] == words[i + n]:
                n += 1
            best = max(best, n)
    return best


def test_verdicts(spark):
    rows = [r for r in documents(7, 40) if not r[1] or len(r[1]) < 3000]
    prose = " ".join(f"w{k}" for k in range(200))
    rows += [(5000 + k, " ".join(f"v{j}" for j in range(30 * k)) + (" " + prose) * 2, "en", "s", 1, 1, 1, "a", "b", "c", "d", "e") for k in range(3)]
    got = {r["doc_id"]: r for r in repetition.judge_repetition(frame(spark, rows)).collect()}
    for i, t in texts(rows).items():
        words = WORD.findall(t or "")
        n, least = len(words), repetition.LEAST
        long_ = longest(words)
        covered = set()
        for a in range(n - least + 1):
            for b in range(a):
                if words[a : a + least] == words[b : b + least]:
                    covered |= {*range(a, a + least), *range(b, b + least)}
        r = got[i]
        assert r["longest_repeat"] == (long_ if long_ >= least else 0) or r["longest_repeat"] == long_, i
        assert r["covered_words"] == len(covered), i
        assert r["kept"] == (not r["base_failed"] and 100 * len(covered) <= repetition.COVERED_PERCENT * n and long_ <= repetition.LONGEST), i


@pytest.mark.parametrize("what", ["chunk", "recipe", "root", "missing", "manifest"])
def test_damage_is_seen(spark, what):
    """One byte of a stored chunk, a recipe or a root, or a chunk that is gone: reading does not go through."""
    path = token_store.write_store(frame(spark), token_store.new_store_path(spark), public_tokenizers.path("byte_bpe_50k.json"))
    folder, column = {"chunk": ("raw/kind=chunk", "b"), "missing": ("raw/kind=chunk", None), "recipe": ("recipes", "addresses"), "root": ("recipes", "root"), "manifest": ("manifest", "root")}[what]
    table = spark.read.parquet(f"{path}/{folder}")
    rows = [r.asDict() for r in table.collect()]
    hurt = max(range(len(rows)), key=lambda k: len(rows[k][column or "b"]))
    if column is None:
        del rows[hurt]
    else:
        rows[hurt][column] = bytes([rows[hurt][column][0] ^ 1]) + bytes(rows[hurt][column][1:])
    spark.createDataFrame([tuple(r[c] for c in table.columns) for r in rows], table.schema).write.mode("overwrite").parquet(f"{path}/{folder}")
    with pytest.raises(Exception, match="does not match|missing"):
        token_store.read_digest(spark, path).collect()
    if what in ("chunk", "missing"):
        with pytest.raises(Exception, match="does not match|missing"):
            token_store.read_ids(spark, path).collect()
