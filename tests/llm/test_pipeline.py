"""The pipeline's stages over the small tables, each held against its own input."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spindrift.llm.common import materialise
from tests.conftest import SF
from tests.llm.test_operators import check_links, check_removed, check_sequences


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])


def test_language_keeps_prose(stages):
    before, after = rows(stages["documents"]), rows(stages["language"])
    assert len(after) >= 0.95 * len(before)
    assert all(before[i] == t for i, t in after.items())


def test_near_duplicates(spark, stages):
    from spindrift.llm.jaccard_join import link_documents

    before, after = rows(stages["language"]), rows(stages["near_duplicates"])
    got = {r["doc_id"]: r.asDict() for r in link_documents(stages["language"]).collect()}
    check_links(got, before)
    assert set(after) == {i for i, r in got.items() if r["component_id"] == i}


def test_repeats(stages):
    from spindrift.llm.substring_dedup import removed_spans

    got = {r["doc_id"]: r.asDict() for r in removed_spans(stages["near_duplicates"]).collect()}
    check_removed(got, rows(stages["near_duplicates"]))
    after = rows(stages["repeated_passages"])
    for i, t in after.items():
        assert len(t.encode()) <= got[i]["n_bytes"] - got[i]["n_removed"]


def test_no_benchmark_is_left(spark, stages):
    after = rows(stages["benchmark_leaks"])
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(t.lower().find(x) >= 0 for t in after.values() if t for x in items)
    before = rows(stages["repeated_passages"])
    gone = set(before) - set(after)
    assert len(gone) < 0.1 * len(before)


def test_packing(stages):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts, got = rows(stages["benchmark_leaks"]), stages["packing"].collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for i, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for r in (r for r in got if r["doc_id"] == i):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    n = check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096)
    assert n <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"].count()
