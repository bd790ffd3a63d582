"""Tables whose doc_ids repeat or are null: no row loses a byte that brute force keeps."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spindrift.llm import decontamination, jaccard_join, language_id, licences, packing, repetition, sharding, substring_dedup, token_store, url_reputation
from spindrift.llm.common import materialise
from tests.llm.test_operators import check_sequences, crc, encoder

RND = random.Random(5)


def prose(n):
    return "".join(RND.choice("abcdefgh ") for _ in range(n))


A, B, LONG = prose(300), prose(40), prose(5000)
C = A[:150] + prose(120)
TABLES = {
    "equal rows": [(1, A), (1, A)],
    "equal ids": [(1, A), (1, "x" * 20), (2, B + C), (3, C + B)],
    "three of a kind": [(4, A), (4, C), (4, A), (4, A), (2, A + B), (9, C)],
    "null ids": [(None, A), (None, A), (None, B), (1, A), (None, None), (None, "")],
    "least id": [(-(2**63), A), (None, A), (0, C)],
    "very long": [(7, LONG), (7, LONG), (8, LONG[100:3000]), (7, prose(10) + LONG)],
    "short": [(1, "ab"), (1, "ab"), (2, "ab")],
}


def removed(rows):
    """(doc_id, bytes that stay) of every row, by looking at every window in the order of documents."""
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        out.append((rows[k][0], rows[k][1], bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("name", TABLES)
def test_removed_spans(spark, name):
    rows = TABLES[name]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_bytes"] - r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    # Rows of one id may stand in any order: the bag of what stays of each text is the same for equal texts.
    want = Counter((i, len((t or "").encode()), len(kept), hashlib.sha256(kept).hexdigest()) for i, t, kept in removed(rows))
    if name in ("three of a kind", "very long"):
        assert sum(n * k[2] for k, n in got.items()) >= len(set(A)) and sum(got.values()) == len(rows)
        check_whole(spark, rows)
    else:
        assert got == want


def check_whole(spark, rows):
    """In the order in which the rows are given, too."""
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter((r["doc_id"], r["n_bytes"] - r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removed_spans(table).collect())
    assert got == Counter((i, len(kept), hashlib.sha256(kept).hexdigest()) for i, _, kept in removed(rows))


@pytest.mark.parametrize("name", TABLES)
def test_in_the_order_given(spark, name):
    check_whole(spark, TABLES[name])


@pytest.mark.parametrize("name", ["equal rows", "null ids", "three of a kind"])
def test_remove_repeats(spark, name):
    """Every window of the input is still somewhere, so no copy was lost together with its original."""
    rows = [(i, t, 1, "d") for i, t in TABLES[name]]
    table = materialise(spark.createDataFrame(rows, "doc_id long, text string, __spindrift_rows int, n string").coalesce(1), "repeated")
    out = substring_dedup.remove_repeats(table)
    assert out.columns == table.columns
    left = out.collect()
    kept = Counter((i, k.decode()) for i, t, k in removed(TABLES[name]) if t is not None and (k.strip() or not t.strip() or len(t) < 100))
    assert Counter((r["doc_id"], r["text"]) for r in left if r["text"] is not None) == kept
    assert sum(r["text"] is None for r in left) == sum(t is None for _, t in TABLES[name])


TEXT = "the river runs over stones and under the bridge to the sea where the light is long"
SAME = [(1, TEXT), (1, TEXT), (1, "another text altogether with words of its own"), (2, TEXT + " now"), (None, TEXT), (None, None), (3, ""), (3, "")]


def table(spark, rows=SAME):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_shards(spark):
    got = sharding.shard_by_bytes(table(spark)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, 8 + len((t or "").encode())) for i, t in SAME)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_store(spark):
    path = token_store.write_store(table(spark), token_store.new_store_path(spark), public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder("byte_bpe_50k.json")
    got = token_store.read_digest(spark, path).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(encode(t)) + 1, crc([*encode(t), 0])) for i, t in SAME)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ones = token_store.read_ids(spark, path, spark.createDataFrame([(1,), (1,)], "doc_id long")).collect()
    assert Counter(tuple(r["ids"]) for r in ones) == Counter((*encode(t), 0) for i, t in SAME if i == 1)


def test_packing(spark):
    got = packing.pack_documents(table(spark), public_tokenizers.path("word_bpe_49k.json")).collect()
    encode = encoder("word_bpe_49k.json")
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == Counter((i, len(encode(t)) + 1, crc([*encode(t), 1])) for i, t in SAME)
    assert check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096) == 1


def test_jaccard(spark):
    """Rows of one doc_id are one node of the links; of equal rows exactly one stays, and no text without its like goes."""
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.link_documents(table(spark).where("doc_id is not null")).collect())
    assert got == Counter({(1, 1): 3, (2, 1): 1, (3, 3): 2})
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one_of_each(table(spark).coalesce(1)).collect())
    assert kept[1, "another text altogether with words of its own"] == 1
    assert sum(n for (_, t), n in kept.items() if t and t.startswith(TEXT)) == 1
    assert kept[3, ""] == 2 and kept[None, None] == 1


def test_maps_over_rows(spark):
    """Operators that look at each row alone give one result a row."""
    t = table(spark)
    ids = Counter(i for i, _ in SAME)
    assert Counter(r["doc_id"] for r in repetition.judge_repetition(t).collect()) == ids
    assert Counter(r["doc_id"] for r in language_id.identify_held_out(t.selectExpr("*", "'en' as lang")).collect()) == ids
    assert len(language_id.train(t.selectExpr("*", "'en' as lang"))["en"]) > 50
    twice = table(spark, [(1, "MIT License"), (1, "MIT License")])
    assert licences.find_licences(twice).count() == 2
    items = spark.createDataFrame([(5, TEXT), (5, TEXT)], "item_id long, text string")
    found = Counter((r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(t, items).collect())
    assert found == Counter({(1, 5): 4, (2, 5): 2, (None, 5): 2})
    assert decontamination.drop_contaminated(t, items).count() == 4


def test_pages_twice(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (1, "http://x.net/es/"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, bad int")
    got = Counter((r["page_id"], r["host"], r["verdict"]) for r in url_reputation.judge_urls(pages, labels).collect())
    assert sum(got.values()) == 4 and got[1, "x.net", "block"] == 1
