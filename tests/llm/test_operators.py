"""Each operator against a brute-force version on small documents with the hard cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spindrift.llm import decontamination, jaccard_join, language_id, packing, repetition, sharding, substring_dedup, token_store, url_reputation
from tests.llm.data import SCHEMA, documents, frame, texts

ROWS = documents()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_removed_spans(spark):
    got = by_id(substring_dedup.removed_spans(frame(spark)))
    check_removed(got, texts(ROWS))
    assert sum(r["n_removed"] for r in got.values()) > 1000


def check_removed(got, rows):
    seen = set()
    assert len(got) == len(rows)
    for i, t in sorted(rows.items()):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((gone & np.r_[True, ~gone[:-1]]).sum()) if len(gone) else 0
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_removed_spans_hot_anchor(spark, monkeypatch):
    """A passage with another neighbour in every document: its anchors are dealt by content."""
    import random

    monkeypatch.setattr(substring_dedup, "HOT_SLICES", 5)
    rnd = random.Random(2)
    mid = "".join(rnd.choice("abcdefg ") for _ in range(130))
    rows = [(i, "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(200))) + mid + "".join(rnd.choice("uvw ") for _ in range(rnd.randrange(200))), "en", "s", 1, 1, 1, "a", "b", "c", "d", "e") for i in range(40)]
    check_removed(by_id(substring_dedup.removed_spans(frame(spark, rows))), texts(rows))


def test_remove_repeats_keeps_columns(spark):
    df = frame(spark)
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns
    rows = by_id(out)
    assert rows[1000]["text"] is None and rows[1001]["text"] == ""
    assert rows[0]["text"] == ROWS[0][1]
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)


def test_shards(spark):
    got = sharding.shard_by_bytes(frame(spark)).collect()
    rows = texts(ROWS)
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    load = Counter()
    for r in got:
        raw = (rows[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
    for s in load:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    where, size = {}, Counter()
    for r in got:
        where.setdefault(rows[r["doc_id"]], set()).add(r["shard"])
        size[rows[r["doc_id"]]] += r["size"]
    assert all(len(s) == 1 for t, s in where.items() if size[t] <= sum(load.values()) // 24)


def test_differencing_is_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 10_000, 3000)
    partials = np.zeros((3000, 24), np.int64)
    partials[:, 0] = sizes
    to = sharding.differencing(partials)
    load = np.bincount(to[:, 0], weights=sizes, minlength=24)
    assert load.max() - load.min() <= 5
    assert all(sorted(row) == list(range(24)) for row in to.tolist())


def test_large_group_is_dealt(spark):
    rows = [(i, "same text" * 50 if i < 150 else f"t{i}" * 20, "en", "s", 1, 1, 1, "a", "b", "c", "d", "e") for i in range(200)]
    got = sharding.shard_by_bytes(frame(spark, rows)).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(got) == 200 and max(load.values()) < 3 * sum(load.values()) / 24


def encoder(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark):
    path = token_store.write_store(frame(spark), token_store.new_store_path(spark), public_tokenizers.path("byte_bpe_50k.json"))
    got = token_store.read_digest(spark, path).orderBy("doc_id").collect()
    encode, at = encoder("byte_bpe_50k.json"), 0
    rows = texts(ROWS)
    assert [r["doc_id"] for r in got] == sorted(rows)
    for r in got:
        ids = [*encode(rows[r["doc_id"]]), 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    ids = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, path, spark.createDataFrame([(0,), (1007,)], "doc_id long")).collect()}
    assert ids == {0: [*encode(rows[0]), 0], 1007: [*encode(rows[1007]), 0]}


def test_token_store_shares_chunks(spark):
    import random

    rnd = random.Random(8)
    common = " ".join("w%d" % rnd.randrange(10**6) for _ in range(3000))
    rows = [(i, f"start {i} {common} end {i}", "en", "s", 1, 1, 1, "a", "b", "c", "d", "e") for i in range(6)]
    path = token_store.write_store(frame(spark, rows), token_store.new_store_path(spark), public_tokenizers.path("byte_bpe_50k.json"))
    stored = spark.read.parquet(f"{path}/raw").where("kind = 'chunk'").groupBy().sum("n").first()[0]
    whole = token_store.read_digest(spark, path).groupBy().sum("n_tokens").first()[0]
    assert stored < whole / 3


def test_token_store_detects_damage():
    ids = np.arange(100, dtype=np.uint32)
    assert token_store.address(ids) != token_store.address(ids[::-1].copy())
    assert token_store.join_planes(token_store.split_planes(ids), 100).tolist() == ids.tolist()
    big = ids + 70_000
    assert token_store.join_planes(token_store.split_planes(big), 100).tolist() == big.tolist()
    a, b = b"hello ", b"world"
    assert token_store.crc32_join([(zlib.crc32(a), len(a)), (zlib.crc32(b), len(b)), (0, 0)]) == zlib.crc32(a + b)


def test_repetition(spark):
    got = by_id(repetition.judge_repetition(frame(spark)))
    for i, t in texts(ROWS).items():
        w = WORD.findall(t or "")
        n = len(w)

        def covered(k, w=w, n=n):
            c = Counter(tuple(w[j : j + k]) for j in range(n - k + 1))
            return {p for j in range(n - k + 1) if c[tuple(w[j : j + k])] > 1 for p in range(j, j + k)}

        seen, lines = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        repeat = len(covered(8))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), lines, repeat), i
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert r["covered_words"] == len(covered(repetition.LEAST))
        assert not (r["kept"] and r["base_failed"])


def test_longest_repeat():
    words = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 99, 1, 2, 3, 4, 5, 6, 7, 8, 9, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7], np.uint64)
    windows, covered, longest = repetition.repeats(words, np.array([len(words), 0]))
    assert longest.tolist() == [9, 0] and covered.tolist() == [28, 0] and windows.tolist()[1] == 0


def test_packing(spark):
    got = packing.pack_documents(frame(spark), public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    encode = encoder("word_bpe_49k.json")
    rows = texts(ROWS)
    for i, t in rows.items():
        ids = [*encode(t), 1]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids
        assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)
        assert all(r["length"] == 4096 for r in own[:-1])
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096)


def check_sequences(rows, capacity):
    sequences = {}
    for s, o, n in rows:
        sequences.setdefault(s, []).append((o, n))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("seed", range(5))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(512, rng.geometric(1 / rng.integers(20, 300), 3000))
    hist = np.bincount(lengths, minlength=513)
    runs, n = packing.plan(hist, 512, 16)
    rows, seen = [], Counter()
    for length, first, times, sequence, offset in runs.tolist():
        assert first == seen[length]
        seen[length] += times
        rows += [(sequence + k, offset, length) for k in range(times)]
    assert seen == Counter(lengths.tolist())
    assert check_sequences(rows, 512) == n
    assert n <= 1.01 * -(-int(lengths.sum()) // 512) + 1


def test_plan_of_nothing():
    assert packing.plan(np.zeros(513, np.int64), 512, 16)[1] == 0


def test_nnls():
    rng = np.random.default_rng(3)
    a = rng.random((20, 8))
    x = np.maximum(0, rng.normal(size=8))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


def shingles(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(w)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def check_links(got, rows):
    sets = {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (len(sets[i]), find(i)) for i in ids} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}


def test_jaccard_join(spark):
    got = by_id(jaccard_join.link_documents(frame(spark)))
    check_links(got, texts(ROWS))
    assert got[1008]["component_id"] == 1008 == got[1009]["component_id"]
    assert got[1000]["component_id"] == 1000 and got[1002]["component_id"] == 1002


def test_jaccard_join_in_chunks(spark, monkeypatch):
    """A chain of near copies in a block that is dealt in chunks."""
    import random

    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", 400)
    rnd = random.Random(9)
    words = ["w%d" % rnd.randrange(500) for _ in range(100)]
    rows = []
    for i in range(50):
        words = list(words)
        words[rnd.randrange(100)] = "n%d" % i
        rows.append((i, " ".join(words), "en", "s", 1, 1, 1, "a", "b", "c", "d", "e"))
    check_links(by_id(jaccard_join.link_documents(frame(spark, rows))), texts(rows))


def test_keep_one_of_each(spark):
    df = frame(spark)
    out = jaccard_join.keep_one_of_each(df)
    assert out.columns == df.columns
    links = by_id(jaccard_join.link_documents(df))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, r in links.items() if r["component_id"] == i)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, extra string")


def edits(rnd, text, n):
    t = list(text)
    for _ in range(n):
        p, kind = rnd.randrange(len(t)), rnd.randrange(3)
        if kind == 0:
            t[p] = "q"
        elif kind == 1:
            t.insert(p, "q")
        else:
            del t[p]
    return "".join(t)


def test_decontamination(spark):
    import random

    from tests.llm.data import prose

    rnd = random.Random(5)
    bench = [(k, prose(rnd, "en", rnd.randrange(15, 60)), "x") for k in range(20)] + [(90, None, "x"), (91, "", "x"), (92, "too short", "x")]
    rows, truth = [], {}
    for i in range(120):
        text = prose(rnd, "fr", rnd.randrange(0, 200))
        if i % 2:
            k = rnd.randrange(20)
            item = bench[k][1]
            text += " " + edits(rnd, item, rnd.choice([0, 1, len(item) // 25])) + " " + prose(rnd, "de", 20)
            truth[i] = k
        rows.append((i, text, "en", "s", 1, 1, 1, "a", "b", "c", "d", "e"))
    rows.append((500, None, "en", "s", 1, 1, 1, "a", "b", "c", "d", "e"))
    df = frame(spark, rows)
    got = decontamination.find_contamination(df, items(spark, bench)).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    found = sum((i, k) in pairs for i, k in truth.items())
    assert found >= 0.95 * len(truth)
    assert {i for i, _ in pairs} <= set(truth)
    text_of = {r[0]: r[1] for r in rows}
    for r in got:
        part = text_of[r["doc_id"]][r["start"] : r["end"]].lower()
        assert distance(part, bench[r["item_id"]][1].lower()) == r["distance"]
    clean = decontamination.drop_contaminated(df, items(spark, bench))
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == set(text_of) - {i for i, _ in pairs}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_infix_distance():
    assert decontamination.infix_distance("kitten", "a sitting cat", 3) is not None
    assert decontamination.infix_distance("abcdef", "xxabcdefyy", 2) == (0, 8)
    assert decontamination.infix_distance("abcdef", "zzzzzz", 2) is None


def test_empty_benchmark(spark):
    assert decontamination.find_contamination(frame(spark), items(spark, [])).count() == 0
    assert decontamination.drop_contaminated(frame(spark), items(spark, [])).count() == len(ROWS)


def test_url_rules(spark):
    urls = {
        1: ("https://a.com/x", "a.com", "/x", "com/", "allow"), 2: ("http://WWW.Example.com/en/1?q", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        3: ("http://m.example.com/en/1#t", "m.example.com", "/en/1", "example.com/en/", "block"), 4: ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        5: ("http://a.com", "a.com", "", None, "allow"), 6: (None, "", "", None, "allow"), 7: ("nonsense", "", "", None, "allow"), 8: ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        9: ("http://b.org?x=://c.net/es/", "b.org", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, v[0], "h", 1) for k, v in urls.items()], "page_id long, url string, host string, verdict int")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge_urls(pages, labels).collect()}
    assert got == {k: v[1:] for k, v in urls.items()}


def test_bad_hosts_are_blocked(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}{i % 4}.site{i % 4}.org/p/{i}", i % 2) for i in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(999, "http://new.other.org/"), (998, "http://bad9.site1.org/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if i < 300], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_reputation.judge_urls(pages, labels).collect()}
    assert all(got[i] == ("block" if b else "allow") for i, _, b in rows)
    assert got[999] == "allow"


def test_reputation_matches_formula(spark):
    out = {r["host"]: r for r in url_reputation.reputations(spark.createDataFrame([("a.x.org", 10, 9), ("b.x.org", 0, 0), ("c.y.org", 50, 1)], "host string, n long, bad long")).collect()}
    assert out["a.x.org"]["rate"] > out["b.x.org"]["rate"] > out["c.y.org"]["rate"]
    assert all(0 < r["low"] + 1 and r["low"] < r["rate"] < 1 for r in out.values())


def test_language(spark):
    df = frame(spark, documents(3, 150))
    got = by_id(language_id.identify_held_out(df))
    rows = {r[0]: r for r in documents(3, 150)}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r["held_out"]} == held
    for i in (1000, 1001, 1002, 1003, 1004):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    long = [i for i in held if rows[i][1] and len(rows[i][1]) > 150 and rows[i][2]]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in long) >= 0.9 * len(long) > 0
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["accepted"]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert substring_dedup.removed_spans(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert sharding.shard_by_bytes(none).count() == 0
    assert token_store.read_digest(spark, token_store.write_store(none, token_store.new_store_path(spark), path)).count() == 0
    assert repetition.judge_repetition(none).count() == 0
    assert packing.pack_documents(none, path).count() == 0
    assert jaccard_join.link_documents(none).count() == 0
    assert decontamination.find_contamination(none, items(spark, [(1, "a sentence of the benchmark that is long enough", "x")])).count() == 0
    assert language_id.identify_held_out(none).count() == 0
    assert language_id.keep_identified(none).count() == 0
    assert url_reputation.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0
