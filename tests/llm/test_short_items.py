"""Items too short for a walk, and every item against brute force."""

import random

import pytest

from spindrift.llm import decontamination, language_id


def distance_inside(item, text):
    """Least edit distance of item to a part of text, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(docs, items, least=1):
    out = set()
    for d, text in docs:
        for i, item in items:
            if text and item and len(item) >= least and distance_inside(fold(item), fold(text)) <= len(item) // 10:
                out.add((d, i))
    return out


def run(spark, docs, items, **how):
    got = decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **how)
    return got.collect()


DOCS = [(1, "Nothing to see"), (2, "the small cat sat"), (3, "THE SMALL CAT sat on it"), (4, "a smal cat"), (5, None), (6, ""), (7, "x" * 3000 + "q7 zebra" + "y" * 3000), (8, "猫在河边睡觉很久"), (9, "naïve café"), (None, "small cat")]
ITEMS = [(1, "the small cat"), (2, "small cat"), (3, "q"), (4, "zebra"), (5, "河边睡"), (6, "café"), (7, ""), (8, None), (9, "small cats"), (None, "sat"), (2, "small cat")]


@pytest.mark.parametrize("least", [1, 5])
def test_short_items(spark, least):
    got = run(spark, DOCS, ITEMS, least_chars=least)
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(DOCS, ITEMS, least)
    # The two equal rows of the benchmark are both reported.
    assert sum(r["item_id"] == 2 for r in got) == 2 * len({d for d, i in brute(DOCS, [(2, "small cat")], least)})
    for r in got:
        text, item = dict(DOCS)[r["doc_id"]], [t for i, t in ITEMS if i == r["item_id"]][0]
        assert distance_inside(fold(item), fold(text[r["start"] : r["end"]])) == r["distance"]


def test_random_short_items(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    docs = [(i, word(rnd.randrange(0, 60))) for i in range(120)]
    items = [(i, word(rnd.randrange(1, 14))) for i in range(60)]
    items = [(i, t) for i, t in items if len(t.encode()) < 16]
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, docs, items)} == brute(docs, items)


def test_recall_against_all_windows(spark):
    """Random edits at up to the rate: found where brute force over the whole text finds them, nine of ten at least."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, prose(rnd.choice([4, 8, 20, 40]))) for i in range(40)]
    docs, planted = [], set()
    for i, t in items:
        for k, rate in enumerate((0.04, 0.07, 0.09)):
            chars = list(t)
            for p in rnd.sample(range(len(chars)), int(rate * len(chars))):
                chars[p] = rnd.choice("abcdefgh")
            docs.append((10 * i + k, prose(30) + " " + "".join(chars) + " " + prose(30)))
    docs += [(1000 + i, prose(80)) for i in range(40)]
    want = brute(docs, items)
    planted = {(d, d // 10) for d, _ in docs if d < 1000}
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, docs, items)}
    assert planted <= want and got <= want
    assert len(got) >= 0.9 * len(want)


def test_letters_are_letters():
    assert not language_id.has_letter("² ½ ① 12 _ ٣ !") and not language_id.has_letter("")
    assert language_id.has_letter("12 ä") and language_id.has_letter("中") and language_id.has_letter("ʰ")


def test_choice_is_the_least_size(spark):
    """The language is the one whose dictionary packs the blocks into the fewest bytes, by plain calls of the library."""
    import zstandard

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    learn = rows.where(language_id.fold_of(rows["doc_id"]) != 2)
    dictionaries = language_id.train(learn)
    assert dictionaries == language_id.train(learn.repartition(7))
    got = {r["doc_id"]: r for r in language_id.identify(rows, dictionaries).collect()}
    packers = {}
    for lang, data in dictionaries.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, source_size=language_id.BLOCK, dict_size=len(data), min_match=language_id.SHORTEST_MATCH, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        packers[lang] = (d, how)
    for r in rows.collect():
        if r["text"] is None or not language_id.has_letter(r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        raw = r["text"].encode()
        sizes = {lang: sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(raw[i : i + language_id.BLOCK])) for i in range(0, len(raw), language_id.BLOCK)) for lang, (d, how) in packers.items()}
        assert sizes[got[r["doc_id"]]["lang_pred"]] == min(sizes.values())


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(i, "some words here", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    assert len(language_id.train(docs, most_languages=5)) == 5
    with pytest.raises(ValueError):
        language_id.train(docs, most_languages=4)
