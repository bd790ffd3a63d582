"""Items in scripts without spaces, parted by other spaces, and in the middle of a line."""

import random

import numpy as np

from spindrift.llm import decontamination
from tests.llm.data import frame, prose


def chinese(rnd, n, space=""):
    return space.join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(n))


def row(i, text):
    return (i, text, "zh", "s", 1, 1, 1, "a", "b", "c", "d", "e")


def pairs(spark, rows, bench):
    df, items = frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.find_contamination(df, items).collect()
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(df, items).collect()}
    assert kept == {r[0] for r in rows} - {r["doc_id"] for r in got}
    return {(r["doc_id"], r["item_id"]): r for r in got}


def test_verbatim_in_the_middle_of_a_line(spark):
    rnd = random.Random(3)
    thai = "".join(chr(rnd.randrange(0x0E01, 0x0E2F)) for _ in range(40))
    bench = [(0, chinese(rnd, 60)), (1, chinese(rnd, 8)), (2, thai), (3, chinese(rnd, 30, "\u3000")), (4, prose(rnd, "en", 20).replace(" ", "\u00a0")), (5, "What is the longest river that has no mouth at all?"), (6, "A question of words")]
    rows = [row(k, chinese(rnd, 50) + text + chinese(rnd, 50)) for k, text in bench]
    rows += [row(100 + k, "Spaced words before, then“" + text + "”and after.") for k, text in bench]
    rows += [row(200, chinese(rnd, 400)), row(201, bench[0][1][:25]), row(202, bench[0][1][25:])]
    got = pairs(spark, rows, bench)
    assert set(got) == {(k, k) for k in range(7)} | {(100 + k, k) for k in range(7)}
    text_of = {r[0]: r[1] for r in rows}
    assert all(text_of[i][r["start"] : r["end"]] == bench[k][1] and r["distance"] == 0 for (i, k), r in got.items())


def test_edited_in_the_middle_of_a_line(spark):
    rnd = random.Random(4)
    bench = [(k, chinese(rnd, rnd.randrange(60, 120))) for k in range(30)]
    rows = []
    for k, text in bench:
        text = list(text)
        for at in rnd.sample(range(len(text)), len(text) // 25):
            text[at] = rnd.choice(["", chinese(rnd, 1), text[at] + chinese(rnd, 1)])
        rows.append(row(k, chinese(rnd, 50) + "".join(text) + chinese(rnd, 50)))
    got = pairs(spark, rows, bench)
    assert set(got) <= {(k, k) for k, _ in bench}
    assert len(got) >= 0.95 * len(bench)


def test_long_stretches_of_one_character():
    item = "-" * 200 + " a question after a line, with some words"
    index = decontamination.ItemIndex([(0, item)])
    text = ("x" + "-" * 100_000 + item[200:]).encode()
    got = decontamination.find(index, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert got == [(0, 0, 100_001 - 200, 100_001 + len(item) - 200, 0)]
