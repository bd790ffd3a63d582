"""Documents with every hard case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

ALPHABET = {"en": "the of and to in river water stone mountain with from over under light".split(), "fr": "le la de et les rivière eau pierre montagne avec dans sur lumière".split(), "de": "der die und zu in fluss wasser stein berg mit aus über unter licht".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, n long, a string, body string, block string, marks string, _key string"


def prose(rnd, lang, n):
    words = ALPHABET[lang]
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "s", "en", "ion", "al", "x%d" % rnd.randrange(400)]) for _ in range(n))


def documents(seed=1, n=60):
    rnd = random.Random(seed)
    passage = prose(rnd, "en", 60)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(ALPHABET))
        text = prose(rnd, lang, rnd.randrange(1, 300))
        if i % 7 == 3:
            text += "\n" + passage
        if i % 9 == 4 and rows:
            _, text, lang = rnd.choice(rows)
        elif i % 9 == 5 and rows and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[rnd.randrange(len(words))] = "changed"
            text, lang = " ".join(words), rows[-1][2]
        rows.append([i * 3, text, lang])
    rows += [[1000, None, "en"], [1001, "", "en"], [1002, None, None], [1003, "  \n\t ", "fr"], [1004, "12345 !!!", "de"], [1005, "ab" * 3000, None], [1006, prose(rnd, "de", 6000), "de"], [1007, "émigré über x \x1c y", "fr"], [1008, "One Two  three\nFOUR", "en"], [1009, "one two three four", "en"]]
    return [(i, t, l, "src", None if t is None else len(t), 7, 8, "a", "b", None, "m", "k") for i, t, l in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def texts(rows):
    return {r[0]: r[1] for r in rows}
