"""Hosts that the method itself blocks, registered domains, and a posterior recomputed by hand."""

import math

import duckdb

from spindrift.llm import sharding, url_reputation

PAGES = (
    [(i, f"http://bad{i % 3}.spam.org/p{i}") for i in range(60)]
    + [(100 + i, f"http://good{i % 4}.fine.org/p{i}") for i in range(80)]
    + [(200 + i, f"https://shop{i % 10}.co.uk/x") for i in range(40)]
    + [(300, "http://new.spam.org/"), (301, "http://new.fine.org/"), (302, None), (303, "nothing"), (304, "http://www.example.com/en/a")]
)
LABELS = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(80)] + [(200 + i, int(i % 10 < 3)) for i in range(40)] + [(0, 0), (9999, 1)]


def verdicts(spark):
    got = url_reputation.judge_urls(spark.createDataFrame(PAGES, "page_id long, url string"), spark.createDataFrame(LABELS, "page_id long, bad int"))
    return {r["page_id"]: r.asDict() for r in got.collect()}


def test_the_method_blocks(spark):
    got = verdicts(spark)
    assert all(got[i]["verdict"] == "block" and got[i]["rule"] is None for i in range(60))
    assert all(got[100 + i]["verdict"] == "allow" for i in range(80))
    # A host without outcomes goes by its domain: the spam domain's bound is high, the fine one's low.
    assert got[301]["verdict"] == "allow" and got[302]["host"] == "" and got[303]["path"] == ""
    # Under co.uk each shop is a domain of its own: bad ones are blocked or not by their own outcomes, good ones stay.
    assert all(got[200 + i]["verdict"] == "allow" for i in range(40) if i % 10 >= 3)


def test_levels(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "co.uk", "x.com.br", "a.example.com", "com", "", "a.co.ukx", "xco.uk")], "host string")
    got = {r["host"]: (r["d"], r["s"]) for r in hosts.select("host", url_reputation.domain_of(hosts["host"]).alias("d"), url_reputation.suffix_of(hosts["host"]).alias("s")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com.br": ("x.com.br", "com.br"), "a.example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "a.co.ukx": ("co.ukx", "ukx"), "xco.uk": ("xco.uk", "uk")}


def test_posterior_of_one_host(spark):
    """All pages of one host: every level has the same counts, so the posterior can be followed by hand."""
    outcomes = spark.createDataFrame([("a.b.c", 10, 9)], "host string, n long, bad long")
    r = url_reputation.reputations(outcomes).first()
    prior = (9 + 1) / (10 + 2)
    for _ in range(3):
        seen, due = (9 - 10 * prior) ** 2, prior * (1 - prior) * 10
        share = min(0.999, max(0.001, (seen - due) / (due * 9)))
        s = 1 / share - 1
        rate = (9 + s * prior) / (10 + s)
        weight, prior = 10 + s, rate
    assert math.isclose(r["rate"], rate, rel_tol=1e-4)
    assert math.isclose(r["low"], rate - 1.645 * math.sqrt(rate * (1 - rate) / (weight + 1)), rel_tol=1e-4)


def test_sql_where_the_method_blocks(spark):
    """The SQL of the query gives the same verdicts on these pages."""
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", PAGES)
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", [(i, 1 - bad, 0) for i, bad in LABELS])
    want = {r[0]: r[1:] for r in con.execute(url_reputation.oracle()).fetchall()}
    assert {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in verdicts(spark).items()} == want


def test_rows_of_one_text(spark, monkeypatch):
    """A third of all rows without text, and another text many times over: every row is placed, loads are near equal."""
    monkeypatch.setattr(sharding, "PART_ROWS", 20)
    monkeypatch.setattr(sharding, "HOT_GROUPS", 10)
    rows = [(i % 50, None) for i in range(300)] + [(i, "same text") for i in range(300)] + [(i, f"text {i} " * 20) for i in range(300)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert len(got) == 900 and sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, 8 + len(t or "")) for i, t in rows)
    assert len(load) == 24 and max(load.values()) < 1.6 * sum(load.values()) / 24
