"""River sections against a version that walks reach by reach; rounds count the places where a river must ask, not hops."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph, sections

LONG = 300


def plain_sections(reach, names, mine, size, owner, stem):
    """rid to its reaches, from the mouth up. reach: id to (down, up); mine: rid to its ids; owner: id to a name."""
    above, held = {}, {}
    for i, (down, _) in reach.items():
        above.setdefault(down, []).append(i)
    for i, name in owner.items():
        held.setdefault(name, []).append(reach[i][1])
    third = {name: sorted(ups)[-3] for name, ups in held.items() if len(ups) > 2}
    strong = {i for i, name in owner.items() if third.get(name, -1.0) >= reach[i][1] / 3}
    found = {}
    for rid, name in names.items():
        own, fit = mine[rid], lambda i: (reach[i][1] <= 1.5 * size[rid], reach[i][1], -i)  # noqa: B023
        foreign = lambda i: i in strong and owner[i] != name  # noqa: B023, E731
        order = lambda i: (reach[i][1], -i)
        at = max(own, key=fit)
        while (down := reach[at][0]) in reach and not foreign(down) and (down in own or reach[down][1] <= 1.6 * reach[at][1]):
            at = down
        way, keep = [at], at in stem and owner.get(at) == name
        while at in above:
            main = max(above[at], key=order)
            best = max((c for c in above[at] if c in own or owner.get(c) == name), key=order, default=None)
            at = best if best is not None and reach[best][1] >= reach[main][1] / 3 else main
            if foreign(at) or keep and at not in stem:
                break
            way.append(at)
        found[rid] = way
    return found


def run(spark, reach, names, mine, size, owner, stem):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = sections.sections(
        frame([(i, d, u) for i, (d, u) in reach.items()], "id long, down long, up double"),
        frame(names.items(), "rid long, name string"),
        frame([(r, i, reach[i][1]) for r, ids in mine.items() for i in ids], "rid long, id long, up double"),
        frame(size.items(), "rid long, size_up double"),
        frame(owner.items(), "id long, owner string"),
        frame([(i,) for i in stem], "id long"),
    )
    found = {}
    for r in out.orderBy("rid", "place").collect():
        found.setdefault(r["rid"], []).append(r["id"])
        assert r["place"] == len(found[r["rid"]]) - 1
    return found


def forest(seed, trees=60, nodes=50):
    """Trees whose reaches are owned in stretches; two rivers may have one name, and claim reaches that others own."""
    rng = random.Random(seed)
    reach, names, mine, size, owner, stem = {}, {}, {}, {}, {}, set()
    for t in range(trees):
        base, few = t * nodes, [f"{t} {k}" for k in range(3)]
        bend = rng.choice([1, 3, nodes])
        for k in range(nodes):
            down = -1 if k == 0 else base + rng.randint(max(0, k - bend), k - 1)
            reach[base + k] = (down, float(rng.randint(1, 12)) if t % 2 else max(1.0, 100.0 - rng.randint(0, 3) - 2 * k))
            name = owner.get(down) if rng.random() < 0.8 else rng.choice([*few, None, None])
            if name is not None:
                owner[base + k] = name
        for k in range(5):
            rid, name = t * 10 + k, few[k % 3]
            ours = [i for i in range(base, base + nodes) if owner.get(i) == name]
            names[rid], size[rid] = name, float(rng.randint(1, 60))
            mine[rid] = set(rng.sample(ours, len(ours) // 2)) | {base + rng.randrange(nodes) for _ in range(rng.randint(1, 6))}
        at = base
        while t % 3 == 0 and at is not None and rng.random() < 0.95:
            stem.add(at)
            at = max((i for i in range(base, base + nodes) if reach[i][0] == at), key=lambda i: (reach[i][1], -i), default=None)
    return reach, names, mine, size, owner, stem


def test_sections_are_those_of_a_walk(spark):
    case = forest(5)
    want = plain_sections(*case)
    assert max(map(len, want.values())) > 20
    assert run(spark, *case) == want


def test_rounds_do_not_count_hops(spark, monkeypatch):
    """One long chain without owners: a river claims its two ends, another a branch in its middle."""
    written, plain = [], sections.cut

    def counted(df, name):
        written.append(name)
        assert len(written) < 40
        return plain(df, name)

    monkeypatch.setattr(sections, "cut", counted)
    reach = {i: (i - 1, 1000.0 - i) for i in range(LONG)} | {1000: (LONG // 2, 600.0), 1001: (1000, 500.0)}
    case = (reach, {1: "long", 2: "side"}, {1: {0, LONG - 1}, 2: {1000, 1001}}, {1: 10.0, 2: 500.0}, {}, set())
    want = plain_sections(*case)
    assert want[1] == list(range(LONG)) and want[2][-1] == 1001 and len(want[2]) == LONG // 2 + 3
    assert run(spark, *case) == want


def test_reaches_without_owner_do_not_meet_quorums(spark):
    """They would be one key of that join, and so one task."""
    reach = spark.createDataFrame([(i, i - 1, 9.0) for i in range(50)], "id long, down long, up double")
    owner = spark.createDataFrame([(i, "a" if i < 4 else None) for i in range(6)] + [(99, "a")], "id long, owner string")
    got = sections._owned(reach, owner)
    assert sorted((r["id"], r["owner"], r["block"]) for r in got.collect()) == [(i, *["a" if i < 4 else None] * 2) for i in range(50)]
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    at = next(i for i, x in enumerate(joins) if "Join LeftOuter, (owner#" in x)
    assert "Join Inner, (id#" in joins[at + 1]


def test_chains_of_a_circle_are_an_error(spark):
    circle = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "id long, down long, up double")
    with pytest.raises(ValueError, match="circle"):
        graph.chain_members(circle.withColumn("len", F.lit(1.0)))
