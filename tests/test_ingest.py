"""Sources that fetch, their retries, and ingest that goes on where it broke off."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import labels, spatial
from spindrift.sources import ingest, service


def test_retries_wait_longer_and_give_up():
    waits, calls = [], []

    def call(k):
        calls.append(k)
        if k < 14:
            raise OSError("busy")
        return "rows"

    assert service.with_retries(call, tries=15, wait=10, most=120, sleep=waits.append) == "rows"
    assert waits == [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 120, 120] and calls == list(range(15))
    with pytest.raises(OSError):
        service.with_retries(call, tries=3, sleep=waits.append)


def test_ingest_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    chunks = spark.range(6).withColumnRenamed("id", "chunk")

    def broken(todo):
        raise RuntimeError("the line is cut")

    assert ingest.ingest(chunks.where("chunk < 2"), lambda todo: todo, path, "chunk") == 2
    with pytest.raises(RuntimeError):
        ingest.ingest(chunks, broken, path, "chunk")
    assert ingest.ingest(chunks, lambda todo: todo.withColumn("n", F.lit(1)).select("chunk"), path, "chunk") == 4
    assert ingest.ingest(chunks, broken, path, "chunk") == 0
    assert sorted(r["chunk"] for r in ingest.rows(spark, path).collect()) == list(range(6))


def test_spellings_of_gap_fill(spark):
    """The primary source's spelling names the run where a like name passes; a bilingual name does not spell."""
    x = [-70.0 + k * 0.02 for k in range(12)]
    primary = spark.createDataFrame([(1, 1, "Rio Itonomas"), (2, 2, "Rio Guapore (Brasil) / Rio Itenez (Bolivia)")], "path_id long, seq long, name string")
    pv = spark.createDataFrame([(1, k + 1, x[k], -5.0) for k in range(4)] + [(2, k + 1, x[k], -8.0) for k in range(4)], "path_id long, seq long, x double, y double")
    secondary = spark.createDataFrame([(11, 1, "Rio Itonamas"), (12, 2, "Itenez")], "path_id long, seq long, name string")
    sv = spark.createDataFrame([(11, k + 1, x[k], -5.0, 10.0) for k in range(12)] + [(12, k + 1, x[k], -8.0, 10.0) for k in range(12)], "path_id long, seq long, x double, y double, up double")
    reach = spark.createDataFrame([(1, 10.0, 0.0, 0.0, 0.1, 0.1)], "id long, up double, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["path_id"], r["name"], r["last"]) for r in labels.gap_fill(primary, pv, secondary, sv, reach).collect())
    assert got == [(11, "Rio Itonomas", 12), (12, "Itenez", 12)]


def test_pairs_grow_with_the_points(spark, monkeypatch):
    """What the bounded joins look at per point stays about the same when points and rivers are three times as many."""
    sizes = {}
    for name in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{name}"
        seen = []

        def count(df, label, keep=spatial.cut, seen=seen):
            out = keep(df, label)
            seen.append(out.count())
            return out

        from spindrift.plans import spatial as plans

        with monkeypatch.context() as m:
            m.setattr(spatial, "cut", count)
            plans.j14_named_river(spark, d).count()
            plans.j15_remoteness(spark, d).count()
        sizes[name] = sum(seen)
    assert sizes["sf0.01"] < 25 * sizes["sf0.001"]
