"""Walks that have not ended at their bound are an error, never a shortened result."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph


def reaches(spark, rows):
    return spark.createDataFrame(rows, "id long, down long, up double, len long")


def test_walks_end_or_fail(spark):
    reach = reaches(spark, [(1, None, 4.0, 1), (2, 1, 3.0, 1), (3, 2, 2.0, 1), (4, 3, 1.0, 1)])
    start = spark.createDataFrame([(7, 4)], "rid long, id long")
    assert [tuple(r) for r in graph.walk_down(reach, start, F.lit(False)).collect()] == [(7, 1)]
    with pytest.raises(ValueError, match="not ended"):
        graph.walk_down(reach, start, F.lit(False), most=1)
    circle = reaches(spark, [(1, 2, 1.0, 1), (2, 1, 1.0, 1)])
    with pytest.raises(ValueError, match="circle"):
        graph.walk_down(circle, spark.createDataFrame([(7, 1)], "rid long, id long"), F.lit(False))


def test_paths_to_sea_end_or_fail(spark):
    reach = reaches(spark, [(1, None, 9.0, 1), (2, 1, 5.0, 1), (3, 1, 3.0, 1), (4, 3, 2.0, 1), (5, 3, 0.5, 1), (6, 5, 0.2, 1), (7, 5, 0.1, 1)])
    members = spark.createDataFrame([(1, 1, 0, 0.0), (2, 1, 1, 1.0), (3, 3, 0, 0.0), (4, 3, 1, 1.0), (5, 5, 0, 0.0), (6, 5, 1, 1.0), (7, 7, 0, 0.0)], "id long, chain long, hops long, km double")
    tops = spark.createDataFrame([(7,)], "id long")
    got = graph.paths_to_sea(reach, members, tops).orderBy("hop").collect()
    assert [r["chain"] for r in got] == [7, 5, 3, 1]
    with pytest.raises(ValueError, match="not ended"):
        graph.paths_to_sea(reach, members, tops, most=1)
