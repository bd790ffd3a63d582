"""Views that give the driver's tables the shapes of a river network. The same SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "reach": """select o_orderkey as id, case when o_orderkey=0 then cast(-1 as bigint) when o_orderkey%40<>0 then o_orderkey-1 else cast(floor(o_orderkey/40e0) as bigint) end as down, o_totalprice as up, cast(1+o_orderkey%9 as double) as len, cast(1+o_orderkey%7 as int) as stra, -80e0+((o_orderkey*7919)%3000)/1000e0 as x1, -20e0+((o_orderkey*104729)%2500)/1000e0 as y1, -80e0+((o_orderkey*7919)%3000)/1000e0+((o_orderkey*31)%100-50)/1000e0 as x2, -20e0+((o_orderkey*104729)%2500)/1000e0+((o_orderkey*17)%100-50)/1000e0 as y2 from orders""",
    "place": """select c_custkey as id, c_name as name, cast(2000+floor(abs(c_acctbal)*50) as bigint) as pop, c_nationkey as cc, -80e0+(cast(floor(abs(c_acctbal)*100) as bigint)%3000)/1000e0 as lon, -20e0+((cast(floor(abs(c_acctbal)*100) as bigint)*7+c_custkey*104723)%2500)/1000e0 as lat from customer""",
    "path_vertex": """select l_orderkey as path_id, cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) as bigint) as seq, -80e0+(l_partkey%3000)/1000e0 as x, -20e0+((l_suppkey*37+l_partkey)%2500)/1000e0 as y, l_extendedprice as up from lineitem""",
    "line_up": """select l_suppkey as rid, l_extendedprice as up, cast(l_quantity as bigint) as km, l_orderkey as line_id, l_linenumber as k from lineitem""",
    "cell": """select cast(floor(value*100) as bigint)%128 as cx, (event_id*31+user_id)%128 as cy, min(cast(event_id%15 as int)) as q from events group by 1,2""",
    "way": """select p_partkey as id, p_name as name, p_type as kind, (p_partkey*7)%500 as start_node, (p_partkey*7+1+p_partkey%3)%500 as end_node from part""",
    "claim": """select distinct l_suppkey as rid, l_orderkey as id from lineitem""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in `sf_dir`."""
    sql = VIEWS[name]
    table = re.search(r" from (\w+)", sql)[1]
    return spark.sql(sql.replace(f" from {table}", " from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(*names: str, more: str = "", recursive: bool = False) -> str:
    """The WITH clause of an oracle: fixture views, then `more` named queries."""
    parts = [f"{n} as ({VIEWS[n]})" for n in names]
    return f"with {'recursive ' * recursive}" + ", ".join(parts + ([more] if more else [])) + " "
