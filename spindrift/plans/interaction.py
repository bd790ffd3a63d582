"""Batch forms of the interactive operators over the events table; `spindrift.streaming` has their streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import table
from ..streaming import interaction
from .registry import query


@query("select user_id, cast(burst as bigint) as burst, n, last_event from (select user_id, burst, count(*) as n, arg_max(event_id, (ts, event_id)) as last_event from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as burst from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) < 3600000000 then 0 else 1 end as new from events)) group by 1, 2)")
def e1_debounce(spark, d):
    return interaction.debounce(table(spark, d, "events"), 3600).select("user_id", "burst", "n", "last_event")


@query("select user_id, event_type, event_id, cast(floor(value*100e0+0.5) as bigint) as value_c from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) where rn = 1")
def e2_latest_wins(spark, d):
    return interaction.latest_wins(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("value_c"))


_HOUR = 3_600_000.0
_IMPULSES = "ev as (select user_id, epoch_us(ts)/1000e0 as ms, event_id, case when event_id%5 = 0 then -value/100 else value/100 end as impulse, row_number() over (partition by user_id order by ts, event_id) as i from events)"
_LEFT = "(case when abs(v*pow(0.9e0, (e.ms-d.ms)/3600000e0)) < 0.0004e0 then 0e0 else v*pow(0.9e0, (e.ms-d.ms)/3600000e0) end)"


@query(f"with recursive {_IMPULSES}, d as (select user_id, i, ms, greatest(-5e0, least(5e0, impulse)) as v from ev where i = 1 union all select e.user_id, e.i, e.ms, greatest(-5e0, least(5e0, case when sign(e.impulse) <> sign({_LEFT}) then 0e0 else {_LEFT} end + e.impulse)) from d join ev e on e.user_id = d.user_id and e.i = d.i + 1) select user_id, cast(floor(arg_max(v, i)*1e6+0.5) as bigint) as velocity, count(*) as n from d group by 1")
def e3_decay_fold(spark, d):
    impulse = F.when(F.col("event_id") % 5 == 0, -F.col("value") / 100).otherwise(F.col("value") / 100)
    e = table(spark, d, "events").select("user_id", "ts", "event_id", impulse.alias("impulse"))
    return interaction.decay(e, 0.9, _HOUR, 5.0).select("user_id", F.floor(F.col("velocity") * 1e6 + 0.5).cast("long").alias("velocity"), "n")


@query("with c as (select o_orderkey as id, o_orderkey%100*2 as x0, o_orderkey//100%50*2 as y0 from orders), f as (select c_custkey%40*5 as x0, c_custkey//40%20*5 as y0 from customer where c_custkey%3 = 0) select id from c where not exists (select 1 from f where c.x0 >= f.x0 and c.y0 >= f.y0 and c.x0+2 <= f.x0+4 and c.y0+2 <= f.y0+4)")
def e6_resumed_ingest(spark, d):
    """Chunks of two degrees, of which some lie in finished ones of four."""
    box = lambda x, y, n: [x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + n).cast("double").alias("x1"), (y + n).cast("double").alias("y1")]
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    chunks = table(spark, d, "orders").select(k.alias("id"), *box(k % 100 * 2, F.floor(k / 100) % 50 * 2, 2))
    done = table(spark, d, "customer").where(c % 3 == 0).select(*box(c % 40 * 5, F.floor(c / 40) % 20 * 5, 4)).distinct()
    return interaction.resumed_ingest(chunks, done, 4.0).select("id")


@query("select user_id, event_type, count(*) as n from events group by 1, 2")
def k3_finished_chunks(spark, d):
    """Events ingested by chunk of user_id in two sessions, the first broken off: each chunk comes in once."""
    from ..operators.graph import scratch_path
    from ..sources import ingest

    e = table(spark, d, "events")
    path = scratch_path(spark, "ingest")
    chunks = e.select((F.col("user_id") % 10).alias("chunk")).distinct()
    read = lambda todo: e.withColumn("chunk", F.col("user_id") % 10).join(todo, "chunk", "left_semi")
    ingest.ingest(chunks.where("chunk < 4"), read, path, "chunk")
    ingest.ingest(chunks, read, path, "chunk")
    return ingest.rows(spark, path).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("select e.user_id, e.event_type, e.event_id from events e join (select user_id, event_type, min(event_id) as event_id from events group by 1, 2) using (user_id, event_type, event_id)")
def e6_duplicates_removed(spark, d):
    """At-least-once rows, given twice, come out once by key."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return e.unionByName(e).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
