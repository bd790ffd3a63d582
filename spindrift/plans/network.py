"""Queries over the fixture network: attributes, graph and sequences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, seq
from ..operators import attributes, graph, sequences
from ..sources.fixtures import view, with_views
from .registry import query


def q(expr: str, factor: str = "1000000e0") -> str:
    """Quantised in SQL."""
    return f"cast(floor(({expr})*{factor}+0.5) as bigint)"


def s(c, factor: float = 1e6):
    return geo.scaled(c, factor)


# Aggregations


@query(with_views("reach") + f"select id as reach_id, {q('up', '100e0')} as up_c from reach order by up desc, id limit 1")
def a1_basin_argmax(spark, d):
    best = view(spark, d, "reach").agg(F.max_by(F.struct("id", "up"), F.struct("up", -F.col("id"))).alias("b"))
    return best.select(F.col("b.id").alias("reach_id"), s(F.col("b.up"), 100).alias("up_c"))


@query(with_views("reach") + "select count(*) as n, cast(sum(cast(len as bigint)) as bigint) as total_len, max(stra) as max_order from reach")
def a2_totals(spark, d):
    return view(spark, d, "reach").agg(F.count("*").alias("n"), F.sum(F.col("len").cast("long")).alias("total_len"), F.max("stra").alias("max_order"))


@query(with_views("reach") + "select stra, count(*) as n from reach group by 1")
def a3_order_histogram(spark, d):
    return view(spark, d, "reach").groupBy("stra").agg(F.count("*").alias("n"))


@query(with_views("reach", more="b as (select least(9, (id*id)%73//10) as decile, count(*) as n from reach group by 1)") + "select cast(r.range as bigint) as decile, coalesce(b.n, 0) as n from range(10) r left join b on b.decile = r.range")
def a3_decile_histogram(spark, d):
    level = F.least(F.lit(9), F.floor(F.pmod(F.col("id") * F.col("id"), F.lit(73)) / 10)).cast("long")
    found = view(spark, d, "reach").groupBy(level.alias("id")).agg(F.count("*").alias("n"))
    return spark.range(10).join(found, "id", "left").select(F.col("id").alias("decile"), F.coalesce("n", F.lit(0)).alias("n"))


_MAIN = "main as (select down, id as main_id from (select r.down, r.id, row_number() over (partition by r.down order by r.up desc, r.id) as rn from reach r join reach t on r.down = t.id) where rn = 1)"


@query(with_views("reach", more=_MAIN) + "select down, main_id from main")
def a4_main_pred(spark, d):
    return graph.main_predecessor(view(spark, d, "reach"))


@query(with_views("reach") + "select rid as down, n, ids[1] as first_id, ids[n] as last_id from (select r.down as rid, count(*) as n, list(r.id order by r.id) as ids from reach r join reach t on r.down = t.id group by 1)")
def a5_upstream_lists(spark, d):
    return graph.upstream_of(view(spark, d, "reach")).select("down", "n", F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query(with_views("line_up") + f"select rid, {q('list_sort(list(up))[cast(floor(count(*)/2) as int)+1]', '100e0')} as median_c from line_up group by 1")
def a6_upper_median(spark, d):
    return attributes.upper_median(view(spark, d, "line_up")).select("rid", s("median_up", 100).alias("median_c"))


_A7 = "a7 as (select rid, min(up) as median_up from (select rid, up, sum(km) over (partition by rid order by up, line_id, k rows unbounded preceding) as run, sum(km) over (partition by rid) as total from line_up) where run*2 >= total group by 1)"
_A8 = "a8 as (select m.rid, coalesce(b.best, m.median_up) as size_up from a7 m left join (select l.rid, max(l.up) as best from line_up l where l.km >= 20 and (select sum(case when t.up >= l.up/3 then t.km else 0 end)*100 from line_up t where t.rid = l.rid) >= (select sum(t.km)*15 from line_up t where t.rid = l.rid) group by 1) b on b.rid = m.rid)"


@query(with_views("line_up", more=_A7) + f"select rid, {q('median_up', '100e0')} as median_c from a7")
def a7_weighted_median(spark, d):
    return attributes.weighted_median(view(spark, d, "line_up")).select("rid", s("median_up", 100).alias("median_c"))


@query(with_views("line_up", more=_A7 + ", " + _A8) + f"select rid, {q('size_up', '100e0')} as size_c from a8")
def a8_supported_max(spark, d):
    return attributes.supported_maximum(view(spark, d, "line_up")).select("rid", s("size_up", 100).alias("size_c"))


@query(with_views("line_up", more=_A7 + ", " + _A8) + "select l.rid, count(*) as n_own from line_up l join a8 on a8.rid = l.rid where l.up <= 3*a8.size_up or not exists (select 1 from line_up t where t.rid = l.rid and t.up <= 3*a8.size_up) group by 1")
def f10_own_reaches(spark, d):
    lines = view(spark, d, "line_up")
    return attributes.own_reaches(lines, attributes.supported_maximum(lines)).groupBy("rid").agg(F.count("*").alias("n_own"))


_F10 = "c as (select claim.rid, claim.id, up, up <= 3*(1000e0 + claim.rid%50*1000) as small, id%3 = 0 and id%4 <> claim.rid%4 as other from claim join reach using (id)), k as (select *, case when other then 2 when small then 0 else 1 end as kind from c), m as (select *, min(kind) over (partition by rid) as least from k)"


@query(with_views("reach", "claim", more=_F10) + "select rid, id from m where kind <= least")
def f10_off_the_other_stem(spark, d):
    """A third of the reaches are a stem of four names; each river has one of these."""
    claims = view(spark, d, "claim").join(view(spark, d, "reach").select("id", "up"), "id")
    sizes = claims.select("rid").distinct().withColumn("size_up", 1000.0 + F.col("rid") % 50 * 1000)
    rivers = sizes.select("rid", (F.col("rid") % 4).cast("string").alias("name"))
    stem = view(spark, d, "reach").where("id % 3 = 0").select("id", (F.col("id") % 4).cast("string").alias("name"))
    return attributes.own_reaches(claims, sizes, rivers=rivers, stem=stem).select("rid", "id")


@query(with_views("line_up", more="r as (select rid, up, row_number() over (partition by rid order by up desc) as rn from line_up), a as (select rid, max(up)*(1+rid%4) as at_up from line_up group by rid)") + "select a.rid as name, coalesce(r.up >= a.at_up/3, false) as yes from a left join r on r.rid = a.rid and r.rn = 3")
def a13_takes_over_quorum(spark, d):
    lines = view(spark, d, "line_up").withColumnRenamed("rid", "name")
    asks = lines.groupBy("name").agg((F.max("up") * (1 + F.col("name") % 4)).alias("at_up"))
    return attributes.takes_over(lines, asks).select("name", "yes")


@query(with_views("reach", "claim") + "select c.rid, count(distinct c.id) as n_ids, min(c.id) as least, max(c.id) as most from claim c join reach r on r.id = c.id group by 1")
def a9_distinct_reaches(spark, d):
    return view(spark, d, "claim").join(view(spark, d, "reach").select("id"), "id").groupBy("rid").agg(F.count_distinct("id").alias("n_ids"), F.min("id").alias("least"), F.max("id").alias("most"))


@query(with_views("way") + "select count(distinct name) as n_names from way")
def a10_distinct_names(spark, d):
    return view(spark, d, "way").agg(F.count_distinct("name").alias("n_names"))


@query(with_views("reach") + f"select {q('min(least(x1,x2))')} as x0, {q('max(greatest(x1,x2))')} as x1, {q('min(least(y1,y2))')} as y0, {q('max(greatest(y1,y2))')} as y1 from reach")
def a17_bounds(spark, d):
    r = view(spark, d, "reach")
    return r.agg(s(F.min(F.least("x1", "x2"))).alias("x0"), s(F.max(F.greatest("x1", "x2"))).alias("x1"), s(F.min(F.least("y1", "y2"))).alias("y0"), s(F.max(F.greatest("y1", "y2"))).alias("y1"))


@query(with_views("way") + "select name, id as dominant from (select name, id, row_number() over (partition by name order by end_node-start_node desc, id) as rn from way) where rn = 1")
def a19_dominant_member(spark, d):
    return view(spark, d, "way").groupBy("name").agg(F.max_by("id", F.struct(F.col("end_node") - F.col("start_node"), -F.col("id"))).alias("dominant"))


@query(with_views("way") + "select lower(name) as key, name from (select name, row_number() over (partition by lower(name) order by id) as rn from way) where rn = 1")
def a23_first_spelling(spark, d):
    from ..operators.names import first_spelling

    return first_spelling(view(spark, d, "way").withColumn("seq", F.col("id")), F.lower("name"))


@query(with_views("reach", "claim") + "select rid, id as mouth_reach from (select c.rid, r.id, row_number() over (partition by c.rid order by r.up desc, r.id) as rn from claim c join reach r on r.id = c.id) where rn = 1")
def a24_largest_matched(spark, d):
    return view(spark, d, "claim").join(view(spark, d, "reach"), "id").groupBy("rid").agg(F.max_by("id", F.struct("up", -F.col("id"))).alias("mouth_reach"))


@query(with_views("line_up") + "select id, rid from (select line_id as id, rid, row_number() over (partition by line_id order by km desc, rid) as rn from (select line_id, rid, max(km) as km from line_up group by 1, 2)) where rn = 1")
def a25_longest_section(spark, d):
    sections = view(spark, d, "line_up").groupBy(F.col("line_id").alias("id"), "rid").agg(F.max("km").alias("length_km")).withColumn("seq", F.col("rid"))
    return attributes.longest_section(sections)


@query(with_views("place") + "select count(*) filter (where pop >= 100000) as cities, count(*) filter (where pop < 100000) as towns, count(*) filter (where lon between -79 and -78.5) as inside from place")
def a22_filtered_counts(spark, d):
    return view(spark, d, "place").agg(F.count_if(F.col("pop") >= 100000).alias("cities"), F.count_if(F.col("pop") < 100000).alias("towns"), F.count_if(F.col("lon").between(-79, -78.5)).alias("inside"))


# Pointer joins


@query(with_views("reach") + "select r.id, r.down from reach r join reach t on r.down = t.id")
def j1_downstream_pairs(spark, d):
    r = view(spark, d, "reach")
    return r.join(r.select(F.col("id").alias("down")), "down").select("id", "down")


@query(with_views("reach") + "select id, down from reach r where not exists (select 1 from reach t where t.id = r.down)")
def j2_outlets(spark, d):
    return graph.outlets(view(spark, d, "reach")).select("id", "down")


@query(with_views("reach") + "select id from reach r where not exists (select 1 from reach t where t.down = r.id)")
def j3_headwaters(spark, d):
    return graph.headwaters(view(spark, d, "reach")).select("id")


@query(with_views("reach", "claim") + "select rid, id from claim where id in (select id from reach where up > 250000)")
def j4_semi_join(spark, d):
    return view(spark, d, "claim").join(view(spark, d, "reach").where("up > 250000").select("id"), "id", "left_semi").select("rid", "id")


@query(with_views("reach", "way") + f"select w.id, {q('m.up', '100e0')} as mouth_up, {q('t.up', '100e0')} as top_up from way w join reach m on m.id = w.end_node left join (select * from reach where stra > 3) t on t.id = w.start_node")
def j5_mouth_and_top(spark, d):
    r = view(spark, d, "reach")
    mouth = r.select(F.col("id").alias("end_node"), s("up", 100).alias("mouth_up"))
    top = r.where("stra > 3").select(F.col("id").alias("start_node"), s("up", 100).alias("top_up"))
    return view(spark, d, "way").join(mouth, "end_node").join(top, "start_node", "left").select("id", "mouth_up", "top_up")


@query(with_views("place") + "select p.id, coalesce(n.n_name, 'unknown') as country, coalesce(r.r_name, 'unknown') as continent from place p left join nation n on n.n_nationkey = p.cc and n.n_nationkey <> 7 left join region r on r.r_regionkey = n.n_regionkey")
def j6_dimension_default(spark, d):
    from ..sources.fixtures import table

    n = table(spark, d, "nation").where("n_nationkey <> 7").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return view(spark, d, "place").join(n, F.col("cc") == F.col("n_nationkey"), "left").select("id", F.coalesce("n_name", F.lit("unknown")).alias("country"), F.coalesce("r_name", F.lit("unknown")).alias("continent"))


# Graph

_CHAIN = _MAIN + ", link as (select r.id, m.down as nxt, r.len, r.up from reach r left join main m on m.main_id = r.id), walk as (select id, id as chain, cast(0 as bigint) as hops, len as km from link where nxt is null union all select l.id, w.chain, w.hops + 1, w.km + l.len from walk w join link l on l.nxt = w.id)"


@query(with_views("reach", more=_CHAIN, recursive=True) + "select id, chain, hops from walk")
def g1_chain_members(spark, d):
    return graph.chain_members(view(spark, d, "reach")).select("id", "chain", "hops")


@query(with_views("reach", more=_CHAIN, recursive=True) + f"select w.chain, count(*) as n_reaches, {q('max(r.up)', '100e0')} as max_up_c, cast(sum(cast(r.len as bigint)) as bigint) as sum_len from walk w join reach r on r.id = w.id group by 1")
def g1_chain_summary(spark, d):
    r = view(spark, d, "reach")
    return graph.chain_summary(r, graph.chain_members(r)).select("chain", "n_reaches", s("max_up", 100).alias("max_up_c"), "sum_len")


@query(with_views("reach", more=_CHAIN, recursive=True) + "select id, cast(km as bigint) as km from walk")
def g3_km_to_mouth(spark, d):
    return graph.chain_members(view(spark, d, "reach")).select("id", F.col("km").cast("long").alias("km"))


_EDGE = ", edge as (select w.chain, n.chain as next_chain, n.km as entry_km from walk w join reach r on r.id = w.id left join walk n on n.id = r.down where w.hops = 0)"
_PATH = _EDGE + ", path as (select w.id, cast(0 as bigint) as hop, w.chain, w.km from walk w where not exists (select 1 from reach u where u.down = w.id) union all select p.id, p.hop + 1, e.next_chain, e.entry_km from path p join edge e on e.chain = p.chain where e.next_chain is not null)"


@query(with_views("reach", more=_CHAIN + _PATH, recursive=True) + "select id, hop, chain, cast(km as bigint) as km from path")
def g4_path_to_sea(spark, d):
    r = view(spark, d, "reach")
    return graph.paths_to_sea(r, graph.chain_members(r), graph.headwaters(r)).select("id", "hop", "chain", F.col("km").cast("long").alias("km"))


@query(with_views("reach", more=_CHAIN + _PATH, recursive=True) + "select max(hops) as most, cast(floor(avg(hops)*1000+0.5) as bigint) as mean_milli, count(distinct chain) as chains from (select id, count(*) as hops from path group by 1) h, (select distinct chain from path)")
def a20_path_statistics(spark, d):
    r = view(spark, d, "reach")
    p = graph.cut(graph.paths_to_sea(r, graph.chain_members(r), graph.headwaters(r)), "paths")
    per = p.groupBy("id").agg(F.count("*").alias("hops")).agg(F.max("hops").alias("most"), F.floor(F.avg("hops") * 1000 + 0.5).cast("long").alias("mean_milli"))
    n = p.agg(F.count_distinct("chain").alias("chains"))
    return per.select("*", F.lit(1).alias("k")).join(n.select("*", F.lit(1).alias("k")), "k").drop("k")


@query(with_views("reach", more=_CHAIN, recursive=True) + f"select w.id, w.hops, {q('r.up', '100e0')} as up_c from walk w join reach r on r.id = w.id where w.chain = (select id from reach o where not exists (select 1 from reach t where t.id = o.down) order by up desc, id limit 1) and w.hops < coalesce((select min(x.hops) from walk x join reach y on y.id = x.id where x.chain = w.chain and y.up < 60000), 1000000000)")
def g5_main_stem(spark, d):
    r = view(spark, d, "reach")
    return graph.main_stem(r, graph.chain_members(r), 60000.0).select("id", "hops", s("up", 100).alias("up_c"))


@query(with_views("reach", "claim", more="f as (select c.id, c.rid, abs(cast(floor(r.up) as bigint) - c.rid*2000) as fit from claim c join reach r on r.id = c.id)") + "select id, rid as owner from (select id, rid, row_number() over (partition by id order by case when id % 97 = 0 and rid % 2 = 0 then -1 else fit end, rid) as rn from f) where rn = 1")
def g7_owner_by_fit(spark, d):
    c = view(spark, d, "claim").join(view(spark, d, "reach").select("id", "up"), "id")
    fit = F.abs(F.floor("up").cast("long") - F.col("rid") * 2000)
    claims = c.select("id", F.col("rid").alias("name"), F.when((F.col("id") % 97 == 0) & (F.col("rid") % 2 == 0), -1).otherwise(fit).alias("fit"), F.col("rid").alias("seq"))
    return graph.owner_by_fit(claims)


_GROUPS = "groups as (select chain % 37 as name, chain as rid, chain as mouth, count(*) as n_reaches, chain as seq from walk group by chain)"
_FOLD = _CHAIN + ", " + _GROUPS + ", dom as (select name, rid as into_, mouth from (select *, row_number() over (partition by name order by n_reaches desc, seq) as rn, count(*) over (partition by name) as n from groups) where rn = 1 and n > 1), dc as (select d.name, d.into_, w.chain as dchain from dom d join walk w on w.id = d.mouth), fold as (select g.rid, c.into_, c.dchain, r.down as at_, 1 as hop from groups g join dc c on c.name = g.name join reach r on r.id = g.mouth where g.rid <> c.into_ union all select f.rid, f.into_, f.dchain, r.down, f.hop + 1 from fold f join walk w on w.id = f.at_ join reach r on r.id = f.at_ where w.chain <> f.dchain and f.hop < 40)"


@query(with_views("reach", more=_FOLD, recursive=True) + "select distinct f.rid, f.into_ as into_rid from fold f join walk w on w.id = f.at_ where w.chain = f.dchain")
def g8_fold_side_channels(spark, d):
    r = view(spark, d, "reach")
    m = graph.chain_members(r)
    chains = m.groupBy("chain").agg(F.count("*").alias("n_reaches"))
    groups = chains.select((F.col("chain") % 37).alias("name"), F.col("chain").alias("rid"), F.col("chain").alias("mouth"), "n_reaches", F.col("chain").alias("seq"))
    return graph.fold_side_channels(r, groups, m).select("rid", F.col("into").alias("into_rid"))


@query(with_views("reach", more=_CHAIN, recursive=True) + "select id, chain, row_number() over (partition by chain order by hops desc) - 1 as from_head from walk")
def g9_chain_from_head(spark, d):
    return graph.position_in_chain(graph.chain_members(view(spark, d, "reach"))).select("id", "chain", F.col("from_head").cast("long").alias("from_head"))


_DOWN = "down as (select id as rid, id as cur, 0 as hop from reach h where not exists (select 1 from reach u where u.down = h.id) union all select w.rid, n.id, w.hop + 1 from down w join reach c on c.id = w.cur join reach n on n.id = c.down where not (n.up > 1.6*c.up and n.stra < 4))"


@query(with_views("reach", more=_DOWN, recursive=True) + "select rid, cur as last from (select rid, cur, row_number() over (partition by rid order by hop desc) as rn from down) where rn = 1")
def g6_walk_down(spark, d):
    r = view(spark, d, "reach")
    starts = graph.headwaters(r).select(F.col("id").alias("rid"), "id")
    return graph.walk_down(r, starts, (F.col("nxt_up") > 1.6 * F.col("cur_up")) & ((1 + F.col("nxt") % 7) < 4))


# Sequences

_SEG = "seg as (select path_id, seq, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from path_vertex window w as (partition by path_id order by seq)), segs as (select * from seg where x2 is not null)"


def _km(at: str, x1="x1", y1="y1", x2="x2", y2="y2") -> str:
    lat = {"start": y1, "end": y2, "mean": f"({y1}+{y2})/2"}[at]
    return f"sqrt(pow(({x2}-{x1})*cos(radians({lat})),2)+pow({y2}-{y1},2))*111.32e0"


@query(with_views("path_vertex", more=_SEG) + f"select path_id, seq, {q('x2-x1')} as dx, {q('y2-y1')} as dy from segs")
def w1_segments(spark, d):
    return sequences.segments(view(spark, d, "path_vertex")).select("path_id", "seq", s(F.col("x2") - F.col("x1")).alias("dx"), s(F.col("y2") - F.col("y1")).alias("dy"))


_RUN = "keyed as (select path_id, seq, cast(floor(up/30000) as bigint) as k from path_vertex), flag as (select *, case when lag(k) over (partition by path_id order by seq) = k then 0 else 1 end as nw from keyed), run as (select *, sum(nw) over (partition by path_id order by seq rows unbounded preceding) as run from flag)"


@query(with_views("path_vertex", more=_RUN) + "select path_id, cast(run as bigint) as run, k, min(seq) as first, max(seq) as last, count(*) as n from run group by path_id, run, k")
def w2_runs(spark, d):
    v = view(spark, d, "path_vertex").select("path_id", "seq", F.floor(F.col("up") / 30000).cast("long").alias("k"))
    return sequences.runs(v, "path_id", "seq", "k")


@query(with_views("path_vertex", more="f as (select path_id, seq, up > 30000 as ok from path_vertex), g as (select path_id, seq, seq - row_number() over (partition by path_id order by seq) as grp from f where ok)") + "select path_id, min(seq) as first, max(seq) as last, count(*) as n from g group by path_id, grp having count(*) >= 2")
def w3_islands(spark, d):
    return sequences.islands(view(spark, d, "path_vertex"), "path_id", "seq", F.col("up") > 30000).select("path_id", "first", "last", "n")


@query(with_views("path_vertex", more=_RUN + ", r as (select path_id, run, k, min(seq) as first, max(seq) as last from run group by 1, 2, 3), e as (select path_id, max(seq) as e from path_vertex group by 1)") + "select r.path_id, k, first, least(last + 1, e.e) as last_shared from r join e on e.path_id = r.path_id where least(last + 1, e.e) > first")
def w4_overlapping_runs(spark, d):
    v = view(spark, d, "path_vertex").select("path_id", "seq", F.floor(F.col("up") / 30000).cast("long").alias("k"))
    return sequences.overlapping_runs(v, "path_id", "seq", "k").select("path_id", "k", "first", F.col("end").alias("last_shared"))


_U = "u as (select path_id, seq, cast(floor(x*100000e0+0.5) as bigint) as ux, cast(floor(y*100000e0+0.5) as bigint) as uy from path_vertex)"


@query(with_views("path_vertex", more=_U) + "select path_id, seq, ux - coalesce(lag(ux) over w, 0) as dx, uy - coalesce(lag(uy) over w, 0) as dy from u window w as (partition by path_id order by seq)")
def w7_delta_encode(spark, d):
    lines = sequences.polylines(view(spark, d, "path_vertex")).select("path_id", seq.delta_encode("c").alias("flat"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("flat") / 2).cast("int")), lambda i: F.struct(F.element_at("flat", 2 * i - 1).alias("dx"), F.element_at("flat", 2 * i).alias("dy")))
    return lines.select("path_id", F.posexplode(pairs).alias("p", "v")).select("path_id", (F.col("p") + 1).cast("long").alias("seq"), "v.dx", "v.dy")


@query(with_views("path_vertex", more=_U) + "select path_id, seq, ux, uy from u")
def w7_delta_decode(spark, d):
    lines = sequences.polylines(view(spark, d, "path_vertex")).select("path_id", seq.delta_decode(seq.delta_encode("c")).alias("c"))
    return lines.select("path_id", F.posexplode("c").alias("p", "v")).select("path_id", (F.col("p") + 1).cast("long").alias("seq"), s(F.col("v.x"), 1e5).alias("ux"), s(F.col("v.y"), 1e5).alias("uy"))


@query(with_views("path_vertex", more="n as (select path_id, count(*) as n from path_vertex group by 1), k as (select path_id, n, least(n, 4) as samples, unnest(range(least(n, 4))) as sample from n)") + f"select k.path_id, k.sample, v.seq, {q('v.x')} as x from k join path_vertex v on v.path_id = k.path_id and v.seq = cast(floor(k.sample*(k.n-1)/greatest(k.samples-1,1)) as bigint) + 1")
def w8_even_samples(spark, d):
    return sequences.evenly_spaced(view(spark, d, "path_vertex"), 4).select("path_id", "sample", "seq", s("x").alias("x"))


@query(with_views("path_vertex", more="k as (select path_id, seq, x, y, x as kx, y as ky, true as kept from path_vertex where seq = 1 union all select v.path_id, v.seq, v.x, v.y, case when abs(v.x-k.kx)+abs(v.y-k.ky) >= 0.5 then v.x else k.kx end, case when abs(v.x-k.kx)+abs(v.y-k.ky) >= 0.5 then v.y else k.ky end, abs(v.x-k.kx)+abs(v.y-k.ky) >= 0.5 from k join path_vertex v on v.path_id = k.path_id and v.seq = k.seq + 1)", recursive=True) + "select path_id, seq from k where kept")
def w8_kept_after_moves(spark, d):
    return sequences.kept_after_moves(view(spark, d, "path_vertex"), 0.5).select("path_id", "seq")


@query(with_views("path_vertex", more=_SEG) + f"select path_id, cast(sum({q(_km('start'), '1000e0')}) as bigint) as by_start, cast(sum({q(_km('end'), '1000e0')}) as bigint) as by_end, cast(sum({q(_km('mean'), '1000e0')}) as bigint) as by_mean from segs group by 1")
def x8_lengths(spark, d):
    return sequences.lengths(view(spark, d, "path_vertex"))


@query(with_views("path_vertex", more="b as (select path_id, seq, x, y, lead(x) over w as px, lead(y) over w as py from path_vertex window w as (partition by path_id order by seq desc)), g as (select *, " + _km("mean", "x", "y", "px", "py") + " as seg from b), c as (select *, coalesce(sum(seg) over (partition by path_id order by seq desc rows unbounded preceding), 0) as after from g), e as (select *, after - coalesce(seg, 0) as before from c), pts as (select path_id, before as d, x, y from e where before > 20 and before < 120 union all select path_id, 20e0, x+(px-x)*((20-before)/seg), y+(py-y)*((20-before)/seg) from e where seg is not null and before <= 20 and after > 20 union all select path_id, 120e0, x+(px-x)*((120-before)/seg), y+(py-y)*((120-before)/seg) from e where seg is not null and before < 120 and after >= 120)") + f"select path_id, row_number() over (partition by path_id order by d desc) - 1 as place, {q('x')} as x, {q('y')} as y from pts")
def w11_slice_km(spark, d):
    return sequences.slice_km(view(spark, d, "path_vertex"), 120.0, 20.0).select("path_id", F.col("place").cast("long").alias("place"), s("x").alias("x"), s("y").alias("y"))


@query(with_views("path_vertex", more=_SEG + ", n as (select path_id, count(*) as n from path_vertex group by 1), v as (select path_id, seq, x, y, lead(x) over w as x2, lead(y) over w as y2 from path_vertex window w as (partition by path_id order by seq)), o as (select v.path_id, 2*seq as p, 0.75e0*x+0.25e0*x2 as x, 0.75e0*y+0.25e0*y2 as y from v join n on n.path_id = v.path_id where n.n > 2 and x2 is not null union all select v.path_id, 2*seq+1, 0.25e0*x+0.75e0*x2, 0.25e0*y+0.75e0*y2 from v join n on n.path_id = v.path_id where n.n > 2 and x2 is not null union all select v.path_id, case when seq = 1 then 1 else 2*seq end, x, y from v join n on n.path_id = v.path_id where n.n <= 2 or seq = 1 or seq = n.n)") + f"select path_id, row_number() over (partition by path_id order by p) as place, {q('x')} as x, {q('y')} as y from o")
def x6_chaikin(spark, d):
    lines = sequences.polylines(view(spark, d, "path_vertex")).select("path_id", seq.chaikin("c", 1).alias("c"))
    return lines.select("path_id", F.posexplode("c").alias("p", "v")).select("path_id", (F.col("p") + 1).cast("long").alias("place"), s(F.col("v.x")).alias("x"), s(F.col("v.y")).alias("y"))


@query(with_views("path_vertex", more="n as (select path_id, count(*) as n from path_vertex group by 1)") + "select path_id, case when n > 2 then 4*n else n end as n2 from n")
def x6_chaikin_sizes(spark, d):
    return sequences.polylines(view(spark, d, "path_vertex")).select("path_id", F.size(seq.chaikin("c", 2)).cast("long").alias("n2"))


@query(with_views("path_vertex", more="n as (select path_id, count(*) as n from path_vertex group by 1)") + f"select v.path_id, {q('v.x')} as x, {q('v.y')} as y from path_vertex v join n on n.path_id = v.path_id and v.seq = cast(floor(n.n/2) as bigint) + 1")
def p5_midpoint(spark, d):
    m = sequences.polylines(view(spark, d, "path_vertex")).select("path_id", seq.midpoint("c").alias("m"))
    return m.select("path_id", s(F.col("m.x")).alias("x"), s(F.col("m.y")).alias("y"))


@query(with_views("path_vertex") + "select path_id, bool_and(x > -79.9 and x < -78.2 and y > -20 and y < -18) as inside from path_vertex group by 1")
def f7_ring_in_box(spark, d):
    return sequences.polylines(view(spark, d, "path_vertex")).select("path_id", seq.inside_box("c", -79.9, -78.2, -20.0, -18.0).alias("inside"))


@query()
def x5_douglas_peucker(spark, d):
    thin = sequences.simplify(sequences.polylines(view(spark, d, "path_vertex")), 0.2)
    return thin.select("path_id", F.size("c").alias("n"))


_W5_JOINS = "(s.km < 3*40075e0/4096 or s.ord = r.ord and s.rem = r.rem)"
_W5 = (
    "rn as (select path_id as chain, seq as i, cast(floor(up/30000) as bigint)%4 as ord, cast(floor(up) as bigint)%100 as rem, 1e0 + cast(floor(up) as bigint)%40 as km from path_vertex), "
    "st as (select chain, i, 0 as grp, ord, rem, km, rem*km as rem_km, km as longest from rn where i = 1 union all "
    f"select r.chain, r.i, case when {_W5_JOINS} then s.grp else s.grp+1 end, case when {_W5_JOINS} and not r.km > s.longest then s.ord else r.ord end, "
    f"case when {_W5_JOINS} then cast(floor((s.rem_km+r.rem*r.km)/(s.km+r.km)+0.5) as bigint) else r.rem end, case when {_W5_JOINS} then s.km+r.km else r.km end, "
    f"case when {_W5_JOINS} then s.rem_km+r.rem*r.km else r.rem*r.km end, case when {_W5_JOINS} then greatest(s.longest, r.km) else r.km end from st s join rn r on r.chain = s.chain and r.i = s.i+1), "
    "gr as (select * from (select *, row_number() over (partition by chain, grp order by i desc) as z, max(grp) over (partition by chain) as g from st) where z = 1), "
    "tl as (select chain, ord, rem, km from gr where grp = g and g > 0 and km < 3*40075e0/4096)"
)


@query(with_views("path_vertex", more=_W5, recursive=True) + "select a.chain, a.grp, case when t.km > a.longest and a.grp = a.g-1 then t.ord else a.ord end as ord, case when t.km is not null and a.grp = a.g-1 then cast(floor((a.rem_km+t.rem*t.km)/(a.km+t.km)+0.5) as bigint) else a.rem end as rem, case when t.km is not null and a.grp = a.g-1 then a.km+t.km else a.km end as km from gr a left join tl t on t.chain = a.chain where not (t.km is not null and a.grp = a.g)")
def w5_merge_runs(spark, d):
    v = view(spark, d, "path_vertex")
    runs = v.groupBy(F.col("path_id").alias("chain")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", (F.floor(F.col("up") / 30000) % 4).cast("int").alias("ord"), (F.floor("up") % 100).cast("int").alias("rem"), (1 + F.floor("up") % 40).cast("double").alias("km")))), lambda r: F.struct(r["ord"].alias("ord"), r["rem"].alias("rem"), r["km"].alias("km"))).alias("runs"))
    return sequences.merge_runs(runs, 3)


@query(with_views("path_vertex", more=_SEG + ", c as (select path_id, x1, y1, x2, y2, unnest(generate_series(cast(floor(least(x1,x2)/0.5e0) as bigint), cast(floor(greatest(x1,x2)/0.5e0) as bigint))) as gx from segs)") + "select path_id, gx, count(*) as n from c group by 1, 2")
def x3_cell_cover(spark, d):
    g = sequences.segments(view(spark, d, "path_vertex")).withColumn("gx", F.explode(F.sequence(F.floor(F.least("x1", "x2") / 0.5).cast("long"), F.floor(F.greatest("x1", "x2") / 0.5).cast("long"))))
    return g.groupBy("path_id", "gx").agg(F.count("*").alias("n"))


@query(with_views("path_vertex") + "select path_id, seq, up_c - coalesce(lag(up_c) over (partition by path_id order by seq), 0) as step, row_number() over (partition by path_id order by up_c desc, seq) as rank from (select path_id, seq, cast(floor(up*100e0+0.5) as bigint) as up_c from path_vertex)")
def w9_ranks(spark, d):
    v = view(spark, d, "path_vertex").select("path_id", "seq", s("up", 100).alias("up_c"))
    w = W.partitionBy("path_id")
    return v.select("path_id", "seq", (F.col("up_c") - F.coalesce(F.lag("up_c").over(w.orderBy("seq")), F.lit(0))).alias("step"), F.row_number().over(w.orderBy(F.col("up_c").desc(), "seq")).cast("long").alias("rank"))
