"""Queries that match named lines with reaches and fill gaps of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import MINOR
from ..operators import labels
from ..sources.fixtures import view, with_views
from .network import q, s
from .registry import query


def _near(points: str, name: str, km: str) -> str:
    """cand (pid, ..., id, up, km): segments by equal cells, within the radius."""
    r = f"({km}/111.32e0)"
    cells = lambda low, high: f"unnest(range(cast(floor(({low})/0.05e0) as bigint), cast(floor(({high})/0.05e0) as bigint)+1))"
    return (
        f"{name}p as (select *, {cells(f'lat-{r}', f'lat+{r}')} as gy from (select *, {cells(f'lon-{r}', f'lon+{r}')} as gx from {points})), "
        f"{name}r as (select *, {cells('least(y1,y2)', 'greatest(y1,y2)')} as gy from (select id, up, x1, y1, x2, y2, {cells('least(x1,x2)', 'greatest(x1,x2)')} as gx from reach)), "
        f"{name}a as (select distinct p.* exclude (gx, gy), r.* exclude (gx, gy) from {name}p p join {name}r r using (gx, gy)), "
        f"{name}b as (select *, cos(radians(lat)) as c from {name}a), {name}c as (select *, (x1-lon)*c as ax, y1-lat as ay, (x2-x1)*c as dx, y2-y1 as dy from {name}b), "
        f"{name}d as (select *, case when dx*dx+dy*dy > 0 then greatest(0e0, least(1e0, -(ax*dx+ay*dy)/(dx*dx+dy*dy))) else 0e0 end as t from {name}c), "
        f"{name} as (select *, sqrt(pow(ax+t*dx,2)+pow(ay+t*dy,2))*111.32e0 as km from {name}d where sqrt(pow(ax+t*dx,2)+pow(ay+t*dy,2))*111.32e0 <= {km})"
    )


_J12 = (
    "v as (select id//4 as line, id%4+1 as seq, id as pid, lon, lat, case when id//4%3 = 0 then pop*4e0 end as target from place where id//4 in (select id//4 from place group by 1 having count(*) = 4)), "
    "sg as (select line, sqrt(pow((lead(lon) over w - lon)*cos(radians(lat)),2)+pow(lead(lat) over w - lat,2))*111.32e0 as km from v window w as (partition by line order by seq)), "
    "ln as (select v.line, case when line%5 = 0 then 'Igarapé ' else 'Rio ' end || cast(line as varchar) as name, count(*)/2e0 as need, case when max(target) is not null then 'size' when (select sum(km) from sg where sg.line = v.line) >= 200 then 'largest' else 'nearest' end as how from v group by 1), "
    + ", ".join(_near("v", n, km) for n, km in (("na", "1.5e0"), ("sz", "3e0"), ("wd", "6e0")))
    + ", hit as (select w.*, ln.how, ln.need, ln.name, r from (select *, 1 as r from na union all select *, 3 from sz union all select *, 6 from wd) w join ln using (line)), "
    "m as (select line, how, need, name, 1 as pass, up, row_number() over (partition by pid order by km, id) as rn from hit where how = 'nearest' and r = 1 "
    "union all select line, how, need, name, 2, up, row_number() over (partition by pid order by km, id) from hit where how = 'nearest' and r = 6 "
    "union all select line, how, need, name, 1, up, row_number() over (partition by pid order by abs(ln(up)-ln(target)), id) from hit where how = 'size' and r = 3 and abs(ln(up)-ln(target)) < ln(4) "
    "union all select line, how, need, name, 1, up, row_number() over (partition by pid order by up desc, id) from hit where how = 'largest' and r = 6), "
    f"h as (select line, how, need, pass, count(*) as hits, list_sort(list(up)) as ups from m where rn = 1 and not (regexp_matches(name, '{MINOR}') and up > 250000) group by 1, 2, 3, 4 having count(*) >= need)"
)


@query(with_views("reach", "place", more=_J12) + f"select line, how, hits, {q('ups[len(ups)//2+1]', '100e0')} as median_c from (select *, row_number() over (partition by line order by pass) as rn from h) where rn = 1")
def j12_line_strategy(spark, d):
    p = view(spark, d, "place").select(F.floor(F.col("id") / 4).cast("long").alias("line"), (F.col("id") % 4 + 1).alias("seq"), "lon", "lat", "pop")
    whole = p.groupBy("line").agg(F.count("*").alias("n")).where("n = 4").select("line")
    v = p.join(whole, "line").select("line", "seq", "lon", "lat", F.when(F.col("line") % 3 == 0, F.col("pop") * 4.0).alias("target"))
    lines = whole.select("line", F.concat(F.when(F.col("line") % 5 == 0, "Igarapé ").otherwise("Rio "), F.col("line").cast("string")).alias("name"))
    found = labels.match_lines(lines, v, view(spark, d, "reach"), minor_most=250000.0)
    return found.select("line", "how", "hits", s("median_up", 100).alias("median_c"))


_NAME = "case when path_id%20 < 2 then 'Igarapé ' else 'Rio ' end || substr(md5(cast(path_id//2 as varchar)), 1, 8)"
_U4 = (
    f"pv as (select path_id, seq, x, y, up, {_NAME} as name, substr(md5(cast(path_id//2 as varchar)), 1, 8) as key from path_vertex), "
    "sg as (select path_id, key, seq, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from pv where path_id%2 = 0 window w as (partition by path_id order by seq)), "
    "st as (select *, greatest(1, cast(ceil(greatest(abs(x2-x1), abs(y2-y1))/(3e0/111.32e0)) as int)) as n from sg where x2 is not null), al as (select *, unnest(range(0, n+1)) as i from st), "
    "cl as (select distinct key, cast(floor((x1+(x2-x1)*(i/cast(n as double)))/(3e0/111.32e0)) as bigint) as gx, cast(floor((y1+(y2-y1)*(i/cast(n as double)))/(3e0/111.32e0)) as bigint) as gy from al), "
    "cs as (select distinct key, gx+a.range-1 as gx, gy+b.range-1 as gy from cl, range(3) a, range(3) b), "
    "sv as (select path_id, seq, x, y, up, name, key, cast(floor(x/(3e0/111.32e0)) as bigint) as gx, cast(floor(y/(3e0/111.32e0)) as bigint) as gy from pv where path_id%2 = 1), "
    "c1 as (select distinct path_id, seq from sv join cs using (gx, gy) where sv.key = cs.key or levenshtein(sv.key, cs.key) <= 1), "
    "pl as (select path_id*100+seq as pid, x as lon, y as lat, name from (select *, abs(x - lag(x) over w) + abs(y - lag(y) over w) as mv from pv where path_id%2 = 0 window w as (partition by path_id order by seq)) where coalesce(mv, 1) >= 0.003), "
    + _near("pl", "cn", "1.5e0")
    + f", cd as (select distinct id from (select id, up, name, row_number() over (partition by pid order by km, id) as rn from cn) where rn = 1 and not (regexp_matches(name, '{MINOR}') and up > 250000)), "
    "op as (select path_id*100+seq as pid, path_id, seq, x as lon, y as lat, up as target from sv where not exists (select 1 from c1 where c1.path_id = sv.path_id and c1.seq = sv.seq)), "
    + _near("op", "oc", "3e0")
    + ", c2 as (select path_id, seq from (select path_id, seq, id, row_number() over (partition by pid order by abs(ln(up)-ln(target)), id) as rn from oc where abs(ln(up)-ln(target)) < ln(4)) where rn = 1 and id in (select id from cd)), "
    "fr as (select sv.* from sv left join (select * from c1 union select * from c2) c using (path_id, seq) where c.path_id is null), "
    "g as (select *, seq - row_number() over (partition by path_id order by seq) as grp from fr), "
    "k as (select path_id, grp, seq, name, sqrt(pow((lead(x) over w - x)*cos(radians(lead(y) over w)),2)+pow(lead(y) over w - y,2))*111.32e0 as km from g window w as (partition by path_id, grp order by seq)), "
    "rn as (select path_id, min(seq) as first, max(seq) as last, count(*) as n, cast(sum(cast(floor(km*1000e0+0.5) as bigint)) as bigint) as metres, any_value(name) as name from k group by path_id, grp having count(*) >= 2 and sum(cast(floor(km*1000e0+0.5) as bigint)) >= 1000), "
    # The spelling of a like name that passes by, where there is one (a primary line of the same key, as distances of one are not among these names).
    "sp as (select path_id, first_value(pn.name) over (partition by c1.path_id order by c1.seq rows between unbounded preceding and unbounded following) as spelling from c1 join (select distinct path_id as sid, key from sv) z on z.sid = c1.path_id join (select key, arg_min(name, path_id) as name from pv where path_id%2 = 0 group by 1) pn using (key))"
)


@query(with_views("reach", "path_vertex", more=_U4) + "select distinct rn.path_id, first, last, n, metres, coalesce(sp.spelling, rn.name) as name from rn left join sp using (path_id)")
def u4_j20_gap_union(spark, d):
    v = view(spark, d, "path_vertex")
    key = F.substring(F.md5(F.floor(F.col("path_id") / 2).cast("string").cast("binary")), 1, 8)
    lines = v.select("path_id").distinct().select("path_id", F.col("path_id").alias("seq"), F.concat(F.when(F.col("path_id") % 20 < 2, "Igarapé ").otherwise("Rio "), key).alias("name"))
    even, odd = "path_id % 2 = 0", "path_id % 2 = 1"
    return labels.gap_fill(lines.where(even), v.where(even).select("path_id", "seq", "x", "y"), lines.where(odd), v.where(odd), view(spark, d, "reach"), minor_most=250000.0)
