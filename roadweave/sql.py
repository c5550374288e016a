"""DuckDB equivalents of the road queries, over the same fixed derivations."""

from __future__ import annotations

from .config import HIGHWAY_SPEEDS

_SPEEDS = ", ".join(f"'{k}': {float(v)}::double" for k, v in HIGHWAY_SPEEDS.items())

_MACROS = {
    "lat": "round(39.5::double + (({k}) % 50) * 0.01::double, 6)",
    "lon": "round(-80.5::double + floor(({k}) / 50.0) * 0.01::double, 6)",
}


def lat(k: str) -> str:
    return _MACROS["lat"].format(k=k)


def lon(k: str) -> str:
    return _MACROS["lon"].format(k=k)


def hav(a1: str, o1: str, a2: str, o2: str) -> str:
    return f"(12742000.0::double * asin(sqrt(pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin((radians({o2}) - radians({o1})) / 2), 2))))"


def bearing(a1: str, o1: str, a2: str, o2: str) -> str:
    y = f"sin(radians({o2}) - radians({o1})) * cos(radians({a2}))"
    x = f"cos(radians({a1})) * sin(radians({a2})) - sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2}) - radians({o1}))"
    turn = "(2 * pi())"
    return f"(((atan2({y}, {x}) % {turn}) + {turn}) % {turn})"


def speed(t: str) -> str:
    low = f"lower(trim({t}))"
    patterns = (r"(\d+(?:\.\d+)?)\s*mph", r"(\d+(?:\.\d+)?)\s*k[mp][/\s]?h?", r"maxspeed[=:]\s*(\d+)", r"speed[=:]\s*(\d+)", r"^(\d+(?:\.\d+)?)$")
    found = ", ".join(f"nullif(regexp_extract({low}, '{p}', 1), '')" for p in patterns)
    return f"(case when {low} not in ('walk', 'none', 'signals', 'variable') then try_cast(coalesce({found}) as double) * case when contains({low}, 'mph') then 1.60934::double else 1.0::double end end)"


RAW = f"""
raw as (
  select o_orderkey as section_id, o_custkey, 'Order ' || o_orderkey as name,
         {lat("o_custkey % 1000")} as a_lat, {lon("o_custkey % 1000")} as a_lon, {lat("(o_orderkey * 7) % 1000")} as b_lat, {lon("(o_orderkey * 7) % 1000")} as b_lon,
         ['I', 'D', 'B', 'NB', ''][substr(o_orderpriority, 1, 1)::int] as dir, o_orderstatus = 'F' as collected, o_orderstatus = 'P' as scheduled,
         ['25 mph', '50 km/h', '0', 'walk', '80', 'maxspeed: 45'][o_orderkey % 6 + 1] as maxspeed,
         case when o_orderkey % 3 <> 0 then 'C' || o_orderkey else '' end as collid, 'R' || (o_custkey % 20) as routename,
         case when o_orderkey % 2 = 0 then 'yes' else '' end as ow1, case when o_orderkey % 5 = 0 then 'no' else '' end as ow2
  from orders
),
sec as (
  select *, {hav("a_lat", "a_lon", "b_lat", "b_lon")} as length_m, nullif({speed("maxspeed")}, 0) as speed_limit,
         case when dir = '' then case when ow2 = 'no' then false when ow1 = 'yes' then true end when dir = 'B' then false else true end as oneway, dir = 'D' as against,
         case when dir = 'D' then b_lat else a_lat end as s_lat, case when dir = 'D' then b_lon else a_lon end as s_lon,
         case when dir = 'D' then a_lat else b_lat end as e_lat, case when dir = 'D' then a_lon else b_lon end as e_lon
  from raw where a_lat <> b_lat or a_lon <> b_lon
)"""

WAYS = f"""
ways as (
  select p_partkey as way_id, ['motorway', 'primary', 'secondary', 'tertiary', 'residential', 'service', 'unknown'][p_size % 7 + 1] as highway,
         {lat("p_partkey % 1000")} as a_lat, {lon("p_partkey % 1000")} as a_lon, {lat("(p_partkey * 3 + 1) % 1000")} as b_lat, {lon("(p_partkey * 3 + 1) % 1000")} as b_lon
  from part where p_partkey % 1000 <> (p_partkey * 3 + 1) % 1000
),
wayspeed as (select *, coalesce(map {{{_SPEEDS}}}[highway], 30.0) as speed_kmh from ways)"""

POINTS = f"""
points as (
  select c_custkey * 2 as id, {lat("c_custkey % 1000")} as lat, {lon("c_custkey % 1000")} as lon from customer
  union all
  select s_suppkey * 2 + 1, round({lat("s_suppkey % 1000")} + (s_suppkey % 7) * 0.00003::double, 6), round({lon("s_suppkey % 1000")} + (s_suppkey % 5) * 0.00004::double, 6) from supplier
)"""

NODES = f"""
nodes as (select s_suppkey as node_id, {lat("s_suppkey % 1000")} + case when s_suppkey % 3 = 0 then 0.003::double else 0.0002::double end as lat, {lon("s_suppkey % 1000")} as lon from supplier)"""

LEGS = RAW + """,
legs as (select o_custkey as day, row_number() over (partition by o_custkey order by section_id) - 1 as leg_no, section_id, section_id % 2 = 1 as flipped, (section_id % 4) * 100.0::double as dh_m, (section_id % 4) * 10.0::double as dh_s,
                length_m, against, collid, name, length_m / (coalesce(speed_limit, 30.0::double) * 1000.0 / 3600.0) as time_s from sec),
vis as (select *, leg_no + 1 as ord, case when flipped <> against then 'D' else 'I' end as dir_out,
               coalesce(sum(time_s) over (partition by day order by leg_no rows between unbounded preceding and 1 preceding), 0) + sum(dh_s) over (partition by day order by leg_no rows between unbounded preceding and current row) as eta_s,
               lead(coalesce(nullif(collid, ''), name)) over (partition by day order by leg_no) as next_segment from legs)"""

RUNS = f"""
runs as (
  select c_custkey as chain_id, {lat("c_custkey % 1000")} as a_lat, {lon("c_custkey % 1000")} as a_lon, {lat("(c_custkey * 3 + 1) % 1000")} as b_lat, {lon("(c_custkey * 3 + 1) % 1000")} as b_lon,
         60.0::double + c_custkey % 97 as time_s, 500.0::double + c_custkey % 89 as length_m from customer
),
cen as (select *, (a_lat + b_lat) / 2 as lat, (a_lon + b_lon) / 2 as lon from runs)"""

SWEPT = RUNS + f""",
ang as (select *, round({bearing("39.7::double", "-80.3::double", "lat", "lon")}, 9) as bearing from cen),
swept as (select *, row_number() over (order by bearing, chain_id) as rn, coalesce(lead(bearing) over (order by bearing, chain_id), first_value(bearing) over (order by bearing, chain_id)) - bearing as d from ang),
gaps as (select *, ((d % (2 * pi())) + 2 * pi()) % (2 * pi()) as gap from swept),
seam as (select arg_max(rn, (round(gap, 7), -rn)) as s, count(*) as n from gaps),
turned as (select g.*, ((rn - 1 - s) % n + n) % n as turn from gaps g, seam)"""

HOPS = """
hops as (select l_suppkey % 200 as src, l_partkey % 200 as dst, l_quantity as seconds, round(l_extendedprice, 2) as meters, l_orderkey, l_linenumber from lineitem),
best as (select src, dst, min(seconds) as seconds, arg_min(meters, (seconds, l_orderkey, l_linenumber, meters)) as meters from hops group by all)"""

NATION = """
e0 as (select n_nationkey::bigint as src, ((n_nationkey * 3 + 1) % 25)::bigint as dst, n_nationkey % 7 + 1.0::double as w from nation
       union all select n_nationkey, (n_nationkey + 1) % 25, n_nationkey % 11 + 5.0::double from nation),
e as (select src, dst, min(w) as w from e0 where src <> dst group by all),
p0 as (select src, dst, w from e union all select n_nationkey, n_nationkey, 0 from nation)"""


def _paths() -> str:
    steps = "".join(f", p{i} as (select a.src, b.dst, min(a.w + b.w) as w from p{i - 1} a join p{i - 1} b on a.dst = b.src group by all)" for i in range(1, 6))
    return NATION + steps


_CELL = 50.0 / 111320.0
_M15 = 15.0 / 111320.0

NEAREST = f"""with {NODES}, p as (select c_custkey as id, {lat("c_custkey % 1000")} as lat, {lon("c_custkey % 1000")} as lon from customer),
        d as (select id, node_id, {hav("p.lat", "p.lon", "n.lat", "n.lon")} as d, trunc(n.lat / {_CELL!r}::double)::bigint - trunc(p.lat / {_CELL!r}::double)::bigint as dx, trunc(n.lon / {_CELL!r}::double)::bigint - trunc(p.lon / {_CELL!r}::double)::bigint as dy from p, nodes n),
        near as (select id, arg_min(node_id, (d, 3 * (dx + 1) + dy + 1, node_id)) as node_id, min(d) as d from d where abs(dx) <= 1 and abs(dy) <= 1 group by id),
        far as (select id, arg_min(node_id, (d, node_id)) as node_id, min(d) as d from d where id not in (select id from near) group by id),
        nearest as (select * from near union all select * from far)"""

_REF = "coalesce(nullif(collid, ''), name)"

ROUTE = RAW + f""",
todo as (select *, row_number() over (order by section_id) as ord, {_REF} as ref, (section_id % 4) * 100.0::double as dh_m, length_m / (coalesce(speed_limit, 30.0::double) * 1000.0 / 3600.0) as time_s,
                case when (section_id % 2 = 1) <> against then 'D' else 'I' end as dir_out from sec where not collected),
seen as (select *, lead(ref) over (order by ord) as following, lpad(ord::varchar, greatest(4, length((count(*) over ())::varchar))::int, '0') as rank, count(*) over () as n,
                coalesce(sum(time_s) over (order by ord rows between unbounded preceding and 1 preceding), 0) + sum(dh_m / 10.0) over (order by ord rows between unbounded preceding and current row) as eta_s from todo),
home as (select {hav("40.0::double", "-80.0::double", "39.7::double", "-80.3::double")} as m)"""

ORACLES: dict[str, str] = {
    "raw_ways": """with p as (select p_partkey as k, ['motorway', 'footway', 'residential', 'unknown'][p_partkey % 4 + 1] as highway, ['', '25 mph', '80', 'none', '0'][p_partkey % 5 + 1] as maxspeed,
        ['no', 'yes', '-1', 'true', '1', 'maybe', ''][p_partkey % 7 + 1] as oneway from part)
        select k as way_id, 2::bigint as points, round(case maxspeed when '25 mph' then 25 * 1.60934 when '80' then 80 else case highway when 'motorway' then 110 when 'residential' then 56 else 30 end end, 4)::double as speed_kmh,
               oneway in ('yes', 'true', '1', '-1') as oneway from p where highway <> 'footway' and k % 11 <> 3 and k % 13 <> 0 and k % 17 <> 0""",
    "road_graph_edges": f"""with {RAW}, {WAYS}, hops as (
        select s_lat as a, s_lon as b, e_lat as c, e_lon as d, coalesce(oneway, false) as oneway, section_id % 2 = 1 and not collected as turned, length_m as m, length_m / (coalesce(speed_limit, 30.0::double) * 1000.0 / 3600.0) as s from sec
        union all select a_lat, a_lon, b_lat, b_lon, way_id % 3 = 0, false, {hav("a_lat", "a_lon", "b_lat", "b_lon")}, {hav("a_lat", "a_lon", "b_lat", "b_lon")} / (speed_kmh * 1000.0 / 3600.0) from wayspeed),
        both_ways as (select a, b, c, d, s, m from hops where not (turned and oneway) union all select c, d, a, b, s, m from hops where turned or not oneway)
        select a as src_lat, b as src_lon, c as dst_lat, d as dst_lon, round(min(s), 3) as seconds, round(min(m), 3) as meters from both_ways group by all""",
    "route_project_rows": f"""with {ROUTE}
        select 0 as part, ord as at, 1 as step, rank || ' · ' || ref as name,
               'Run ' || ord || ' of ' || n || ' | ' || printf('%.2f', length_m / 1000) || ' km | ETA +' || printf('%.1f', eta_s / 3600) || ' h' || case when dir_out = 'D' then ' | PINK: drive AGAINST the arrows' else ' | BLUE: drive WITH the arrows' end
               || case when dir not in ('', 'I', 'D') then ' | original Dir: ' || dir else '' end || coalesce(' | next: CollId ' || following, '') as note,
               2::bigint as points, false as transfer, routename as "RouteName", dir_out as "Dir", collid as "CollId", 'No' as "Collected", case when scheduled then ' yes' else '' end as "Scheduled", null::varchar as "ScheduledDay", null::varchar as "LengthFt", ord::varchar as "RouteOrder", following as "NextCollId" from seen
        union all select 0, ord, 0, '→ ' || rank, 'Transfer ' || printf('%.2f', dh_m / 1000) || ' km (~' || printf('%.0f', dh_m / 10.0 / 60) || ' min) to segment ' || rank || ' (CollId ' || ref || ')', 2, true, 'Deadhead', null, null, null, null, null, printf('%.1f', dh_m * 3.28084), ord::varchar, ref
        from seen where dh_m > 0 and (ord - 1) % 5 <> 0
        union all select 1, 0, 0, '→ Return', 'Return to start: ' || printf('%.2f', m / 1000) || ' km', 2, true, 'Deadhead', null, null, null, null, null, printf('%.1f', m * 3.28084), null, null from home
        union all select 2, section_id, 0, '✓ ' || {_REF}, 'Already collected — not part of the route', 2, false, routename, dir, collid, 'Yes', case when scheduled then ' yes' else '' end, null, null, null, null from sec where collected""",
    "segment_state_rows": f"""with {RAW}, st as (select *, {_REF} as ref, not collected and not scheduled and section_id % 3 = 0 as planned, (section_id % 5 + 1)::varchar as day from sec)
        select 0 as part, section_id as at, 0 as step, case when collected then '✓ ' || ref when scheduled then '◷ ' || ref when planned then 'Day ' || day || ' · ' || ref else ref end as name,
               case when collected then 'Already collected' when scheduled then 'Locked into an earlier day''s route' when planned then 'Planned for day ' || day end as note, 2::bigint as points, false as transfer,
               routename as "RouteName", dir as "Dir", collid as "CollId", case when collected then 'Yes' else 'No' end as "Collected", case when scheduled and not collected then 'Yes' end as "Scheduled", case when planned then day end as "ScheduledDay",
               null::varchar as "LengthFt", null::varchar as "RouteOrder", null::varchar as "NextCollId" from st""",
    "locked_state_rows": f"""with {RAW}, st as (select *, case when not collected and not scheduled and section_id % 3 = 0 then section_id % 5 + 1 end as day from sec)
        select case when collected then 'Yes' else 'No' end as "Collected", case when (scheduled or day = 2) and not collected then 'Yes' end as "Scheduled", case when day <> 2 then day::varchar end as "ScheduledDay", count(*) as n from st group by all""",
    "day_metrics": f"""with {RAW}, d as (select section_id % 7 as day, sum(length_m) / 1609.344::double as s, (sum(section_id % 4) * 100.0 + max(length_m)) / 1609.344::double as t from sec group by 1)
        select day, round(s, 6) as survey_mi, round(t, 6) as deadhead_mi, round(s + t, 6) as total_mi, round(s * 100 / (s + t), 6) as efficiency, round(s / 35.0 + t / 45.0, 6) as hours from d""",
    "merge_endpoints": f"""with {RAW}, moved as (select section_id, dir, round(a_lat + (section_id % 5) * 0.00002::double, 6) as a_lat, round(a_lon + (section_id % 3) * 0.00003::double, 6) as a_lon,
               round(b_lat + (section_id * 2 % 5) * 0.00002::double, 6) as b_lat, round(b_lon + (section_id * 2 % 3) * 0.00003::double, 6) as b_lon from raw),
        own as (select section_id, case when dir = 'D' then b_lat else a_lat end as s_lat, case when dir = 'D' then b_lon else a_lon end as s_lon, case when dir = 'D' then a_lat else b_lat end as e_lat, case when dir = 'D' then a_lon else b_lon end as e_lon
                from moved where a_lat <> b_lat or a_lon <> b_lon),
        ends as (select section_id * 2 as seen, s_lat as lat, s_lon as lon from own union all select section_id * 2 + 1, e_lat, e_lon from own),
        pts as (select lat, lon, min(seen) as seen, trunc(lat / {_M15!r}::double)::bigint as cx, trunc(lon / {_M15!r}::double)::bigint as cy from ends group by all),
        -- the points around one grid node are all within the tolerance of each other, so the first one takes them all
        kept as (select p.lat, p.lon, arg_min(q.lat, q.seen) as to_lat, arg_min(q.lon, q.seen) as to_lon from pts p join pts q on q.cx between p.cx - 1 and p.cx + 1 and q.cy between p.cy - 1 and p.cy + 1 where {hav("p.lat", "p.lon", "q.lat", "q.lon")} < 15 group by p.lat, p.lon)
        select section_id, a.to_lat as lat, a.to_lon as lon, case when a.to_lat = b.to_lat and a.to_lon = b.to_lon then e_lat else b.to_lat end as end_lat, case when a.to_lat = b.to_lat and a.to_lon = b.to_lon then e_lon else b.to_lon end as end_lon
        from own join kept a on a.lat = s_lat and a.lon = s_lon join kept b on b.lat = e_lat and b.lon = e_lon""",
    "remaining_km_by_dir": f"with {RAW} select dir as dir_code, count(*) as n_sections, round(sum(length_m) / 1000, 3) as km, count(*) filter (where oneway) as n_oneway from sec where not collected group by dir",
    "parse_speed_limit": f"with {RAW} select section_id, round({speed('maxspeed')}, 4) as kmh from raw",
    "oneway_cascade": f"with {RAW} select section_id, dir as dir_code, case when dir = '' then case when ow2 = 'no' then false when ow1 = 'yes' then true end when dir = 'B' then false else true end as oneway, dir = 'D' as against from raw",
    "flags_split": f"with {RAW} select count(*) as n, count(*) filter (where collected) as collected, count(*) filter (where scheduled) as scheduled, count(*) filter (where not collected and not scheduled) as left_for_days from sec",
    "name_coalesce": f"with {RAW} select section_id, routename || ' ' || coalesce(nullif(collid, ''), nullif(case when section_id % 7 <> 0 then name else '' end, ''), 'Section ' || (section_id + 1)) as name from raw",
    "section_build": f"with {RAW} select section_id, round(length_m, 3) as length_m, oneway, against as digitized_reversed, round(speed_limit, 4) as speed_limit, round(s_lat, 6) as start_lat, round(e_lon, 6) as end_lon, collected, scheduled from sec",
    "haversine_length": f"with {RAW} select section_id, round(length_m, 3) as length_m, round(length_m / (coalesce(speed_limit, 30.0::double) * 1000.0 / 3600.0), 3) as time_s from sec",
    "bearing_from_depot": f"with {RUNS} select chain_id, round({bearing('39.7::double', '-80.3::double', 'lat', 'lon')}, 6) as bearing from cen",
    "centroid": f"with {RUNS} select chain_id, round(lat, 6) as lat, round(lon, 6) as lon from cen",
    "collapse_dups": "with k as (select o_custkey, o_orderkey, floor(o_orderkey / 2) % 1000 as n, lag(floor(o_orderkey / 2) % 1000) over (partition by o_custkey order by o_orderkey) as p from orders) select o_custkey, count(*) as points, count(*) filter (where p is null or p <> n) as kept from k group by o_custkey",
    "hop_pairs": f"""with k as (select o_custkey, o_orderkey, floor(o_orderkey / 2) % 1000 as n, lag(floor(o_orderkey / 2) % 1000) over (partition by o_custkey order by o_orderkey) as p from orders),
        c as (select *, lead(n) over (partition by o_custkey order by o_orderkey) as nx, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos from k where p is null or p <> n)
        select o_custkey, pos, round({lat("n")}, 6) as a_lat, round({lat("nx")}, 6) as b_lat, round({hav(lat("n"), lon("n"), lat("nx"), lon("nx"))}, 3) as meters from c where nx is not null""",
    "eav_pivot": "select p_partkey as item_id, p_brand as brand, case when p_partkey % 3 <> 0 then p_type end as type, p_size::varchar as size from part where p_partkey % 5 <> 0",
    "fields_left_default": "select p_partkey as item_id, p_name as name, case when p_partkey % 5 = 0 then 0 when p_partkey % 3 = 0 then 2 else 3 end::bigint as n_fields from part where p_partkey % 4 <> 0",
    "items_shapes_join": f"with {WAYS} select way_id as item_id, 44::bigint as bytes, round({hav('a_lat', 'a_lon', 'b_lat', 'b_lon')}, 3) as meters from ways where way_id % 4 <> 0",
    "highway_speed_lookup": f"with {WAYS} select highway, count(*) as n, max(speed_kmh) as speed_kmh from wayspeed group by highway",
    "proximity_pairs_15m": f"""with {POINTS}, c as (select *, trunc(lat / {_M15!r}::double)::bigint as cx, trunc(lon / {_M15!r}::double)::bigint as cy from points),
        d as (select a.id as id_a, b.id as id_b, {hav("a.lat", "a.lon", "b.lat", "b.lon")} as d from c a join c b on b.cx between a.cx - 1 and a.cx + 1 and b.cy between a.cy - 1 and a.cy + 1 and a.id < b.id)
        select id_a, id_b, round(d, 3) as meters from d where d < 15""",
    "nearest_way_speed": f"""with {RAW}, {WAYS}, v as (select way_id, speed_kmh, a_lat as lat, a_lon as lon from wayspeed union all select way_id, speed_kmh, b_lat, b_lon from wayspeed),
        vc as (select *, trunc(lat / 0.01::double)::bigint as cx, trunc(lon / 0.01::double)::bigint as cy from v),
        m as (select section_id, trunc(e_lat / 0.01::double)::bigint as cx, trunc(e_lon / 0.01::double)::bigint as cy, e_lat, e_lon from sec where speed_limit is null),
        w as (select distinct section_id, e_lat, e_lon, way_id from m join vc on vc.cx between m.cx - 1 and m.cx + 1 and vc.cy between m.cy - 1 and m.cy + 1),
        d as (select section_id, way_id, speed_kmh, min({hav("e_lat", "e_lon", "v.lat", "v.lon")}) as d from w join v using (way_id) group by all)
        select section_id, arg_min(speed_kmh, (d, way_id)) as speed_kmh, round(min(d), 3) as meters from d where d < 100 group by section_id""",
    "nearest_node_two_phase": NEAREST + " select id, node_id, round(d, 3) as meters from nearest",
    "far_links": NEAREST + " select count(*) as links, count(*) filter (where d > 50) as far_links, round(coalesce(max(d) filter (where d > 50), 0), 3) as longest_m from nearest",
    "depot_nearest": f"with {NODES}, d as (select node_id, {hav('39.7::double', '-80.3::double', 'lat', 'lon')} as d from nodes) select arg_min(node_id, (d, node_id)) as node_id, round(min(d), 3) as meters from d",
    "incident_degree": f"with {RAW}, n as (select s_lat as a, s_lon as o from sec union all select e_lat, e_lon from sec), c as (select count(*) as degree from n group by a, o) select degree, count(*) as nodes from c group by degree",
    "chain_rollup": f"""with {RAW}, p as (select *, section_id // 4 as chain_id, row_number() over (partition by section_id // 4 order by section_id) as pos from sec)
        select chain_id, bool_or(coalesce(oneway, false)) as oneway, case when count(*) = 1 then min(name) else arg_min(name, pos) || ' … ' || arg_max(name, pos) || ' (' || count(*) || ' sections)' end as name,
               round(sum(length_m), 3) as length_m, round(sum(length_m / (coalesce(speed_limit, 30.0::double) * 1000.0 / 3600.0)), 3) as time_s, count(*) as n_parts, count(*) + 1 as n_points from p group by chain_id""",
    "targets_semi": f"with {RAW} select distinct round(s_lat * 1000000)::bigint as lat, round(s_lon * 1000000)::bigint as lon from sec where not collected",
    "tile_cover_ring": f"with {POINTS} select distinct floor(lat / 0.25)::bigint + x as tx, floor(lon / 0.25)::bigint + y as ty from points, (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(y)",
    "uncached_tiles_anti": f"with {POINTS}, t as (select distinct floor(lat / 0.25)::bigint + x as tx, floor(lon / 0.25)::bigint + y as ty from points, (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(y)) select tx, ty from t where (tx + ty) % 2 <> 0",
    "day_left_join": f"with {RAW} select case when collected then 'collected' when scheduled then 'scheduled' when section_id % 3 = 0 then 'day ' || (section_id % 5 + 1) else 'open' end as state, count(*) as n from sec group by 1",
    "min_edge_dedupe": f"with {HOPS} select src, dst, seconds, meters from best",
    "undirected_closure": f"with {HOPS}, u as (select src, dst, seconds from best union all select dst, src, seconds from best), m as (select src, dst, min(seconds) as seconds from u group by all) select src, count(*) as degree, sum(seconds) as seconds from m group by src",
    "ring_union_distinct": f"""with p as (select {lat("c_custkey % 1000")} as lat, {lon("c_custkey % 1000")} as lon from customer union all select round(40.2::double + s_suppkey * 0.001::double, 6), -80.1::double from supplier),
        t as (select distinct floor(lat / 0.25)::bigint + x as tx, floor(lon / 0.25)::bigint + y as ty from p, (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(y)) select tx, count(*) as tiles, min(ty) as low, max(ty) as high from t group by tx""",
    "except_visited": f"with {LEGS} select section_id from sec where not collected except select section_id from legs where leg_no < 3",
    "visit_order_eta": f"with {LEGS} select day, ord as \"order\", section_id, flipped as reversed, dir_out, case when dh_m > 0 then dh_m end as dh_m, round(time_s, 3) as time_s, round(eta_s, 2) as eta_s from vis",
    "next_segment_lead": f"with {LEGS} select section_id, next_segment from vis",
    "leg_slices": f"with {LEGS}, l as (select day, leg_no, leg_no * 3 as start_index, dh_s + round(length_m, 3) as t from legs) select day, leg_no, start_index, coalesce(lead(start_index) over w, count(*) over (partition by day) * 3 + 1) as end_index, round(coalesce(sum(t) over (partition by day order by leg_no rows between unbounded preceding and 1 preceding), 0), 3) as eta_s from l window w as (partition by day order by leg_no)",
    "label_pad": f"with {LEGS} select section_id, lpad(ord::varchar, greatest(4, length(ord::varchar), length((count(*) over (partition by day))::varchar))::int, '0') as rank, round(length_m * 3.28084::double, 1) as length_ft from vis",
    "token_chunks": f"with {LEGS} select day, (ord - 1) // 10 as line_no, string_agg(coalesce(nullif(collid, ''), name) || dir_out, ' ' order by ord) as line from vis group by all",
    "leg_totals": f"with {LEGS} select day, round(sum(round(length_m, 3)), 3) as survey_m, sum(length_m * 0 + 1) as survey_s, sum(dh_m) as deadhead_m, sum(dh_s) as deadhead_s, count(*) filter (where dh_m = 300) as jumps, count(*) filter (where flipped) as wrong_way from legs group by day",
    "circular_gaps": f"with {SWEPT} select chain_id, rn, round(gap, 6) as gap from gaps",
    "seam_rotation": f"with {SWEPT} select chain_id, turn from turned",
    "wedge_buckets": f"""with {SWEPT}, c as (select *, coalesce(sum(time_s) over (order by turn rows between unbounded preceding and 1 preceding), 0) + time_s / 2 as mid, sum(time_s) over () as total from turned)
        select least(floor(mid / (total / 5))::int, 4) as day, count(*) as runs, sum(time_s) as time_s, min(turn) as first_turn from c group by 1""",
    "day_balance": f"with {RAW}, d as (select sum(length_m) / 1609.344::double / 35.0::double as hours from sec group by section_id % 7) select round(min(hours), 6) as min_hours, round(max(hours), 6) as max_hours, round(avg(hours), 6) as avg_hours, round(max(hours) - min(hours), 6) as spread, round((max(hours) - min(hours)) * 100 / avg(hours), 6) as spread_pct from d",
    "day_count_estimate": f"with {RAW}, d as (select sum(length_m) / 1609.344::double / 35.0::double as h from sec where not collected and not scheduled) select round(h, 4) as hours, greatest(1, least(5, ceil(h / (6.0::double * 0.6::double))))::bigint as days from d",
    "trim_filler_rank": f"""with {RUNS}, d as (select chain_id, (chain_id % 5 + 1)::int as day, round({hav('39.7::double', '-80.3::double', 'lat', 'lon')}, 3) as meters from cen), r as (select *, row_number() over (partition by day order by meters, chain_id) as rn from d) select day, rn, chain_id, meters from r where rn <= 3""",
    "filler_anti": f"with {RUNS} select count(*) as runs, round(sum(length_m) / 1609.344::double, 4) as miles from runs where chain_id % 4 = 1",
    "shortest_paths_25": f"with {_paths()} select src as source, dst as target, w as seconds from p5",
    "greedy_walk_25": f"""with recursive {_paths()},
        w as (select 0::bigint as leg_no, 0::bigint as chain_id, 0.0::double as dh_s, [0::bigint] as seen
              union all
              select leg_no + 1, (pick).d, (pick).w, list_append(seen, (pick).d)
              from (select leg_no, seen, (select {{'d': arg_min(p.dst, (p.w, p.dst)), 'w': min(p.w)}} from p5 p where p.src = w.chain_id and not list_contains(w.seen, p.dst)) as pick from w where leg_no < 24))
        select leg_no, chain_id, dh_s from w""",
    "json_props": "select event_type, count((props::json ->> 'k')::bigint) as n, sum((props::json ->> 'k')::bigint)::bigint as total, max((props::json ->> 'k')::bigint) as highest from events group by event_type",
    "kml_scan": f"with {RAW} select routename as route, count(*) as n, count(*) filter (where collected) as collected, round(sum(round(length_m, 3)), 3) as meters from sec group by routename",
    "mpz_roundtrip": f"with {RAW} select dir as dir_code, count(*) as n, count(*) filter (where collected) as collected, count(nullif(collid, '')) as with_id, round(sum(round(length_m, 3)), 3) as meters from sec group by dir",
}
