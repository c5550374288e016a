"""Driver queries of the road operators. The tables carry no geometry, so nodes, sections, ways and edges are derived by fixed rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import checkpointed
from .config import MILES_PER_M, PlannerConfig
from .functions import geo, text
from .operators import chains as ch
from .operators import graph as g
from .operators import sections as sec
from .operators import spatial as sp
from .operators.ranking import ranked
from .plans import days as dy
from .plans import visits as vi
from .plans.walk import Chain, Network, walk
from .plans.engine import locked_state
from .sinks.project import Project, route_features, state_features
from .sources import kml, network, project
from .sources.tables import read_table

DEPOT = (39.7, -80.3)
CONFIG = PlannerConfig()


def node(k):
    """The place of node k: a grid of 50 columns, a hundredth of a degree apart."""
    return geo.snap(F.lit(39.5) + (k % 50) * 0.01, F.lit(-80.5) + F.floor(k / 50) * 0.01)


def raw_sections(spark, sf_dir) -> DataFrame:
    """Raw sections of orders: customer's node to another one; attributes from status and priority."""
    o = read_table(spark, sf_dir, "orders")
    speed = F.element_at(F.array(*map(F.lit, ("25 mph", "50 km/h", "0", "walk", "80", "maxspeed: 45"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    direction = F.element_at(F.array(*map(F.lit, ("I", "D", "B", "NB", ""))), F.substring("o_orderpriority", 1, 1).cast("int"))
    fields = F.map_from_arrays(
        F.array(*map(F.lit, ("dir", "collected", "scheduled", "maxspeed", "collid", "routename", "oneway", "one_way"))),
        F.array(direction, F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No"), F.when(F.col("o_orderstatus") == "P", " yes").otherwise(""), speed, F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("C"), F.col("o_orderkey").cast("string"))).otherwise(""), F.concat(F.lit("R"), (F.col("o_custkey") % 20).cast("string")), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise(""), F.when(F.col("o_orderkey") % 5 == 0, "no").otherwise("")),
    )
    a, b = node(F.col("o_custkey") % 1000), node((F.col("o_orderkey") * 7) % 1000)
    return o.select(F.col("o_orderkey").alias("section_id"), F.array(a, b).alias("coords"), fields.alias("fields"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"))


def sections(spark, sf_dir) -> DataFrame:
    return sec.build_sections(raw_sections(spark, sf_dir))


def ways(spark, sf_dir) -> DataFrame:
    """Ways of parts: two grid nodes each, the class from p_size."""
    p = read_table(spark, sf_dir, "part").where("p_partkey % 1000 <> (p_partkey * 3 + 1) % 1000")
    classes = ("motorway", "primary", "secondary", "tertiary", "residential", "service", "unknown")
    highway = F.element_at(F.array(*map(F.lit, classes)), (F.col("p_size") % len(classes) + 1).cast("int"))
    speed = F.coalesce(network.highway_speed(highway), F.lit(CONFIG.default_speed_kmh))
    return p.select(F.col("p_partkey").alias("way_id"), F.array(node(F.col("p_partkey") % 1000), node((F.col("p_partkey") * 3 + 1) % 1000)).alias("geometry"), speed.alias("speed_kmh"), highway.alias("highway"))


def points(spark, sf_dir) -> DataFrame:
    """Points of customers and of suppliers, the latter some metres aside."""
    c = read_table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"), node(F.col("c_custkey") % 1000).alias("p"))
    s = read_table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_suppkey").alias("k"), node(F.col("s_suppkey") % 1000).alias("q"))
    return c.unionByName(s.select("id", geo.snap(F.col("q.lat") + (F.col("k") % 7) * 0.00003, F.col("q.lon") + (F.col("k") % 5) * 0.00004).alias("p")))


def road_nodes(spark, sf_dir) -> DataFrame:
    """Nodes of suppliers, shifted by metres from the grid, every third far outside the cells."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), node(F.col("s_suppkey") % 1000).alias("q"))
    shift = F.when(F.col("node_id") % 3 == 0, 0.003).otherwise(0.0002)
    return s.select("node_id", (F.col("q.lat") + shift).alias("lat"), F.col("q.lon").alias("lon"))


def hop_rows(spark, sf_dir) -> DataFrame:
    """Directed edges of line items between 200 nodes: seconds by quantity, meters by price, numbered by all their values."""
    x = read_table(spark, sf_dir, "lineitem")
    return x.select((F.col("l_suppkey") % 200).alias("src"), (F.col("l_partkey") % 200).alias("dst"), F.col("l_quantity").alias("seconds"), F.round("l_extendedprice", 2).alias("meters"), F.struct("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2)).alias("seen"))


def legs(spark, sf_dir) -> DataFrame:
    """Legs of orders by customer: a chain of one section each, in order of o_orderkey."""
    s = sections(spark, sf_dir).join(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), "o_custkey"), "section_id")
    order = Window.partitionBy("o_custkey").orderBy("section_id")
    dead = (F.col("section_id") % 4) * 100.0
    return s.select(F.col("o_custkey").alias("day"), (F.row_number().over(order) - 1).cast("int").alias("leg_no"), F.col("section_id").alias("chain_id"), (F.col("section_id") % 2 == 1).alias("flipped"), dead.alias("dh_m"), (dead / 10.0).alias("dh_s"), "length_m")


def single_parts(spark, sf_dir) -> DataFrame:
    return sections(spark, sf_dir).select(F.col("section_id").alias("chain_id"), F.lit(0).alias("pos"), "section_id", F.lit(False).alias("flipped"))


def visited(spark, sf_dir) -> DataFrame:
    return vi.visits(legs(spark, sf_dir), single_parts(spark, sf_dir), sections(spark, sf_dir))


def runs(spark, sf_dir) -> DataFrame:
    """Chains of customers: centroid node and time."""
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chain_id"), F.array(node(F.col("c_custkey") % 1000), node((F.col("c_custkey") * 3 + 1) % 1000)).alias("coords"), (F.lit(60.0) + F.col("c_custkey") % 97).alias("time_s"), (F.lit(500.0) + F.col("c_custkey") % 89).alias("length_m"))


# queries


def remaining_km_by_dir(spark, sf_dir):
    left = sec.to_survey(sections(spark, sf_dir))
    return left.groupBy("dir_code").agg(F.count("*").alias("n_sections"), F.round(F.sum("length_m") / 1000, 3).alias("km"), F.count_if("oneway").alias("n_oneway"))


def parse_speed_limit(spark, sf_dir):
    return raw_sections(spark, sf_dir).select("section_id", F.round(text.parse_speed_limit(F.col("fields")["maxspeed"]), 4).alias("kmh"))


def oneway_cascade(spark, sf_dir):
    code, oneway, against = sec.direction(F.col("fields"))
    return raw_sections(spark, sf_dir).select("section_id", code.alias("dir_code"), oneway.alias("oneway"), against.alias("against"))


def flags_split(spark, sf_dir):
    s = sections(spark, sf_dir)
    return s.agg(F.count("*").alias("n"), F.count_if("collected").alias("collected"), F.count_if("scheduled").alias("scheduled"), F.count_if(F.expr("not collected and not scheduled")).alias("left_for_days"))


def name_coalesce(spark, sf_dir):
    raw = raw_sections(spark, sf_dir)
    n = F.col("section_id") + 1
    feature = F.when(F.col("section_id") % 7 != 0, F.col("name")).otherwise("")
    return raw.select("section_id", sec.display_name(F.col("fields")["collid"], feature, n, F.col("fields")["routename"]).alias("name"))


def section_build(spark, sf_dir):
    s = sections(spark, sf_dir)
    return s.select("section_id", F.round("length_m", 3).alias("length_m"), "oneway", "digitized_reversed", F.round("speed_limit", 4).alias("speed_limit"), F.round("start.lat", 6).alias("start_lat"), F.round("end.lon", 6).alias("end_lon"), "collected", "scheduled")


def haversine_length(spark, sf_dir):
    return sections(spark, sf_dir).select("section_id", F.round(geo.path_length(F.col("coords")), 3).alias("length_m"), F.round(geo.drive_seconds(F.col("length_m"), F.coalesce(text.known_speed(F.col("speed_limit")), F.lit(30.0))), 3).alias("time_s"))


def bearing_from_depot(spark, sf_dir):
    swept = dy.with_bearing(runs(spark, sf_dir), geo.point(F.lit(DEPOT[0]), F.lit(DEPOT[1])))
    return swept.select("chain_id", F.round("bearing", 6).alias("bearing"))


def centroid(spark, sf_dir):
    c = geo.centroid(F.col("coords"))
    return runs(spark, sf_dir).select("chain_id", F.round(c["lat"], 6).alias("lat"), F.round(c["lon"], 6).alias("lon"))


def long_lines(spark, sf_dir):
    """Lines of customers: nodes of their orders in order, repeats included."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", node(F.floor(F.col("o_orderkey") / 2) % 1000).alias("p"))
    rows = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "p"))).alias("r"))
    return rows.select("o_custkey", F.transform("r", lambda x: x["p"]).alias("line"))


def collapse_dups(spark, sf_dir):
    return long_lines(spark, sf_dir).select("o_custkey", F.size("line").cast("long").alias("points"), F.size(geo.collapse_repeats(F.col("line"))).cast("long").alias("kept"))


def hop_pairs(spark, sf_dir):
    hops = long_lines(spark, sf_dir).select("o_custkey", F.posexplode(geo.hops(geo.collapse_repeats(F.col("line")))).alias("pos", "h"))
    return hops.select("o_custkey", F.col("pos").cast("long").alias("pos"), F.round("h.a.lat", 6).alias("a_lat"), F.round("h.b.lat", 6).alias("b_lat"), F.round(geo.haversine(F.col("h.a"), F.col("h.b")), 3).alias("meters"))


def eav(spark, sf_dir):
    """(items, properties, values) of parts: brand, type and size as values, some blank."""
    p = read_table(spark, sf_dir, "part")
    items = p.select(F.lit("f").alias("file"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(3).alias("type"))
    properties = spark.createDataFrame([("f", 1, "Brand"), ("f", 2, "Type"), ("f", 3, "Size")], "file string, property_id long, name string")
    kinds = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("property_id"), F.col("p_brand").alias("v")), F.struct(F.lit(2).cast("long").alias("property_id"), F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_type")).alias("v")), F.struct(F.lit(3).cast("long").alias("property_id"), F.col("p_size").cast("string").alias("v"))))
    values = p.where("p_partkey % 5 <> 0").select(F.lit("f").alias("file"), F.col("p_partkey").alias("item_id"), kinds.alias("k")).select("file", "item_id", "k.property_id", F.col("k.v").cast("binary").alias("value"))
    return items, properties, values


def eav_pivot(spark, sf_dir):
    _, properties, values = eav(spark, sf_dir)
    f = project.pivot_fields(values, properties)
    return f.select("item_id", F.col("fields")["brand"].alias("brand"), F.col("fields")["type"].alias("type"), F.col("fields")["size"].alias("size"))


def fields_left_default(spark, sf_dir):
    items, properties, values = eav(spark, sf_dir)
    lines = items.where(F.col("type") == project.LINE_TYPE).join(project.pivot_fields(values, properties), ["file", "item_id"], "left")
    return lines.select("item_id", "name", F.size(F.coalesce("fields", F.create_map().cast("map<string,string>"))).cast("long").alias("n_fields"))


def items_shapes_join(spark, sf_dir):
    items, _, _ = eav(spark, sf_dir)
    from .functions.shapes import decode_shape, encode_shape

    shapes = ways(spark, sf_dir).select(F.lit("f").alias("file"), F.col("way_id").alias("item_id"), encode_shape("geometry").alias("coordinates"))
    lines = items.where(F.col("type") == project.LINE_TYPE).join(shapes, ["file", "item_id"]).withColumn("coords", decode_shape("coordinates"))
    return lines.select("item_id", F.length("coordinates").cast("long").alias("bytes"), F.round(geo.path_length(F.col("coords")), 3).alias("meters"))


def highway_speed_lookup(spark, sf_dir):
    return ways(spark, sf_dir).groupBy("highway").agg(F.count("*").alias("n"), F.max("speed_kmh").alias("speed_kmh"))


def proximity_pairs_15m(spark, sf_dir):
    return sp.proximity_pairs(points(spark, sf_dir), 15.0).select("id_a", "id_b", F.round("d", 3).alias("meters"))


def nearest_way_speed(spark, sf_dir):
    found = sp.nearest_way_speed(sections(spark, sf_dir).where("speed_limit is null"), ways(spark, sf_dir))
    return found.select("section_id", "speed_kmh", F.round("d", 3).alias("meters"))


def linked_customers(spark, sf_dir):
    ends = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), node(F.col("c_custkey") % 1000).alias("p"))
    return sp.nearest_node(ends, road_nodes(spark, sf_dir))


def nearest_node_two_phase(spark, sf_dir):
    return linked_customers(spark, sf_dir).select("id", "node_id", F.round("d", 3).alias("meters"))


def far_links(spark, sf_dir):
    return g.link_stats(linked_customers(spark, sf_dir)).select("links", "far_links", F.round("longest_m", 3).alias("longest_m"))


def depot_nearest(spark, sf_dir):
    return sp.depot_nearest(DEPOT, road_nodes(spark, sf_dir)).select("node_id", F.round("d", 3).alias("meters"))


def incident_degree(spark, sf_dir):
    n = ch.incident(sections(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"))
    return n.groupBy("degree").agg(F.count("*").alias("nodes"))


def chain_rollup(spark, sf_dir):
    s = sections(spark, sf_dir)
    order = Window.partitionBy("collid_group").orderBy("section_id")
    grouped = s.withColumn("collid_group", F.floor(F.col("section_id") / 4))
    parts = grouped.select(F.col("collid_group").cast("long").alias("chain_id"), (F.row_number().over(order) - 1).cast("int").alias("pos"), "section_id", (F.col("section_id") % 2 == 1).alias("flipped"))
    r = ch.roll_up(parts, s)
    return r.select("chain_id", "oneway", "name", F.round("length_m", 3).alias("length_m"), F.round("time_s", 3).alias("time_s"), F.col("n_parts").cast("long").alias("n_parts"), F.size("coords").cast("long").alias("n_points"))


def targets_semi(spark, sf_dir):
    entries = sections(spark, sf_dir).select("section_id", geo.key(F.col("start")).alias("node"))
    left = sec.to_survey(sections(spark, sf_dir)).select("section_id")
    return entries.join(left, "section_id", "left_semi").select("node.lat", "node.lon").distinct()


def tiles(spark, sf_dir):
    return network.tile_cover(points(spark, sf_dir).select("p"))


def tile_cover_ring(spark, sf_dir):
    return tiles(spark, sf_dir)


def uncached_tiles_anti(spark, sf_dir):
    return network.uncached(tiles(spark, sf_dir), tiles(spark, sf_dir).where("(tx + ty) % 2 = 0"))


def day_left_join(spark, sf_dir):
    days = sections(spark, sf_dir).where("section_id % 3 = 0").select("section_id", (F.col("section_id") % 5 + 1).cast("int").alias("day"))
    from .sinks.project import state_of

    return state_of(sections(spark, sf_dir), days).groupBy("state").agg(F.count("*").alias("n"))


def min_edge_dedupe(spark, sf_dir):
    return g.cheapest_edges(hop_rows(spark, sf_dir))


def undirected_closure(spark, sf_dir):
    edges = g.cheapest_edges(hop_rows(spark, sf_dir))
    return g.undirected(edges).groupBy("src").agg(F.count("*").alias("degree"), F.sum("seconds").alias("seconds"))


def ring_union_distinct(spark, sf_dir):
    a = network.tile_cover(read_table(spark, sf_dir, "customer").select(node(F.col("c_custkey") % 1000).alias("p")))
    b = network.tile_cover(read_table(spark, sf_dir, "supplier").select(geo.snap(F.lit(40.2) + F.col("s_suppkey") * 0.001, F.lit(-80.1)).alias("p")))
    return a.unionByName(b).distinct().groupBy("tx").agg(F.count("*").alias("tiles"), F.min("ty").alias("low"), F.max("ty").alias("high"))


def except_visited(spark, sf_dir):
    todo = sec.to_survey(sections(spark, sf_dir)).select("section_id")
    done = legs(spark, sf_dir).where("leg_no < 3").select(F.col("chain_id").alias("section_id"))
    return todo.join(done, "section_id", "left_anti")


def visit_order_eta(spark, sf_dir):
    v = visited(spark, sf_dir)
    return v.select("day", F.col("order").cast("long").alias("order"), "section_id", "reversed", "dir_out", "dh_m", F.round("time_s", 3).alias("time_s"), F.round("eta_s", 2).alias("eta_s"))


def next_segment_lead(spark, sf_dir):
    return visited(spark, sf_dir).select("section_id", "next_segment")


def leg_slices(spark, sf_dir):
    one = legs(spark, sf_dir).withColumns({"start_index": F.col("leg_no") * 3, "time_s": F.col("dh_s") + F.round("length_m", 3)})
    one = one.withColumn("route_points", F.count("*").over(Window.partitionBy("day")) * 3 + 1)
    return vi.leg_times(one).select("day", F.col("leg_no").cast("long").alias("leg_no"), F.col("start_index").cast("long").alias("start_index"), F.col("end_index").cast("long").alias("end_index"), F.round("eta_s", 3).alias("eta_s"))


def label_pad(spark, sf_dir):
    return vi.labelled(visited(spark, sf_dir)).select("section_id", "rank", "length_ft")


def token_chunks(spark, sf_dir):
    v = visited(spark, sf_dir).join(sections(spark, sf_dir).select("section_id", "collid", "name"), "section_id")
    return vi.token_lines(v)


def leg_totals(spark, sf_dir):
    one = legs(spark, sf_dir).select("day", F.round("length_m", 3).alias("survey_m"), (F.col("length_m") * 0 + 1).alias("survey_s"), "dh_m", "dh_s", (F.col("dh_m") == 300).alias("is_jump"), F.col("flipped").alias("is_wrong_way"))
    t = vi.leg_totals(one)
    return t.select("day", F.round("survey_m", 3).alias("survey_m"), "survey_s", "deadhead_m", "deadhead_s", "jumps", "wrong_way")


def swept(spark, sf_dir):
    one = dy.with_bearing(runs(spark, sf_dir), geo.point(F.lit(DEPOT[0]), F.lit(DEPOT[1]))).withColumn("bearing", F.round("bearing", 9))
    return dy.circular_gaps(one)


def circular_gaps(spark, sf_dir):
    return swept(spark, sf_dir).select("chain_id", F.col("rn").cast("long").alias("rn"), F.round("gap", 6).alias("gap"))


def seam_rotation(spark, sf_dir):
    rounded = swept(spark, sf_dir).withColumn("gap", F.round("gap", 7))
    return dy.seam_rotation(rounded).select("chain_id", F.col("turn").cast("long").alias("turn"))


def wedge_buckets(spark, sf_dir):
    rounded = swept(spark, sf_dir).withColumn("gap", F.round("gap", 7))
    w = dy.wedges(dy.seam_rotation(rounded), 5)
    return w.groupBy("day").agg(F.count("*").alias("runs"), F.sum("time_s").alias("time_s"), F.min("turn").cast("long").alias("first_turn"))


def day_balance(spark, sf_dir):
    days = sections(spark, sf_dir).groupBy((F.col("section_id") % 7).alias("day")).agg((F.sum("length_m") * MILES_PER_M / CONFIG.collect_mph).alias("hours"))
    b = dy.day_balance(days)
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


def day_count_estimate(spark, sf_dir):
    found = dy.day_estimate(sec.to_survey(sections(spark, sf_dir), honour_scheduled=True), CONFIG)
    return found.select(F.round("hours", 4).alias("hours"), F.col("days").cast("long").alias("days"))


def trim_filler_rank(spark, sf_dir):
    at = geo.point(F.lit(DEPOT[0]), F.lit(DEPOT[1]))
    one = runs(spark, sf_dir).withColumn("d", F.round(geo.haversine(at, geo.centroid(F.col("coords"))), 3)).withColumn("day", (F.col("chain_id") % 5 + 1).cast("int"))
    near = Window.partitionBy("day").orderBy("d", "chain_id")
    return one.withColumn("rn", F.row_number().over(near)).where("rn <= 3").select("day", F.col("rn").cast("long").alias("rn"), "chain_id", F.col("d").alias("meters"))


def filler_anti(spark, sf_dir):
    planned = runs(spark, sf_dir).where("chain_id % 4 <> 1").select("chain_id")
    left = runs(spark, sf_dir).join(planned, "chain_id", "left_anti")
    return left.agg(F.count("*").alias("runs"), F.round(F.sum("length_m") * MILES_PER_M, 4).alias("miles"))


def nation_edges(spark, sf_dir):
    """Edges between nations: each to the two that follow it, weights by key, and back from every third."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    hop = F.explode(F.array(F.struct(((F.col("k") * 3 + 1) % 25).alias("dst"), (F.col("k") % 7 + 1.0).alias("w")), F.struct(((F.col("k") + 1) % 25).alias("dst"), (F.col("k") % 11 + 5.0).alias("w"))))
    e = n.select(F.col("k").alias("src"), hop.alias("h")).select("src", "h.dst", F.col("h.w").alias("seconds"), (F.col("h.w") * 10).alias("meters")).where("src <> dst")
    return g.cheapest_edges(e.withColumn("seen", F.col("meters")))


def nation_graph(spark, sf_dir) -> g.Csr:
    e = nation_edges(spark, sf_dir).toPandas()  # 25 nodes
    return g.Csr(25, e["src"], e["dst"], e["seconds"], e["meters"])


def shortest_paths_25(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"))
    paths = g.shortest_paths(nodes, set(range(25)), nation_graph(spark, sf_dir))
    return paths.select("source", "target", "seconds")


def greedy_walk_25(spark, sf_dir):
    net = Network(nation_graph(spark, sf_dir), [(39.5 + i * 0.01, -80.5) for i in range(25)], {i: Chain(i, i, i, 100.0, 10.0, True) for i in range(25)})
    rows = [(n, leg["chain_id"], float(leg["dh_s"])) for n, leg in enumerate(walk(net, list(range(25))))]
    return spark.createDataFrame(rows, "leg_no long, chain_id long, dh_s double")


def json_props(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("highest"))


def raw_ways(spark, sf_dir):
    """Ways read from raw JSON answers, one a part: classes, posted speeds and directions by key, some no ways at all."""
    key = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    at = lambda k: F.struct(node(k % 1000)["lat"].alias("lat"), node(k % 1000)["lon"].alias("lon"))
    line = F.when(key % 13 == 0, F.array(at(key))).otherwise(F.array(at(key), at(key * 3 + 1)))
    tags = F.create_map(F.lit("highway"), pick(("motorway", "footway", "residential", "unknown")), F.lit("maxspeed"), pick(("", "25 mph", "80", "none", "0")), F.lit("oneway"), pick(("no", "yes", "-1", "true", "1", "maybe", "")), F.lit("area"), pick(("no", "no", "no", "yes", "no", "no", "no", "no", "no", "no", "no")))
    element = F.struct(F.when(key % 17 == 0, "node").otherwise("way").alias("type"), key.alias("id"), line.alias("geometry"), tags.alias("tags"))
    answers = read_table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("json"))
    found = network.ways_from_elements(network.parse_response(answers))
    return found.select("way_id", F.size("geometry").cast("long").alias("points"), F.round("speed_kmh", 4).alias("speed_kmh"), "oneway")


def road_graph_edges(spark, sf_dir):
    """Edges of open sections (each a chain of its own), collected ones and ways, by their places."""
    s = sections(spark, sf_dir)
    todo, done = sec.to_survey(s), s.where("collected")
    parts = todo.select(F.col("section_id").alias("chain_id"), F.lit(0).alias("pos"), "section_id", (F.col("section_id") % 2 == 1).alias("flipped"))
    roads = ways(spark, sf_dir).select(F.col("way_id").alias("way_no"), "geometry", "speed_kmh", (F.col("way_id") % 3 == 0).alias("oneway"))
    hops = g.survey_hops(parts, todo, done).unionByName(g.way_hops(roads))
    nodes = checkpointed(g.node_table(hops))
    places = lambda end: nodes.select(F.col("node_id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
    edges = g.numbered_edges(hops, nodes).join(places("src"), "src").join(places("dst"), "dst")
    return edges.select("src_lat", "src_lon", "dst_lat", "dst_lon", F.round("seconds", 3).alias("seconds"), F.round("meters", 3).alias("meters"))


def one_route(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visits, sections, transfers) of a route over all open sections in their order, each a leg."""
    s = sections(spark, sf_dir)
    todo = sec.to_survey(s)
    dead = (F.col("section_id") % 4) * 100.0
    numbered = ranked(todo.select("section_id", "start"), "leg_no", "section_id")
    one = checkpointed(numbered.select(F.lit(1).alias("day"), F.col("leg_no").cast("int").alias("leg_no"), F.col("section_id").alias("chain_id"), (F.col("section_id") % 2 == 1).alias("flipped"), dead.alias("dh_m"), (dead / 10.0).alias("dh_s"), "start"))
    parts = todo.select(F.col("section_id").alias("chain_id"), F.lit(0).alias("pos"), "section_id", F.lit(False).alias("flipped"))
    paths = one.select("leg_no", F.when(F.col("leg_no") % 5 == 0, F.array("start")).otherwise(F.array(geo.point(F.lit(DEPOT[0]), F.lit(DEPOT[1])), "start")).alias("path"))
    return vi.visits(one.drop("start"), parts, todo), s, paths


FEATURE_VALUES = ("RouteName", "Dir", "CollId", "Collected", "Scheduled", "ScheduledDay", "LengthFt", "RouteOrder", "NextCollId")


def _feature_rows(features: DataFrame) -> DataFrame:
    return features.select("part", "at", "step", "name", "note", F.size("line").cast("long").alias("points"), "transfer", *(F.col("values")[v].alias(v) for v in FEATURE_VALUES))


def route_project_rows(spark, sf_dir):
    """Features of one route's file: transfers, sections, the way home, collected sections."""
    visited, s, paths = one_route(spark, sf_dir)
    home = spark.createDataFrame([([(40.0, -80.0), DEPOT],)], f"path {geo.LINE}")
    return _feature_rows(route_features(visited, s, paths, s.where("collected"), home))


def segment_state_rows(spark, sf_dir):
    """Features of a state file: collected before scheduled before the planned day."""
    s = sections(spark, sf_dir)
    days = s.where("section_id % 3 = 0").select("section_id", (F.col("section_id") % 5 + 1).cast("int").alias("day"))
    return _feature_rows(state_features(s, days))


def locked_state_rows(spark, sf_dir):
    """The same once day 2 is locked: its open sections are scheduled, the other days keep theirs."""
    s = sections(spark, sf_dir)
    days = sec.to_survey(s, honour_scheduled=True).where("section_id % 3 = 0").select("section_id", (F.col("section_id") % 5 + 1).cast("int").alias("day"))
    rows = _feature_rows(state_features(locked_state(s, days, 2), days))
    return rows.groupBy("Collected", "Scheduled", "ScheduledDay").agg(F.count("*").alias("n"))


def day_metrics(spark, sf_dir):
    """Miles, efficiency and hours of seven made-up days."""
    s = sections(spark, sf_dir)
    days = s.groupBy((F.col("section_id") % 7).alias("day")).agg(F.sum("length_m").alias("survey_m"), (F.sum(F.col("section_id") % 4) * 100.0).alias("deadhead_m"), F.max("length_m").alias("return_m"))
    m = dy.day_metrics(days)
    return m.select("day", *(F.round(c, 6).alias(c) for c in ("survey_mi", "deadhead_mi", "total_mi", "efficiency", "hours")))


def merge_endpoints(spark, sf_dir):
    """Sections whose ends are some metres off the grid, snapped together."""
    off = lambda p, k: geo.snap(p["lat"] + (k % 5) * 0.00002, p["lon"] + (k % 3) * 0.00003)
    raw = raw_sections(spark, sf_dir)
    moved = raw.withColumn("coords", F.array(off(F.col("coords")[0], F.col("section_id")), off(F.col("coords")[1], F.col("section_id") * 2)))
    m = sp.merge_endpoints(sec.build_sections(moved))
    return m.select("section_id", "start.lat", "start.lon", F.col("end.lat").alias("end_lat"), F.col("end.lon").alias("end_lon"))


def chain_sections(spark, sf_dir):
    parts = ch.chain_parts(sections(spark, sf_dir))
    return parts.select("chain_id", F.col("pos").cast("long").alias("pos"), "section_id", "flipped")


def sweep_solve(spark, sf_dir):
    """Days of the nations' chains from nation 0: sweep, solve, rebalance."""
    net = Network(nation_graph(spark, sf_dir), [(39.5 + (i % 5) * 0.01, -80.5 + i // 5 * 0.01) for i in range(25)], {i: Chain(i, i, i, 900.0 + 37 * i, 60.0 + i, True, (39.5 + (i % 5) * 0.01, -80.5 + i // 5 * 0.01)) for i in range(1, 25)}, 0)
    chains = read_table(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("chain_id"), F.array(geo.point(F.lit(39.5) + F.col("n_nationkey") % 5 * 0.01, F.lit(-80.5) + F.floor(F.col("n_nationkey") / 5) * 0.01)).alias("coords"), (F.col("n_nationkey") + 60.0).alias("time_s"))
    solved, _ = dy.plan_groups(spark, chains, (39.5, -80.5), 1000.0, spark.sparkContext.broadcast(net), 3)
    return dy.day_table(spark, solved).select("day", "runs", F.round("hours", 6).alias("hours"), F.round("total_mi", 6).alias("total_mi"), "jumps")


def kml_scan(spark, sf_dir):
    """Sections written as KML, one file a route, and read back."""
    raw = raw_sections(spark, sf_dir)
    attrs = F.concat(*[F.concat(F.lit(f'<Data name="{k}"><value>'), text.xml_escape(F.col("fields")[k]), F.lit("</value></Data>")) for k in ("dir", "collected", "scheduled", "maxspeed", "collid", "routename", "oneway", "one_way")])
    at = lambda p: F.concat(p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(",0"))
    mark = F.concat(F.lit("<Placemark><name>"), text.xml_escape(F.col("name")), F.lit("</name><ExtendedData>"), attrs, F.lit("</ExtendedData><LineString><coordinates>"), at(F.col("coords")[0]), F.lit(" "), at(F.col("coords")[1]), F.lit("</coordinates></LineString></Placemark>"))
    files = raw.withColumn("mark", mark).groupBy(F.col("fields")["routename"].alias("file"), (F.col("section_id") % 64).alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_id", "mark"))), lambda x: x["mark"]), "").alias("marks"))
    content = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), F.col("marks"), F.lit("</Document></kml>")).cast("binary")
    features = kml.parse_kml(files.select(F.concat_ws("/", "file", F.col("b").cast("string")).alias("file"), content.alias("content")))
    return features.groupBy(F.col("fields")["routename"].alias("route")).agg(F.count("*").alias("n"), F.count_if(text.starts_yes(F.col("fields")["collected"])).alias("collected"), F.round(F.sum(F.round(geo.path_length(F.col("coords")), 3)), 3).alias("meters"))


def mpz_roundtrip(spark, sf_dir):
    """Sections written as one project for each of 20 routes, in parallel, and read back through its tables."""
    import pandas as pd

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Project("routes")
        for r in pdf.sort_values("section_id").itertuples(index=False):
            own.add_line(r.name, [(p["lat"], p["lon"]) for p in r.line], {"CollId": r.collid or None, "RouteName": r.route, "Dir": r.dir or None, "Collected": r.collected})
        return pd.DataFrame({"file": [pdf["route"].iloc[0]], "content": [own.content()]})

    raw = raw_sections(spark, sf_dir)
    rows = raw.select("section_id", "name", F.col("coords").alias("line"), *[F.col("fields")[k].alias(a) for k, a in (("collid", "collid"), ("routename", "route"), ("dir", "dir"), ("collected", "collected"))])
    files = rows.groupBy("route").applyInPandas(write, "file string, content binary")
    s = project.parse_projects(files)
    return s.groupBy("dir_code").agg(F.count("*").alias("n"), F.count_if("collected").alias("collected"), F.count("collid").alias("with_id"), F.round(F.sum(F.round("length_m", 3)), 3).alias("meters"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        remaining_km_by_dir, parse_speed_limit, oneway_cascade, flags_split, name_coalesce, section_build, haversine_length, bearing_from_depot, centroid, collapse_dups, hop_pairs, eav_pivot, items_shapes_join,
        fields_left_default, highway_speed_lookup, proximity_pairs_15m, nearest_way_speed, nearest_node_two_phase, depot_nearest, incident_degree, chain_rollup, targets_semi, uncached_tiles_anti, day_left_join,
        min_edge_dedupe, undirected_closure, tile_cover_ring, ring_union_distinct, except_visited, visit_order_eta, next_segment_lead, leg_slices, label_pad, token_chunks, leg_totals, circular_gaps, seam_rotation,
        far_links, raw_ways, road_graph_edges, route_project_rows, segment_state_rows, locked_state_rows, day_metrics,
        wedge_buckets, day_balance, day_count_estimate, trim_filler_rank, filler_anti, shortest_paths_25, greedy_walk_25, json_props, merge_endpoints, chain_sections, sweep_solve, kml_scan, mpz_roundtrip,
    )
}
