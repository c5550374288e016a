"""The road graph as tables of nodes and edges, and shortest paths over it."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..config import PlannerConfig
from ..functions import geo, text
from .ranking import ranked
from .spatial import nearest_node

#: Order in which kinds of roads enter the graph.
CHAIN, COLLECTED, WAY, LINK, DEPOT = range(5)


def line_hops(lines: DataFrame, stage: int) -> DataFrame:
    """Hops (stage, r1, r2, pos, a, b, seconds, meters, oneway) of rows (r1, r2, line, kmh, oneway)."""
    one = lines.select(F.lit(stage).alias("stage"), "r1", "r2", "kmh", "oneway", F.posexplode(geo.hops(F.col("line"))).alias("pos", "hop"))
    one = one.select("stage", "r1", "r2", "pos", F.col("hop.a").alias("a"), F.col("hop.b").alias("b"), "kmh", F.coalesce("oneway", F.lit(False)).alias("oneway"))
    return one.withColumn("meters", geo.haversine(F.col("a"), F.col("b"))).withColumn("seconds", geo.drive_seconds(F.col("meters"), F.col("kmh"))).drop("kmh")


def survey_hops(parts: DataFrame, sections: DataFrame, collected: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """Hops of the chains' sections in drive order, then of collected sections."""
    kmh = F.coalesce(text.known_speed(F.col("speed_limit")), F.lit(config.default_speed_kmh)).alias("kmh")
    line = F.when(F.col("flipped"), F.reverse("coords")).otherwise(F.col("coords")).alias("line")
    of_chains = parts.join(sections, "section_id").select(F.col("chain_id").alias("r1"), F.col("pos").cast("long").alias("r2"), line, kmh, "oneway")
    of_collected = collected.select(F.col("section_id").alias("r1"), F.lit(0).cast("long").alias("r2"), F.col("coords").alias("line"), kmh, "oneway")
    return line_hops(of_chains, CHAIN).unionByName(line_hops(of_collected, COLLECTED))


def way_hops(ways: DataFrame) -> DataFrame:
    return line_hops(ways.select(F.col("way_no").alias("r1"), F.lit(0).cast("long").alias("r2"), F.col("geometry").alias("line"), F.col("speed_kmh").alias("kmh"), "oneway"), WAY)


def both_directions(hops: DataFrame) -> DataFrame:
    """Directed (a, b, seconds, meters, seen): two-way hops also backwards; seen orders them as they enter."""
    seen = F.struct("stage", "r1", "r2", "pos")
    there = hops.select("a", "b", "seconds", "meters", seen.alias("seen"))
    back = hops.where("not oneway").select(F.col("b").alias("a"), F.col("a").alias("b"), "seconds", "meters", seen.alias("seen"))
    return there.unionByName(back)


def node_table(hops: DataFrame) -> DataFrame:
    """(node_id, lat, lon, stage): dense ids in order of first appearance, a hop's start before its end."""
    ends = F.array(*[F.struct(F.col(c).alias("p"), F.struct("stage", "r1", "r2", "pos", F.lit(i).alias("side")).alias("seen")) for i, c in enumerate("ab")])
    first = hops.select(F.explode(ends).alias("e")).groupBy("e.p").agg(F.min("e.seen").alias("seen"))
    return ranked(first, "node_id", "seen").select("node_id", "p.lat", "p.lon", "seen.stage")


def cheapest_edges(directed: DataFrame, order: str = "seen") -> DataFrame:
    """One edge for each (src, dst): the fewest seconds with its meters, the first of equals."""
    return directed.groupBy("src", "dst").agg(F.min_by(F.struct("seconds", "meters"), F.struct("seconds", order)).alias("e")).select("src", "dst", "e.seconds", "e.meters")


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge usable both ways; an edge's own weight is kept unless the other direction's is strictly smaller."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seconds", "meters", F.lit(1).alias("seen"))
    return cheapest_edges(edges.withColumn("seen", F.lit(0)).unionByName(back))


def numbered_edges(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, seconds, meters) between node ids."""
    ids = nodes.select("node_id", F.struct("lat", "lon").alias("p"))
    directed = both_directions(hops)
    directed = directed.join(ids.withColumnsRenamed({"node_id": "src", "p": "a"}), "a").join(ids.withColumnsRenamed({"node_id": "dst", "p": "b"}), "b")
    return cheapest_edges(directed.where("src <> dst"))


def chain_links(chains: DataFrame, of_ways: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """(a, b, d): every chain end with its nearest way node and the distance."""
    ends = chains.select(F.explode(F.array(F.element_at("coords", 1), F.element_at("coords", -1))).alias("p")).distinct()
    points = ends.withColumn("id", F.struct(F.col("p.lat"), F.col("p.lon")))
    linked = nearest_node(points, of_ways, config).join(of_ways.select("node_id", F.struct("lat", "lon").alias("b")), "node_id")
    return linked.select(F.col("id").alias("a"), "b", "d")


def link_stats(links: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """One row: links, those over the tolerance, and the longest of these (0 without one)."""
    far = F.col("d") > config.link_cell_m
    return links.agg(F.count("*").alias("links"), F.count_if(far).alias("far_links"), F.coalesce(F.max(F.when(far, F.col("d"))), F.lit(0.0)).alias("longest_m"))


def build_graph(parts: DataFrame, sections: DataFrame, collected: DataFrame, chains: DataFrame, ways: DataFrame | None, depot: tuple[float, float] | None = None, config: PlannerConfig = PlannerConfig()) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, edges, links) of survey roads and ways, every chain end linked to its nearest way node, the depot to the nearest node of all."""
    hops, links = survey_hops(parts, sections, collected, config), None
    if ways is not None:
        hops = hops.unionByName(way_hops(ways))
        links = checkpointed(chain_links(chains, checkpointed(node_table(hops).where(F.col("stage") == WAY)), config))
        hops = hops.unionByName(_link_hops(links, LINK, config))
    if depot:
        nodes = node_table(hops)
        at = geo.point(F.lit(depot[0]), F.lit(depot[1]))
        d = geo.haversine(at, F.struct("lat", "lon"))
        best = nodes.agg(F.min_by(F.struct("lat", "lon"), F.struct(d, "node_id")).alias("b")).where("b is not null")
        best = best.select(at.alias("a"), "b", geo.haversine(at, F.col("b")).alias("d")).where("a <> b")
        hops = hops.unionByName(_link_hops(best, DEPOT, config))
    nodes = node_table(hops)
    return nodes, numbered_edges(hops, nodes), links


def _link_hops(links: DataFrame, stage: int, config: PlannerConfig) -> DataFrame:
    zero = F.lit(0).cast("long")
    return links.select(F.lit(stage).alias("stage"), zero.alias("r1"), zero.alias("r2"), F.lit(0).alias("pos"), "a", "b", F.lit(False).alias("oneway"), F.col("d").alias("meters"), geo.drive_seconds(F.col("d"), F.lit(config.default_speed_kmh)).alias("seconds"))


class Csr:
    """Adjacency in arrays, small enough to broadcast; node ids are positions."""

    def __init__(self, n: int, src, dst, seconds, meters):
        order = np.lexsort((dst, src))
        src = np.asarray(src, np.int64)[order]
        self.n, self.at = n, np.searchsorted(src, np.arange(n + 1))
        self.to, self.seconds, self.meters = np.asarray(dst, np.int64)[order], np.asarray(seconds, float)[order], np.asarray(meters, float)[order]

    def both_ways(self) -> Csr:
        src = np.repeat(np.arange(self.n), np.diff(self.at))
        a, b = np.concatenate([src, self.to]), np.concatenate([self.to, src])
        s, m, back = np.tile(self.seconds, 2), np.tile(self.meters, 2), np.repeat([0, 1], len(src))
        order = np.lexsort((back, s, b, a))
        first = np.ones(len(order), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        keep = order[first]
        return Csr(self.n, a[keep], b[keep], s[keep], m[keep])

    def search(self, source: int, targets: set[int], stop: bool = True):
        """Settle nodes by (seconds, node): yield (target, seconds, meters, path) of the targets, only the first if ``stop``."""
        best, meters, before, done = {source: 0.0}, {source: 0.0}, {}, set()
        heap = [(0.0, source)]
        left = len(targets)
        while heap and left:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u in targets:
                path, x = [u], u
                while x != source:
                    x = before[x]
                    path.append(x)
                yield u, d, meters[u], path[::-1]
                left = 0 if stop else left - 1
            for k in range(self.at[u], self.at[u + 1]):
                v, t = int(self.to[k]), d + self.seconds[k]
                if t < best.get(v, math.inf):
                    best[v], meters[v], before[v] = t, meters[u] + self.meters[k], u
                    heapq.heappush(heap, (t, v))


def to_csr(nodes: DataFrame, edges: DataFrame, config: PlannerConfig = PlannerConfig()) -> Csr:
    """Collect a graph for broadcasting; one over the configured size is refused, since areas are planned one by one."""
    size = edges.count()
    if size > config.max_graph_edges:
        raise ValueError(f"the road graph has {size} edges, more than max_graph_edges; plan its regions separately")
    pdf = edges.select("src", "dst", "seconds", "meters").toPandas()
    return Csr(nodes.count(), pdf["src"], pdf["dst"], pdf["seconds"], pdf["meters"])


def shortest_paths(sources: DataFrame, targets: set[int], graph: Csr) -> DataFrame:
    """(source, target, seconds, meters) for rows (node_id): one search a source over the broadcast graph, sources in parallel."""
    spread = sources.sparkSession.sparkContext.broadcast((graph, targets))

    def run(batches):
        own, wanted = spread.value
        for pdf in batches:
            rows = [(s, t, d, m) for s in pdf["node_id"] for t, d, m, _ in own.search(int(s), wanted, stop=False)]
            yield pd.DataFrame(rows, columns=["source", "target", "seconds", "meters"])

    return sources.select("node_id").mapInPandas(run, "source long, target long, seconds double, meters double")
