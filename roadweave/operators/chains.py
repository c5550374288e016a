"""Chains: maximal unambiguous runs of sections that meet end to start."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..config import PlannerConfig
from ..functions import geo, text
from .components import components


def incident(sections: DataFrame) -> DataFrame:
    """(section_id, at_start, node): two rows a section."""
    ends = F.array(F.struct(F.lit(True).alias("at_start"), F.col("start").alias("p")), F.struct(F.lit(False).alias("at_start"), F.col("end").alias("p")))
    return sections.select("section_id", "oneway", F.explode(ends).alias("e")).select("section_id", "oneway", "e.at_start", geo.key(F.col("e.p")).alias("node"))


def links(sections: DataFrame) -> DataFrame:
    """(section_id, node, other, other_at_start): where exactly one entry of other sections meets a section's end.

    A section whose both ends meet at a node counts twice for the others, so it may see a link that they do not.
    """
    entries = incident(sections)
    per_node = entries.groupBy("node").agg(F.count("*").alias("total"))
    own = entries.groupBy("node", "section_id").agg(F.count("*").alias("own"))
    seen = own.join(per_node, "node").where("total - own = 1").select("node", "section_id")
    others = entries.join(per_node.where("total <= 3"), "node").select("node", F.col("section_id").alias("other"), F.col("at_start").alias("other_at_start"))
    return seen.join(others, "node").where("other <> section_id")


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Grow runs in order of section_id, forward, then backward; a seed is never flipped."""
    oneway = dict(zip(pdf["section_id"], pdf["oneway"], strict=True))
    ends: dict[int, tuple] = {}
    link: dict[tuple, tuple] = {}
    for r in pdf.itertuples(index=False):
        ends[r.section_id] = (r.start_key, r.end_key)
        if r.other is not None and not pd.isna(r.other):
            link[r.section_id, r.node_key] = (int(r.other), bool(r.other_at_start))
    used: set[int] = set()
    out = []
    for seed in sorted(ends):
        if seed in used:
            continue
        used.add(seed)
        run = [(seed, False)]
        for forward in (True, False):
            while True:
                current, flipped = run[-1 if forward else 0]
                found = link.get((current, ends[current][int(flipped != forward)]))
                if not found or found[0] in used or (found[1] != forward and oneway[found[0]] is True):
                    break
                used.add(found[0])
                piece = (found[0], found[1] != forward)
                run = [*run, piece] if forward else [piece, *run]
        out += [(seed, pos, section, flipped) for pos, (section, flipped) in enumerate(run)]
    return pd.DataFrame(out, columns=["chain_id", "pos", "section_id", "flipped"])


def chain_parts(sections: DataFrame) -> DataFrame:
    """(chain_id, pos, section_id, flipped); chain_id is the section_id that the run grew from, so chains order as their seeds."""
    link = checkpointed(links(sections))
    labels = components(link, "section_id", "other").withColumnsRenamed({"node": "section_id", "root": "component"})
    text_key = lambda p: F.concat_ws(",", geo.key(p)["lat"].cast("string"), geo.key(p)["lon"].cast("string"))
    own = sections.select("section_id", "oneway", text_key(F.col("start")).alias("start_key"), text_key(F.col("end")).alias("end_key"))
    linked = own.join(labels, "section_id").join(link.select("section_id", F.concat_ws(",", F.col("node.lat").cast("string"), F.col("node.lon").cast("string")).alias("node_key"), "other", "other_at_start"), "section_id", "left")
    runs = linked.groupBy("component").applyInPandas(_replay, "chain_id long, pos int, section_id long, flipped boolean")
    single = own.join(labels, "section_id", "left_anti").select(F.col("section_id").alias("chain_id"), F.lit(0).alias("pos"), "section_id", F.lit(False).alias("flipped"))
    return runs.unionByName(single)


def roll_up(parts: DataFrame, sections: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """Chains (chain_id, coords, oneway, name, length_m, time_s, n_parts) of their parts; joints appear once in coords."""
    speed = F.coalesce(text.known_speed(F.col("speed_limit")), F.lit(config.default_speed_kmh))
    line = F.when(F.col("flipped"), F.reverse("coords")).otherwise(F.col("coords"))
    piece = F.when(F.col("pos") == 0, line).otherwise(F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))))
    rows = parts.join(sections, "section_id").select("chain_id", "pos", piece.alias("piece"), "name", "oneway", "length_m", geo.drive_seconds(F.col("length_m"), speed).alias("time_s"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    out = rows.groupBy("chain_id").agg(
        F.flatten(ordered["piece"]).alias("coords"), F.bool_or(F.coalesce("oneway", F.lit(False))).alias("oneway"), F.min_by("name", "pos").alias("first"), F.max_by("name", "pos").alias("last"),
        F.sum("length_m").alias("length_m"), F.sum("time_s").alias("time_s"), F.count("*").cast("int").alias("n_parts"),
    )
    name = F.when(F.col("n_parts") == 1, F.col("first")).otherwise(F.concat(F.col("first"), F.lit(" … "), F.col("last"), F.lit(" ("), F.col("n_parts").cast("string"), F.lit(" sections)")))
    return out.select("chain_id", "coords", "oneway", name.alias("name"), "length_m", "time_s", "n_parts")


def chain_sections(sections: DataFrame, config: PlannerConfig = PlannerConfig()) -> tuple[DataFrame, DataFrame]:
    """(chains, chain_parts) of sections."""
    parts = checkpointed(chain_parts(sections))
    return roll_up(parts, sections, config), parts
