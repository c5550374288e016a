"""Parameters of the planner. Values marked fixed must equal those of existing plans and files."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_RADIUS_M = 6_371_000.0
M_PER_DEGREE = 111_320.0
KMH_PER_MPH = 1.60934
MILES_PER_M = 1 / 1609.344
FEET_PER_M = 3.28084

#: Road classes that are never driven (fixed values).
EXCLUDED_HIGHWAYS = (
    "footway", "path", "cycleway", "steps", "pedestrian", "bridleway", "corridor", "platform",
    "proposed", "construction", "abandoned", "razed", "raceway", "escape", "busway",
)

#: Speed in km/h by road class where no limit is known (fixed values).
HIGHWAY_SPEEDS = {
    "motorway": 110, "motorway_link": 80, "trunk": 90, "trunk_link": 70, "primary": 70, "primary_link": 50,
    "secondary": 60, "secondary_link": 50, "tertiary": 56, "tertiary_link": 45, "unclassified": 56,
    "residential": 56, "living_street": 20, "service": 20, "track": 15,
}

#: Servers of the road-network web API (fixed values).
NETWORK_URLS = (
    "https://overpass-api.de/api/interpreter",
    "https://overpass.kumi.systems/api/interpreter",
    "https://overpass.private.coffee/api/interpreter",
)


@dataclass(frozen=True)
class PlannerConfig:
    default_speed_kmh: float = 30.0
    merge_tolerance_m: float = 15.0
    link_cell_m: float = 50.0
    tile_deg: float = 0.25
    speed_match_m: float = 100.0
    speed_cell_deg: float = 0.01
    collect_mph: float = 35.0
    transfer_mph: float = 45.0
    collection_share: float = 0.6
    shift_hours: float = 6.0
    max_days: int = 5
    rebalance_rounds: int = 10
    rebalance_stop: float = 0.15
    #: Largest road graph (edges, some 40 bytes each) that is broadcast; a larger area is refused.
    max_graph_edges: int = 20_000_000
