"""GPX 1.1: one waypoint a leg and one track with all points."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime, timedelta
from xml.sax.saxutils import escape

#: Name of the file's route (fixed value).
TITLE = "Survey Route"


def waypoint(rank: int, leg: dict, place: tuple[float, float], elapsed: float, now: datetime) -> str:
    arrival = now + timedelta(seconds=elapsed)
    said = f"{leg['dist_m'] / 1000:.2f} km | {leg['time_s'] / 60:.0f} min | ETA +{elapsed / 3600:.1f} h ({arrival:%H:%M} UTC)"
    return f'<wpt lat="{place[0]}" lon="{place[1]}"><name>{rank}. {escape(leg["name"] or "")}</name><desc>{said}</desc></wpt>'


def gpx_text(route: Sequence[tuple[float, float]], legs: list[dict], totals: dict, now: datetime | None = None) -> str:
    """``legs`` have name, dist_m, time_s and start_index in the route (0 if absent); arrival is the time of all legs before. A leg without points has no waypoint."""
    now = now or datetime.now(UTC)
    all_km, transfer_km = (totals["survey_m"] + totals["deadhead_m"]) / 1000, totals["deadhead_m"] / 1000
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gpx version="1.1" creator="roadweave" xmlns="http://www.topografix.com/GPX/1/1">']
    out += ["<metadata>", f"<name>{TITLE}</name>", f"<desc>{len(legs)} runs, {all_km:.1f} km total ({transfer_km:.1f} km deadhead)</desc>", f"<time>{now:%Y-%m-%dT%H:%M:%SZ}</time>", "</metadata>"]
    elapsed = 0.0
    for rank, leg in enumerate(legs, 1):
        at = leg.get("start_index", 0)
        if at < len(route):
            out.append(waypoint(rank, leg, route[at], elapsed, now))
            elapsed += leg["time_s"]
    out += [f"<trk><name>{TITLE}</name><trkseg>", *(f'<trkpt lat="{lat}" lon="{lon}"/>' for lat, lon in route), "</trkseg></trk></gpx>"]
    return "\n".join(out)
