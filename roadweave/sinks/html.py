"""Map pages: a route, or a plan of several days, drawn from embedded JSON beside a panel with its sums."""

from __future__ import annotations

import json

#: Line colours of days, in turn.
PALETTE = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#8c564b", "#17becf")

_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css"><script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script>
<style>html,body,#map{{height:100%;margin:0}}#panel{{position:absolute;top:10px;right:10px;z-index:1000;background:#fff;padding:10px;font:14px sans-serif}}</style></head><body><div id="map"></div><div id="panel"></div><script>
const data = {data};
const map = L.map("map");
L.tileLayer("https://tile.openstreetmap.org/{{z}}/{{x}}/{{y}}.png", {{attribution: "&copy; OpenStreetMap contributors"}}).addTo(map);
const all = L.featureGroup().addTo(map);
const panel = document.getElementById("panel");
for (const row of data.panel) {{
  const line = panel.appendChild(document.createElement("div"));
  line.textContent = row.text;
  if (row.color) line.style.borderLeft = "12px solid " + row.color;
}}
for (const l of data.lines) L.polyline(l.points, {{color: l.color, weight: l.weight}}).bindPopup(l.label).addTo(all);
for (const m of data.marks) L.circleMarker(m.at, {{radius: 5, color: m.color}}).bindPopup(m.label).addTo(all);
if (all.getLayers().length) map.fitBounds(all.getBounds());
</script></body></html>
"""


def page(title: str, lines: list[dict], marks: list[dict], panel: list[dict]) -> str:
    data = json.dumps({"lines": lines, "marks": marks, "panel": panel}).replace("</", "<\\/")
    return _PAGE.format(title=title.replace("&", "&amp;").replace("<", "&lt;"), data=data)


def _faded(collected) -> list[dict]:
    return [{"points": line, "color": "#888888", "weight": 2, "label": "Already collected"} for line in collected]


def route_page(route: list, legs: list[dict], totals: dict, collected: list[list] = ()) -> str:
    """``legs`` have name, dist_m, time_s, lat and lon; ``totals`` survey_m, deadhead_m, survey_s and deadhead_s; ``collected`` are lines."""
    survey, transfers, hours = totals["survey_m"] / 1000, totals["deadhead_m"] / 1000, (totals["survey_s"] + totals["deadhead_s"]) / 3600
    panel = ["Survey Route", f"Total: {survey + transfers:.1f} km (~{hours:.1f} h)", f"Survey: {survey:.1f} km | Deadhead: {transfers:.1f} km", f"Runs: {len(legs)} | Already collected: {len(collected)}"]
    lines = [*_faded(collected), {"points": route, "color": PALETTE[0], "weight": 4, "label": "Route"}]
    marks = [{"at": [leg["lat"], leg["lon"]], "color": PALETTE[1], "label": f"{i}. {leg['name']}: {leg['dist_m'] / 1000:.2f} km, {leg['time_s'] / 60:.0f} min"} for i, leg in enumerate(legs, 1)]
    marks += [{"at": list(route[i]), "color": "#000000", "label": label} for i, label in ((0, "START"), (-1, "END")) if route]
    return page("Survey Route", lines, marks, [{"text": t} for t in panel])


def plan_page(days: list[dict], depot: tuple[float, float], filler: list[list] = (), collected: list[list] = ()) -> str:
    """``days`` have route, miles, hours and segments; ``filler`` and ``collected`` are lines."""
    lines, panel = _faded(collected), [{"text": "Multi-Day Plan"}]
    lines += [{"points": line, "color": "#222222", "weight": 3, "label": "Unplanned filler near the depot"} for line in filler]
    for i, d in enumerate(days):
        color = PALETTE[i % len(PALETTE)]
        lines.append({"points": d["route"], "color": color, "weight": 4, "label": f"Route {i + 1}: {d['miles']:.1f} mi, {d['segments']} segments, ~{d['hours']:.1f} h"})
        panel.append({"text": f"Route {i + 1}: ~{d['hours']:.1f} h, {d['miles']:.1f} mi", "color": color})
    if filler:
        panel.append({"text": "filler (unplanned)", "color": "#222222"})
    return page("Multi-Day Survey Plan", lines, [{"at": list(depot), "color": "#000000", "label": "Depot: every route starts and ends here"}], panel)
