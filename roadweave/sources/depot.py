"""The depot's place from a text."""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable

#: Address search of the public map's service, its time limit in seconds (fixed values).
SEARCH_URL, SEARCH_TIMEOUT = "https://nominatim.openstreetmap.org/search", 30


def address_search(timeout: int = SEARCH_TIMEOUT, open_url: Callable = urllib.request.urlopen) -> Callable[[str], tuple[float, float] | None]:
    """A geocoder that asks the public search for the best hit of an address; None without one."""

    def geocode(text: str) -> tuple[float, float] | None:
        query = urllib.parse.urlencode({"q": text, "format": "json", "limit": 1})
        request = urllib.request.Request(f"{SEARCH_URL}?{query}", headers={"User-Agent": "roadweave"})
        with open_url(request, timeout=timeout) as answer:
            hits = json.load(answer)
        return (float(hits[0]["lat"]), float(hits[0]["lon"])) if hits else None

    return geocode


def parse_place(text: str) -> tuple[float, float] | None:
    """The two numbers of ``LAT,LON``, else None."""
    m = re.fullmatch(r"\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)\s*,\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)\s*", text)
    return (float(m[1]), float(m[2])) if m else None


def resolve_depot(text: str, geocode: Callable[[str], tuple[float, float] | None] | None = None) -> tuple[float, float]:
    """``LAT,LON`` to six decimals, else what ``geocode`` finds for an address (no network unless one is given)."""
    found = parse_place(text) or (geocode(text) if geocode else None)
    if found is None:
        raise ValueError(f"no place found for {text!r}; give it as LAT,LON")
    return round(found[0], 6), round(found[1], 6)
