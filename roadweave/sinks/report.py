"""The plan as text."""

from __future__ import annotations


def _day(d: dict, tokens: list[str], shift_hours: float, min_miles: float | None) -> list[str]:
    fit = "fits" if d["hours"] <= shift_hours else "OVER"
    least = f" | minimum {min_miles:.0f} mi: {'OK' if d['total_mi'] >= min_miles else 'UNDER'}" if min_miles else ""
    out = [
        f"--- Route {d['day']}",
        f"  ~{d['hours']:.1f} h driving ({fit} the {shift_hours:.1f} h shift) | {d['total_mi']:.1f} mi total = {d['survey_mi']:.1f} mi collection + {d['deadhead_mi']:.1f} mi deadhead (incl. return)",
        f"  {d['segments']} segments | efficiency {d['efficiency']:.0f}%{least}",
    ]
    if d["wrong_way_return"]:
        out.append("  Note: return leg ignores one-way restrictions")
    return [*out, "  Collection order:", *(f"    {line}" for line in tokens)]


def plan_report(days: list[dict], lines: dict[int, list[str]], shift_hours: float, min_miles: float | None = None, filler: tuple[int, float] | None = None, paces: tuple[float, float] = (35.0, 45.0)) -> str:
    """``days`` are rows of the day table, ``lines`` the token lines of each day, ``filler`` sections and miles left out, ``paces`` mph of collecting and of transfers.

    The least miles are tested on a day's total.
    """
    out = ["MULTI-DAY PLAN", f"(hours assume {paces[0]:.0f} mph collecting / {paces[1]:.0f} mph transfers)"]
    for d in days:
        out += ["", *_day(d, lines.get(d["day"], []), shift_hours, min_miles)]
    hours = [d["hours"] for d in days]
    if hours:
        spread = (max(hours) - min(hours)) / (sum(hours) / len(hours)) * 100 if len(hours) > 1 and sum(hours) else 0
        out += ["", f"  Plan: {len(days)} days | {sum(d['total_mi'] for d in days):.0f} mi | days {min(hours):.1f}-{max(hours):.1f} h | day-to-day spread {spread:.0f}% of average"]
    if filler and filler[0]:
        out.append(f"  Filler pool: {filler[0]} segments, {filler[1]:.0f} mi near the depot - grab these whenever a shift ends early, then re-run")
    return "\n".join([*out, "  (I = blue, drive WITH the arrows; D = pink, drive AGAINST them)"])
