"""Speed texts, flags, labels and escapes on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import KMH_PER_MPH

#: Patterns of a speed, in order of precedence (fixed values), and texts without one.
SPEED_PATTERNS = (
    r"(\d+(?:\.\d+)?)\s*mph",
    r"(\d+(?:\.\d+)?)\s*k[mp][/\s]?h?",
    r"maxspeed[=:]\s*(\d+)",
    r"speed[=:]\s*(\d+)",
    r"^(\d+(?:\.\d+)?)$",
)
NO_SPEED = ("walk", "none", "signals", "variable")


def parse_speed_limit(text: Column) -> Column:
    """km/h of a free text, null without a speed; ``mph`` anywhere converts whichever pattern matched first."""
    low = F.lower(F.btrim(text))
    found = F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in SPEED_PATTERNS]).try_cast("double")
    value = F.when(F.contains(low, F.lit("mph")), found * KMH_PER_MPH).otherwise(found)
    return F.when(~low.isin(*NO_SPEED), value)


def known_speed(speed: Column) -> Column:
    """Zero means missing."""
    return F.nullif(speed, F.lit(0.0))


def starts_yes(value: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(value, F.lit("")))).startswith("y")


def yes_no(value: Column) -> Column:
    """true, false, or null for any other text."""
    low = F.lower(value)
    return F.when(low.isin("yes", "true", "1", "y"), True).when(low.isin("no", "false", "0", "n"), False)


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def padded(number: Column, width: Column) -> Column:
    """Zero-padded decimal that is never cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))


#: What no XML holds, and ampersands that begin none of XML's five names or a number (fixed values).
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)"


def repair_xml(text: Column) -> Column:
    """Control characters removed and bare ampersands escaped."""
    return F.regexp_replace(F.regexp_replace(text, NOT_XML, ""), BARE_AMPERSAND, "&amp;")


def fixed(number: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(number.cast("double"), digits))
