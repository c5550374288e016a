"""Binary polylines of map projects: magic 01 00 01 02, int32 count, int32 zero, then (lat, lon) doubles, little-endian."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_TYPE = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
MAGIC = b"\x01\x00\x01\x02"


def decode(blob: bytes | None) -> list[tuple[float, float]] | None:
    """Points rounded to six decimals without repeats; None for another magic, a short blob or under two points."""
    if not blob or len(blob) < 12 or bytes(blob[:4]) != MAGIC:
        return None
    count = int.from_bytes(blob[4:8], "little", signed=True)
    if count < 2 or len(blob) < 12 + 16 * count:
        return None
    out: list[tuple[float, float]] = []
    for lat, lon in np.frombuffer(blob, "<f8", 2 * count, 12).reshape(-1, 2).tolist():
        p = (round(lat, 6), round(lon, 6))
        if not out or out[-1] != p:
            out.append(p)
    return out if len(out) >= 2 else None


def encode(line) -> bytes:
    at = np.array([(p[0], p[1]) for p in line], "<f8").reshape(-1, 2)
    return MAGIC + len(at).to_bytes(4, "little") + bytes(4) + at.tobytes()


@F.pandas_udf(LINE_TYPE)
def decode_shape(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if (line := decode(b)) is None else [{"lat": p[0], "lon": p[1]} for p in line])


@F.pandas_udf(T.BinaryType())
def encode_shape(lines: pd.Series) -> pd.Series:
    return lines.map(lambda line: None if line is None else encode([(p["lat"], p["lon"]) for p in line]))
