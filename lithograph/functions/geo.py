"""Column functions on positions and state labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius in metres of the sphere that catalogue positions refer to.
CATALOG_RADIUS_M = 1737151.3


def wrap_lon(lon: Column) -> Column:
    """0 .. 360 to -180 .. 180."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def project_equirect(lon: Column, lat: Column, radius_m: float = CATALOG_RADIUS_M) -> tuple[Column, Column]:
    """x and y in metres, equirectangular on a sphere (standard parallel 0, meridian 0)."""
    return F.lit(radius_m) * F.radians(lon), F.lit(radius_m) * F.radians(lat)


def crop_box(x: Column, y: Column, lat: Column, diam_km: Column, offset: float) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y) around a feature; null where the cosine of the latitude vanishes."""
    half = diam_km / 2 * 1000.0 * (1 + offset)
    cosine = F.cos(F.radians(lat))
    wide = F.when(cosine > 1e-9, half / cosine)
    return x - wide, y - half, x + wide, y + half


def combine_states(state: Column) -> Column:
    """States 1 and 2 become 1, higher ones 2."""
    return F.when(state <= 2, 1).otherwise(2)


def state_name(state: Column, names: dict[int, str]) -> Column:
    """A state's display name, "State n" where it has none."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    known = F.element_at(F.create_map(*pairs), state.cast("int")) if pairs else F.lit(None).cast("string")
    return F.coalesce(known, F.concat(F.lit("State "), state.cast("string")))


def file_stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
