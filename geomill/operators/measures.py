"""Measures of logical features, written back into all their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rings as R
from .outlines import united_parts


def with_property(properties: Column, key: str, value: Column) -> Column:
    """JSON text of the properties with `key` set to a number or other value; the types of all others stay. Text that is no
    object counts as an empty one."""
    held = F.coalesce(F.from_json(properties, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    others = F.map_filter(held, lambda k, _: k != key)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(key), value.cast("variant"))))


def measure(df: DataFrame, op: str, unit: str, field: str, size: float = 1.0) -> DataFrame:
    """Part rows `df` (collection_id, id, part_index, rings, properties and, for lines, a flat `line`) with the property `field`:
    area, perimeter or length of the whole feature, as a JSON number in every part.

    Polygons of several parts are united first, so what parts share counts once and inner borders don't count at all. The
    perimeter is that of outer rings; of a feature without polygons it is its length. Lines have no area.
    """
    if op not in ("area", "perimeter", "length") or unit not in (G.AREA_UNITS if op == "area" else G.LENGTH_UNITS):
        raise ValueError(f"no measure {op} in {unit}")
    of = ["collection_id", "id"]
    polys = united_parts(df, size).groupBy(*of)
    shape = G.ellipsoid_area(F.col("rings"), unit) if op == "area" else R.perimeter("rings", unit) if op == "perimeter" else R.rings_length("rings", unit)
    made = polys.agg(F.sum(shape).alias("_shape"))
    lines = R.line_length("line", unit) if "line" in df.columns and op != "area" else F.lit(0.0)
    along = df.groupBy(*of).agg(F.sum(lines).alias("_line"))
    both = F.coalesce("_shape", F.lit(0.0)) + F.col("_line") if op == "length" else F.coalesce("_shape", F.col("_line"))
    values = along.join(made, of, "left").select(*of, both.alias("_measure"))
    out = df.join(values, of).withColumn("properties", with_property(F.col("properties"), field, F.col("_measure")))
    return out.select(*df.columns)
