"""Scalar helpers as Columns: keys, sizes, projections, scene properties, dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
LAT_LIMIT = 85.0

# Months of the seasons (southern summer is named by its months, winter is December and, in the next year, January to 28 February).
# Units of sizes.
UNITS = ("KB", "MB", "GB", "TB", "PB")
SEASONS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "winter": (12, 2)}


def safe_json_key(key: Column) -> Column:
    return F.left(F.regexp_replace(key, r"[^A-Za-z0-9_.:-]", ""), F.lit(200))


def like_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def format_bytes(n: Column) -> Column:
    """Whole bytes below 1024, else two decimals of the largest unit that fits; null and what is not positive: 0 B."""
    out = F.when(F.coalesce(n, F.lit(0)) <= 0, "0 B").when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in enumerate(UNITS, 1):
        size = F.concat(F.format_string("%.2f", n / F.lit(1024.0**power)), F.lit(f" {unit}"))
        out = out.otherwise(size) if unit == UNITS[-1] else out.when(n < F.lit(1024.0 ** (power + 1)), size)
    return out


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once. The product's error (Dekker) and that of the sum (Knuth) are added at the end."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = F.lit(134217729.0) * x - (F.lit(134217729.0) * x - x)
        return high, x - high

    (a1, a2), (b1, b2) = halves(a), halves(b)
    product = a * b
    lost = ((a1 * b1 - product) + a1 * b2 + a2 * b1) + a2 * b2
    total = product + c
    back = total - product
    return total + ((product - (total - back)) + (c - back) + lost)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EARTH


def tile_x(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.least(F.greatest(F.floor((lon + 180) / 360 * n), F.lit(0)), n.cast("long") - 1).cast("int")


def tile_y(lat: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    held = F.radians(F.least(F.greatest(lat, F.lit(-LAT_LIMIT)), F.lit(LAT_LIMIT)))
    return F.least(F.greatest(F.floor((1 - F.ln(F.tan(held) + 1 / F.cos(held)) / F.pi()) / 2 * n), F.lit(0)), n.cast("long") - 1).cast("int")


def tile_west(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360 - 180


def tile_north(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def quadkey(z: Column, x: Column, y: Column) -> Column:
    bits = F.transform(
        F.sequence(z - 1, F.lit(0), F.lit(-1)),
        lambda i: (F.call_function("mod", F.floor(x / F.pow(F.lit(2.0), i)), F.lit(2)) + 2 * F.call_function("mod", F.floor(y / F.pow(F.lit(2.0), i)), F.lit(2))).cast("int").cast("string"),
    )
    return F.when(z > 0, F.array_join(bits, "")).otherwise("")


def mgrs_tile(item_id: Column, *properties: Column) -> Column:
    """The first tile (two digits, three letters) that a property is or has among its parts (cut at _ and spaces), else the
    one in an item's id: after _T, or after S2A_ or S2B_ at a start."""
    out = []
    for p in properties:
        parts = F.filter(F.split(F.upper(F.trim(p)), r"[_\s]+"), lambda x: x.rlike(r"^\d{2}[A-Z]{3}$"))
        out.append(F.get(parts, 0))
    for pattern in (r"(?i)_T(\d{2}[A-Z]{3})(?:_|$)", r"(?i)(?:^|_)S2[AB]_(\d{2}[A-Z]{3})_"):
        out.append(F.nullif(F.upper(F.regexp_extract(item_id, pattern, 1)), F.lit("")))
    return F.coalesce(*out)


def composite_id(member: Column, feature: Column) -> Column:
    return F.concat(member, F.lit(":"), feature)


def season_slices(first: dt.date, last: dt.date, seasons: list[str] | None = None) -> list[tuple[dt.date, dt.date]]:
    """Date ranges to search: by season, else by month beyond 31 days, else as given; reversed bounds are swapped. A winter is
    a December and the following January to 28 February, two ranges; a range that meets no season is searched whole."""
    first, last = min(first, last), max(first, last)
    out = []
    if seasons:
        for year in range(first.year, last.year + 1):
            for name in seasons:
                a, b = SEASONS[name]
                if name == "winter":
                    spans = [(dt.date(year, a, 1), dt.date(year, 12, 31)), (dt.date(year + 1, 1, 1), dt.date(year + 1, b, 28))]
                else:
                    spans = [(dt.date(year, a, 1), dt.date(year, b + 1, 1) - dt.timedelta(days=1))]
                out += [(max(start, first), min(end, last)) for start, end in spans if start <= last and end >= first]
        return sorted(out) or [(first, last)]
    if (last - first).days <= 31:
        return [(first, last)]
    while first <= last:
        end = (first.replace(day=1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
        out.append((first, min(end, last)))
        first = end + dt.timedelta(days=1)
    return out
