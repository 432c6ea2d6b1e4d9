"""Scene items as Columns: date slices, assets, cloud cover, dates and footprints.

Assets are map<string, struct<href, type, roles: array<string>>>, properties are map<string, string>, both as read from item JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from .scalar import SEASONS

# Asset names in the order in which they are tried, property names, and endings of preview images.
RASTERS = ("visual", "image", "cog", "B04", "red", "green", "blue", "nir")
PREVIEWS = ("thumbnail", "thumb", "preview", "rendered_preview", "browse", "overview")
CLOUD = ("eo:cloud_cover", "cloud_cover", "cloud")
DATES = ("datetime", "start_datetime", "end_datetime")
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".webp")


def _span(first: Column, last: Column) -> Column:
    return F.struct(first.alias("first_day"), last.alias("last_day"))


def date_slices(first: Column, last: Column, seasons: list[str] | None = None) -> Column:
    """Slices (first_day, last_day) of a range: by season, else by month if it is longer than 31 days, else whole. Reversed bounds
    are swapped. A winter is a December and the following January to 28 February, in leap years too, as two slices; a range that
    meets no season stays whole. A single bound is a range of one day; without bounds the slices are null."""
    a, b = F.least(first, last), F.greatest(first, last)
    known = first.isNotNull() | last.isNotNull()
    if not seasons:
        months = F.sequence(F.trunc(a, "month"), b, F.expr("interval 1 month"))
        cut = F.transform(months, lambda m: _span(F.greatest(m.cast("date"), a), F.least(F.last_day(m), b)))
        return F.when(known, F.when(F.datediff(b, a) <= 31, F.array(_span(a, b))).otherwise(cut))
    years = F.sequence(F.year(a), F.year(b))

    def of(name: str) -> Column:
        start, end = SEASONS[name]
        day = lambda y, m, d=1: F.make_date(y, F.lit(m), F.lit(d))
        if name == "winter":
            return F.flatten(F.transform(years, lambda y: F.array(_span(day(y, start), day(y, 12, 31)), _span(day(y + 1, 1), day(y + 1, end, 28)))))
        return F.transform(years, lambda y: _span(day(y, start), F.last_day(day(y, end))))

    met = F.filter(F.flatten(F.array(*(of(s) for s in seasons))), lambda s: (s["first_day"] <= b) & (s["last_day"] >= a))
    cut = F.array_sort(F.transform(met, lambda s: _span(F.greatest(s["first_day"], a), F.least(s["last_day"], b))))
    return F.when(known, F.when(F.size(cut) > 0, cut).otherwise(F.array(_span(a, b))))


def _pick(assets: Column, names: tuple[str, ...], else_if) -> Column:
    """The href of the first named asset, else of the first other one that else_if(href, type, roles) takes. Only http addresses count."""
    web = lambda a: F.coalesce(a["href"].startswith("http"), F.lit(False))
    named = [F.try_element_at(assets, F.lit(n)) for n in names]
    kind = lambda a: F.lower(F.coalesce(a["type"], F.lit("")))
    roles = lambda a: F.lower(F.coalesce(F.array_join(a["roles"], " "), F.lit("")))
    other = F.filter(F.map_values(assets), lambda a: web(a) & else_if(F.lower(a["href"]), kind(a), roles(a)))
    return F.coalesce(*(F.when(web(a), a["href"]) for a in named), F.get(other, 0)["href"])


def primary_href(assets: Column) -> Column:
    return _pick(assets, RASTERS, lambda href, kind, _: href.contains("tif") | kind.contains("image") | kind.contains("geotiff"))


def thumbnail_href(assets: Column) -> Column:
    def shown(href, kind, roles):
        out = roles.contains("thumbnail") | roles.contains("preview")
        for name in ("png", "jpeg", "jpg"):
            out = out | kind.contains(name)
        for ending in IMAGE_ENDINGS:
            out = out | href.endswith(ending)
        return out

    return _pick(assets, PREVIEWS, shown)


def cloud_cover(properties: Column) -> Column:
    return F.coalesce(*(F.try_element_at(properties, F.lit(k)).try_cast("double") for k in CLOUD))


def item_datetime(properties: Column) -> Column:
    """The first property that reads as a time, to the second, in UTC."""
    return F.coalesce(*(F.left(F.trim(F.try_element_at(properties, F.lit(k))), F.lit(19)).try_cast("timestamp") for k in DATES))


def polygons(kind: Column, coordinates: Column) -> Column:
    """Polygons, each as rings, of a geometry's type and its coordinates as JSON text; other types have none."""
    nested = F.when(kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))).when(kind == "MultiPolygon", coordinates)
    flat = lambda ring: F.flatten(F.transform(ring, lambda p: F.slice(p, 1, 2)))
    return F.transform(F.from_json(nested, "array<array<array<array<double>>>>"), lambda p: F.transform(p, flat))


def footprint(kind: Column, coordinates: Column, bbox: Column) -> Column:
    """A scene's rings: the largest polygon of its geometry, else its bbox as a box, else null."""
    sized = F.transform(polygons(kind, coordinates), lambda p: F.struct(G.planar_area(p).alias("area"), p.alias("rings")))
    largest = F.array_max(F.filter(sized, lambda s: s["area"] > 0))["rings"]
    at = lambda i: F.get(bbox, i)
    whole = (F.size(bbox) >= 4) & at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull() & at(3).isNotNull()
    return F.coalesce(largest, F.when(whole, F.array(F.array(at(0), at(1), at(2), at(1), at(2), at(3), at(0), at(3), at(0), at(1)))))
