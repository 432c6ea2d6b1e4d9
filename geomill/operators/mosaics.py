"""Satellite scenes: search, date windows, overlap swaps, mosaic index, pixel samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

from ..functions import scalar as S
from .paging import newest, swap_pages
from .quantiles import quantiles
from .spatial import _met, cell


def scene_search(scenes: DataFrame, box=None, slices=None, max_cloud: float | None = None, collections: list[str] | None = None) -> DataFrame:
    """Scenes by box, date slices and cloud cover; scenes without a cloud value only drop out if a bound is given. Without
    slices (None) every date fits; no date fits an empty list of them."""
    if collections:
        scenes = scenes.where(F.col("collection").isin(collections))
    if box is not None:
        x1, y1, x2, y2 = box
        scenes = scenes.where((F.col("minx") <= x2) & (F.col("maxx") >= x1) & (F.col("miny") <= y2) & (F.col("maxy") >= y1))
    if max_cloud is not None:
        scenes = scenes.where(F.col("cloud") <= max_cloud)
    if slices is not None:
        day, hit = F.to_date("dt"), F.lit(False)
        for a, b in slices:
            hit = hit | day.between(F.lit(a), F.lit(b))
        scenes = scenes.where(hit)
    return scenes


def federate(*catalogs: DataFrame) -> DataFrame:
    """Union of catalogs in order; of equal catalog:id the first stays."""
    tagged = [c.withColumn("ord", F.lit(k)) for k, c in enumerate(catalogs)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return newest(out, ["catalog", "id"], F.col("ord"), F.col("dt")).drop("ord")


def dedupe_scenes(slices: list[DataFrame], last: bool = False) -> DataFrame:
    """One scene for each catalog, collection and id: the first slice's, or with `last` the last one's; `ord` is its slice."""
    every = None
    for k, d in enumerate(slices):
        tagged = d.withColumn("ord", F.lit(k))
        every = tagged if every is None else every.unionByName(tagged)
    return newest(every, ["catalog", "collection", "id"], F.col("ord").desc() if last else F.col("ord").asc(), F.col("dt"))


def window_costs(scenes: DataFrame, half: int = 3) -> DataFrame:
    """(anchor, n, cloud): scenes within `half` days around each day that has one. Each scene is dealt to its 2 half + 1
    anchors, so the range join is an equi-join."""
    day = F.to_date("dt")
    dealt = scenes.select("cloud", F.explode(F.expr(f"sequence(date_sub(to_date(dt), {half}), date_add(to_date(dt), {half}))")).alias("anchor"))
    days = scenes.select(day.alias("anchor")).distinct()
    costs = dealt.groupBy("anchor").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("cloud"), F.lit(50.0)), 6).alias("cloud"))
    return costs.join(days, "anchor", "left_semi")


def best_window(scenes: DataFrame) -> DataFrame:
    """The seven days with the least mean cloud, then the most scenes, then the earliest."""
    return window_costs(scenes).agg(F.min(F.struct("cloud", (-F.col("n")).alias("m"), "anchor", "n")).alias("b")).select("b.anchor", "b.cloud", "b.n")


def swap_options(selected: DataFrame, scenes: DataFrame, offset: int = 0, limit: int = 5) -> DataFrame:
    """Other scenes whose boxes overlap a selected one, a page of them with totals; least cloud first. Two known tiles must be the
    same, so these pairs are joined on the tile and the grid cell of the boxes, as a tile may hold any number of scenes."""
    box = ("minx", "miny", "maxx", "maxy")
    s = selected.select(F.col("mgrs").alias("_mgrs"), *(F.col(c).alias(f"{c}_s") for c in ("id", *box)))

    def by_box(some: DataFrame, others: DataFrame, same=()) -> DataFrame:
        return _met(others, tuple(F.col(c) for c in box), some, tuple(F.col(f"{c}_s") for c in box), 4.0, list(same)).drop("_mgrs")

    known, unknown = s.where("_mgrs is not null"), s.where("_mgrs is null")
    pairs = by_box(known, scenes.where("mgrs is not null"), [("mgrs", "_mgrs")])
    if not unknown.isEmpty():
        pairs = pairs.unionByName(by_box(unknown, scenes))
    if not (untiled := scenes.where("mgrs is null")).isEmpty():
        pairs = pairs.unionByName(by_box(known, untiled))
    met = pairs.where("id <> id_s and minx < maxx_s and minx_s < maxx and miny < maxy_s and miny_s < maxy")
    return swap_pages(met, ["id_s"], [F.col("cloud").asc_nulls_last(), F.col("id")], offset, limit)


def mosaic_index(scenes: DataFrame, zoom: int, pad: float = 1e-5) -> DataFrame:
    """(quadkey, assets): for each tile the scenes that cover it, least cloud first."""
    z = F.lit(zoom)
    xs = F.sequence(S.tile_x(F.col("minx") - pad, z), S.tile_x(F.col("maxx") + pad, z))
    ys = F.sequence(S.tile_y(F.col("maxy") + pad, z), S.tile_y(F.col("miny") - pad, z))
    dealt = scenes.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys)).withColumn("quadkey", S.quadkey(z, F.col("x"), F.col("y")))
    return dealt.groupBy("quadkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("cloud", "id", "href"))), lambda s: s["href"]).alias("assets"))


def sample_points(points: DataFrame, pixels: DataFrame, step: float = 0.125) -> DataFrame:
    """Each point with the values of the pixels at its place, by raster and band; points without pixels stay with nulls."""
    at = lambda d: d.withColumn("px", cell("lon", step)).withColumn("py", cell("lat", step))
    left = at(points).select("id", "px", "py")
    right = at(pixels.where("not masked")).select("px", "py", "raster_id", "band", "value")
    return left.join(right, ["px", "py"], "left").drop("px", "py")


def classify(samples: DataFrame, classes: DataFrame, nodata: float) -> DataFrame:
    """Value to class by a normalised key (3.0 and 3 are the same); classes is a short table (value_key, name)."""
    whole = F.col("value") == F.floor("value")
    key = F.when(whole, F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    out = samples.withColumn("value_key", key).join(classes, "value_key", "left")
    return out.withColumn("is_nodata", F.coalesce(F.col("value") == nodata, F.lit(False)))


def legend(classes: DataFrame, colormap: DataFrame) -> DataFrame:
    """(value_key, name, color) of a style: its classes(value, name, color), of equal values the first by `place`, and colours of
    colormap(value, color) for values without a class, named by their value. Values are normalised as samples are (3.0 is 3), a
    class without a name has its value's, and colours begin with #. Rows without a value count for nothing."""
    number = F.col("value").try_cast("double")
    key = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(F.col("value").cast("string"))
    hashed = lambda c: F.when((c != "") & ~c.startswith("#"), F.concat(F.lit("#"), c)).otherwise(F.coalesce(c, F.lit("")))
    named = classes.where("value is not null").groupBy(key.alias("value_key")).agg(F.min_by(F.struct("name", "color"), "place").alias("c"))
    named = named.select("value_key", F.coalesce(F.nullif("c.name", F.lit("")), "value_key").alias("name"), hashed(F.col("c.color")).alias("color"))
    colored = colormap.where("value is not null").groupBy(key.alias("value_key")).agg(F.min("color").alias("color"))
    rest = colored.join(named, "value_key", "left_anti").select("value_key", F.col("value_key").alias("name"), hashed(F.col("color")).alias("color"))
    return named.unionByName(rest)


def rescale_suggestion(pixels: DataFrame) -> DataFrame:
    """Per raster: the least 2nd and the greatest 98th percentile over bands, as text; none if they don't span a range."""
    counts = pixels.where("not masked").groupBy("raster_id", "band", "value").agg(F.count("*").alias("n"))
    bands = quantiles(counts, ["raster_id", "band"], {"lo": 0.02, "hi": 0.98})
    both = bands.groupBy("raster_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("hi > lo")
    return both.select("raster_id", F.concat(F.round("lo").cast("long").cast("string"), F.lit(","), F.round("hi").cast("long").cast("string")).alias("rescale"))


def coverage_gaps(gaps: DataFrame, limit: int = 16) -> DataFrame:
    """Search boxes around the largest gaps of each area: half-size clamp(0.32 sqrt(area), 0.0025, 0.11) degrees."""
    half = F.least(F.greatest(F.sqrt("area") * 0.32, F.lit(0.0025)), F.lit(0.11))
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    w = Window.partitionBy("aoi").orderBy(F.col("area").desc(), F.col("id"))
    top = gaps.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return top.select("aoi", "id", "place", (cx - half).alias("sx1"), (cy - half).alias("sy1"), (cx + half).alias("sx2"), (cy + half).alias("sy2"))


def search_boxes(gaps: DataFrame, areas: DataFrame, limit: int = 16) -> DataFrame:
    """aoi, place, x1, y1, x2, y2: where to search for scenes that fill gaps(aoi, id, area, rings) of areas(aoi, box).

    For each of an area's largest gaps a box around a point inside it, with half-size clamp(0.32 sqrt(area), 0.0025, 0.11)
    degrees, cut at the map's and the area's box; equal boxes count once. An area with gaps but without such a box has
    one around all its gaps, 3 % or 0.008 degrees wider, at place 0.
    """
    order = Window.partitionBy("aoi").orderBy(F.col("area").desc(), F.col("id"))
    top = gaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).withColumn("p", G.interior_point(F.col("rings")))
    half = F.least(F.greatest(F.sqrt(F.greatest("area", F.lit(1e-12))) * 0.32, F.lit(0.0025)), F.lit(0.11))
    around = top.select("aoi", "place", *((F.col(f"p.{c}") + sign * half).alias(f"{c}{k}") for k, sign in ((1, -1), (2, 1)) for c in "xy"))
    box = areas.select("aoi", *(F.col(c).alias(f"_{c}") for c in ("minx", "miny", "maxx", "maxy")))
    low, high = {"x": -180.0, "y": -85.0}, {"x": 180.0, "y": 85.0}

    def cut(df: DataFrame) -> DataFrame:
        held = {f"{c}1": F.greatest(f"{c}1", f"_min{c}", F.lit(low[c])) for c in "xy"} | {f"{c}2": F.least(f"{c}2", f"_max{c}", F.lit(high[c])) for c in "xy"}
        return df.join(box, "aoi").withColumns(held).where("x1 < x2 - 1e-9 and y1 < y2 - 1e-9").select("aoi", "place", "x1", "y1", "x2", "y2")

    found = cut(around.where("x1 is not null")).groupBy("aoi", "x1", "y1", "x2", "y2").agg(F.min("place").alias("place")).select("aoi", "place", "x1", "y1", "x2", "y2")
    b = G.bounds(F.col("rings"))
    whole = gaps.groupBy("aoi").agg(*((F.min if c.startswith("min") else F.max)(v).alias(c) for c, v in b.items()))
    pad = F.greatest((F.col("maxx") - F.col("minx")) * 0.03, (F.col("maxy") - F.col("miny")) * 0.03, F.lit(0.008))
    wide = whole.select("aoi", F.lit(0).alias("place"), *((F.col(f"min{c}") - pad).alias(f"{c}1") for c in "xy"), *((F.col(f"max{c}") + pad).alias(f"{c}2") for c in "xy"))
    return found.unionByName(cut(wide.join(found.select("aoi").distinct(), "aoi", "left_anti")))
