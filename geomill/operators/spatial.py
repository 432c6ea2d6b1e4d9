"""Spatial joins as equi-joins on a hierarchy of grid cells: no cross join, no distinct afterwards.

A box has its home on the level whose cells are about as long as itself, so it touches at most REACH + 1 cells of a row there, whatever its
size. Two boxes meet on the coarser of their two home levels: one side looks itself up among the other side's homes on all
coarser levels that the other side has. A pair is emitted only in its reference cell, the one that holds the larger of the two
lower corners, so it appears once. A cell that holds a large share of a side's rows is split: that side's rows are dealt to
parts, and the other side's rows go to each part.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings as R
from .quantiles import quantiles
from .shared import stored

BOX = ("minx", "miny", "maxx", "maxy")
#: The cells of a level are so many times as long as those of the level below; levels above the finest one; a box's length in
#: cells of its home.
STEP, TOP, REACH = 4, 24, 4
CELL = ("_turn", "_level", "_x", "_y")
#: Rows of a cell that is not split, and the share of all rows (1 / SHARE) below which no cell is.
DENSE, SHARE = 50_000, 1000
#: Rows of one shape that stand together as a row's members.
TOGETHER = 256


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(size)).cast("int")


def to_cells(df: DataFrame, size: float) -> DataFrame:
    xs, ys = F.sequence(cell("minx", size), cell("maxx", size)), F.sequence(cell("miny", size), cell("maxy", size))
    return df.where("minx is not null").withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def _extents(box: tuple[Column, ...], size: float) -> tuple[Column, ...]:
    """The box held to what the hierarchy's coarsest cells reach, so that boxes without ends stay a few cells."""
    reach = float(size) * STEP**TOP
    return tuple(F.greatest(F.least(c.cast("double"), F.lit(reach)), F.lit(-reach)) for c in box)


def home_level(box: tuple[Column, ...], size: float) -> Column:
    """The lowest level on which the box is at most REACH cells long; 0 for points and all that is as short on the finest cells."""
    x1, y1, x2, y2 = _extents(box, size)
    steps = F.ceil(F.ln(F.greatest(x2 - x1, y2 - y1) / F.lit(float(size) * REACH)) / math.log(STEP))
    return F.least(F.greatest(F.coalesce(steps, F.lit(0)), F.lit(0)), F.lit(TOP)).cast("int")


def _long(size: float, level: Column) -> Column:
    return F.lit(float(size)) * F.pow(F.lit(float(STEP)), level)


def _in_cells(df: DataFrame, box: tuple[Column, ...], size: float, looks: Column) -> DataFrame:
    """`df` with a row for each cell (_turn, _level, _x, _y) that the box touches on the levels of `looks`, an array of (turn, level)."""
    x1, y1, x2, y2 = _extents(box, size)
    place = lambda v: F.floor(v / _long(size, F.col("_look.level")))
    df = df.withColumn("_look", F.explode(looks)).withColumn("_x", F.explode(F.sequence(place(x1), place(x2)))).withColumn("_y", F.explode(F.sequence(place(y1), place(y2))))
    return df.withColumns({"_turn": F.col("_look.turn"), "_level": F.col("_look.level")}).drop("_look")


def _crowded(cells: DataFrame) -> dict[tuple, list[int]]:
    """{cell: [parts of a, parts of b]} of the cells with over DENSE rows of a side and over 1/SHARE of all its rows, fewer than
    2 SHARE. cells: _side, CELL."""
    counts = cells.groupBy("_side", *CELL).agg(F.count("*").alias("_n")).where(F.col("_n") > DENSE)
    total = {r[0]: r[1] for r in cells.groupBy("_side").count().collect()}
    if not total:  # one side is empty, so the other looks for nothing
        return {}
    large = counts.where(reduce(lambda p, q: p | q, ((F.col("_side") == side) & (F.col("_n") * SHARE > n) for side, n in total.items())))
    out: dict[tuple, list[int]] = {}
    for side, *cell_, n in large.collect():
        out.setdefault(tuple(cell_), [1, 1])[side] = math.ceil(n / DENSE)
    return out


def _dealt(df: DataFrame, crowded: dict[tuple, list[int]], own: int) -> DataFrame:
    """`df` with `_u` and `_v`: the parts of a crowded cell that a row goes to: one of its own side's and all of the other side's."""
    known = df.sparkSession.createDataFrame([(*c, p) for c, p in crowded.items()], "_turn int, _level int, _x long, _y long, _p array<int>")
    df = df.join(F.broadcast(known), list(CELL), "left").withColumn("_p", F.coalesce("_p", F.array(F.lit(1), F.lit(1))))
    mine = F.pmod(F.monotonically_increasing_id(), F.get("_p", own)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.get("_p", 1 - own) - 1))
    place, spread = ("_u", "_v") if own == 0 else ("_v", "_u")
    return df.withColumn(place, mine).withColumn(spread, others).drop("_p")


def _met(a: DataFrame, box_a: tuple[Column, ...], b: DataFrame, box_b: tuple[Column, ...], size: float, same: list[tuple[str, str]] = (), spread: bool = False) -> DataFrame:
    """Rows of a and b, whose column names differ, for each pair of boxes that meet and that agrees in the columns `same` (null
    equals null). With `spread` the cells stay in as many tasks as the session has shuffle partitions, for rows that become much more later.

    One small pass over the boxes tells which levels the two sides have; only a side with more than DENSE rows can have
    crowded cells, and then a second one counts them.
    """
    whole = lambda df, box: df.where(reduce(lambda p, q: p & q, (c.isNotNull() & ~F.isnan(c.cast("double")) for c in box)) & (box[0] <= box[2]) & (box[1] <= box[3]))
    a, b = whole(a, box_a), whole(b, box_b)
    own_a, own_b = home_level(box_a, size), home_level(box_b, size)
    counts = a.select(F.lit(0).alias("side"), own_a.alias("level")).union(b.select(F.lit(1), own_b)).groupBy("side", "level").count()
    found = [tuple(r) for r in counts.collect()]  # at most one for each level
    in_a, in_b = (sorted(level for side, level, _ in found if side == k) for k in (0, 1))
    # turn 1: b at home, a there or on a lower level; turn 2: a at home, b on a lower level
    look = lambda turn, level: F.struct(F.lit(turn).alias("turn"), level.alias("level"))
    on = lambda turn, level, when: F.when(when, look(turn, F.lit(level)))
    looks_a = F.array(*(on(1, k, own_a <= k) for k in in_b), F.when(own_a > (in_b or [TOP])[0], look(2, own_a)))
    looks_b = F.array(look(1, own_b), *(on(2, k, own_b < k) for k in in_a if in_b and k > in_b[0]))
    some = lambda looks: F.filter(looks, lambda x: x.isNotNull())
    if len({*in_a, *in_b}) == 1:
        looks_a = looks_b = F.array(look(1, F.lit(in_a[0] if in_a else in_b[0])))
    left, right = _in_cells(a, box_a, size, some(looks_a)), _in_cells(b, box_b, size, some(looks_b))
    keys = list(CELL)
    if any(sum(n for side, _, n in found if side == k) > DENSE for k in (0, 1)):
        crowded = _crowded(left.select(F.lit(0).alias("_side"), *CELL).union(right.select(F.lit(1), *CELL)))
        if crowded:
            left, right, keys = _dealt(left, crowded, 0), _dealt(right, crowded, 1), [*CELL, "_u", "_v"]
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = _extents(box_a, size), _extents(box_b, size)
    long = _long(size, F.col("_level"))
    here = (F.col("_x") == F.floor(F.greatest(ax1, bx1) / long)) & (F.col("_y") == F.floor(F.greatest(ay1, by1) / long))
    meets = (box_a[0] <= box_b[2]) & (box_b[0] <= box_a[2]) & (box_a[1] <= box_b[3]) & (box_b[1] <= box_a[3])
    if same:
        left, right = (df.withColumn("_same", F.xxhash64(*(pair[k] for pair in same))) for k, df in enumerate((left, right)))
        keys, meets = [*keys, "_same"], reduce(lambda p, q: p & q, (F.col(x).eqNullSafe(F.col(y)) for x, y in same), meets)
    if spread:
        n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    return left.join(right, keys).where(here & meets).drop(*keys)


def _suffixed(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{c}_b") for c in df.columns))


def spatial_join(a: DataFrame, b: DataFrame, size: float = 1.0, spread: bool = False) -> DataFrame:
    """Rows of a and b (columns of b with suffix _b) whose boxes meet; touching counts. Boxes with null or NaN ends, and boxes
    whose ends are the wrong way round, meet nothing. `size` is the length of the finest cells; `spread` as in `_met`."""
    return _met(a, tuple(F.col(c) for c in BOX), _suffixed(b), tuple(F.col(f"{c}_b") for c in BOX), size, spread=spread)


def points_in(points: DataFrame, boxes: DataFrame, size: float = 1.0, keep: bool = False, spread: bool = False) -> DataFrame:
    """Points (lon, lat) with the boxes that hold them (suffix _b); `keep` keeps points outside all boxes, with nulls."""
    at, right = (F.col("lon"), F.col("lat")), _suffixed(boxes)
    met = _met(points, at * 2, right, tuple(F.col(f"{c}_b") for c in BOX), size, spread=spread)
    if not keep:
        return met
    held = met.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct()
    outside = points.join(held, (at[0] == F.col("_lon")) & (at[1] == F.col("_lat")), "left_anti")
    return met.unionByName(outside.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields)))


def by_shape(df: DataFrame, geometry: str, also: tuple[str, ...] = ()) -> DataFrame:
    """`geometry`, box, `also` and `members`: an array of structs of the other columns of rows that agree in these, TOGETHER at most;
    more rows of a shape stand in several. What depends on shapes alone, as joins by place and overlays, is so done once for equal ones.

    A shape with over DENSE rows is dealt to several groups first. Rows without a box are left out. The table is written once to
    the shared folder, as joins read it several times.
    """
    shape = [geometry, *BOX, *also]
    rest = [F.col(c) for c in df.columns if c not in shape]
    boxed = df.where("minx is not null").withColumn("_of", F.xxhash64(geometry, *BOX))
    many = boxed.groupBy("_of").agg(F.ceil(F.count("*") / DENSE).alias("_parts")).where("_parts > 1")
    dealt = boxed.join(F.broadcast(many), "_of", "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))))
    every = dealt.groupBy("_of", *shape, "_part").agg(F.collect_list(F.struct(*rest)).alias("_every"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_every") - 1) / TOGETHER)), lambda k: F.slice("_every", (k * TOGETHER + 1).cast("int"), TOGETHER))
    return stored(every.select(*shape, F.explode(runs).alias("members")), "shapes")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """Points (lon, lat) with `id_b` of each polygon (id, rings, box) that holds them, on its border included; equal polygons are tested once."""
    met = points_in(points, by_shape(polygons.select("id", "rings", *BOX), "rings"), size, spread=True)
    held = met.where(R.holds("rings_b", "lon", "lat"))
    return held.select(*points.columns, F.explode("members_b").alias("_b")).select(*points.columns, F.col("_b.id").alias("id_b"))


def semi(a: DataFrame, b: DataFrame, size: float = 1.0, anti: bool = False) -> DataFrame:
    hit = spatial_join(a.select("collection_id", "id", *BOX), b.select("id", *BOX), size).select("collection_id", "id").distinct()
    return a.join(hit, ["collection_id", "id"], "left_anti" if anti else "left_semi")


def clip(df: DataFrame, other: str = "_b") -> DataFrame:
    """The common box of a joined pair, with its area; pairs that only touch have none."""
    out = df.withColumns(
        {
            "ix1": F.greatest("minx", f"minx{other}"), "iy1": F.greatest("miny", f"miny{other}"),
            "ix2": F.least("maxx", f"maxx{other}"), "iy2": F.least("maxy", f"maxy{other}"),
        }
    )
    return out.withColumn("area", (F.col("ix2") - F.col("ix1")) * (F.col("iy2") - F.col("iy1"))).where("ix2 > ix1 and iy2 > iy1")


def pixels_in(pixels: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """Pixels with the zones (suffix _b) that hold their centres; zones are polygons where they have `rings`, else boxes."""
    met = points_in(pixels, zones, size)
    return met.where(R.holds("rings_b", "lon", "lat")) if "rings" in zones.columns else met


def zonal_statistics(zones: DataFrame, pixels: DataFrame, size: float = 18.0) -> DataFrame:
    """Per zone and band: counts, min, max, mean, sum, deviation, median and percentiles of the pixels that are not masked.

    Pixels are counted by value before anything else, so a zone of any size is spread over tasks.
    """
    keys, v, n = ["zone", "band"], F.col("value"), F.col("n")
    met = pixels_in(pixels, zones, size).select(F.col("id_b").alias("zone"), "band", F.when(~F.col("masked"), F.col("value")).alias("value"), "masked")
    counts = met.groupBy(*keys, "masked", "value").agg(F.count("*").alias("n"))
    valid = F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0))
    stats = counts.groupBy(*keys).agg(
        valid.alias("valid_pixels"), F.coalesce(F.sum(F.when(F.col("masked"), n)), F.lit(0)).alias("masked_pixels"), F.round(valid * 100.0 / F.sum(n), 6).alias("valid_percent"),
        F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))).alias("mean"), F.sum(v * n).alias("sum"),
    )
    means = stats.select(F.col("zone").alias("of_zone"), F.col("band").alias("of_band"), F.col("mean"))
    same = F.col("zone").eqNullSafe(F.col("of_zone")) & F.col("band").eqNullSafe(F.col("of_band"))
    spread = counts.join(means, same).groupBy(*keys).agg(F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum(F.when(v.isNotNull(), n))).alias("std"))
    shares = {"median": 0.5, "percentile_2": 0.02, "percentile_98": 0.98}
    out = stats
    for more in (spread, quantiles(counts, keys, shares)):
        more = more.withColumnsRenamed({"zone": "of_zone", "band": "of_band"})
        out = out.join(more, same, "left").drop("of_zone", "of_band")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "percentile_2", "percentile_98")})


def zonal_values(zones: DataFrame, pixels: DataFrame, size: float = 18.0) -> DataFrame:
    """(zone, band, value, n): how often each value stands in the pixels that are not masked."""
    return pixels_in(pixels, zones, size).where("not masked and value is not null").groupBy(F.col("id_b").alias("zone"), "band", "value").agg(F.count("*").alias("n"))


def zonal_categories(zones: DataFrame, pixels: DataFrame, size: float = 18.0) -> DataFrame:
    """Per zone and band: number of values, the most and the least frequent one (ties to the smaller value)."""
    return zonal_values(zones, pixels, size).groupBy("zone", "band").agg(
        F.count("*").alias("unique"), F.max_by("value", F.struct("n", -F.col("value"))).alias("majority"), F.min_by("value", F.struct("n", "value")).alias("minority")
    )


def zonal_histogram(zones: DataFrame, pixels: DataFrame, bins: int = 10, size: float = 18.0) -> DataFrame:
    """(zone, band, bin, n): pixels that are not masked in equal parts of their zone's and band's range; bins without pixels have no
    row, the greatest value is in the last bin, and a range of one value is bin 0. Values are counted before they are binned."""
    counts = zonal_values(zones, pixels, size)
    range_ = counts.groupBy("zone", "band").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    return counts.join(range_, ["zone", "band"]).groupBy("zone", "band", place.alias("bin")).agg(F.sum("n").alias("n"))
