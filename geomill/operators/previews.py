"""Data footprints of preview images: the largest blob of pixels that are neither padding nor cut out, and its four corners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import BLOCK, extreme_corners, filled_size, largest_area

# Up to this a pixel is near black, from this it is near white.
BLACK, WHITE = 18, 235


def data_pixels(pixels: DataFrame) -> DataFrame:
    """(raster_id, px, py) of the data pixels. pixels: raster_id, px, py, red, green, blue; pixels with a null are no data."""
    bands = ("red", "green", "blue")
    held = pixels.dropna(subset=list(bands))
    dark, light = (F.greatest(*bands) <= BLACK), (F.least(*bands) >= WHITE)
    return held.where(~dark & ~light).select(*(F.col(c).cast("long") for c in ("raster_id", "px", "py")))


def data_footprint(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """raster_id, n_pixels (holes filled) and corners of each preview's largest blob (ties: the upper, then the left one).

    Rasters are labelled by blocks of `block` x `block` pixels and joined across them, so no task holds a raster; the size of
    the blocks doesn't change the result. Previews without data have no row; repeated pixels count once.
    """
    area = largest_area(data_pixels(pixels), block)
    return filled_size(area, block).join(extreme_corners(area), "raster_id")
