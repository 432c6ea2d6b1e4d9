"""Areas of pixels across blocks: flood fill, spirals through many blocks, holes that span blocks."""

import random

import pytest

from geomill.operators import blobs, previews as pv

PIXELS = "raster_id long, px long, py long, red int, green int, blue int"


def flood(cells):
    todo, out = set(cells), []
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            x, y = edge.pop()
            group.add((x, y))
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in todo:
                    todo.remove(q)
                    edge.append(q)
        out.append(group)
    return out


def expected(data):
    largest = min(flood(data), key=lambda b: (-len(b), min((y, x) for x, y in b)))
    xs, ys = [x for x, _ in largest], [y for _, y in largest]
    frame = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)}
    outside = next(b for b in flood(frame - largest) if (min(xs) - 1, min(ys) - 1) in b)
    p = {(x + a, -y - b) for x, y in largest for a in (0, 1) for b in (0, 1)}
    ends = (
        min(p, key=lambda q: (q[0] + q[1], q)), max(p, key=lambda q: (q[1] - q[0], -q[0], q[1])),
        max(p, key=lambda q: (q[0] + q[1], q)), max(p, key=lambda q: (q[0] - q[1], q[0], -q[1])),
    )
    return len(frame) - len(outside), [[x, -y] for x, y in ends]


def spiral(n):
    """One path of pixels that winds inwards with gaps of one pixel."""
    x = y = 0
    dx, dy, data, length = 1, 0, {(0, 0)}, n
    while length > 1:
        for _ in range(2):
            for _ in range(length):
                x, y = x + dx, y + dy
                data.add((x, y))
            dx, dy = -dy, dx
        length -= 2
    return data


@pytest.mark.parametrize("block", (4, 256))
def test_footprints_equal_flood_fill_for_any_block(spark, block):
    rng = random.Random(block)
    rasters = {k: {(x, y) for x in range(23) for y in range(17) if rng.random() < 0.6} for k in range(4)}
    rasters[7] = {(x - 9, y - 5) for x, y in spiral(20)}  # negative places too
    rasters[8] = {(x, y) for x in range(20) for y in range(20) if min(x, y, 19 - x, 19 - y) < 2 or (8 < x < 12 and 8 < y < 12)}  # an island in a hole
    rasters[9] = {(0, 0), (1, 0), (5, 5), (6, 5)}  # a tie
    rows = [(k, x, y, 100, 100, 100) for k, data in rasters.items() for x, y in data]
    rows += rows[:9] + [(5, 0, 0, 3, 4, 5), (5, 1, 0, 255, 240, 236), (None, 1, 1, 100, 100, 100), (1, None, 1, 100, 100, 100), (6, 1, 1, None, 100, 100)]
    rng.shuffle(rows)
    got = {r.raster_id: (r.n_pixels, r.corners) for r in pv.data_footprint(spark.createDataFrame(rows, PIXELS), block).collect()}
    assert got == {k: expected(data) for k, data in rasters.items()}


def test_empty_table(spark):
    assert pv.data_footprint(spark.createDataFrame([], PIXELS)).collect() == []
    assert blobs.joined_runs([]) == []
