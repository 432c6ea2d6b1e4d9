"""Polygons of many tiles are cut together, and as each one alone."""

import numpy as np
from geomill.operators import overlay as ov
from geomill.operators import tiles as tl


def test_tiles_of_many_polygons(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(ov, "_rowwise", lambda *a: calls.append(a))
    monkeypatch.setattr(tl, "_rowwise", lambda *a: calls.append(a), raising=False)
    rng = np.random.default_rng(4)
    rows = [(str(k), [(rng.uniform(-4, 4, (5, 2)) + rng.uniform(-80, 80, 2)).ravel().tolist() for _ in range(1 + k % 3)]) for k in range(60)]
    rows += [("none", None), ("no ring", []), ("empty", [[]]), ("pole", [[0.0, 80.0, 20.0, 80.0, 20.0, 89.0, 0.0, 89.0]]), ("flat", [[0.0, 0.0, 9.0, 0.0, 3.0, 0.0]])]
    df = ov.with_box(spark.createDataFrame(rows, "id string, rings array<array<double>>"))
    made = tl.tile_polygons(df, 4, 6)
    assert calls == []  # no row has a kernel call of its own
    got = {(r.id, r.z, r.x, r.y): r.rings for r in made.collect()}
    every, low, high = dict(rows), -256.0, 4352.0
    want = {}
    for r in tl.assign_tiles(df, 4, 6).select("id", "z", "x", "y").collect():
        placed = []
        for ring in every[r.id] or []:
            p = np.asarray(ring, float).reshape(-1, 2)
            held = np.radians(np.clip(p[:, 1], -85.0, 85.0))
            across, down = (p[:, 0] + 180) / 360 * 2**r.z, (1 - np.log(np.tan(held) + 1 / np.cos(held)) / np.pi) / 2 * 2**r.z
            placed.append(np.column_stack([(across - r.x) * 4096, (down - r.y) * 4096]).ravel())
        whole = [np.floor(np.round(q, 6) + 0.5) for q in ov.clip(placed, low, low, high, high)]
        if any(np.ptp(q[::2]) * np.ptp(q[1::2]) > 0 for q in whole):
            want[r.id, r.z, r.x, r.y] = [q.tolist() for q in whole]
    assert got == want and len(want) > 200 and {"pole"} < {k[0] for k in want} and not {k[0] for k in want} & {"none", "no ring", "empty", "flat"}
