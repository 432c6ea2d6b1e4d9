import random

import numpy as np
from geomill.operators import cover as cv


def _scenes():
    rng, out = random.Random(5), []
    for n in range(400):
        shape = rng.randrange(24)
        x, y, w, h = shape % 6 * 2.0 - 2, shape // 6 * 2.0 - 2, 3.0 + shape % 4, 3.0 + shape % 3
        ring = [x, y, x + w, y, x + w, y + h, x, y + h]
        cloud = None if n % 17 == 0 else float(rng.randrange(100))
        out.append({"id": f"s{n:03}", "rings": [ring], "shape": shape, "box": cv._box(ring), "area": w * h, "cloud": cloud, "day": None if n % 40 == 0 else f"d{n % 80:02}", "order": (cloud if cloud is not None else cv.NO_CLOUD_VALUE, f"s{n:03}")})
    return sorted(out, key=lambda s: s["order"])


def test_bounds_change_no_plan_and_spare_the_kernel(monkeypatch):
    calls, kernel = [], cv.overlay
    monkeypatch.setattr(cv, "overlay", lambda *a: calls.append(1) or kernel(*a))
    area = [[0.0, 0.0, 8.0, 0.0, 8.0, 6.0, 0.0, 6.0]]

    def plans():
        calls.clear()
        found = []
        for solve in (cv.greedy, cv.by_strips):
            hole = cv.Hole(kernel([(0, area)], any))
            picks, left = solve(hole, _scenes(), hole.area)
            found.append(([(s["id"], g) for s, g in picks], left.parts))
        return found, len(calls)

    found, few = plans()
    monkeypatch.setattr(cv.Hole, "bounds", lambda self, boxes: np.full(len(boxes), np.inf))
    whole, many = plans()
    assert found == whole and all(picks for picks, _ in found)
    assert few < min(many, 8 * 20)  # before, every day of every strip was solved
