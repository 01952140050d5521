"""Bounds that can exclude nothing are not tried: no pair is a row of a shuffle then."""

import random

from reviewrec.operators import itemcf

from .test_nearest import both, planted


def test_useless_bounds_are_left_alone(spark, monkeypatch):
    draw = random.Random(5)
    cells = [(f"u{u}", f"i{i}", draw.choice([1.0, 2.0])) for u in range(12) for i in range(40) if draw.random() < (0.9 if u < 8 else 0.2)]

    def refuse(_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(itemcf, "_met_by_bounds", refuse)
    report = {}
    got, want = both(spark, cells, 3, heavy=20, report=report)
    assert got == want and got
    assert report["met"] == report["heavy"] > report["light"] > 0 == report["looked_up"]


def test_useful_bounds_are_tried(spark):
    cells = planted(True)
    report = {}
    got, want = both(spark, cells, 5, heavy=50, report=report)
    assert got == want and report["met"] < report["heavy"]
