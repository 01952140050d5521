"""Neighbours found by bounds are those of the full join."""

import random

import pytest

from reviewrec.operators import itemcf

from .test_operators import rows


def planted(signed: bool, seed: int = 3) -> list[tuple]:
    """Families of items rated by users of their own, and users that rated (almost) everything."""
    draw = random.Random(seed)
    cells = {}
    for item in range(120):
        for user in range(4):
            if draw.random() < 0.9:
                cells[f"f{item // 12}-{user}", f"i{item:03}"] = draw.uniform(3, 5)
        for hot in ("hot1", "hot2"):
            if draw.random() < 0.95:
                cells[hot, f"i{item:03}"] = draw.uniform(-1, 1) if signed else draw.uniform(0.1, 1)
    cells["hot1", "lone"] = 2.0  # rated by a heavy user alone
    cells["f0-0", "zero"] = 0.0
    return [(u, i, v) for (u, i), v in cells.items()]


def both(spark, cells, k, **given):
    df = spark.createDataFrame(cells, "user_id string, item_id string, value double")
    want = itemcf.top_neighbors(itemcf.item_similarity(df), k)
    got = itemcf.nearest_items(df, k, **given)
    columns = ("item_id", "neighbor_id", "sim", "rank")
    return rows(got, *columns), rows(want, *columns)


@pytest.mark.parametrize("signed", [False, True])
def test_bounds_keep_the_rows(spark, signed, monkeypatch):
    monkeypatch.setattr(itemcf, "BLOCK", 16)
    report = {}
    got, want = both(spark, planted(signed), 5, heavy=50, report=report)
    assert got == want and got
    assert report["met"] < report["heavy"] / 2 and report["looked_up"] > 0, report


def test_random_signs_and_no_floor(spark):
    draw = random.Random(8)
    cells = [(f"u{u}", f"i{i}", draw.choice([-2.0, -1.0, 1.0, 2.0])) for u in range(12) for i in range(40) if draw.random() < (0.9 if u < 3 else 0.2)]
    for k in (3, 50):  # no item has 50 partners: all pairs are met
        got, want = both(spark, cells, k, heavy=20)
        assert got == want and got


def test_ties_at_the_floor(spark):
    cells = [(f"u{i % 3}", f"i{i:02}", 1.0) for i in range(30)] + [("hot", f"i{i:02}", 1.0) for i in range(30)]
    got, want = both(spark, cells, 4, heavy=15)
    assert got == want and len(got) == 120


def test_no_light_users_and_no_rows(spark):
    cells = [("hot", f"i{i}", float(i + 1)) for i in range(9)]
    got, want = both(spark, cells, 3, heavy=2)
    assert got == want and len(got) == 27
    assert both(spark, [], 3, heavy=2) == ([], [])
    nulls = [(None, "i0", 1.0), (None, "i1", 1.0), *cells]
    got, want = both(spark, nulls, 3, heavy=2)
    assert got == want
