"""Assignments that list short pairs first, against the exact ones over all pairs."""

import math

import numpy as np
import pytest

from grovekit.operators import assignment, graph, spatial

COLS = ("k", "x", "y")


def points(spark, rnd, n, side):
    """Half of the points in a sixth of the side, so that places are scarce there and plenty elsewhere."""
    xy = np.concatenate([rnd.uniform(0, side / 6, (n // 2, 2)), rnd.uniform(0, side, (n - n // 2, 2))]).tolist()
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(xy)], "k long, x double, y double").coalesce(1)


@pytest.fixture
def short_first(monkeypatch):
    monkeypatch.setattr(assignment, "_steps", lambda a, b, radius: [radius / 2, radius])


def test_steps_of_a_crowded_table(spark, monkeypatch):
    monkeypatch.setattr(assignment, "PAIRS_LEAST", 10)
    p = assignment._points(points(spark, np.random.default_rng(2), 300, 150.0), COLS)
    steps = assignment._steps(p, p, 40.0)
    assert steps[0] < 40.0 and steps[-1] == 40.0 and all(b == 2 * a for a, b in zip(steps, steps[1:]))


def test_capacity_near(spark, short_first):
    n, m, radius = 120, 40, 40.0
    rnd = np.random.default_rng(n)
    a, b = points(spark, rnd, n, 150.0), points(spark, rnd, m, 150.0)
    got = {r["l"]: r for r in assignment.capacity_near(a, b, COLS, COLS, radius, slots=2, penalty=2.0, null=35.0).collect()}
    want = graph.capacity_pairs(spatial.near_join(a, b, COLS, COLS, radius), "a_id", "b_id", "d", slots=2, penalty=2.0, null=35.0).collect()
    assert len(got) == len(want) and all(got[r["l"]]["r"] == r["r"] and math.isclose(got[r["l"]]["margin"], r["margin"], abs_tol=1e-6) for r in want)


def test_optimal_near(spark, short_first):
    n, m = 120, 40
    rnd = np.random.default_rng(m)
    a, b = points(spark, rnd, n, 150.0), points(spark, rnd, m, 150.0)
    got = assignment.optimal_near(a, b, COLS, COLS, 40.0).collect()
    want = graph.optimal_pairs(spatial.near_join(a, b, COLS, COLS, 40.0), "a_id", "b_id", "d").collect()
    assert len(got) == len(want) == len({r["l"] for r in got}) == len({r["r"] for r in got})
    assert {(r["l"], r["r"]) for r in got} == {(r["l"], r["r"]) for r in want} and math.isclose(sum(r["cost"] for r in got), sum(r["cost"] for r in want))
