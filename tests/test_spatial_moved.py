"""Keys that occur at several locations."""

from test_spatial import brute, points

from tidemark.operators import spatial as S


def test_keys_at_several_locations(spark):
    rows = [("A", 53.0, -8.0), ("B", 53.0, -8.0), ("A", 53.0001, -8.0), ("C", 53.0001, -8.0)]  # two near spots
    rows += [("D", 53.0, -7.0), ("E", 53.0, -7.0), ("D", 54.0, -7.0), ("F", 54.0, -7.0)]  # two distant spots
    rows += [("A", 54.0, -6.0), ("G", 54.0001, -6.0), ("D", 54.0, -5.0), ("D", 54.0001, -5.0)]
    got = {tuple(r) for r in S.near_pairs(points(spark, rows), "id", "lat", "lon", 25.0).collect()}
    assert got == brute(rows, 25.0)
    assert ("B", "C") in got and ("E", "F") not in got
