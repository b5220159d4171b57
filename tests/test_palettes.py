"""Colour palettes of any size: the array form equals the constants, and more references than those are taken too."""

from flightline.operators import identity as idn


def test_large_palette(spark, monkeypatch):
    obs = spark.range(300).selectExpr("id", "cast(id * 7 % 180 as double) AS h", "cast(id * 13 % 256 as double) AS s", "cast(id * 29 % 256 as double) AS v")
    refs = spark.range(90).selectExpr("concat('c', id) AS name", "cast(id * 2 as double) AS h", "cast(40 + id * 11 % 200 as double) AS s", "cast(id * 17 % 256 as double) AS v")
    by_array = sorted(map(tuple, idn.classify(obs, refs).collect()))
    monkeypatch.setattr(idn, "MAX_REFS", 100)
    assert by_array == sorted(map(tuple, idn.classify(obs, refs).collect()))
    assert len(by_array) == 300 and all(r[4] for r in by_array)
