"""Published unit cases, kept as data."""

import pytest
from pyspark.sql import functions as F

from flightline.operators import cleaning as cl
from flightline.operators import identity as idn
from flightline.operators import segments as seg
from flightline.operators.blocks import Series

CLEAN = [(i, 130.0, 40.0 + 25 * i) for i in range(7)]
MAKES = {
    "clean": (CLEAN, 1),
    "pass": ([(i, 40.0 + 20 * i, 120.0) for i in range(10)], 0),
    "bounce": ([(i, 130.0, 40.0 + 25 * i) for i in range(4)] + [(4 + i, 130.0, 130.0 - 25 * i) for i in range(4)], 0),
    "wide": ([(i, 300.0, 40.0 + 25 * i) for i in range(7)], 0),
    "gappy": ([(0, 130.0, 40.0), (1, 130.0, 65.0), (5, 130.0, 190.0)], 1),
    "two": (CLEAN + [(200 + f, x, y) for f, x, y in CLEAN], 2),
    "near": (CLEAN + [(20 + f, x, y) for f, x, y in CLEAN], 1),
}


def test_makes(spark):
    rows = [(k, f, i, x, y) for k, (pts, _) in MAKES.items() for i, (f, x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "video string, frame long, seq long, x double, y double")
    s = Series(("video",), "frame", "seq", 16.0)
    hoop = {"x1": F.lit(100.0), "x2": F.lit(160.0), "y1": F.lit(100.0), "y2": F.lit(140.0)}
    found = seg.passes_through(df, s, hoop)
    out = Series(("video",), "exit_frame", "seq", 16.0)
    kept = {r["video"]: r["n"] for r in seg.spaced(found, out, 60).groupBy("video").agg(F.count("*").alias("n")).collect()}
    assert {k: kept.get(k, 0) for k in MAKES} == {k: n for k, (_, n) in MAKES.items()}


SAMPLES = [("red", 2.0, 220.0, 200.0), ("red", 178.0, 210.0, 190.0), ("cyan", 90.0, 200.0, 210.0), ("lime", 40.0, 200.0, 200.0),
           ("white", 0.0, 10.0, 245.0), ("black", 0.0, 10.0, 20.0)]


def test_colours(spark):
    refs = idn.calibrate(spark.createDataFrame(SAMPLES, "name string, h double, s double, v double"), ["name"])
    red = refs.filter("name = 'red'").first()["h"]
    assert red < 5 or red > 175
    obs = [(1.0, 215.0, 195.0, "red"), (92.0, 190.0, 200.0, "cyan"), (92.0, 170.0, 120.0, "cyan"), (0.0, 8.0, 240.0, "white"),
           (0.0, 8.0, 25.0, "black"), (150.0, 5.0, 250.0, "white")]
    got = idn.classify(spark.createDataFrame(obs, "h double, s double, v double, want string"), refs).collect()
    assert [r["match"] for r in got] == [r["want"] for r in got]
    one = spark.createDataFrame([(62.0, 200.0, 200.0)], "h double, s double, v double")
    close = spark.createDataFrame([("a", 60.0, 200.0, 200.0), ("b", 64.0, 200.0, 200.0)], "name string, h double, s double, v double")
    assert idn.classify(one, close).first()["confidence"] < 0.3
    assert idn.classify(one, close.limit(0)).first()["match"] is None
    assert idn.classify(one, close.limit(1)).first()["confidence"] == 1.0


CASES = {
    "single": ([(1, 0, 100, {"red": 5.0})], ["red", "cyan", "lime"], {1: "p1"}),
    "rival": ([(1, 0, 100, {"red": 9.0, "cyan": 1.0}), (2, 50, 150, {"red": 4.0, "cyan": 3.0})], ["red", "cyan", "lime"], {1: "p1", 2: "p2"}),
    "apart": ([(1, 0, 50, {"red": 5.0}), (2, 60, 100, {"red": 5.0})], ["red", "cyan", "lime"], {1: "p1", 2: "p1"}),
    "blind": ([(1, 0, 100, {}), (2, 10, 90, {}), (3, 20, 80, {})], ["red", "cyan", "lime"], {1: None, 2: None, 3: None}),
    "elimination": ([(1, 0, 100, {"red": 9.0}), (2, 10, 90, {})], ["red", "cyan"], {1: "p1", 2: "p2"}),
}
PLAYERS = {"red": "p1", "cyan": "p2", "lime": "p3"}


@pytest.mark.parametrize("case", CASES)
def test_identity(spark, case):
    tracklets, colours, want = CASES[case]
    df = spark.createDataFrame([("v", *t) for t in tracklets], "video string, tid long, t0 long, t1 long, votes map<string,double>")
    roster = spark.createDataFrame([(c, PLAYERS[c]) for c in colours], "colour string, player string")
    grouped = idn.overlap_groups(df, Series(("video",), "t0", "tid", 40.0), "t1")
    got = {r["tid"]: r["player"] for r in idn.assign(grouped, roster, ["video", "overlap_group"], "tid").collect()}
    assert got == want


def test_parked_ball(spark):
    rows = [("v", f, f * 2, 424.0, 2084.0, 0.88) for f in range(200)]
    rows += [("v", f, f * 2 + 1, 500.0 + 12 * f, 900.0 - 2 * f, 0.31) for f in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "video string, frame long, seq long, x double, y double, conf double")
    frames = spark.range(200).select(F.lit("v").alias("video"), F.col("id").alias("frame"))
    kept = cl.moving_ball(df, frames, ["video"], ["seq"]).collect()
    assert len(kept) == 67 and all(abs(r["x"] - 424) > 50 for r in kept)
    moving = df.filter("conf < 0.5 AND frame < 60")
    assert cl.drop_parked(moving, ["video"], size=45, frames=frames).count() == moving.count()
