import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from flightline.operators.blocks import Series, islands, neighbours, running, scan_blocks

S = Series(("k",), "t", "seq", 10.0)


def data(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(("hot" if rnd.random() < 0.7 else rnd.choice("abc")), round(rnd.uniform(0, 300), 1), i,
             float(rnd.randint(-5, 5))) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t double, seq long, v double")


def same(a, b, cols):
    x = a.select(*cols).toPandas().sort_values(cols[:3], ignore_index=True)
    y = b.select(*cols).toPandas().sort_values(cols[:3], ignore_index=True)
    pd.testing.assert_frame_equal(x, y, check_dtype=False)


def test_neighbours_equal_plain_window(spark):
    df = data(spark)
    w = Window.partitionBy("k").orderBy("t", "seq")
    want = df.withColumns({"p": F.lag("v", 3).over(w), "n": F.lead("v", 2).over(w)})
    got = neighbours(df, S, {"p": ("v", -3), "n": ("v", 2)})
    same(got, want, ["k", "t", "seq", "p", "n"])


def test_running_equal_plain_window(spark):
    df = data(spark, seed=2)
    w = Window.partitionBy("k").orderBy("t", "seq")
    odd = F.when(F.col("v") > 2, F.col("v"))
    for inclusive in (True, False):
        f = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.withColumns({"s": F.sum("v").over(f), "m": F.max("v").over(f),
                               "l": F.last(odd, ignorenulls=True).over(f)})
        got = running(df, S, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", odd)}, inclusive)
        same(got, want, ["k", "t", "seq", "s", "m", "l"])


def test_islands_span_blocks(spark):
    df = data(spark, seed=3)
    got = islands(df, S, F.col("v") > 4).groupBy("k").agg(F.max("run_id").alias("n"))
    want = df.groupBy("k").agg(F.sum((F.col("v") > 4).cast("long")).alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_scan_equals_sequential_loop(spark):
    df = data(spark, seed=4)

    def step(rows, state):
        keep, last = [], state
        for i, t in enumerate(rows["t"]):
            if last is None or t - last >= 7.3:
                keep.append(i)
                last = float(t)
        return rows.loc[keep, ["k", "t", "seq"]], last

    got = {(r.k, r.t, r.seq) for r in scan_blocks(df, S, step, "k string, t double, seq long").collect()}
    want = set()
    for k, g in df.toPandas().sort_values(["t", "seq"]).groupby("k"):
        last = None
        for t, q in zip(g["t"], g["seq"]):
            if last is None or t - last >= 7.3:
                want.add((k, t, q))
                last = t
    assert got == want
