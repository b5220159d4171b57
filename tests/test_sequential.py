"""Block-wise operators against the plain loop they stand for, on small random data with several blocks per key."""

import random

import numpy as np
from pyspark.sql import functions as F

from flightline.operators import arcs as ar
from flightline.operators import matching as mt
from flightline.operators import tracking as tk
from flightline.operators.blocks import Series
from flightline.operators.quantiles import UPPER_MEDIAN, quantiles


def loop_tracks(dets, radius, p):
    """The tracker as one straight loop; dets are (frame, seq, x, y, conf)."""
    live, owner = [], {}
    for f in sorted({d[0] for d in dets}):
        now = sorted((d for d in dets if d[0] == f), key=lambda d: (-d[4], d[1]))
        cand = []
        for i, t in enumerate(live):
            g = f - t["f"]
            k = min(g, p.predict_cap)
            px, py = t["x"] + t["vx"] * k, t["y"] + t["vy"] * k
            lim = min(radius + p.slack * max(0, g - 1), p.ceiling)
            for j, d in enumerate(now):
                r = ((d[2] - px) ** 2 + (d[3] - py) ** 2) ** 0.5
                if r <= lim:
                    cand.append((r, i, j))
        ti, dj = set(), set()
        for r, i, j in sorted(cand):
            if i in ti or j in dj:
                continue
            ti.add(i)
            dj.add(j)
            t, d = live[i], now[j]
            g = max(1, f - t["f"])
            t.update(vx=.5 * t["vx"] + .5 * (d[2] - t["x"]) / g, vy=.5 * t["vy"] + .5 * (d[3] - t["y"]) / g, f=f, x=d[2], y=d[3], miss=0)
            owner[d[1]] = t["id"]
        for i, t in enumerate(live):
            if i not in ti:
                t["miss"] += 1
        live = [t for t in live if t["miss"] <= p.max_miss]
        for j, d in enumerate(now):
            if j not in dj and d[4] >= p.new_conf:
                live.append(dict(id=d[1], f=f, x=d[2], y=d[3], vx=0.0, vy=0.0, miss=0))
                owner[d[1]] = d[1]
    sizes = {}
    for t in owner.values():
        sizes[t] = sizes.get(t, 0) + 1
    return {q: t for q, t in owner.items() if sizes[t] >= p.min_track}


def moving_balls(rnd, n_frames, seq0):
    rows, seq = [], seq0
    for ball in range(3):
        x, y, vx, vy = rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.uniform(-20, 20), rnd.uniform(-20, 20)
        for f in range(n_frames):
            x, y = x + vx, y + vy
            if rnd.random() < 0.7:
                rows.append((f, seq, round(x + rnd.uniform(-4, 4), 1), round(y + rnd.uniform(-4, 4), 1), round(rnd.random(), 3)))
                seq += 1
            if rnd.random() < 0.05:
                vx, vy = rnd.uniform(-20, 20), rnd.uniform(-20, 20)
    return rows


def test_tracker_equals_loop(spark):
    rnd, p = random.Random(7), tk.Tracker(slack=8.0, ceiling=120.0)
    per = {v: moving_balls(rnd, n, 1000 * i) for i, (v, n) in enumerate((("hot", 260), ("cold", 40)))}
    rows = [(v, *d) for v, ds in per.items() for d in ds]
    df = spark.createDataFrame(rows, "video string, frame long, seq long, x double, y double, conf double").withColumn("radius", F.lit(60.0))
    got = {(r["video"], r["seq"]): r["track_id"] for r in tk.build_tracks(df, Series(("video",), "frame", "seq", 50.0), p).collect()}
    want = {(v, q): t for v, ds in per.items() for q, t in loop_tracks(ds, 60.0, p).items()}
    assert got == want


def events(spark, rnd, n, name, t):
    rows = [(rnd.choice(["hot", "hot", "b"]), i, round(rnd.uniform(0, 200), 1), rnd.choice([0, 1, None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"video string, {name} long, {t} double, {name[0]}hoop long")


def agree(a, b):
    return a is None or b is None or a == b


def test_matching_rules_equal_loops(spark):
    rnd = random.Random(11)
    marks, m_df = events(spark, rnd, 60, "mark", "mt")
    calls, c_df = events(spark, rnd, 70, "call", "ct")
    pairs = sorted((abs(c[2] - m[2]), m[1], c[1]) for m in marks for c in calls if m[0] == c[0] and abs(c[2] - m[2]) <= 4 and agree(m[3], c[3]))
    um, uc, want = set(), set(), set()
    for _, m, c in pairs:
        if m not in um and c not in uc:
            um.add(m)
            uc.add(c)
            want.add((m, c))
    assert {(r["mark"], r["call"]) for r in mt.match_events(m_df, c_df, ["video"], 4.0).collect()} == want
    for nearest, use_hoop in ((False, True), (True, False)):
        used, want = set(), set()
        for m in sorted(marks, key=lambda m: (m[2], m[1])):
            ok = [c for c in sorted(calls, key=lambda c: (c[2], c[1])) if c[1] not in used and c[0] == m[0] and abs(c[2] - m[2]) <= 4
                  and (not use_hoop or c[3] is None or m[3] == c[3])]
            if ok:
                best = min(ok, key=lambda c: abs(c[2] - m[2])) if nearest else ok[0]
                used.add(best[1])
                want.add((m[1], best[1]))
        got = mt.in_order(m_df, c_df, ["video"], 4.0, nearest, use_hoop, 25.0)
        assert {(r["mark"], r["call"]) for r in got.collect()} == want


def test_arcs_equal_refits():
    """Stretches grown one point at a time with a new least-squares fit each."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(4, 120))
        t = np.cumsum(rng.choice([0.0, 0.03, 0.03, 0.2], n))
        x, y = 100 + 90 * t + rng.normal(0, 6, n), 300 - 200 * t + rng.choice([60, 150]) * t * t + rng.normal(0, 6, n)
        y[n // 3:n // 2] = 120.0
        rows = []
        for end in range(5, n + 1):
            holds = lambda i: (f := ar.ballistic(t[i:end], x[i:end], y[i:end])) is not None and f[0] > 0 and f[5] <= 14.0  # noqa: B023, E731
            reach = []
            for i in range(end - 5, -1, -1):
                if reach:
                    a, b, c, d, e, _ = ar.ballistic(t[i + 1:end], x[i + 1:end], y[i + 1:end])
                    k = t[i] - t[i + 1]
                    if np.hypot(d * k + e - x[i], a * k * k + b * k + c - y[i]) > 14.0:
                        break
                if not holds(i):
                    break
                reach.append(i)
            if reach:
                f = ar.ballistic(t[reach[-1]:end], x[reach[-1]:end], y[reach[-1]:end])
                if f[0] * (t[end - 1] - t[reach[-1]]) ** 2 / 8 >= ar.MIN_SAG:
                    rows.append((-(end - reach[-1]), f[5], -end))
        got, _ = ar.longest_arc(t, x, y, 0, False, 14.0, 5)
        assert (got is None) == (not rows)
        if rows:
            best = min(rows)
            assert got[0] == -best[0] and abs(got[8] - best[1]) < 1e-6 and got[10] == t[-best[2] - 1]


def test_arcs_do_not_depend_on_blocks(spark):
    rnd = random.Random(3)
    rows = []
    for v in ("a", "b"):
        for i in range(90):
            t = i / 30
            y = 400 - 500 * t + 300 * t * t if 20 <= i < 70 else 300.0
            rows.append((v, t, i, 100 + 150 * t + rnd.uniform(-2, 2), y + rnd.uniform(-2, 2)))
    df = spark.createDataFrame(rows, "v string, t double, seq long, x double, y double")
    got = [{r["v"]: (r["n"], round(r["rms"], 6)) for r in ar.best_arcs(df, Series(("v",), "t", "seq", w), halo=h).collect()}
           for w, h in ((100.0, 32), (0.4, 4))]
    assert got[0] == got[1] and all(n >= 45 for n, _ in got[0].values())


def test_quantiles_equal_numpy(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice([rnd.gauss(0, 100), 7.0])) for k in "aab" * 150]
    got = {r["k"]: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q": 0.37, "m": 0.5, "u": UPPER_MEDIAN}, bins=8).collect()}
    for k in "ab":
        v = np.array(sorted(x for key, x in rows if key == k))
        assert np.allclose([got[k]["q"], got[k]["m"], got[k]["u"]], [np.percentile(v, 37), np.median(v), v[len(v) // 2]])


def chain(n):
    """Marks and calls in turn, each gap smaller than the one before: the walk starts at the far end and every choice hangs on the one after it."""
    at, points = 0.0, []
    for i in range(2 * n):
        points.append(at)
        at += 3.0 - i / (2 * n)
    return [("k", i, points[2 * i]) for i in range(n)], [("k", i, points[2 * i + 1]) for i in range(n)]


def test_chains_of_ever_closer_pairs_take_a_fixed_number_of_steps(spark, monkeypatch):
    real, steps = mt.cut, []
    monkeypatch.setattr(mt, "cut", lambda df: steps.append(1) or real(df))
    counts = []
    for n in (5, 1000):
        steps.clear()
        marks, calls = chain(n)
        pairs = sorted((abs(c[2] - m[2]), m[1], c[1]) for m in marks for c in calls[max(0, m[1] - 4):m[1] + 4] if abs(c[2] - m[2]) <= 7.0)
        um, uc, want = set(), set(), set()
        for _, m, c in pairs:
            if m not in um and c not in uc:
                um.add(m)
                uc.add(c)
                want.add((m, c))
        none = F.lit(None).cast("long")
        m_df = spark.createDataFrame(marks, "video string, mark long, mt double").withColumn("mhoop", none)
        c_df = spark.createDataFrame(calls, "video string, call long, ct double").withColumn("choop", none)
        assert {(r["mark"], r["call"]) for r in mt.match_events(m_df, c_df, ["video"], 7.0).collect()} == want
        counts.append(len(steps))
    assert counts[0] == counts[1]


def test_parts_too_large_for_a_task_go_in_rounds(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice("ab"), i, float(rnd.randint(0, 300))) for i in range(160)]
    marks, calls = rows[:80], rows[80:]
    none = F.lit(None).cast("long")
    pairs = mt.candidate_pairs(spark.createDataFrame(marks, "v string, mark long, mt double").withColumn("mhoop", none),
                               spark.createDataFrame(calls, "v string, call long, ct double").withColumn("choop", none), ["v"], 9.0)
    pairs = pairs.select("v", "mark", "call", "dt", F.least("mt", "ct").alias("_from"), F.greatest("mt", "ct").alias("_to"), F.struct("mark", "call").alias("_pair"))
    rank = [F.col("dt"), F.col("mark"), F.col("call")]
    want = {(r["mark"], r["call"]) for r in mt.greedy_pairs(pairs, ["mark"], ["call"], rank).collect()}
    for walk in (1, 6, 1000):
        got = mt.greedy_in_parts(pairs, Series(("v",), "_from", "_pair", 40.0), ["mark"], ["call"], rank, F.col("_to"), walk).collect()
        assert len(got) == len(want) and {(r["mark"], r["call"]) for r in got} == want


def test_people_linking_equals_loops(spark):
    """Several boxes a frame, equal distances, people who come back too late, blocks shorter than a stay."""
    rnd = random.Random(21)
    rows, seq = [], 0
    for f in range(0, 240, 3):
        for p in range(4):
            if rnd.random() < 0.7 and not (p == 2 and 90 < f < 150):
                rows.append(("v", f, seq, float(100 * p + rnd.randint(-40, 40)), float(50 * p + rnd.randint(-20, 20)), 30.0 + p))
                seq += 1
    df = spark.createDataFrame(rows, "video string, frame long, seq long, x double, y double, sw double")
    s = Series(("video",), "frame", "seq", 30.0)
    open_, want = [], {}
    for _, f, q, x, y, _ in rows:
        near = [((x - t["x"]) ** 2 + (y - t["y"]) ** 2) ** 0.5 for t in open_]
        ok = [(d, i) for i, (d, t) in enumerate(zip(near, open_)) if 0 < (f - t["f"]) / 3 <= 4 and d < 35 * (f - t["f"]) / 3]
        if not ok:
            open_.append({"id": q})
            ok = [(0, len(open_) - 1)]
        open_[min(ok)[1]].update(f=f, x=x, y=y)
        want[q] = open_[min(ok)[1]]["id"]
    assert {r["seq"]: r["track_id"] for r in tk.link_people(df, s, 3.0, 4.0, 35.0).collect()} == want
    last, want = [], {}
    for _, _, q, x, y, sw in rows:
        fits = [i for i, (px, py) in enumerate(last) if abs(x - px) < sw * 1.8 and abs(y - py) < sw * 2.2]
        i = fits[0] if fits else len(last)
        last[i:i + 1] = [(x, y)]
        want[q] = i
    assert {r["seq"]: r["person"] for r in tk.link_by_scale(df, s).collect()} == want
