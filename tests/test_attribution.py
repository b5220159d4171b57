"""Walking a flight back among people who move, against the plain loop."""

import random

from flightline.operators import attribution as at


def loop(flight, samples, reach, back, step, near, hands_up):
    _, _, release, t0, a, b, c, d, e = flight
    people = sorted({s[1] for s in samples})
    for k in range(1, int(back / step) + 1):
        t = release - k * step
        x, y = d * (t - t0) + e, a * (t - t0) ** 2 + b * (t - t0) + c
        for person in people:
            mine = [s for s in samples if s[1] == person]
            if min(s[4] for s in mine) > at.NEVER_HELD:
                continue
            _, _, ts, _, _, lift, side, x1, y1, x2, y2 = min(mine, key=lambda s: (abs(s[2] - t), s[2], s[3]))
            if abs(ts - t) > near or hands_up and not lift > 0 or side == 0 and not lift > 0:
                continue
            dist = (max(x1 - x, 0, x - x2) ** 2 + max(y1 - y, 0, y - y2) ** 2) ** 0.5
            if dist <= reach:
                return k, person, dist
    return None


def test_walk_back_among_moving_people(spark):
    rnd = random.Random(4)
    flights, samples = [], []
    for v in range(12):
        flights.append((v, v, 10.0, 9.9, 300.0, -200.0, 300.0, rnd.uniform(-400, 400), 500.0))
        flights.append((v, 100 + v, 10.7, 10.5, 250.0, -100.0, 200.0, rnd.uniform(-400, 400), 400.0))
        for person in "abcd":
            x, y, speed, held = rnd.uniform(0, 1000), rnd.uniform(0, 600), rnd.uniform(-300, 300), rnd.random() < 0.8
            for i in range(rnd.choice([3, 20, 90])):
                t = round(rnd.uniform(8.4, 11.0), 2) if i % 5 else 9.5  # repeated moments, gaps longer than the reach
                px, py = x + speed * (t - 9), y
                samples.append((v, person, t, len(samples), rnd.uniform(0.5, 3) if held else 5.0, rnd.uniform(-1, 1), rnd.choice([-1, 0, 1, None]), px - 40, py - 60, px + 40, py + 60))
    fl = spark.createDataFrame(flights, "video int, shot int, release_t double, t0 double, a double, b double, c double, d double, e double")
    sm = spark.createDataFrame(samples, "video int, person string, t double, seq long, gap double, lift double, side int, px1 double, py1 double, px2 double, py2 double")
    for hands_up in (False, True):
        got = {r["shot"]: (r["steps"], r["person"], round(r["dist"], 6)) for r in at.walk_back_among(fl, sm, ["video"], ["shot"], hands_up=hands_up).collect()}
        want = {f[1]: loop(f, [s for s in samples if s[0] == f[0]], 90.0, 1.2, 1 / 60, 0.25, hands_up) for f in flights}
        assert got == {k: (v[0], v[1], round(v[2], 6)) for k, v in want.items() if v}
        assert len(got) > 5
    assert at.walk_back_among(fl, sm.limit(0), ["video"], ["shot"]).collect() == []


def test_attribute_with_moving_people_and_caps(spark):
    arc = (10.0, 10.0, 0.0, 0.0, 300.0, 100.0, 500.0)  # level flight to the right: x = 500 + 100 (t - 10)
    fl = spark.createDataFrame([(1, i, 500.0, 300.0, *arc) for i in range(1, 4)] + [(2, 4, 500.0, 300.0, *arc)],
                               "video int, mark int, release_x double, release_y double, release_t double, t0 double, a double, b double, c double, d double, e double")
    # shot 1 has someone at the release, shot 2 someone too far with a cap there, shot 3 and 4 nobody; in video 1 "w" swims into the arc's past
    ppl = spark.createDataFrame([(1, "n", 480.0, 280.0, 520.0, 320.0, True, None, None), (2, "f", 300.0, 280.0, 320.0, 320.0, True, None, None)],
                                "mark int, person string, px1 double, py1 double, px2 double, py2 double, up boolean, turn double, face double")
    samples = spark.createDataFrame([(1, "w", 9.2, 1, 0.5, 1.0, 1, 300.0, 250.0, 330.0, 350.0), (1, "w", 10.0, 2, 0.5, 1.0, 1, 0.0, 0.0, 10.0, 10.0)],
                                    "video int, person string, t double, seq long, gap double, lift double, side int, px1 double, py1 double, px2 double, py2 double")
    caps = spark.createDataFrame([(1, 7, 10.1, 510.0, 300.0, 30.0)], "video int, cap int, t double, x double, y double, w double")
    cands = spark.createDataFrame([(4, "r", 1)], "mark int, person string, rank int")
    shots = spark.createDataFrame([(i,) for i in range(1, 6)], "mark int")
    out = at.attribute(shots, fl, ppl, cands, ["mark"], samples, caps, ["video"])
    got = {r["mark"]: (r["person"], r["cap"], r["how"]) for r in out.collect()}
    assert got[1] == ("n", None, "arc") and got[2] == (None, 7, "cap") and got[4] == ("r", None, "release") and got[5] == (None, None, "none")
    # x at 9.2 is 420, 90 from the box of "w" there: found only where "w" was then
    assert got[3] == ("w", None, "walked back")
