"""Reading a 17-point pose held as ARRAY<STRUCT<x,y,c>>.  Indices follow the COCO order (fixed values)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NOSE, LEYE, REYE, LEAR, REAR, LSH, RSH, LELB, RELB, LWR, RWR, LHIP, RHIP = range(13)
CONF, WRIST_CONF = 0.25, 0.3
MIN_SHOULDERS, READABLE_SHOULDERS, DEAD_BAND = 8.0, 26.0, 0.15


def joint(kp: Column, i: int) -> Column:
    return kp[i]


def seen(kp: Column, i: int, conf: float = CONF) -> Column:
    return joint(kp, i)["c"] > conf


def visible(kp: Column, idx: Sequence[int], conf: float = CONF) -> Column:
    """The joints of ``idx`` that are confident enough, as an array."""
    return F.filter(F.array(*[joint(kp, i) for i in idx]), lambda j: j["c"] > conf)


def count_seen(kp: Column, idx: Sequence[int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(seen(kp, i), 1).otherwise(0) for i in idx])


def mean_of(kp: Column, idx: Sequence[int], axis: str) -> Column:
    """Mean coordinate of the visible joints, null when none is."""
    total = reduce(lambda a, b: a + b, [F.when(seen(kp, i), joint(kp, i)[axis]).otherwise(0.0) for i in idx])
    return total / F.nullif(count_seen(kp, idx), F.lit(0))


HEAD = (NOSE, LEYE, REYE, LEAR, REAR)
LIMBS = (LELB, RELB, LWR, RWR)


def body_point(kp: Column) -> Column:
    """Hip midpoint, else the one visible hip, else the same for shoulders, else null."""
    options = [F.when(count_seen(kp, pair) > 0, F.struct(mean_of(kp, pair, "x").alias("x"), mean_of(kp, pair, "y").alias("y")))
               for pair in ((LHIP, RHIP), (LSH, RSH))]
    return F.coalesce(*options)


def both_shoulders(kp: Column) -> Column:
    return seen(kp, LSH) & seen(kp, RSH)


def shoulder_gap(kp: Column) -> Column:
    dx, dy = kp[LSH]["x"] - kp[RSH]["x"], kp[LSH]["y"] - kp[RSH]["y"]
    return F.when(both_shoulders(kp), F.sqrt(dx * dx + dy * dy))


def shoulder_width(kp: Column) -> Column:
    return F.when(both_shoulders(kp), F.greatest(F.lit(12.0), shoulder_gap(kp)))


def facing(kp: Column) -> Column:
    """Unit vector the chest points along, in image axes; null without readable shoulders.

    The shoulder normal has two directions.  The default choice comes from which shoulder is on which side, limbs in
    front of the body correct it, and a visible face (or only ears) settles it.
    """
    n = shoulder_gap(kp)
    sx, sy = kp[LSH]["x"] - kp[RSH]["x"], kp[LSH]["y"] - kp[RSH]["y"]
    ax, ay = -sy / n, sx / n
    smx, smy = (kp[LSH]["x"] + kp[RSH]["x"]) / 2, (kp[LSH]["y"] + kp[RSH]["y"]) / 2
    proj = ax * (mean_of(kp, LIMBS, "x") - smx) + ay * (mean_of(kp, LIMBS, "y") - smy)
    by_order = kp[LSH]["x"] > kp[RSH]["x"]
    by_limbs = F.when(F.abs(proj) > n * 0.10, (ay > 0) == (proj > 0)).otherwise(by_order)
    by_limbs = F.coalesce(by_limbs, by_order)
    face, ears, limbs = count_seen(kp, (NOSE, LEYE, REYE)), count_seen(kp, (LEAR, REAR)), count_seen(kp, LIMBS)
    camera = (F.when(face >= 2, True).when((face == 0) & (ears >= 1) & (limbs == 0), False).otherwise(by_limbs))
    keep = (ay > 0) == camera
    return F.when(n >= MIN_SHOULDERS, F.struct(F.when(keep, ax).otherwise(-ax).alias("x"),
                                               F.when(keep, ay).otherwise(-ay).alias("y")))


def readable(kp: Column) -> Column:
    evidence = ((count_seen(kp, (NOSE, LEYE, REYE)) >= 2) | (count_seen(kp, (LEAR, REAR)) >= 1)
                | (count_seen(kp, LIMBS) >= 2))
    return F.coalesce(shoulder_gap(kp) >= READABLE_SHOULDERS, F.lit(False)) & evidence


def toward(kp: Column, target_x: Column, target_y: Column, cx: Column, cy: Column) -> Column:
    """Cosine between the chest direction and the way to a target; null when the pose cannot tell."""
    f = facing(kp)
    dx, dy = target_x - cx, target_y - cy
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(readable(kp) & (n >= 1e-6), (f["x"] * dx + f["y"] * dy) / n)


def head_x(kp: Column) -> Column:
    return F.coalesce(mean_of(kp, HEAD, "x"), F.when(both_shoulders(kp), (kp[LSH]["x"] + kp[RSH]["x"]) / 2))


def side(kp: Column) -> Column:
    """STRUCT<dir,strength>: which way the wrists point off the head, 0 inside the dead band or with one each side."""
    w = F.greatest(F.lit(12.0), F.abs(kp[LSH]["x"] - kp[RSH]["x"]))
    off = [F.when(seen(kp, i), (kp[i]["x"] - head_x(kp)) / w) for i in (LWR, RWR)]
    n = count_seen(kp, (LWR, RWR))
    m = (F.coalesce(off[0], F.lit(0.0)) + F.coalesce(off[1], F.lit(0.0))) / F.nullif(n, F.lit(0))
    straddle = (n == 2) & (F.least(*off) < -DEAD_BAND) & (F.greatest(*off) > DEAD_BAND)
    flat = straddle | (F.abs(m) < DEAD_BAND)
    ok = head_x(kp).isNotNull() & both_shoulders(kp) & (n > 0)
    return F.when(ok, F.struct(
        F.when(flat, 0).when(m > 0, 1).otherwise(-1).alias("dir"),
        F.when(flat, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.abs(m))).alias("strength")))


def side_toward(kp: Column, target_x: Column, body_x: Column) -> Column:
    """+strength toward the target, -strength away, 0 square on, null when not readable."""
    s = side(kp)
    want = F.when(target_x > body_x, 1).otherwise(-1)
    return F.when(s.isNotNull() & body_x.isNotNull(), F.when(s["dir"] == 0, F.lit(0.0)).otherwise(
        F.when(s["dir"] == want, s["strength"]).otherwise(-s["strength"])))


def lift_and_gap(kp: Column, ball_x: Column, ball_y: Column) -> tuple[Column, Column]:
    """Hands above the head, and the nearer wrist's distance to the ball, both in shoulder widths."""
    head = mean_of(kp, HEAD, "y")
    sw = shoulder_width(kp)
    wrists = [F.when(seen(kp, i, WRIST_CONF), kp[i]) for i in (LWR, RWR)]
    lift = F.greatest(*[head - w["y"] for w in wrists]) / sw
    far = [F.sqrt((w["x"] - ball_x) * (w["x"] - ball_x) + (w["y"] - ball_y) * (w["y"] - ball_y)) for w in wrists]
    ok = head.isNotNull() & sw.isNotNull() & (wrists[0].isNotNull() | wrists[1].isNotNull())
    return F.when(ok, lift), F.when(ok, F.least(*far) / sw)
