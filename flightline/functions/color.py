"""Colour arithmetic on OpenCV scales (hue 0-179)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACHROMATIC_S = 60  # below this saturation hue means nothing (fixed value)
MISMATCH = 1e6


def hue_gap(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % F.lit(180)
    return F.least(d, F.lit(180) - d)


def color_distance(h: Column, s: Column, v: Column, rh: Column, rs: Column, rv: Column) -> Column:
    grey, ref_grey = s < ACHROMATIC_S, rs < ACHROMATIC_S
    vivid = hue_gap(h, rh) * 4.0 + F.abs(s - rs) * 0.35 + F.abs(v - rv) * 0.2
    return F.when(grey != ref_grey, F.lit(MISMATCH)).when(ref_grey, F.abs(v - rv)).otherwise(vivid)


def margin(best: Column, runner_up: Column) -> Column:
    """Confidence of a match from its distance and the next one's; 1 when nothing else was compared."""
    m = (runner_up - best) / F.greatest(runner_up, F.lit(1e-6))
    return F.when(runner_up.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), m)))


def hue_name(h: Column) -> Column:
    """Named bands of a hue in degrees; -1 stands for white and -2 for black (fixed values)."""
    return (F.when(h.isNull(), None).when(h == -1, "white").when(h == -2, "black")
            .when((h >= 30) & (h < 75), "yellow").when((h >= 75) & (h < 165), "green")
            .when((h >= 165) & (h < 265), "blue").otherwise("pink"))


def hue_band(h: Column, width: int = 30) -> Column:
    """Start of the hue band, -1 for white."""
    return F.when(h < 0, F.lit(-1)).otherwise(F.floor(h / width) * width).cast("long")


def circular_mean_hue(h: Column) -> Column:
    """Aggregate: mean direction on the 180-degree hue circle."""
    turn = h * F.lit(3.141592653589793) / 90
    return F.pmod(F.atan2(F.sum(F.sin(turn)), F.sum(F.cos(turn))) * 90 / F.lit(3.141592653589793), F.lit(180.0))
