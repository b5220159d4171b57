"""Anchored scans without rounds: every block tells what it makes of any anchor, these maps are composed, then each block runs once.

Keeping a row only when it is far enough from the last row *kept* hangs on all rows before.  But a block's part in it is a step function from
the anchor it is handed (the last kept time before it) to the anchor it hands on, and that function follows from the block alone: one backward pass gives,
for each row that may be kept first, where the chain from it ends.  Functions of up to ``FAN`` neighbouring blocks are composed by one task, these again,
and so on; going back down, each block gets its anchor.  The number of steps is the logarithm of the blocks to the base ``FAN``,
whatever the rows look like.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.operators.blocks import Series, map_blocks, packed
from flightline.runtime import cut

FAN = 64
NONE = float("-inf")  # no row kept yet


def far(later, earlier, gap: float, strict: bool):
    """Whether a row is far enough from an anchor, judged by the subtraction itself."""
    away = later - earlier
    return away > gap if strict else away >= gap


def first_far(t: np.ndarray, anchors: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """For each anchor the first place of the sorted ``t`` that is far enough from it; ``len(t)`` if none is."""
    n = len(t)
    at = np.searchsorted(t, anchors + gap)
    while True:  # rounding of the sum may be off by a few places
        back = at > 0
        back[back] = far(t[at[back] - 1], anchors[back], gap, strict)
        if not back.any():
            break
        at = at - back
    while True:
        on = at < n
        on[on] = ~far(t[at[on]], anchors[on], gap, strict)
        if not on.any():
            return at
        at = at + on


def chain_ends(t: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """For each row the last row kept if it is kept itself: one pass from the back."""
    nxt = first_far(t, t, gap, strict)
    nxt = np.maximum(nxt, np.arange(1, len(t) + 1)).tolist()  # a gap of zero keeps every row
    ends, values = [0.0] * len(t), t.tolist()
    for i in range(len(t) - 1, -1, -1):
        ends[i] = values[i] if nxt[i] >= len(t) else ends[nxt[i]]
    return np.array(ends)


def kept_rows(t: np.ndarray, anchor: float, gap: float, strict: bool) -> list[int]:
    """The rows that a block keeps when it is handed ``anchor``."""
    nxt = np.maximum(first_far(t, t, gap, strict), np.arange(1, len(t) + 1)).tolist()
    i = int(first_far(t, np.array([anchor]), gap, strict)[0])
    kept = []
    while i < len(t):
        kept.append(i)
        i = nxt[i]
    return kept


class StepMap:
    """Anchor in, anchor out: the first of ``at`` that is far enough from the anchor decides for its entry of ``out``; if none is, the anchor stays."""

    def __init__(self, at, out, start: float):
        self.at, self.out, self.start = np.asarray(at, float), np.asarray(out, float), start

    @classmethod
    def of_rows(cls, t: np.ndarray, gap: float, strict: bool) -> StepMap:
        ends = chain_ends(t, gap, strict)
        # an anchor lies before the block, so no row after the first that is far from the block's start is ever kept first
        size = min(len(t), int(first_far(t, t[:1], gap, strict)[0]) + 1)
        return cls(t[:size], ends[:size], float(t[0])).thinned()

    def thinned(self) -> StepMap:
        """Of neighbouring entries with the same outcome the last one says it all."""
        last = np.append(self.out[1:] != self.out[:-1], True)
        return StepMap(self.at[last], self.out[last], self.start)

    def closed(self, start: float, gap: float, strict: bool) -> bool:
        """Whether every anchor before ``start`` meets an entry here."""
        return bool(far(self.at[-1], start, gap, strict))

    def __call__(self, anchors: np.ndarray, gap: float, strict: bool) -> np.ndarray:
        i = first_far(self.at, anchors, gap, strict)
        return np.where(i < len(self.at), self.out[np.minimum(i, len(self.at) - 1)], anchors)

    @staticmethod
    def composed(maps: list[StepMap], gap: float, strict: bool) -> StepMap:
        """One map after the other.  Anchors that go through the first maps untouched meet the entries of the next."""
        start, at, out = maps[0].start, [], []
        for k, m in enumerate(maps):
            values = m.out
            for later in maps[k + 1:]:
                values = later(values, gap, strict)
            at.append(m.at)
            out.append(values)
            if m.closed(start, gap, strict):
                break
        return StepMap(np.concatenate(at), np.concatenate(out), start).thinned()


def levels(blocks: int) -> int:
    """Steps up, and as many down, for so many blocks of one key."""
    n = 0
    while blocks > 1:
        blocks, n = -(-blocks // FAN), n + 1
    return n


def spaced_rows(df: DataFrame, s: Series, gap: float, strict: bool = False) -> DataFrame:
    """(keys, time, seq) of the rows that are at least (``strict``: more than) ``gap`` after the last row kept.

    Equal times go by ``s.seq``.  A row without a time is no row.  A task holds a block's times, or the maps of ``FAN`` blocks, which have no
    more entries than rows lie within ``gap`` of a block's start; what the driver sees is one number.
    """
    keys, part = list(s.keys), s.part
    rows, several, _ = packed(df.select(*keys, *s.order).filter(F.col(s.time).isNotNull()), s)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ids = ", ".join(f"{k} {types[k]}" for k in keys)
    shape = f"{ids}, nr long, at array<double>, out array<double>, start double"
    time, block = s.time, s.block

    def told(nr: int, m: StepMap) -> dict[str, list]:
        return {"nr": [nr], "at": [m.at.tolist()], "out": [m.out.tolist()], "start": [m.start]}

    def map_of(rows):
        return [0], told(int(rows[block][0]), StepMap.of_rows(np.sort(rows[time].astype(float)), gap, strict))

    def maps_in(group: pd.DataFrame) -> list[StepMap]:
        return [StepMap(a, o, b) for a, o, b in zip(group["at"], group["out"], group["start"])]

    def upward(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nr")
        made = told(int(group["nr"].iloc[0]) // FAN, StepMap.composed(maps_in(group), gap, strict))
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, **made})

    def downward(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nr")
        anchor, handed = np.array([group["anchor"].iloc[0]]), []
        for m in maps_in(group):
            handed.append(float(anchor[0]))
            anchor = m(anchor, gap, strict)
        return group[[*keys, "nr"]].assign(anchor=handed)

    def kept(rows):
        anchor = float(rows["anchor"][0]) if "anchor" in rows else NONE
        return kept_rows(rows[time].astype(float), anchor, gap, strict), {}

    schema = f"{ids}, " + ", ".join(f"{c} {types[c]}" for c in s.order)
    if several is None:  # no key goes over a block's edge, so each block starts without an anchor
        return map_blocks(rows, part, s.order, kept, schema)
    longer = rows.join(several, part, "left_semi")
    tiers = [cut(map_blocks(longer, part, s.order, map_of, shape))]
    low = tiers[0].groupBy(*keys).agg(F.min("nr").alias("_low"))
    tiers[0] = tiers[0].join(low, keys).withColumn("nr", F.col("nr") - F.col("_low"))
    most = tiers[0].agg(F.max("nr")).first()[0]
    for _ in range(levels(int(most or 0) + 1)):
        up = tiers[-1].withColumn("_up", F.floor(F.col("nr") / FAN)).groupBy(*keys, "_up").applyInPandas(upward, shape)
        tiers.append(up)
    anchors = tiers[-1].select(*keys, "nr", F.lit(NONE).alias("anchor"))
    for tier in reversed(tiers[:-1]):
        above = anchors.select(*keys, F.col("nr").alias("_up"), "anchor")
        below = tier.withColumn("_up", F.floor(F.col("nr") / FAN)).join(above, [*keys, "_up"])
        anchors = below.groupBy(*keys, "_up").applyInPandas(downward, f"{ids}, nr long, anchor double")
    handed = anchors.join(low, keys).select(*keys, (F.col("nr") + F.col("_low")).alias(block), "anchor")
    given = rows.join(handed, part, "left").withColumn("anchor", F.coalesce("anchor", F.lit(NONE)))
    return map_blocks(given, part, s.order, kept, schema)
