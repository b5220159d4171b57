"""Ordered work on series whose keys may be very uneven.

A plain ``Window.partitionBy(key).orderBy(time)`` puts a whole key into one task, which fails when one
recording holds a third of the data.  Everything here works on *blocks*: a key's rows cut at fixed
time steps.  A block is one task's worth of work whatever the key's size, and what has to cross a block
edge travels through a table with one row per block.

* :func:`with_halo`   - bounded frames (lag, lead, moving averages): copy the few edge rows over.
* :func:`running`     - unbounded frames (running sum/max/last): add up block totals.
* :func:`islands`     - ids of stretches started by a flag.
* :func:`settled`     - where no key is long, whole keys for blocks: plain windows, nothing is copied or added up.
* :func:`packed`      - blocks by rows instead of time: short keys become one block, so that nothing has to cross an edge.
* :func:`map_blocks`  - a Python function on every block; blocks stream by, so a short one costs little.
* :func:`scan_blocks` - any ordered state machine: guess each block's starting state, rerun only the
  blocks whose guess was wrong, stop when nothing changes.  Exact, and no round at all for keys of one block.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flightline.runtime import cut

HALO = "_halo"
PACK = 4096  # rows that neighbouring blocks of one key are put together to
ROWS_PER_TASK = 4096  # fewer tasks than spark.sql.shuffle.partitions when there is less than this to do in each


@dataclass(frozen=True)
class Series:
    """Rows of one key in time order, cut into blocks ``width`` time units long."""

    keys: tuple[str, ...]
    time: str
    seq: str
    width: float
    block: str = "_block"
    whole: bool = False  # every key is one block, see settled

    @property
    def part(self) -> list[str]:
        return list(self.keys) if self.whole else [*self.keys, self.block]

    @property
    def order(self) -> list[str]:
        return [self.time, self.seq]

    def stamp(self, df: DataFrame) -> DataFrame:
        if self.whole or self.block in df.columns:
            return df
        return df.withColumn(self.block, F.floor(F.col(self.time) / F.lit(float(self.width))))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)


def settled(s: Series, df: DataFrame, most: int | None = None) -> Series:
    """``s`` with whole keys for blocks if no key of ``df`` has more than ``most`` rows, else ``s`` as it is.

    For :func:`neighbours`, :func:`running` and :func:`islands`, of ``df`` or of any part of its rows.  Keys of a few rows lie in blocks of one or two, so
    copies of edge rows would be as many as the rows; the longest key is counted, and that takes a fraction of it.
    """
    longest = df.groupBy(*s.keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    return replace(s, whole=longest <= (PACK if most is None else most))


def _edge_rows(rows: DataFrame, s: Series, k: int, side: str) -> DataFrame:
    """For every block, the ``k`` rows of its key nearest to it on one side."""
    back = side == "before"
    by = [F.col(c).desc() if back else F.col(c).asc() for c in s.order]
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*s.part).orderBy(*by)))
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(s.order)],
                      F.struct(*rows.columns).alias("row"))
    edges = ranked.filter(F.col("_r") <= k).groupBy(*s.part).agg(F.collect_list(packed).alias("_edge"))
    step = F.col(s.block).asc() if back else F.col(s.block).desc()
    # every listed block holds at least one row, so k blocks always cover k rows
    frame = Window.partitionBy(*s.keys).orderBy(step).rowsBetween(-k, -1)
    pool = F.flatten(F.collect_list("_edge").over(frame))
    near = F.slice(F.sort_array(pool, asc=not back), 1, k)
    carried = edges.select(*s.part, near.alias("_near")).select(*s.part, F.explode("_near").alias("_e"))
    keep = [F.col("_e.row")[c].alias(c) for c in rows.columns if c != s.block]
    return carried.select(*keep, F.col(s.block), F.lit(True).alias(HALO))


def _single_edges(rows: DataFrame, s: Series, before: bool, after: bool) -> DataFrame:
    """The one-row case of :func:`_edge_rows` for both sides from a single partial aggregation."""
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(s.order)], F.struct(*rows.columns).alias("row"))
    ends = rows.groupBy(*s.part).agg(F.min(packed).alias("_first"), F.max(packed).alias("_last"))
    chain = Window.partitionBy(*s.keys).orderBy(s.block)
    sides = ([F.lag("_last.row").over(chain)] if before else []) + ([F.lead("_first.row").over(chain)] if after else [])
    carried = ends.select(*s.part, F.array(*sides).alias("_near")).select(*s.part, F.explode("_near").alias("_e"))
    keep = [F.col("_e")[c].alias(c) for c in rows.columns if c != s.block]
    return carried.filter(F.col("_e").isNotNull()).select(*keep, F.col(s.block), F.lit(True).alias(HALO))


def with_halo(df: DataFrame, s: Series, before: int = 1, after: int = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """Blocks plus copies of the neighbouring edge rows, flagged in ``_halo``.

    Row frames reaching at most ``before`` back and ``after`` ahead are then exact inside a block.  Drop
    the copies with :func:`drop_halo` afterwards.  The copies carry only ``columns`` when given, so that the
    second scan finding them reads no others.
    """
    rows = s.stamp(df)
    if s.whole:
        return rows.withColumn(HALO, F.lit(False))
    slim = rows if columns is None else rows.select(*dict.fromkeys([*s.part, *s.order, *columns]))
    parts = [rows.withColumn(HALO, F.lit(False))]
    if max(before, after) == 1:
        parts.append(_single_edges(slim, s, before == 1, after == 1))
    else:
        if before:
            parts.append(_edge_rows(slim, s, before, "before"))
        if after:
            parts.append(_edge_rows(slim, s, after, "after"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO)


def neighbours(df: DataFrame, s: Series, columns: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Add shifted columns: ``{"prev_y": ("y", -1), "next_t": ("t", 1)}``."""
    before = max([-o for _, o in columns.values() if o < 0], default=0)
    after = max([o for _, o in columns.values() if o > 0], default=0)
    wide = with_halo(df, s, before, after, [c for c, _ in columns.values()])
    w = s.window()
    shifted = {
        name: F.lag(c, -o).over(w) if o < 0 else F.lead(c, o).over(w) for name, (c, o) in columns.items()
    }
    return drop_halo(wide.withColumns(shifted))


_TOTAL = {
    "sum": lambda c, s: F.sum(c),
    "max": lambda c, s: F.max(c),
    "min": lambda c, s: F.min(c),
    "last": lambda c, s: F.max_by(c, F.when(c.isNotNull(), F.struct(*s.order))),
}
_OVER = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _combine(kind: str, earlier: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(earlier.isNull() & local.isNull(), None).otherwise(
            F.coalesce(earlier, F.lit(0)) + F.coalesce(local, F.lit(0)))
    if kind == "last":
        return F.coalesce(local, earlier)
    return F.greatest(earlier, local) if kind == "max" else F.least(earlier, local)


def running(df: DataFrame, s: Series, specs: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Running aggregates from the key's first row, ``{"name": ("sum"|"max"|"min"|"last", column)}``."""
    rows = s.stamp(df)
    local = s.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    if s.whole:
        return rows.withColumns({n: _OVER[k](c).over(local) for n, (k, c) in specs.items()})
    totals = rows.groupBy(*s.part).agg(*[_TOTAL[k](c, s).alias(f"_t_{n}") for n, (k, c) in specs.items()])
    past = Window.partitionBy(*s.keys).orderBy(s.block).rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(
        *s.part, *[_OVER[k](F.col(f"_t_{n}")).over(past).alias(f"_e_{n}") for n, (k, _) in specs.items()])
    rows = rows.withColumns({f"_l_{n}": _OVER[k](c).over(local) for n, (k, c) in specs.items()})
    out = rows.join(earlier, s.part, "left").withColumns(
        {n: _combine(k, F.col(f"_e_{n}"), F.col(f"_l_{n}")) for n, (k, _) in specs.items()})
    return out.drop(*[f"_{p}_{n}" for p in "el" for n in specs])


def islands(df: DataFrame, s: Series, starts: Column, name: str = "run_id") -> DataFrame:
    """Number the stretches of a key: a new one begins at every row where ``starts`` is true."""
    flag = F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return running(df, s, {name: ("sum", flag)})


def gap_flag(prev: str, time: str, gap: float) -> Column:
    return F.col(prev).isNull() | (F.col(time) - F.col(prev) > F.lit(gap))


def packed(df: DataFrame, s: Series, most: int | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows with neighbouring blocks of a key put together, the keys that still have several blocks (None: no key has), and the number of rows.

    A block of time may hold two rows or a million.  Blocks are joined up to about ``most`` rows (one that holds more stays as it is), so a key
    with few rows is one block and what is done for each block is paid for by its rows.  Only counts of the longer keys' blocks are numbered in order.
    """
    most = PACK if most is None else most
    rows = cut(s.stamp(df))
    keys = list(s.keys)
    counts = rows.groupBy(*s.part).agg(F.count("*").alias("_n"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    seen = total.agg(F.sum("_n").alias("rows"), F.max("_n").alias("longest")).first()
    kind = dict(rows.dtypes)[s.block]
    if (seen["longest"] or 0) <= most:
        return rows.withColumn(s.block, F.lit(0).cast(kind)), None, seen["rows"] or 0
    long_keys = total.filter(F.col("_n") > most).select(*keys)
    past = Window.partitionBy(*keys).orderBy(s.block).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"_k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(s.part)]
    names = [f"_k{i}" for i in range(len(s.part))]
    longer = counts.join(long_keys.toDF(*names[:-1]), same[:-1], "left_semi")
    # a block that ends beyond a multiple of ``most`` starts there
    place = longer.withColumn("_pack", F.floor((F.sum("_n").over(past) - 1) / F.lit(most)) + 1)
    place = cut(place.select(*[F.col(c).alias(k) for c, k in zip(s.part, names)], F.col("_pack").cast(kind)))
    out = rows.join(place, same, "left").withColumn(s.block, F.coalesce("_pack", F.lit(0).cast(kind))).select(*rows.columns)
    blocks = place.select(*[F.col(k).alias(c) for c, k in zip(keys, names)], F.col("_pack").alias(s.block)).distinct()
    return out, cut(blocks), seen["rows"]


def changes(df: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """Places where a row differs from the one before in some column of ``by``; nulls are alike."""
    new = np.zeros(len(df), bool)
    for c in by:
        v = df[c]
        if v.dtype.kind in "iub":
            raw = v.to_numpy()
            new[1:] |= raw[1:] != raw[:-1]
        else:
            codes = pd.factorize(v)[0]
            new[1:] |= codes[1:] != codes[:-1]
    new[:1] = True
    return np.flatnonzero(new)


Group = Callable[[dict[str, np.ndarray]], tuple[Sequence[int], Mapping[str, Sequence]]]


def map_blocks(df: DataFrame, part: Sequence[str], order: Sequence[str], fn: Group, schema: str, tasks: int | None = None) -> DataFrame:
    """``fn(columns of one block) -> (places of rows, further columns)``; columns of ``schema`` that the rows have are taken at these places.

    The same as a grouped map, but blocks stream through one Python function as arrays: no pandas frame is made for a block, so that millions
    of short ones cost little.  A fixed partition count, because adaptive coalescing looks at bytes and would put all Python work in one task.
    """
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in schema.split(", ")]
    columns, by = df.columns, list(part)
    taken = [c for c in names if c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in whole_blocks(batches, by):
            arrays = {c: frame[c].to_numpy() for c in columns}
            places, more = [], {c: [] for c in names if c not in taken}
            for lo, hi in zip(cuts, cuts[1:]):
                at, made = fn({c: v[lo:hi] for c, v in arrays.items()})
                if len(at):
                    places.append(np.asarray(at, np.int64) + lo)
                    for c, held in more.items():
                        held.extend(made[c])
            if places:
                out = frame[taken].take(np.concatenate(places)).reset_index(drop=True)
                yield out.assign(**more)[names]

    return df.repartition(n, *by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def whole_blocks(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Sorted batches cut so that every block is whole, with the places where blocks begin and the end."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        firsts = changes(pd.concat([held[-1].iloc[-1:], batch])[list(by)], by)[1:] - 1 if held else changes(batch, by)
        if held and not len(firsts):
            held.append(batch)  # all of it goes on with the block held
            continue
        last = int(firsts[-1])  # the last block may go on in the next batch
        if held or last:
            frame = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            cuts = changes(frame, by)
            yield frame, [*cuts.tolist(), len(frame)]
        held = [batch.iloc[last:]]
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, [*changes(frame, by).tolist(), len(frame)]


Step = Callable[[pd.DataFrame, object], tuple[pd.DataFrame | None, object]]


def scan_blocks(df: DataFrame, s: Series, step: Step, out_schema: str, initial: object = None, arrays: bool = False, pack: int | None = None) -> DataFrame:
    """Run ``step(rows, state) -> (output rows, next state)`` along every key, block by block.

    ``step`` gets one block's rows in order and the (JSON-able) state left by the block before.  Blocks are
    first run from ``initial``; a block is run again only while the state its predecessor hands over differs
    from the one it used.  The result is that of the sequential loop, while no task ever holds more than a block.
    Blocks are :func:`packed`, so a key of few rows is one block, which takes no round and is run once.
    With ``arrays`` a step gets columns as arrays and returns ``((places of rows, further columns), next state)`` as in :func:`map_blocks`.
    """
    rows, several, size = packed(df, s, pack)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_ddl = ", ".join(f"{c} {types[c]}" for c in s.part)
    part, order, start, columns = s.part, s.order, json.dumps(initial), rows.columns
    n = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROWS_PER_TASK)))
    out_names = [f.split()[0] for f in out_schema.split(", ")]

    def stepped(block: dict[str, np.ndarray], used: str):
        """The block's (places, columns) and the state it hands on."""
        if arrays:
            return step(block, json.loads(used))
        got, state = step(pd.DataFrame(block), json.loads(used))
        got = got if got is not None else pd.DataFrame(columns=out_names)
        return (np.zeros(len(got), np.int64), {c: got[c].tolist() for c in out_names}), state

    def given(block: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], str]:
        """A block's own rows, and the state that a row ahead of them carries if it does not start from ``initial``."""
        if "_row" not in block:
            return block, start
        led = int(not block["_row"][0])
        return {c: block[c][led:] for c in columns}, block["used"][0] if led else start

    def states_of(block):
        mine, used = given(block)
        return [0], {"state": [json.dumps(stepped(mine, used)[1])]}  # every block to run has a row ahead, which tells ``used``

    def output_of(block):
        mine, used = given(block)
        (places, more), _ = stepped(mine, used)
        led = len(next(iter(block.values()))) - len(next(iter(mine.values())))
        return np.asarray(places, np.int64) + led, more

    def each_block(live: DataFrame, starts: DataFrame | None, fn, schema: str) -> DataFrame:
        if starts is not None:
            blank = {c: F.lit("0" if types[c] == "string" else 0).cast(types[c]) for c in columns if c not in part}
            lead = starts.withColumns(blank).withColumn("_row", F.lit(False))
            live = live.withColumns({"used": F.lit(""), "_row": F.lit(True)}).unionByName(lead.select(*columns, "used", "_row"))
        return map_blocks(live, part, [*(["_row"] if starts is not None else []), *order], fn, schema, n)

    # a step's own frames may hold columns under names that the rows have too: they come from the step, not from the rows
    own = out_schema if arrays else ", ".join(f"_o_{f}" for f in out_schema.split(", "))

    def output(live: DataFrame, starts: DataFrame | None) -> DataFrame:
        if arrays:
            return each_block(live, starts, output_of, own)

        def renamed(block):
            places, more = output_of(block)
            return places, {f"_o_{c}": v for c, v in more.items()}
        return each_block(live, starts, renamed, own).toDF(*out_names)

    if several is None:
        return output(rows, None)

    # the last block of a key hands its state to nobody, so only the others need running ahead of the output
    chain = Window.partitionBy(*s.keys).orderBy(s.block)
    blocks = cut(several.withColumn("_next", F.lead(s.block).over(chain)))
    feeds = blocks.filter(F.col("_next").isNotNull())

    def advance(todo: DataFrame) -> DataFrame:
        live = rows.join(todo.select(*part), part, "left_semi")
        return each_block(live, todo, states_of, f"{key_ddl}, used string, state string")

    states = None
    todo = feeds.select(*part, F.lit(start).alias("used"))
    rounds = 0
    while not todo.isEmpty():
        fresh = cut(advance(todo))
        if states is not None:
            fresh = states.join(fresh.select(*part), part, "left_anti").unionByName(fresh)
        rounds += 1
        states = cut(fresh) if rounds % 8 == 0 else fresh  # the pieces are cut already; keep the plan short
        handed = (states.join(feeds, part).select(*s.keys, F.col("_next").alias(s.block), F.col("state").alias("_in")))
        todo = cut(states.select(*part, "used").join(handed, part, "left")
                   .select(*part, F.coalesce("_in", F.lit(start)).alias("_want"), "used")
                   .filter(F.col("_want") != F.col("used"))
                   .select(*part, F.col("_want").alias("used")))
    if states is None:
        return output(rows, None)
    handed = states.join(feeds, part).select(*s.keys, F.col("_next").alias(s.block), F.col("state").alias("used"))
    return output(rows, handed)
