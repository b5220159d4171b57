"""What several of these operators share: stored tables, words as SQL sees them, bytes and word hashes as numpy sees them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.runtime import workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SHARD_BYTES = 8 << 20  # text that one Python call holds; a longer single text is held whole
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
CHUNK_BYTES = 2 << 20  # text that one round of numpy arrays covers
SLOTS, PAGE = 24, 16  # bits of the place in a filter, 16 MB whatever the corpus, and in a page of it; what shares a place only lets more through


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: short lineage, safe from lost executors."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again: what was made from them is stored itself."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand Python no more than ``BATCH_ROWS`` rows or ``BATCH_BYTES`` at once; workers keep the memory of their largest batch for later jobs."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` is the fast way where a text has no other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shard_count(docs: DataFrame, text: str) -> int:
    """How many shards of about ``SHARD_BYTES`` the texts make: one number comes to the driver."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return int(total // SHARD_BYTES) + 1


# ---------------------------------------------------------------- bytes and words in numpy

def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE = _table(11)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, dtype=np.uint64)]


def powers(n: int) -> np.ndarray:
    """1, b, b^2 ... modulo 2^64, at least ``n`` of them."""
    if len(_POWERS[0]) < n:
        grown = np.full(max(n, 4096), np.uint64(0xD6E8FEB86659FD93))
        grown[0] = 1
        _POWERS[0] = np.cumprod(grown)
    return _POWERS[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column laid end to end (null: none) and where each text starts; one more entry ends the last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), pa.scalar(b"" if kind == pa.large_binary() else "", kind))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes each."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_in(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word of the texts ``raw[at[i]:at[i+1]]``."""
    inside = ~SPACE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(at, starts, side="right") - 1


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the text number of every word; ``lower`` reads A-Z as a-z."""
    hashes, owners = [], []
    for lo, hi in chunks(at):
        part, edges = raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        starts, stops, owner = words_in(part, edges)
        if not len(starts):
            continue
        lengths = stops - starts
        total = int(lengths.sum())
        within = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters = (BYTE_LOWER if lower else BYTE)[part[~SPACE[part]]]
        sums = np.add.reduceat(letters * powers(int(lengths.max()) + 1)[within], np.cumsum(lengths) - lengths)
        hashes.append(mixed(sums + lengths.astype(np.uint64) * ODD))
        owners.append(owner + lo)
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``n`` consecutive hashes, whatever texts they are of; ``len(h) - n + 1`` of them."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(0xA0761D6478BD642F + 2 * seed)
    out = h[:size].copy()
    for j in range(1, n):
        out *= factor
        out += h[j:j + size]
    return mixed(out + np.full(1, n, np.uint64) * ODD)


def spans(owner: np.ndarray, n: int) -> np.ndarray:
    """Whether ``n`` consecutive entries from here on are of one text."""
    size = len(owner) - n + 1
    return owner[:size] == owner[n - 1:] if size > 0 else np.zeros(0, bool)


def sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``w`` consecutive values."""
    out, width = values, 1
    while width * 2 <= w:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[:len(out) - (w - width)], out[w - width:]) if w > width else out


def winnow(g: np.ndarray, w: int, whole: np.ndarray) -> np.ndarray:
    """Positions that are the smallest of some window of ``w`` grams; ``whole[j]``: the window at ``j`` lies in one text.  Every such window has one."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    low = np.where(whole, sliding(g, w, np.minimum), np.uint64(0))
    reach = sliding(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    return np.flatnonzero((reach == g) & (reach > 0))


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie within ``n`` of a start."""
    edge = np.bincount(starts, minlength=size + 1)
    edge -= np.bincount(np.minimum(starts + n, size), minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


# ---------------------------------------------------------------- filters of a fixed size

def packed(places: DataFrame) -> np.ndarray:
    """(place, bit) rows as 2^SLOTS bytes on the driver; the size is fixed, pages of it are put together by tasks."""
    size = 1 << PAGE

    def page(table: pa.Table) -> pa.Table:
        out = np.zeros(size, np.uint8)
        out[table["place"].to_numpy() & (size - 1)] = table["bits"].to_numpy().astype(np.uint8)
        return pa.table({"page": table["page"].slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    pages = (places.groupBy("place").agg(F.bit_or("bit").alias("bits")).withColumn("page", F.shiftright("place", PAGE))
             .groupBy("page").applyInArrow(page, "page long, bits binary"))
    whole = np.zeros(1 << SLOTS, np.uint8)
    for row in pages.collect():
        whole[row["page"] * size:(row["page"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return whole


def key_filter(keys: DataFrame) -> np.ndarray:
    """The filter of a column ``key`` of 64-bit hashes: 2^(SLOTS + 3) bits."""
    return packed(keys.select(F.shiftright("key", 3).bitwiseAND(F.lit((1 << SLOTS) - 1)).alias("place"), F.expr("shiftleft(1, cast(key & 7 as int))").alias("bit")))


def listed(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys are in the filter: all that were put in, and some others."""
    places = (keys >> np.uint64(3)) & np.uint64((1 << SLOTS) - 1)
    return (marks[places.astype(np.int64)] >> (keys & np.uint64(7)).astype(np.uint8)) & 1 == 1
