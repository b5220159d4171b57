"""Repeated passages by seed and extend: winnowed anchors, extension both ways, maximal repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightline.llm.common import covered, grams, shard_count, sliding, spans, stored, text_bytes, winnow, word_hashes

LENGTH, SEED = 20, 10
NO_ID = -(1 << 63)  # sorts before every id
COPY, HASH = 0, 1


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are among ``known`` hashes: most that are not fail on their low bits, only the others are looked up."""
    if not len(known):
        return np.zeros(len(values), bool)
    mask = (1 << min(22, max(10, int(len(known)).bit_length() + 4))) - 1
    marked = np.zeros(mask + 1, bool)
    low = lambda h: (h & np.asarray(mask, h.dtype)).astype(np.int64)
    marked[low(known)] = True
    out, known = marked[low(values)], np.sort(known)
    maybe = np.flatnonzero(out)
    out[maybe] = known[np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)] == values[maybe]
    return out


class Shard:
    """The words of one shard's texts, in order of (doc_id, place), as numbers."""

    def __init__(self, table: pa.Table, told: pa.Table, length: int, seed: int):
        self.length, self.seed, self.window = length, seed, length - seed + 1
        ids = table.column("doc_id").cast(pa.int64())
        self.ids = ids
        doc = np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64)
        raw, at = text_bytes(table.column("text"))
        self.raw, self.at = raw, at
        self.h, self.owner = word_hashes(raw, at)
        self.counts = np.bincount(self.owner, minlength=len(doc)) if len(self.h) else np.zeros(len(doc), np.int64)
        self.place = np.arange(len(self.h)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.doc = doc[self.owner] if len(self.h) else np.zeros(0, np.int64)
        copies = told.filter(pc.equal(told.column("kind"), COPY))
        pairs = set(zip(copies.column("h").to_pylist(), copies.column("doc").to_pylist()))
        self.copy = np.array([x in pairs for x in zip(table.column("d").to_pylist(), doc.tolist())], bool) if pairs else np.zeros(len(doc), bool)
        self.whole = spans(self.owner, length)  # a window of `length` words starts here
        self.whole &= ~self.copy[self.owner[:len(self.whole)]]
        self.told = told.filter(pc.equal(told.column("kind"), HASH)).column("h").to_numpy().view(np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place in the shard) of the anchors: every window of `length` words contains one."""
        g = grams(self.h, self.seed)
        at = winnow(g, self.window, self.whole) if len(self.whole) else np.zeros(0, np.int64)
        return g[at], at

    def repeats(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the windows at ``starts``, the number of each one's class, and the earliest member (index into starts) of each class."""
        key = grams(self.h, self.length)[starts]
        order = np.lexsort((self.place[starts], self.doc[starts], key))
        sorted_key = key[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        return key, number, order[fresh]


def sharded(docs: DataFrame, id_col: str, text_col: str, finer: int = 1) -> DataFrame:
    """(shard, doc_id, text, d): shards of bounded size; equal texts and missing ids spread over all of them.  ``d`` is a hash of the text."""
    n = shard_count(docs, text_col) * finer
    return docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int").alias("shard"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"), F.xxhash64(text_col).alias("d"))


def later_copies(docs: DataFrame, id_col: str, text_col: str, finer: int = 1) -> DataFrame:
    """(shard, kind, h, doc): rows whose whole text a row of a smaller id has."""
    doc = F.coalesce("doc_id", F.lit(NO_ID))
    rows = sharded(docs, id_col, text_col, finer).select("shard", "d", doc.alias("doc"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"))
    least = rows.groupBy("m").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(least, "m").filter("doc > least").select("shard", F.lit(COPY).alias("kind"), F.col("d").alias("h"), "doc")


def hashes(df: DataFrame) -> DataFrame:
    return df.select("shard", F.lit(HASH).alias("kind"), "h", F.lit(0).cast("long").alias("doc"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, kept_text``; ``spans`` are the maximal removed runs of words [start, stop).

    Words are separated by ASCII white space.  A window of ``length`` words is removed if the same words also start earlier, in a row of a smaller id
    or earlier under the same id; a null id is smaller than any.  Rows that repeat id and text therefore keep or lose the same words.
    Texts null, empty or of fewer words lose nothing.  Other columns are not read.

    A text that a smaller id has as well goes whole (if long enough) and takes no part in the search: what it repeats, the first copy has too.
    Seed: each shard hands on its distinct anchors (winnowed grams of ``seed`` words; every window has one) and anchors met once drop out.
    Extend: from the anchors left, both ways, to every window whose smallest gram is one of them; each shard hands on the first of equal windows, and the
    earliest in all shards is found by their hashes (96 bits).  A passage that many documents share is one row per shard in either step.
    All three passes read one exchange of the texts.
    """
    texts, copies = sharded(docs, id_col, text_col), stored(later_copies(docs, id_col, text_col), "copies")
    groups = lambda df: df.groupBy("shard")

    def seeds(key, table, told):
        h, _ = Shard(table, told, length, seed).anchors()
        found, n = np.unique(h, return_counts=True)
        return pa.table({"shard": pa.array(np.full(len(found), key[0].as_py(), np.int32)), "h": found.view(np.int64), "n": np.minimum(n, 2).astype(np.int32)})

    def extend(key, table, told):
        s = Shard(table, told, length, seed)
        starts = np.flatnonzero(s.whole)
        if len(starts):
            starts = starts[among(sliding(grams(s.h, seed), s.window, np.minimum)[starts], s.told)]
        k, _, first = s.repeats(starts)
        second = grams(s.h, length, 1)[starts[first]] >> np.uint64(32)
        packed = (s.place[starts[first]].astype(np.uint64) << np.uint64(32)) | second
        return pa.table({"shard": pa.array(np.full(len(first), key[0].as_py(), np.int32)), "h": k[first].view(np.int64), "doc": s.doc[starts[first]], "packed": packed.view(np.int64)})

    def finish(key, table, told):
        s = Shard(table, told, length, seed)
        starts = np.flatnonzero(s.whole)
        gone = np.zeros(len(s.h), bool)
        if len(starts):
            k, number, first = s.repeats(starts)
            lead = starts[first][number]
            again = (s.doc[starts] != s.doc[lead]) | (s.place[starts] != s.place[lead])
            again |= among(k, s.told)
            gone = covered(starts[again], length, len(s.h))
        if len(s.h):
            gone |= (s.copy & (s.counts >= length))[s.owner]
        return kept(s, gone)

    found = groups(texts).cogroup(groups(copies)).applyInArrow(seeds, "shard int, h long, n int")
    live = found.withColumn("n", F.sum("n").over(Window.partitionBy("h"))).filter("n > 1").select("shard", "h")
    windows = groups(texts).cogroup(groups(hashes(live).unionByName(copies))).applyInArrow(extend, "shard int, h long, doc long, packed long")
    same = Window.partitionBy("h", F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)))
    here = F.struct("doc", F.shiftright("packed", 32))
    earlier = windows.withColumn("_later", here > F.min(here).over(same)).filter("_later").select("shard", "h")
    return groups(texts).cogroup(groups(hashes(earlier).unionByName(copies))).applyInArrow(finish, "doc_id long, n_words long, spans array<struct<start:int,stop:int>>, kept_text string")


def runs(gone: np.ndarray, owner: np.ndarray, base: np.ndarray, n: int) -> pa.Array:
    """Maximal runs of marked places within each text, as lists of (start, stop)."""
    edge = np.ones(len(owner), bool)
    edge[1:] = owner[1:] != owner[:-1]
    before = np.concatenate([[False], gone[:-1]]) & ~edge
    after = np.concatenate([gone[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
    start, stop = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    text = owner[start] if len(start) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array((start - base[text]).astype(np.int32)), pa.array((stop - base[text]).astype(np.int32))], ["start", "stop"]))


def kept(s: Shard, gone: np.ndarray) -> pa.Table:
    n = len(s.counts)
    base = np.cumsum(s.counts) - s.counts
    left = []
    raw = s.raw.tobytes()
    for i in range(n):
        words = raw[s.at[i]:s.at[i + 1]].split()
        mine = gone[base[i]:base[i] + s.counts[i]]
        left.append(b" ".join([w for w, g in zip(words, mine) if not g] if mine.any() else words))
    return pa.table({"doc_id": s.ids, "n_words": s.counts.astype(np.int64), "spans": runs(gone, s.owner, base, n), "kept_text": pa.array(left, pa.binary()).cast(pa.string())})


def removed(spans_col: str = "spans"):
    """Words or bytes in all spans."""
    return F.aggregate(spans_col, F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", removed().alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
