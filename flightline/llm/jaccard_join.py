"""Documents whose word-shingle sets have a high Jaccard similarity, by universe partition and pigeonhole."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightline.llm.common import chunks, dropped, grams, key_filter, listed, mixed, spans, stored, text_bytes, word_hashes
from flightline.llm.components import components

SHINGLE, PERCENT = 4, 85
BLOCK = 512  # sets of a cluster that one side of a comparing task holds
HOT = 64  # more different sets than this under one signature make it costly
MOST = 0.02  # share of sets that may have more unusable segments than the allocation provides for; those use them all the same
FEW_BITS, MANY_BITS = 256, 1 << 16  # of a set's parity sketch; in between two bits for three shingles at least
K = np.uint64(0x9E3779B97F4A7C15)


def bands(percent: int, most: int = 1 << 40) -> list[int]:
    """Smallest set size of each band; partners of a set are in its own band or the next one."""
    lows = [1]
    while lows[-1] < most:
        lows.append(lows[-1] * 100 // percent + 1)
    return lows


def allocation(low: int, percent: int) -> tuple[int, int, int]:
    """(segments, of these with one-deletion neighbourhoods, spare) for pairs whose smaller set is in the band from ``low``.

    Such a pair differs in at most ``h`` shingles.  An exact segment spends one difference to miss, one with deletions two, so if
    segments + deletions = h + 1 + spare, a pair of which at most ``spare`` credits are unusable still meets.  Segments with no or one shingle are
    never used.  Of all allocations the cheapest is taken: one signature for an exact segment, its size and one for one with deletions,
    and a penalty for small segments, which meet by chance.
    """
    high = low * 100 // percent
    h = high * (100 - percent) // percent
    best = None
    for deletions in range(0, 3):
        for spare in range(0, 64):
            m = h + 1 + spare - deletions
            if m < max(1, deletions):
                continue
            s = low / m
            tiny = m * math.exp(-s) * (1 + s)  # expected segments of no or one shingle
            weight = tiny * (m + deletions) / m
            tail = 1.0 - sum(math.exp(-weight) * weight ** i / math.factorial(i) for i in range(spare + 1)) if weight < 200 else 1.0
            small = m * math.exp(-s) * (1 + s + s * s / 2)
            cost = m + deletions * s + small + (0 if tail <= MOST else 1e6 * tail)
            if best is None or cost < best[0]:
                best = (cost, m, deletions, spare)
    return best[1], best[2], best[3]


def shingle_sets(batch: pa.RecordBatch, at: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, shingle hashes, text of each), distinct and sorted within each text."""
    raw, edges = text_bytes(batch.column(at))
    for lo, hi in chunks(edges):
        h, owner = word_hashes(raw[edges[lo]:edges[hi]], edges[lo:hi + 1] - edges[lo], lower=True)
        whole = np.flatnonzero(spans(owner, size))
        g, o = grams(h, size)[whole], owner[whole]
        counts = np.bincount(owner, minlength=hi - lo)
        for n in range(1, size):  # texts of fewer words: all of them as one
            short = np.flatnonzero(counts == n)
            if len(short):
                starts = np.searchsorted(owner, short)
                g, o = np.concatenate([g, grams(h, n, n)[starts]]), np.concatenate([o, short])
        order = np.lexsort((g, o))
        g, o = g[order], o[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
        yield lo, hi, g[fresh], o[fresh]


def set_ids(g: np.ndarray, o: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit id) of each text's set; equal sets have equal ids."""
    sizes = np.bincount(o, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, o, mixed(g + K))
    return sizes, mixed(total + sizes.astype(np.uint64) * K).view(np.int64)


def segment_signatures(g: np.ndarray, o: np.ndarray, n: int, band: int, m: int, deletions: int, spare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set) of the segments of sets ``o`` in one band's partition of the universe, and the spare credits each of the ``n`` sets has left.

    A segment of no or one shingle is used only by a set that has more of them than spare credits (-1 left), under signatures of their own: of two
    such sets both have them, and of any other two the one with credits to spare doesn't need them.
    """
    salt = np.full(1, band + 1, np.uint64) * K
    place = (mixed(g + salt) % np.uint64(m)).astype(np.int64)
    group = o * m + place
    order = np.argsort(group, kind="stable")
    group, g = group[order], g[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    value = mixed(g ^ salt)
    total = np.add.reduceat(value, starts) if len(starts) else value
    owner, segment = group[starts] // m, group[starts] % m
    base = lambda seg, kind: (seg.astype(np.uint64) * np.uint64(4) + np.uint64(kind)) * np.uint64(0xD1342543DE82EF95) + salt
    enough = sizes >= 2
    sigs, owners = [mixed(total[enough] + base(segment[enough], 0))], [owner[enough]]
    near = enough & (segment < deletions)
    if near.any():  # without one shingle; sets that differ by one meet there, or at the whole of the smaller one
        inner = np.repeat(near, sizes)
        rest = np.repeat(total, sizes)[inner] - value[inner]
        seg = np.repeat(segment, sizes)[inner]
        sigs += [mixed(rest + base(seg, 1)), mixed(total[near] + base(segment[near], 1))]
        owners += [np.repeat(owner, sizes)[inner], owner[near]]
    used = np.bincount(owner[enough], 1 + (segment[enough] < deletions), n).astype(np.int64)
    left = np.maximum(spare - (m + deletions - used), -1)
    for i in np.unique(o[left[o] < 0]).tolist():
        lo, hi = np.searchsorted(owner, [i, i + 1])
        single = lo + np.flatnonzero(sizes[lo:hi] == 1)
        none = np.setdiff1d(np.arange(m), segment[lo:hi])
        places, sums = np.concatenate([segment[single], none]), np.concatenate([total[single], np.zeros(len(none), np.uint64)])
        close = places < deletions
        more = np.concatenate([mixed(sums + base(places, 2)), mixed(sums[close] + base(places[close], 3)), mixed(base(segment[single][segment[single] < deletions], 3))])
        sigs.append(more)
        owners.append(np.full(len(more), i, np.int64))
    return np.concatenate(sigs), np.concatenate(owners), left


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, node, band, left): signatures of every distinct set for its own band and, as the larger of a pair, for the one before; spare credits left there."""
    lows = np.array(bands(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            for lo, hi, g, o in shingle_sets(batch, 0, size):
                sizes, nodes = set_ids(g, o, hi - lo)
                _, first = np.unique(nodes, return_index=True)  # copies within the chunk
                chosen = np.zeros(hi - lo, bool)
                chosen[first] = True
                chosen &= sizes > 0
                own = np.searchsorted(lows, sizes, side="right") - 1
                for band in np.unique(np.concatenate([own[chosen], own[chosen] - 1])).tolist():
                    if band < 0:
                        continue
                    if band not in known:
                        known[band] = allocation(int(lows[band]), percent)
                    m, deletions, spare = known[band]
                    mine = chosen & ((own == band) | (own == band + 1))
                    take = mine[o]
                    sig, owner, left = segment_signatures(g[take], o[take], hi - lo, band, m, deletions, spare)
                    if len(sig):
                        told = (left[owner] + band * 128).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(nodes[owner]), pa.array(told)], ["sig", "node", "told"])

    found = docs.select("text").mapInArrow(run, "sig long, node long, told int")
    return found.select("sig", "node", F.floor((F.col("told") + 1) / 128).cast("int").alias("band"), (F.pmod(F.col("told") + 1, F.lit(128)) - 1).alias("left"))


def sketches(g: np.ndarray, o: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each set, bit by bit, whether an odd number of its shingles falls on the bit; ``n`` are the sets' sizes.

    Sets that differ in d shingles have sketches that differ in at most d bits, so a pair with more differing bits than its similarity allows is no
    link, and needs no texts to tell.  Sets far larger than the largest sketch fill it and go on to the texts.
    """
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 1.5)).clip(0).astype(np.int64), FEW_BITS, MANY_BITS)
    at = np.cumsum(bits) - bits
    where = at[o] + (mixed(g ^ K) & (bits[o] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(where, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
    return [packed[i // 8:(i + b) // 8] for i, b in zip(at.tolist(), bits.tolist())]


def folded(rows: list[bytes], size: int) -> np.ndarray:
    """Sketches of at least ``size`` bytes as rows of 64-bit numbers; longer ones are folded over, as if they had been made that long."""
    out = np.zeros((len(rows), size // 8), np.uint64)
    lengths = np.array([len(r) for r in rows])
    for length in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == length)
        whole = np.frombuffer(b"".join([rows[i] for i in which.tolist()]), np.uint64)
        out[which] = np.bitwise_xor.reduce(whole.reshape(len(which), length // size, size // 8), axis=1)
    return out


def may_link(n, m, bits, percent: int):
    """Whether sets of sizes ``n`` and ``m`` whose sketches differ in ``bits`` bits may reach the limit."""
    return (bits * (100 + percent) <= (n + m) * (100 - percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that sketches do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            shorter, bits = np.array([min(len(x), len(y)) for x, y in zip(us, vs)]), np.zeros(len(us), np.int64)
            for length in np.unique(shorter).tolist():
                which = np.flatnonzero(shorter == length)
                for part in np.array_split(which, len(which) * length // (1 << 22) + 1):
                    x, y = folded([us[i] for i in part.tolist()], length), folded([vs[i] for i in part.tolist()], length)
                    bits[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(may_link(batch.column(2).to_numpy(), batch.column(3).to_numpy(), bits, percent)))

    a, b = (marks.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def possible(rows: DataFrame, marks: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(u, v): links that join, within a signature, all sets of different roots that sketches do not rule out for each other.

    The sets of a signature are cut into blocks of about ``block``, each pair of which is compared by one task.
    """
    def joined(nodes, roots, n, marks) -> Iterator[tuple[int, int]]:
        near = np.zeros((len(nodes), len(nodes)), bool)
        lengths = np.array([len(m) for m in marks])
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            others = np.flatnonzero((lengths >= length) & (n * percent <= n[mine].max() * 100))
            words = folded([marks[i] for i in others.tolist()], length)
            for i, own in zip(mine.tolist(), words[np.searchsorted(others, mine)]):
                bits = np.bitwise_count(words ^ own).sum(axis=1, dtype=np.int64)
                near[i, others] = may_link(n[i], n[others], bits, percent) & (roots[i] != roots[others])
        near |= near.T
        seen = np.zeros(len(nodes), bool)
        for first in np.flatnonzero(near.any(axis=1)).tolist():
            front = np.array([first])
            while not seen[first] or len(front):
                seen[front] = True
                front = np.flatnonzero(near[front].any(axis=0) & ~seen)
                yield from ((nodes[i], nodes[first]) for i in front.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            table = pa.Table.from_batches([x for x in (held, batch) if x is not None]) if held is not None or batch is not None else None
            if table is None or not table.num_rows:
                continue
            whole = table.combine_chunks().to_batches()[0]
            sig, lo_, hi_ = (whole.column(k).to_numpy() for k in (0, 5, 6))
            starts = np.concatenate([[0], np.flatnonzero((sig[1:] != sig[:-1]) | (lo_[1:] != lo_[:-1]) | (hi_[1:] != hi_[:-1])) + 1])
            if batch is not None:  # the last signature may go on
                held, starts = whole.slice(int(starts[-1])), starts
                ends = starts[1:]
            else:
                held, ends = None, np.append(starts[1:], len(sig))
            if not len(ends):
                continue
            nodes, roots, n = (whole.column(k).to_numpy() for k in (1, 2, 3))
            marks = whole.column(4).to_pylist()
            found = [e for lo, hi in zip(starts.tolist(), ends.tolist()) if hi - lo > 1 for e in joined(nodes[lo:hi], roots[lo:hi], n[lo:hi], marks[lo:hi])]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    blocks = F.ceil(F.col("f") / block)
    placed = rows.join(marks, "node").withColumns({"b": F.pmod(F.xxhash64("node"), blocks), "_c": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    placed = placed.select("sig", "node", "root", "n", "sketch", F.least("b", "_c").alias("lo"), F.greatest("b", "_c").alias("hi"))
    return placed.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of sets whose similarity reaches the limit, by their shingles; ``texts`` has one text for each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = []
                for at in (2, 3):
                    mine = [np.zeros(0, np.uint64)] * part.num_rows
                    for a, b, g, o in shingle_sets(part, at, size):
                        cuts = np.searchsorted(o, np.arange(b - a + 1))
                        mine[a:b] = [g[i:j] for i, j in zip(cuts, cuts[1:])]
                    sets.append(mine)
                for x, y in zip(*sets):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    a = texts.select(F.col("node").alias("u"), F.col("text").alias("t"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("s"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "t", "s").mapInArrow(run, "u long, v long")


def stars(rows: DataFrame) -> DataFrame:
    """(u, v): every set with the smallest one under the same signature."""
    least = rows.groupBy("sig").agg(F.min("node").alias("v"))
    return rows.join(least, "sig").filter("node != v").select(F.col("node").alias("u"), "v").distinct()


def texts_of(keyed: DataFrame, chosen: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text), stored, of all sets in ``pairs``.  A filter of a fixed size leaves most other texts where they are; the join that follows is exact."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = stored(chosen.join(nodes, "node"), "wanted")
    shared = keyed.sparkSession.sparkContext.broadcast(key_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(listed(shared.value, batch.column(0).to_numpy().view(np.uint64))))

    near = keyed.select("key", "text").mapInArrow(run, "key long, text string")
    texts = stored(near.join(wanted, "key").dropDuplicates(["node"]).select("node", "text"), "texts")
    dropped(wanted)
    return texts


def between(nodes: DataFrame, links: DataFrame, texts: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between sets of different roots that share a signature and whose sketches allow it, or that are joined by way of others such.

    ``nodes`` has the sets' roots; sets joined by the possible ``links`` make a cluster, cut into blocks; a task compares two blocks, a set is sent once for each block of its cluster.  The sizes of
    all common parts come from products of incidence matrices, so no pair is a row; of the links between two roots in a task one is enough.
    """
    def compare(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        nodes, roots, side = (table.column(c).to_numpy() for c in ("node", "root", "b"))
        g, o = (np.concatenate(x) for x in zip(*[(g, o + a) for a, _, g, o in shingle_sets(table, table.schema.get_field_index("text"), size)]))
        sizes = np.bincount(o, minlength=len(nodes))
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        _, column, count = np.unique(g, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        column, o = column[shared], o[shared]
        order = np.argsort(column, kind="stable")
        column, o = np.cumsum(np.concatenate([[0], np.diff(column[order]) > 0])) if len(order) else column, o[order]
        common = np.zeros((len(left), len(right)), np.float64)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            i, j = np.searchsorted(column, [first, first + 4096])
            part = np.zeros((len(nodes), 4096), np.float32)
            part[o[i:j], column[i:j] - first] = 1
            common += part[left] @ part[right].T
        united = sizes[left][:, None] + sizes[right][None, :] - common
        x, y = np.nonzero((100 * common >= percent * united) & (roots[left][:, None] != roots[right][None, :]))
        x, y = left[x], right[y]
        ends = np.stack([np.maximum(roots[x], roots[y]), np.minimum(roots[x], roots[y])], axis=1)
        _, one = np.unique(ends, axis=0, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
        return pa.table({"u": nodes[x[one]].astype(np.int64), "v": nodes[y[one]].astype(np.int64)})

    clusters = components(links).select("node", F.col("root").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = nodes.join(clusters, "node").join(sizes, "cluster").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "cluster", F.least("b", "_c").alias("lo"), F.greatest("b", "_c").alias("hi"), "b", "node", "root")
    return placed.join(texts, "node").groupBy("cluster", "lo", "hi").applyInArrow(compare, "u long, v long")


def _labelled(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the root of their node, only of signatures that still lie in two or more components; also the stored table of roots that they read."""
    roots = components(links)
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    w = Window.partitionBy("sig")
    return named.withColumns({"_a": F.min("root").over(w), "_b": F.max("root").over(w), "f": F.count("*").over(w)}).filter("_a != _b").drop("_a", "_b"), roots


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, set_id, root``; documents of one ``root`` reach each other by links.

    Two sets of word shingles (A-Z in lower case) link when ``100 * common >= percent * united``.  Fewer words than ``size`` make one shingle; texts null, empty or
    without words have no set, no link and a null ``root``.  Repeated rows and equal sets share a root.  Other columns are not read.

    Equal sets become one node.  Signatures met once drop out.  A signature of more than ``hot`` sets is skipped by the sets that have spare credits for all such
    signatures of theirs; those with more keep them, so two similar sets always share one that both kept.  Under a signature every set is
    compared with the smallest first; signatures that then still lie in several components are settled by :func:`between`, so no pair of sets
    that could connect two components goes untested.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, g, o in shingle_sets(batch, 1, size):
                sizes, nodes = set_ids(g, o, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(nodes), batch.column(2).slice(lo, hi - lo),
                                                  pa.array(sketches(g, o, sizes), pa.binary())], ["doc_id", "n_shingles", "set_id", "key", "sketch"])

    keyed = plain.withColumn("key", F.xxhash64("doc_id", "text"))
    sets = stored(keyed.mapInArrow(name, f"doc_id {kind}, n_shingles long, set_id long, key long, sketch binary"), "sets")
    met = signatures(plain, size, percent).repartition("sig").dropDuplicates(["sig", "node"]).withColumn("f", F.count("*").over(Window.partitionBy("sig"))).filter("f > 1")
    met = stored(met, "signatures")
    full = met.filter(F.col("f") > hot).groupBy("node", "band").agg(F.count("*").alias("n"), F.min("left").alias("left")).filter("n * 2 > left").select(
        "node", "band", F.lit(True).alias("keep"))
    rows = met.join(full, ["node", "band"], "left").filter((F.col("f") <= hot) | F.col("keep")).select("sig", "node")
    rows = stored(rows, "rows")
    dropped(met)
    least = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min("key").alias("key")).select(F.col("set_id").alias("node"), "key")
    chosen = stored(least.join(rows.select("node").distinct(), "node"), "chosen")
    marks = sets.select("key", F.col("n_shingles").alias("n"), "sketch").join(chosen, "key").dropDuplicates(["node"]).select("node", "n", "sketch")
    marks = stored(marks, "sketches")

    tested = stored(stars(rows), "pairs")
    hopeful = stored(likely(tested, marks, percent), "likely")
    dropped(tested)
    texts = texts_of(keyed, chosen, hopeful)
    first = stored(verified(hopeful, texts, size, percent), "links")
    dropped(hopeful, texts)
    labelled, named = _labelled(rows, first)
    still = stored(labelled, "open")
    dropped(rows, named)
    joined = stored(possible(still, marks, percent), "possible")
    texts = texts_of(keyed, chosen, joined)
    more = stored(between(still.select("node", "root").distinct(), joined, texts, size, percent), "links")
    dropped(still, joined, texts, marks, chosen)
    nodes = components(first.unionByName(more))
    dropped(first, more)
    roots = nodes.select(F.col("node").alias("set_id"), "root")
    joined = sets.join(roots, "set_id", "left")
    return joined.select("doc_id", "n_shingles", "set_id", F.when(F.col("n_shingles") > 0, F.coalesce("root", "set_id")).alias("root"))


def component_ids(found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id of each root; texts without a set stand alone."""
    least = found.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = found.join(least, "root", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
