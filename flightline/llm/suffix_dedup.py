"""Repeated byte strings by suffix sorting with a difference cover of period three."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightline.llm.common import BYTE, ODD, covered, mixed, sliding, stored, text_bytes, winnow
from flightline.llm.substring_dedup import COPY, HASH, NO_ID, among, hashes, later_copies, removed, runs, sharded

LENGTH, SEED = 50, 18
FINER = 4  # a byte takes more memory than a word's share of it, so shards are smaller
DEPTH = 4  # names of 3 ** DEPTH bytes are more than a string's length


def packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number for two, in the same order."""
    return high.astype(np.int64) * (int(low.max(initial=0)) + 1) + low


def dense(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of ``keys``: counted where the keys are about as many as their values, else sorted."""
    if keys.max(initial=0) <= 4 * len(keys) + 1024:
        seen = np.zeros(int(keys.max(initial=0)) + 1, np.int64)
        seen[keys] = 1
        return (np.cumsum(seen) - 1)[keys]
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Place of every suffix of ``s`` (numbers from 1) in sorted order, as far as the first 3 ** depth numbers tell.

    Suffixes at places 1 and 2 of every three are the sample.  Their triples are sorted and named; the names, laid out place by place, are sorted by
    the same function; the other suffixes follow from their first number and the rank behind it, and both lists are merged.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two, rest = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    pair, most = packed(t[:-2], t[1:-1]), int(t.max()) + 1
    pair = pair if most * most * max(most, n + 4) < 1 << 62 else dense(pair)  # numbered only where a pair and another number don't fit into 63 bits
    names = dense(packed(pair[sample], t[sample + 2])) if len(sample) else np.zeros(0, np.int64)
    if len(names) and names.max() + 1 < len(names) and depth > 1:
        inner = suffix_ranks(np.concatenate([names[:len(one)] + 2, [1], names[len(one):] + 2]), depth - 1)
        names = dense(np.delete(inner, len(one)))
    rank = np.zeros(n + 3, np.int64)
    if len(names) and names.max() + 1 < len(names):
        rank[sample[np.argsort(names)]] = np.arange(1, len(sample) + 1)
    else:
        rank[sample] = names + 1  # all told apart
    # how many of the sample come before each of the rest: those at place 1 by (number, rank), those at place 2 by (two numbers, rank)
    key1 = packed(t[:n], rank[1:n + 1])
    key2 = packed(pair[:n], rank[2:n + 2])
    rest = rest[np.argsort(key1[rest])]
    before = np.searchsorted(np.sort(key1[one]), key1[rest]) + np.searchsorted(np.sort(key2[two]), key2[rest])
    before = np.maximum.accumulate(before)  # falls only among suffixes that the first 3 ** depth numbers do not tell apart
    out = np.empty(n, np.int64)
    out[rest] = np.arange(len(rest)) + before
    out[sample] = rank[sample] - 1 + np.cumsum(np.bincount(before, minlength=len(sample) + 1))[rank[sample] - 1]  # how many of ``before`` are less than the rank
    return out


def words_of(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on, as one number."""
    w = raw.astype(np.uint64)
    for width in (1, 2, 4):
        w = (w[:-width] << np.uint64(8 * width)) | w[width:]
    return w


def same_strings(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at ``a`` and at ``b`` are equal, pair by pair."""
    same = np.ones(len(a), bool)
    step, w = (8, words_of(raw)) if length >= 8 else (1, raw)
    for j in sorted({*range(0, length - step + 1, step), length - step}):
        live = np.flatnonzero(same)
        same[live] = w[a[live] + j] == w[b[live] + j]
    return same


def string_hashes(h: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size ``n`` the hashes of every ``n`` consecutive bytes' hashes, built from the same powers of two."""
    factor, at, width = 0xA0761D6478BD642F, [0] * len(sizes), 1
    out = [np.zeros(max(0, len(h) - n + 1), np.uint64) for n in sizes]
    while any(a < n and len(o) for a, n, o in zip(at, sizes, out)):
        times = np.full(1, pow(factor, width, 1 << 64), np.uint64)
        for i, n in enumerate(sizes):
            if n & width:
                if at[i]:
                    out[i] *= times
                out[i] += h[at[i]:at[i] + len(out[i])]
                at[i] += width
        if all(a >= n for a, n in zip(at, sizes)) or len(h) <= width:
            break
        grown = h[:-width] * times
        grown += h[width:]
        h, width = grown, width * 2
    return [mixed(o + np.full(1, n, np.uint64) * ODD) for o, n in zip(out, sizes)]


class Bytes:
    """One shard's texts as bytes; ``whole[j]``: a string of ``length`` bytes at ``j`` lies in one text that is no later copy."""

    def __init__(self, table: pa.Table, told: pa.Table, length: int, seed: int):
        table = table.sort_by([("doc_id", "ascending"), ("d", "ascending")])  # the same order in every pass
        self.ids = table.column("doc_id").cast(pa.int64())
        self.doc = np.array([NO_ID if i is None else i for i in self.ids.to_pylist()], np.int64)
        self.raw, self.at = text_bytes(table.column("text"))
        self.sizes = np.diff(self.at)
        self.owner = np.repeat(np.arange(len(self.doc), dtype=np.int32), self.sizes)
        copies = told.filter(pc.equal(told.column("kind"), COPY))
        pairs = set(zip(copies.column("h").to_pylist(), copies.column("doc").to_pylist()))
        self.copy = np.array([x in pairs for x in zip(table.column("d").to_pylist(), self.doc.tolist())], bool) if pairs else np.zeros(len(self.doc), bool)
        known = told.filter(pc.equal(told.column("kind"), HASH))
        self.told, self.counts = known.column("h").to_numpy().view(np.uint64), known.column("doc").to_numpy()
        self.letters = BYTE[self.raw]
        size = max(0, len(self.raw) - length + 1)
        self.whole = (self.owner[:size] == self.owner[length - 1:]) & ~self.copy[self.owner[:size]] if size else np.zeros(0, bool)
        self.length, self.window, self.seed = length, length - seed + 1, seed

    def seeds(self) -> np.ndarray:
        return string_hashes(self.letters, self.seed)[0]

    def hashes(self) -> list[np.ndarray]:
        """Of the grams and of the strings."""
        return string_hashes(self.letters, self.seed, self.length)

    def anchors(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors (smallest grams of some string) among the grams ``g``, and at how many places each one is met."""
        return np.unique(g[winnow(g, self.window, self.whole) if len(self.whole) else np.zeros(0, np.int64)], return_counts=True)

    def classes(self, key: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each one's class of the strings of hashes ``key`` at ``starts``, and the class's first member of the smallest id."""
        order = np.lexsort((self.doc[self.owner[starts]], key))
        fresh = np.ones(len(order), bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        return number, order[fresh]


def with_gram(least: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether the smallest gram of each string is one of ``grams``; neighbours mostly share theirs, which is looked up once."""
    edge = np.ones(len(least), bool)
    edge[1:] = least[1:] != least[:-1]
    return among(least[edge], grams)[np.cumsum(edge) - 1] if len(least) else edge


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans, kept`` (binary); ``spans`` are the maximal removed runs of bytes [start, stop).

    A byte goes if a string of ``length`` bytes over it also starts in a row of a smaller id (a null id is smaller than any; rows of one id don't touch each
    other).  Null text is empty.  Shorter texts lose nothing.  Other columns are not read.

    Only strings whose smallest gram of ``seed`` bytes is met again (in the shard or in another) can repeat.  Each shard hands on one of equal strings, as
    stretches of text that share that gram; stretches of one gram meet in one bucket, whose suffixes are sorted with the difference cover, and
    adjacent ones are compared over ``length`` bytes.  So suffix sorting is dealt out by gram, and no bucket needs another's ranks.
    A text that a smaller id has as well goes whole and takes no part.
    """
    texts, copies = sharded(docs, id_col, text_col, FINER), stored(later_copies(docs, id_col, text_col, FINER), "copies")
    shards = lambda df: df.groupBy("shard")

    def find(key, table, told):
        s = Bytes(table, told, length, seed)
        found, n = s.anchors(s.seeds())
        return pa.table({"shard": pa.array(np.full(len(found), key[0].as_py(), np.int32)), "h": found.view(np.int64), "n": np.minimum(n, 2).astype(np.int32)})

    def stretches(key, table, told):
        s = Bytes(table, told, length, seed)
        starts = np.flatnonzero(s.whole)
        g, keys = s.hashes()
        least = sliding(g, s.window, np.minimum) if len(starts) else np.zeros(0, np.uint64)
        starts = starts[with_gram(least[starts], s.told)]
        starts = np.sort(starts[s.classes(keys[starts], starts)[1]])
        edge = np.ones(len(starts), bool)
        edge[1:] = (starts[1:] != starts[:-1] + 1) | (least[starts[1:]] != least[starts[:-1]]) | (s.owner[starts[1:]] != s.owner[starts[:-1]])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(starts)) - 1 if len(first) else first
        raw = s.raw.tobytes()
        cut = [raw[a:b] for a, b in zip(starts[first].tolist(), (starts[last] + length).tolist())]
        return pa.table({"shard": pa.array(np.full(len(first), key[0].as_py(), np.int32)), "g": least[starts[first]].view(np.int64), "doc": s.doc[s.owner[starts[first]]], "cut": pa.array(cut, pa.binary())})

    def sort_suffixes(key, table):
        shard, doc = table.column("shard").to_numpy(), table.column("doc").to_numpy()
        column = table.column("cut").combine_chunks()
        coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        raw, at = text_bytes(coded.dictionary)  # equal stretches are sorted once, with the smallest of their ids
        smallest = np.full(len(at) - 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, which, doc)
        owner = np.repeat(np.arange(len(smallest)), np.diff(at))
        joined = np.full(len(raw) + len(smallest), 1, np.int64)
        joined[np.arange(len(raw)) + owner] = raw.astype(np.int64) + 2
        rank = suffix_ranks(joined, DEPTH)
        size = max(0, len(raw) - length + 1)
        valid = np.flatnonzero(owner[:size] == owner[length - 1:])
        in_order = np.full(len(rank), -1, np.int64)
        in_order[rank[valid + owner[valid]]] = valid
        valid = in_order[in_order >= 0]
        same = same_strings(raw, valid[1:], valid[:-1], length)
        group = np.concatenate([[0], np.cumsum(~same)]) if len(valid) else np.zeros(0, np.int64)
        least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, group, smallest[owner[valid]])
        first = np.zeros(len(raw), np.int64)
        first[valid] = least[group]
        # back to the stretches: runs of strings that start in a smaller id as well, told by the hash of the run's first string
        count = np.diff(at)[which] - length + 1
        row = np.repeat(np.arange(len(which)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + at[:-1][which][row]
        late = doc[row] > first[place]
        edge = np.ones(len(row), bool)
        edge[1:] = row[1:] != row[:-1]
        begin = np.flatnonzero(late & (edge | ~np.concatenate([[False], late[:-1]])))
        n = np.diff(np.append(np.cumsum(late)[begin] - 1, late.sum())) if len(begin) else begin
        h = string_hashes(BYTE[raw], length)[0][place[begin]] if len(begin) else np.zeros(0, np.uint64)
        return pa.table({"shard": shard[row[begin]].astype(np.int32), "kind": np.full(len(begin), HASH, np.int32), "h": h.view(np.int64), "doc": n.astype(np.int64)})

    def finish(key, table, told):
        s = Bytes(table, told, length, seed)
        gone, starts = np.zeros(len(s.raw), bool), np.flatnonzero(s.whole)
        if len(starts):
            # only strings whose smallest gram is met twice here, or that were sent back, are compared with each other
            g, key = s.hashes()
            key = key[starts]
            anchors, times = s.anchors(g)
            order = np.argsort(s.told)
            known, n = s.told[order], s.counts[order]
            some = with_gram(sliding(g, s.window, np.minimum)[starts], anchors[times > 1]) | among(key, known)
            picked, k = starts[some], key[some]
            number, first = s.classes(k, picked)
            doc = s.doc[s.owner[picked]]
            late = np.zeros(len(first), bool)
            run = np.zeros(len(s.raw), bool)
            if len(known) and len(first):  # runs of strings from a class's first member on
                at = np.minimum(np.searchsorted(known, k[first]), len(known) - 1)
                hit = known[at] == k[first]
                edge = np.zeros(len(s.raw) + 1, np.int32)
                np.add.at(edge, picked[first[hit]], 1)
                np.add.at(edge, picked[first[hit]] + n[at[hit]], -1)
                run = np.cumsum(edge[:-1]) > 0
                late[number[run[picked]]] = True
            repeats = picked[(doc > doc[first][number]) | late[number]]
            gone = covered(np.concatenate([repeats, starts[run[starts] & ~some]]), length, len(s.raw))
        if len(s.raw):
            gone |= (s.copy & (s.sizes >= length))[s.owner]
        left = [s.raw[a:b][~gone[a:b]].tobytes() for a, b in zip(s.at[:-1].tolist(), s.at[1:].tolist())]
        return pa.table({"doc_id": s.ids, "n_bytes": s.sizes.astype(np.int64), "spans": runs(gone, s.owner, s.at[:-1], len(s.doc)), "kept": pa.array(left, pa.binary())})

    found = shards(texts).cogroup(shards(copies)).applyInArrow(find, "shard int, h long, n int")
    live = found.withColumn("n", F.sum("n").over(Window.partitionBy("h"))).filter("n > 1").select("shard", "h")
    cuts = shards(texts).cogroup(shards(hashes(live).unionByName(copies))).applyInArrow(stretches, "shard int, g long, doc long, cut binary")
    buckets = docs.select(F.lit(1)).count() // 200 + 1
    late = cuts.withColumn("bucket", F.pmod("g", F.lit(buckets))).groupBy("bucket").applyInArrow(sort_suffixes, "shard int, kind int, h long, doc long")
    return shards(texts).cogroup(shards(late.unionByName(copies))).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
