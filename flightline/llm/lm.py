"""Perplexity by an interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays in files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.llm.common import chunks, mixed, shard_count, stored, text_bytes, word_hashes
from flightline.runtime import workspace

END = np.uint64(0x5851F42D4C957F2D)  # the hash of the end token; no word has it but by chance
HOLD = 1 << 20  # rows that a writing task holds


def mounted(folder: str) -> str:
    """The shared folder as a path that workers can map into memory."""
    path = folder[5:] if folder.startswith("file:") else folder
    path = "/" + path.lstrip("/")
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"language-model arrays are memory-mapped: spark.checkpoint.dir must be a mounted folder, not {folder}")
    return path


def tokens(batch: pa.RecordBatch, at: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, hash of every token, text of every token): words in lower case (A-Z), then one end token for each text."""
    raw, edges = text_bytes(batch.column(at))
    for lo, hi in chunks(edges):
        h, owner = word_hashes(raw[edges[lo]:edges[hi]], edges[lo:hi + 1] - edges[lo], lower=True)
        places = np.searchsorted(owner, np.arange(hi - lo), side="right")
        yield lo, hi, np.insert(h, places, END), np.insert(owner, places, np.arange(hi - lo))


def unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays one after another under a name that appears only when complete; a task that runs again writes the same file."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    for i, a in enumerate(arrays):
        a.tofile(f"{part}.{i}")
    for i in range(len(arrays)):
        os.replace(f"{part}.{i}", f"{folder}/{name}.{i}")


class Appending:
    """Arrays that grow in files while a sorted bucket streams by."""

    def __init__(self, folder: str, name: str, n: int):
        os.makedirs(folder, exist_ok=True)
        self.final = [f"{folder}/{name}.{i}" for i in range(n)]
        self.part = [f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}.{i}" for i in range(n)]
        self.files = [open(p, "wb") for p in self.part]

    def add(self, *arrays: np.ndarray) -> None:
        for f, a in zip(self.files, arrays):
            a.tofile(f)

    def close(self) -> None:
        for f, part, final in zip(self.files, self.part, self.final):
            f.close()
            os.replace(part, final)


def mapped(path: str, dtype) -> np.ndarray:
    return np.memmap(path, dtype=dtype, mode="r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)


@dataclass
class Words:
    """Sorted word hashes in buckets of their leading bits, mapped into memory; a word's id is its place in the whole."""

    folder: str
    bits: int
    first: list[int]  # id of each bucket's first word, then the number of words
    open: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"folder": self.folder, "bits": self.bits, "first": self.first, "open": {}}

    @property
    def size(self) -> int:
        return self.first[-1]

    def arrays(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.open:
            self.open[b] = mapped(f"{self.folder}/words-{b}.0", np.uint64), mapped(f"{self.folder}/words-{b}.1", np.int64)
        return self.open[b]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, training count) of each token hash."""
        keys, which = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[b], cuts[b + 1]
            known, n = self.arrays(int(b))
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
                hit = known[at] == keys[lo:hi]
                ids[lo:hi][hit] = at[hit] + self.first[b]
                counts[lo:hi][hit] = n[at[hit]]
        return ids[which], counts[which]


def count_words(train: DataFrame, folder: str, bits: int) -> tuple[Words, int]:
    """Training counts of all tokens as sorted hash arrays, and their sum."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, _ in tokens(batch, 0):
                keys, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = -1

        def done() -> list[tuple[int, int, int]]:
            if now < 0:
                return []
            keys, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            save(folder, f"words-{now}", keys[order], n[order])
            held.clear()
            return [(now, len(keys), int(n.sum()))]

        rows = []
        for batch in batches:
            b, keys, n = batch.column(0).to_numpy(), unsigned(batch.column(1)), batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if b[lo] != now:
                        rows += done()
                        now = int(b[lo])
                    held.append((keys[lo:hi].copy(), n[lo:hi].copy()))
        rows += done()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["b", "words", "n"]).astype("int64"), preserve_index=False)

    counted = train.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    bucket = F.shiftrightunsigned("h", 64 - bits).cast("long")
    placed = counted.select(bucket.alias("b"), "h", "n").repartition(1 << bits, "b").sortWithinPartitions("b")
    rows = stored(placed.mapInArrow(write, "b long, words long, n long"), "lm-words").orderBy("b").collect()  # one row for each file
    sizes = np.zeros((1 << bits) + 1, np.int64)
    for r in rows:
        sizes[r["b"] + 1] = r["words"]
    return Words(folder, bits, np.cumsum(sizes).tolist()), sum(r["n"] for r in rows)


def pair_ids(words: Words, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context id, word id, training count) of every token; the context of a text's first token is the begin mark, whose id is the number of words."""
    ids, counts = words.find(h)
    context = np.concatenate([[words.size], ids[:-1]]) if len(ids) else ids
    first = np.ones(len(ids), bool)
    first[1:] = owner[1:] != owner[:-1]
    return np.where(first, words.size, context), ids, counts


def count_pairs(train: DataFrame, words: Words, folder: str, parts: int) -> DataFrame:
    """Write bigram counts and context sums by ranges of context ids; give back (kind, id, n): words' continuation counts and counts of counts."""
    span = words.size // parts + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32) // span), pa.array(keys), pa.array(n.astype(np.int32))], ["b", "pair", "n"])

        for batch in batches:
            for _, _, h, owner in tokens(batch, 0):
                context, ids, _ = pair_ids(words, h, owner)
                held.append((context << 32) | ids)
                if sum(map(len, held)) >= HOLD * 2:
                    yield flush()
        if held:
            yield flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"now": -1}

        def settle(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            """Keys complete and in order: append them, add them to their contexts, count what precedes their words."""
            state["file"].add(keys, n.astype(np.int32))
            c = (keys >> 32) - state["now"] * span
            for i, x in enumerate((n, n == 1, n == 2, n >= 3)):
                state["sums"][i] += np.bincount(c, x, span).astype(np.int64)
            ids, before = np.unique(keys & 0xFFFFFFFF, return_counts=True)
            few, times = np.unique(n[n <= 4], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([1, 2], [len(ids), len(few)]).astype(np.int32)), pa.array(np.concatenate([ids, few])),
                                               pa.array(np.concatenate([before, times]).astype(np.int64))], ["kind", "id", "n"])

        def merge(last: bool) -> Iterator[pa.RecordBatch]:
            if not state["held"]:
                return
            keys, n = (np.concatenate(x) for x in zip(*state["held"]))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n = np.add.reduceat(n, starts)
            keys = keys[starts]
            whole = len(keys) if last else len(keys) - 1  # the last key may go on in the next batch
            state["held"] = [] if last else [(keys[-1:], n[-1:])]
            if whole:
                yield settle(keys[:whole], n[:whole])

        def close() -> Iterator[pa.RecordBatch]:
            if state["now"] >= 0:
                yield from merge(True)
                state["file"].close()
                save(folder, f"contexts-{state['now']}", *state["sums"])

        for batch in batches:
            b, keys, n = (batch.column(i).to_numpy() for i in range(3))
            edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(edges, edges[1:]):
                if hi <= lo:
                    continue
                if b[lo] != state["now"]:
                    yield from close()
                    state.update(now=int(b[lo]), file=Appending(folder, f"pairs-{b[lo]}", 2), sums=np.zeros((4, span), np.int64), held=[])
                state["held"].append((keys[lo:hi].copy(), n[lo:hi].astype(np.int64)))
                if sum(len(k) for k, _ in state["held"]) >= HOLD:
                    yield from merge(False)
        yield from close()

    found = train.select("text").mapInArrow(count, "b long, pair long, n int")
    placed = found.repartition(parts, "b").sortWithinPartitions("b", "pair")
    return placed.mapInArrow(write, "kind int, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n"))


def write_continuations(rows: DataFrame, folder: str, parts: int, span: int) -> DataFrame:
    """Write how many different words precede each word, by ranges of ids; give back counts of those counts and their sum."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:  # a range is written densely, so no order is needed; ranges come one after another
            b, ids, n = (batch.column(i).to_numpy() for i in range(3))
            for x in np.unique(b).tolist():
                if x not in held:
                    for y in list(held):
                        save(folder, f"before-{y}", held.pop(y))
                    held[x] = np.zeros(span, np.int64)
                held[x][ids[b == x] - x * span] = n[b == x]
            few, times = np.unique(np.minimum(n, 5), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(few, 0).astype(np.int64)), pa.array(np.append(times, n.sum()).astype(np.int64))], ["r", "n"])
        for y in list(held):
            save(folder, f"before-{y}", held[y])

    placed = rows.select(F.floor(F.col("id") / span).alias("b"), "id", "n").repartition(parts, "b").sortWithinPartitions("b")
    return placed.mapInArrow(write, "r long, n long").groupBy("r").agg(F.sum("n").alias("n"))


def discounts(n: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts; kept within .01 and the count, .5 where undefined."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for r in (1, 2, 3):
        d = r - (r + 1) * y * n.get(r + 1, 0) / n[r] if n1 and n.get(r) else 0.5
        out.append(min(max(d, 0.01), float(r)))
    return out


@dataclass
class Model:
    """What scoring needs: paths and a few numbers; the arrays stay in the files."""

    words: Words
    folder: str
    parts: int
    train_tokens: int
    d1: list[float]
    d2: list[float]
    continuations: int
    kinds: list[int]  # words seen after 1, 2, and 3 or more different words
    open: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    def at(self, name: str, dtype) -> np.ndarray:
        if name not in self.open:
            self.open[name] = mapped(f"{self.folder}/{name}", dtype)
        return self.open[name]

    def ranged(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        span = self.words.size // self.parts + 1
        b = ids // span
        for x in np.unique(b[ids >= 0]).tolist():
            yield x, np.flatnonzero(b == x)

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        v, span = self.words.size, self.words.size // self.parts + 1
        if not self.continuations:
            return np.full(len(ids), 1.0 / (v + 1))
        c = np.zeros(len(ids), np.int64)
        for x, where in self.ranged(ids):
            before = self.at(f"before-{x}.0", np.int64)
            if len(before):
                c[where] = before[ids[where] - x * span]
        spare = sum(d * k for d, k in zip(self.d1, self.kinds)) / self.continuations
        taken = np.array([0.0, *self.d1])[np.minimum(c, 3)]
        return (c - taken) / self.continuations + spare / (v + 1)

    def bigram(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Probability of each word after its context; the word alone where the context was never seen."""
        lower, span = self.unigram(ids), self.words.size // self.parts + 1
        out = lower.copy()
        for x, where in self.ranged(context):
            total, *kinds = (self.at(f"contexts-{x}.{i}", np.int64) for i in range(4))
            if not len(total):
                continue
            local = context[where] - x * span
            seen = total[local] > 0
            where, local = where[seen], local[seen]
            pairs, counts = self.at(f"pairs-{x}.0", np.int64), self.at(f"pairs-{x}.1", np.int32)
            want = (context[where] << 32) | np.maximum(ids[where], 0)
            place = np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)
            c = np.where((pairs[place] == want) & (ids[where] >= 0), counts[place], 0).astype(np.int64)
            spare = sum(d * k[local] for d, k in zip(self.d2, kinds))
            out[where] = (c - np.array([0.0, *self.d2])[np.minimum(c, 3)] + spare * lower[where]) / total[local]
        return out


def train_model(train: DataFrame, folder: str) -> Model:
    """Three passes: count words, count pairs of word ids, count what precedes each word."""
    shards = shard_count(train, "text")
    bits = max(3, (shards // 8).bit_length())
    words, n = count_words(train, folder, bits)
    span = words.size // shards + 1
    rows = stored(count_pairs(train, words, folder, shards), "lm-counts")
    twos = {r["id"]: r["n"] for r in rows.filter("kind = 2").collect()}
    ones = {r["r"]: r["n"] for r in stored(write_continuations(rows.filter("kind = 1"), folder, shards, span), "lm-before").collect()}
    return Model(words, folder, shards, n, discounts(ones), discounts(twos), ones.get(0, 0), [ones.get(1, 0), ones.get(2, 0), sum(ones.get(r, 0) for r in (3, 4, 5))])


def perplexity(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``; learns from rows where ``learn`` holds.

    Tokens are the words of the whole text with A-Z in lower case, then one end token.  ``score`` is the log10 probability under the interpolated
    modified Kneser-Ney bigram model, ``base_score`` under smoothed word counts.  Null text is empty: one end token.  With nothing to learn
    from, every score is that of one unknown word in a vocabulary of none: 0.  Repeated rows score alike.  Other columns are not read.
    Counting moves each task's distinct pairs only; contexts are cut into ranges, a range streams through the task that writes it.
    """
    spark = docs.sparkSession
    folder = mounted(workspace(spark, "lm"))
    os.makedirs(folder, exist_ok=True)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train_model(docs.filter(learn).select(F.col(text_col).alias("text")), folder)
    n, v = model.train_tokens, model.words.size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, owner in tokens(batch):
                context, ids, counts = pair_ids(model.words, h, owner)
                base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
                ours = np.log10(model.bigram(context, ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(owner, minlength=hi - lo)), pa.array(np.bincount(owner, counts > 0, hi - lo).astype(np.int64)),
                     pa.array(np.full(hi - lo, n, np.int64)), pa.array(np.bincount(owner, base, hi - lo)), pa.array(np.bincount(owner, ours, hi - lo))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
