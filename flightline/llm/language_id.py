"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.llm.common import mixed, small_batches

DIMENSIONS = 2048
UNKNOWN = "und"
CHARS = 1 << 18  # characters that one round of numpy arrays covers
BITS = np.uint64(21)  # a code point fits in so many bits


class Profiles:
    """Turns texts into letter trigrams and trigrams into vectors; one per task, with what it has worked out so far."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letters = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                self.letters[c] = ord(low) if len(low) == 1 else c

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code and text number of every trigram: three letters in lower case, where one space stands for all between two words."""
        sizes = np.array([len(t) for t in texts], np.int64) + 1
        flat = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        a = self.letters[flat]
        keep = a != 0
        keep[1:] |= a[:-1] != 0
        keep[0] = True
        a, at = a[keep].astype(np.uint64), np.flatnonzero(keep)
        middle = np.flatnonzero(a[1:-1] != 0) + 1  # a trigram belongs to the text of its middle letter, so none spans two
        codes = (a[middle - 1] << (BITS + BITS)) | (a[middle] << BITS) | a[middle + 1]
        return codes, np.searchsorted(np.cumsum(sizes), at[middle] - 1, side="right")

    def letter_vectors(self, points: np.ndarray) -> np.ndarray:
        """Random +1/-1 vectors, drawn from the code point itself, so that every task draws the same."""
        lanes = np.arange(self.dimensions // 64, dtype=np.uint64)
        bits = mixed(mixed(points.astype(np.uint64) + np.uint64(1))[:, None] + lanes[None, :] * np.uint64(0x9E3779B97F4A7C15))
        return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)

    def vectors(self, codes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Trigram vectors: the letters' vectors, permuted by their place (a rotation) and bound by multiplication; in blocks."""
        mask = np.uint64((1 << 21) - 1)
        for lo in range(0, len(codes), 2048):
            part = codes[lo:lo + 2048]
            bound = None
            for place in range(3):
                points, which = np.unique((part >> (BITS * np.uint64(2 - place))) & mask, return_inverse=True)
                v = np.roll(self.letter_vectors(points), 2 - place, axis=1)[which]
                bound = v if bound is None else bound * v
            yield slice(lo, lo + len(part)), bound.astype(np.float32)


def _grouped(texts: list) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def prototypes(docs: DataFrame, text_col: str, lang_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, trigrams, vector): the bundle of all trigram vectors of a language's texts, in whole numbers.

    Each task adds up counts per language and trigram, bundles them once and hands on one vector per language; two rounds of sums
    follow.  Rows whose language or text is null teach nothing.
    """
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, counts = Profiles(dimensions), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), _texts(batch.column(1))
            for lo, hi in _grouped(texts):
                codes, owner = made.trigrams(texts[lo:hi])
                names = langs[lo:hi]
                order = {n: i for i, n in enumerate(dict.fromkeys(names))}
                lang = np.array([order[n] for n in names], np.int64)[owner] if len(codes) else np.zeros(0, np.int64)
                for name, i in order.items():
                    found, n = np.unique(codes[lang == i], return_counts=True)
                    if name in counts:
                        both = np.concatenate([counts[name][0], found])
                        found, which = np.unique(both, return_inverse=True)
                        n = np.bincount(which, np.concatenate([counts[name][1], n]), len(found)).astype(np.int64)
                    counts[name] = (found, n)
        rows = {"lang": [], "trigrams": [], "vector": []}
        for name, (codes, n) in counts.items():
            total = np.zeros(dimensions)
            for where, v in made.vectors(codes):
                total += n[where].astype(np.float64) @ v
            rows["lang"].append(name)
            rows["trigrams"].append(int(n.sum()))
            rows["vector"].append(total.astype(np.int64).tolist())
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("lang", pa.string()), ("trigrams", pa.int64()), ("vector", pa.list_(pa.int64()))]))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for name, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                had = sums.get(name, (0, 0))
                sums[name] = (had[0] + n, had[1] + np.array(v, np.int64))
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "trigrams": [n for n, _ in sums.values()], "vector": [v.tolist() for _, v in sums.values()]},
                                         schema=pa.schema([("lang", pa.string()), ("trigrams", pa.int64()), ("vector", pa.list_(pa.int64()))]))

    schema = "lang string, trigrams long, vector array<long>"
    small_batches(docs.sparkSession)
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = known.mapInArrow(bundle, schema).repartition(32).mapInArrow(add_up, schema)
    sums = parts.select("lang", "trigrams", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(
        F.sum("value").alias("value"), F.sum("trigrams").alias("trigrams"))
    return sums.groupBy("lang").agg(F.max("trigrams").alias("trigrams"), F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).select(
        "lang", "trigrams", F.col("v.value").alias("vector"))


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score``; learns from the rows where ``learn`` holds.

    A text's vector is the bundle of its trigram vectors.  Its dot product with a prototype is the sum of its trigrams' dot products, so
    each distinct trigram is compared once; the language of the largest cosine is predicted, ties to the name first in order.  ``score`` is that cosine's share
    of all positive cosines, in which the text's own length cancels out.  ``und`` and 0 where the text is null, empty or has no letter, or
    nothing could be learned.  The languages are taken to be few (their vectors come to the driver).  Other columns are not read.
    """
    taught = prototypes(docs.filter(learn), text_col, lang_col, dimensions).orderBy("lang").collect()
    names = [r["lang"] for r in taught]
    against = np.array([r["vector"] for r in taught], np.float64).reshape(len(names), dimensions)
    against = (against / np.maximum(np.linalg.norm(against, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Profiles(dimensions)
        known, dots = np.zeros(0, np.uint64), np.zeros((0, len(names)))
        for batch in batches:
            texts = _texts(batch.column(1))
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo, hi in _grouped(texts) if names else ():
                codes, owner = made.trigrams(texts[lo:hi])
                if not len(codes):
                    continue
                found, which = np.unique(codes, return_inverse=True)
                fresh = np.setdiff1d(found, known, assume_unique=True)
                more = np.zeros((len(fresh), len(names)))
                for where, v in made.vectors(fresh):
                    more[where] = v @ against.T
                if len(known) > 200_000:  # only what later texts repeat is worth keeping; start anew
                    known, dots, fresh = np.zeros(0, np.uint64), dots[:0], found
                    more = np.concatenate([v @ against.T for _, v in made.vectors(fresh)]).astype(np.float64)
                known, dots = np.concatenate([known, fresh]), np.concatenate([dots, more])
                order = np.argsort(known)
                known, dots = known[order], dots[order]
                each = dots[np.searchsorted(known, found)]
                total = np.stack([np.bincount(owner, each[which, j], hi - lo) for j in range(len(names))], axis=1)
                some = np.bincount(owner, minlength=hi - lo) > 0
                best = total.argmax(axis=1)
                positive = np.maximum(total, 0)
                share = positive[np.arange(hi - lo), best] / np.maximum(positive.sum(axis=1), 1e-12)
                for i in np.flatnonzero(some):
                    langs[lo + i] = names[best[i]]
                scores[lo:hi] = np.where(some, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
