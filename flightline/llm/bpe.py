"""Byte-level BPE encoding with a pair occurrence index, and decoding."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.llm.common import small_batches

BATCH_CHARS = 1 << 20
KEPT_IDS = 1 << 19  # ids of words that a task keeps for its next texts
#: Fixed value: how the vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, otherwise the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in set(seen) else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of a tokenizer file, as arrays; its size is that of the file, whatever the corpus."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        ids, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*ids.values(), *special.values()]) + 1
        self.special = special
        self.byte_id = np.array([ids[c] for c in letters], np.int64)
        codes = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], order
        self.left, self.right = codes // self.size, codes % self.size
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        spelled = [b""] * self.size
        for t, i in ids.items():
            spelled[i] = bytes(to_byte[c] for c in t)
        for t, i in special.items():
            spelled[i] = t.encode()
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)

    def rank_of(self, codes: np.ndarray) -> np.ndarray:
        """Rank of each pair code; -1 for pairs that no merge has."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, laid end to end, and how many each has.

        The words' symbols form one array with links to the next and the previous.  An index maps each rank (so each pair) to all places
        where that pair stands; the smallest active rank is applied to all its places at once, and only the pairs beside them change.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sym = self.byte_id[raw]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        nxt[ends[sizes > 0] - 1] = -1
        prv[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray, codes: np.ndarray) -> None:
            ranks = self.rank_of(codes)
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lows = [0, *cuts.tolist()]
            for lo, hi, r in zip(lows, [*lows[1:], len(ranks)], ranks[lows].tolist()):
                if r in index:
                    index[r].append(places[lo:hi])
                else:
                    index[r] = [places[lo:hi]]
                    heapq.heappush(active, r)

        have = np.flatnonzero(nxt >= 0)
        note(have, sym[have] * self.size + sym[have + 1])
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            a, b, c = self.left[r], self.right[r], self.made[r]
            at = at[(sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            at = np.unique(at)  # a pair between two fresh symbols was noted from both sides
            if a == b and len(at) > 1:
                at = first_of_runs(at, nxt)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone], nxt[at] = c, -1, after
            prv[after[after >= 0]] = at[after >= 0]
            right, before = at[after >= 0], prv[at]
            left = before[before >= 0]
            note(np.concatenate([right, left]), np.concatenate([c * self.size + sym[after[after >= 0]], sym[left] * self.size + c]))
        alive = sym >= 0
        counts = np.add.reduceat(np.concatenate([alive, [False]]).astype(np.int64), ends - sizes) if len(words) else np.zeros(0, np.int64)
        return sym[alive], np.where(sizes > 0, counts, 0)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        total = int(sizes.sum())
        return self.spelling[np.arange(total) + np.repeat(self.begins[ids] - (np.cumsum(sizes) - sizes), sizes)].tobytes()


def first_of_runs(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of the sorted places of a pair of equal symbols, every other one of each run that overlaps: the leftmost merges first."""
    starts = np.ones(len(at), bool)
    starts[1:] = nxt[at[:-1]] != at[1:]
    run = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    return at[(np.arange(len(at)) - run) % 2 == 0]


def shared_vocabulary(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast of a few MB; tasks build their vocabulary from its bytes, so they need no copy of this package."""
    small_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _batched(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of each whole text by the byte-level BPE file at ``path``.

    Special tokens of the file found in a text become their own ids, as the tokenizers library has it; none are added.  Texts null or
    empty have no ids; repeated rows are encoded alike.  Other columns are not read.
    """
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        vocab = Vocabulary(shared.value)
        pieces = regex.compile(PATTERN).findall
        special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True)) + ")") if vocab.special else None
        numbers: dict[str, int] = {}
        ids, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _batched([len(t) for t in texts], BATCH_CHARS):
                if len(ids) > KEPT_IDS:
                    numbers, ids, sizes = {}, ids[:0], sizes[:0]
                words, counts = [], []
                for t in texts[lo:hi]:
                    n = len(words)
                    if special is not None and special.search(t):
                        for k, part in enumerate(special.split(t)):
                            words.extend([numbers.setdefault("\0special" + part, len(numbers))] if k % 2 else [numbers.setdefault(w, len(numbers)) for w in pieces(part)])
                    else:
                        words.extend([numbers.setdefault(w, len(numbers)) for w in pieces(t)])
                    counts.append(len(words) - n)
                fresh = list(islice(numbers, len(sizes), None))
                alone = {i: vocab.special[w[8:]] for i, w in enumerate(fresh) if w.startswith("\0special") and w[8:] in vocab.special}
                more, each = vocab.encode([b" " if i in alone else w.encode("utf-8", "surrogatepass") for i, w in enumerate(fresh)])
                at = np.cumsum(each) - each
                for i, token in alone.items():
                    more[at[i]] = token
                ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, each])
                begins = np.cumsum(sizes) - sizes
                which = np.array(words, np.int64)
                each = sizes[which]
                flat = ids[np.arange(int(each.sum())) + np.repeat(begins[which] - (np.cumsum(each) - each), each)].astype(np.int32)
                per = np.add.reduceat(np.concatenate([each, [0]]), np.cumsum(counts) - counts) * (np.array(counts) > 0)
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text`` to (doc_id, ids): the tokens' bytes as UTF-8, special tokens as their names; null ids count as none."""
    shared = shared_vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(shared.value)
        for batch in batches:
            texts = [vocab.decode(np.asarray(ids.values.to_numpy(zero_copy_only=False), np.int64)).decode("utf-8", "replace") if ids.is_valid else "" for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
