"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how often over the whole corpus."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.llm.bpe import byte_letters
from flightline.llm.common import small_batches, stored

BLOCK_CHARS = 8 << 20  # text whose stretches make one block; a longer single text is held whole
KEPT = 300_000  # stretches that a task keeps encoded for its next blocks
AT_ONCE, TOGETHER = 20_000, 500  # stretches that one round of arrays covers, and that go to A as one text
#: A space beside anything but letters, digits and visible ASCII is no place to cut a text into stretches.
UNSURE = re.compile(r"^(?![\w!-~])|(?<![\w!-~]) | (?![\w!-~])|^ ")
DOCUMENT, BLOCK, VECTOR = 0, 1, 2
TABLE = ("kind int, block long, {id} n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stretches array<int>, "
         "pair_at array<int>, pair_of array<int>, same_at array<int>, same_of array<int>, pairs array<long>, times array<long>")


def stretches_of(text: str) -> list[str]:
    """The text cut at single spaces that both tokenizers always start a token with; the space that leads each stretch is left off.

    Neither tokenizer joins anything across such a space: the byte-level one splits there before merging, and no piece of the other holds a space
    after something else (``Pair`` checks that).  So each stretch is encoded alike wherever it stands.
    """
    parts = text.split(" ")
    if not UNSURE.search(text):
        return parts
    out, whole = [parts[0]], bool(parts[0]) and sure(parts[0][-1])
    for part in parts[1:]:
        if whole and part and sure(part[0]):
            out.append(part)
        else:
            out[-1] += " " + part
        whole = bool(part) and sure(part[-1])
    return out


def sure(letter: str) -> bool:
    return letter.isalnum() or "!" <= letter <= "~"


def spellings(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, beginnings and bytes of all tokens."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    return lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(tokens), np.uint8)


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``begins[i], begins[i] + 1, ...``, ``sizes[i]`` of each, end to end."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(begins - first, sizes)


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes, empty ones too."""
    edges = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return edges[ends] - edges[ends - sizes]


class Pair:
    """Both tokenizers and what is known of their ids; built in the task from the files' bytes."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_file.decode("utf-8"))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        to_byte = {c: i for i, c in enumerate(byte_letters())}
        spec = json.loads(a_file)
        ids = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}}
        a_bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # texts may be cut at spaces only if no piece goes on over one and the model changes nothing before it looks for pieces
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces) and self.b.normalize("ﬁ  Ⅷ\ta ") == "▁ﬁ▁▁Ⅷ\ta▁"
        self.a_spelt, self.b_spelt = spellings(a_bytes), spellings(b_bytes)
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        normal = {t: i for i, t in enumerate(b_bytes) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([normal.get(t, -1) for t in a_bytes], np.int64)
        self.a_text = [np.array([f"{i}{mark}" for i in range(self.n_a)], object) for mark in ",|"]
        self.b_text = [np.array([f"{i}{mark}" for i in range(self.n_b)], object) for mark in ",;"]
        self.a_width = np.array([len(t) for t in self.a_text[0]], np.int64)
        self.b_width = np.array([len(t) for t in self.b_text[0]], np.int64)

    def align(self, stretches: list[str]) -> dict:
        """For each stretch: whether both tokenizers give its bytes back, its counts, its groups as text, and its links.

        The ends of both tokenizers' tokens, taken together, cut the bytes into segments, each within one token of either: so every link is one
        segment, and a group is what lies between two ends that both have.  ``same``: A ids of groups of one token each whose B id is that of
        the same bytes; ``pairs``: all other links as ``a * B's size + b``.
        """
        raw = [b" " + s.encode() for s in stretches]
        sizes = np.array([len(t) for t in raw], np.int64)
        ids_a, many_a = self._first_ids(stretches, sizes)
        listed_b = self.b.encode(stretches, out_type=int, add_bos=False, add_eos=False, num_threads=1)
        many_b = np.array([len(x) for x in listed_b], np.int64)
        ids_b = np.fromiter(chain.from_iterable(listed_b), np.int64, int(many_b.sum()))
        good = self._spelt_right(raw, sizes, ids_a, many_a, self.a_spelt) & self._spelt_right(raw, sizes, ids_b, many_b, self.b_spelt)
        ids_a, ids_b = ids_a[np.repeat(good, many_a)], ids_b[np.repeat(good, many_b)]
        many_a, many_b = many_a * good, many_b * good
        end_a, end_b = np.cumsum(self.a_spelt[0][ids_a]), np.cumsum(self.b_spelt[0][ids_b])
        stops = np.cumsum(sizes * good)
        in_a, in_b = np.zeros((2, int(stops[-1]) + 1 if len(stops) else 1), bool)
        in_a[end_a], in_b[end_b] = True, True
        cuts = np.flatnonzero(in_a | in_b)  # one link ends at each
        of_a, of_b, of_both = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, np.cumsum(in_a & in_b)
        a_of, b_of = of_a[cuts], of_b[cuts]
        shared = (in_a & in_b)[cuts]
        links = np.diff(np.cumsum(in_a | in_b)[stops], prepend=0)
        group = np.cumsum(shared) - shared
        a_group, b_group = of_both[end_a] - in_b[end_a], of_both[end_b] - in_a[end_b]
        groups = summed(shared.astype(np.int64), links)
        per_group = int(shared.sum())
        a_in, b_in = np.bincount(a_group, minlength=per_group), np.bincount(b_group, minlength=per_group)
        one = (a_in == 1) & (b_in == 1)
        found_a, found_b = ids_a[a_of], ids_b[b_of]
        same = one[group] & (self.same[found_a] == found_b) if len(cuts) else np.zeros(0, bool)
        return {"good": good, "n_a": many_a, "n_b": many_b, "n_groups": groups, "n_links": links, "groups": self._written(ids_a, a_group, a_in, many_a, ids_b, b_group, b_in, many_b),
                "same": found_a[same], "n_same": summed(same.astype(np.int64), links), "pairs": (found_a * self.n_b + found_b)[~same], "n_pairs": summed((~same).astype(np.int64), links)}

    def _first_ids(self, stretches: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all stretches, end to end, and how many each has.  Stretches that begin and end surely are encoded as one text."""
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        texts, together = [], 0
        for s in stretches:
            if s and sure(s[0]) and sure(s[-1]):
                if together % TOGETHER:
                    texts[-1].append(s)
                else:
                    texts.append([s])
                together += 1
            else:
                texts.append([s])
                together = 0
        ids = np.fromiter(chain.from_iterable(e.ids for e in encode([" " + " ".join(t) for t in texts], add_special_tokens=False)), np.int64)
        ends, stops = np.cumsum(self.a_spelt[0][ids]), np.cumsum(sizes)
        at = np.searchsorted(ends, stops)
        if len(ends) and ends[-1] == stops[-1] and np.array_equal(ends[at], stops):
            return ids, np.diff(at + 1, prepend=0)
        listed = [e.ids for e in encode([" " + s for s in stretches], add_special_tokens=False)]
        many = np.array([len(x) for x in listed], np.int64)
        return np.fromiter(chain.from_iterable(listed), np.int64, int(many.sum())), many

    @staticmethod
    def _spelt_right(raw: list[bytes], sizes: np.ndarray, ids: np.ndarray, many: np.ndarray, spelt) -> np.ndarray:
        lengths, begins, letters = spelt
        good = summed(lengths[ids], many) == sizes
        kept = ids[np.repeat(good, many)]
        made = letters[spread(begins[kept], lengths[kept])]
        want = np.frombuffer(b"".join(t for t, g in zip(raw, good) if g), np.uint8)
        wrong = np.flatnonzero(made != want)
        if len(wrong):
            which = np.flatnonzero(good)
            good[which[np.searchsorted(np.cumsum(sizes[which]), wrong, side="right")]] = False
        return good

    def _written(self, ids_a, a_group, a_in, many_a, ids_b, b_group, b_in, many_b) -> list[str]:
        """Groups of each stretch as ``a1,a2|b1;a3|b2,b3``."""
        n = len(ids_a) + len(ids_b)
        if not n:
            return [""] * len(many_a)
        # tokens in the order they are written: a group's A ids, then its B ids
        before_a, before_b = np.cumsum(a_in) - a_in, np.cumsum(b_in) - b_in
        at_a = np.arange(len(ids_a)) + before_b[a_group]
        at_b = np.arange(len(ids_b)) + np.cumsum(a_in)[b_group]
        last_a = np.arange(len(ids_a)) == (before_a + a_in - 1)[a_group]
        last_b = np.arange(len(ids_b)) == (before_b + b_in - 1)[b_group]
        out, width = np.empty(n, object), np.zeros(n, np.int64)
        out[at_a] = np.where(last_a, self.a_text[1][ids_a], self.a_text[0][ids_a])
        out[at_b] = np.where(last_b, self.b_text[1][ids_b], self.b_text[0][ids_b])
        width[at_a], width[at_b] = self.a_width[ids_a], self.b_width[ids_b]
        whole = "".join(out.tolist())
        ends = np.concatenate([[0], np.cumsum(width)])[np.cumsum(many_a + many_b)]
        starts = np.concatenate([[0], ends[:-1]])
        return [whole[lo:hi - 1] if hi > lo else "" for lo, hi in zip(starts.tolist(), ends.tolist())]


class Known:
    """Stretches that a task has aligned so far, as arrays that grow block by block."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.same, self.pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64)), (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def learn(self, pair: Pair, stretches: list[str]) -> None:
        parts = [pair.align(stretches[lo:lo + AT_ONCE]) for lo in range(0, len(stretches), AT_ONCE)]
        for got in parts:
            self.groups += got["groups"]
        self.counts = np.concatenate([self.counts, *[np.stack([got["n_a"], got["n_b"], got["n_groups"], got["n_links"]], 1) for got in parts]])
        self.good = np.concatenate([self.good, *[got["good"] for got in parts]])
        self.same = tuple(np.concatenate([old, *[got[name] for got in parts]]) for old, name in zip(self.same, ("same", "n_same")))
        self.pairs = tuple(np.concatenate([old, *[got[name] for got in parts]]) for old, name in zip(self.pairs, ("pairs", "n_pairs")))


def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def token_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Blocks of texts: a row per text with its stretches by number, and a row per block with the stretches' links; a row per task has the counts of
    regular links by A id.  Stored once, so that numbers and rows belong together whatever becomes of a task.  Also B's number of ids."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        files = f.read(), g.read()
    shared = spark.sparkContext.broadcast(files)  # a few MB, the size of the tokenizers' files
    n_b = Pair(*files).n_b
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair, known, vector, nr = Pair(*shared.value), Known(), None, 0
        vector = np.zeros(pair.n_a, np.int64)
        ids, texts, chars, part, id_type = [], [], 0, 0, None

        def table(kinds, block, ids, numbers, digests, *lists_) -> pa.RecordBatch:
            n = len(kinds)
            empty = pa.array([None] * n, pa.list_(pa.int32()))
            filled = [*lists_, *[None] * (7 - len(lists_))]
            wide = [x if x is not None else (empty if k < 5 else pa.array([None] * n, pa.list_(pa.int64()))) for k, x in enumerate(filled)]
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([block] * n, pa.int64()), ids, *[pa.array(numbers[:, k]) for k in range(4)],
                                               pa.array(digests, pa.string()), *wide], names)

        names = ["kind", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "stretches", "pair_at", "pair_of", "same_at", "same_of", "pairs", "times"]

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal known, nr, vector
            if len(known.groups) > KEPT:
                known = Known()
            which, sizes = [], []
            number = known.number
            for t in texts:
                parts = (stretches_of(t) if pair.cuts else [t]) if t else []
                which.extend([number.setdefault(p, len(number)) for p in parts])
                sizes.append(len(parts))
            if len(number) > len(known.groups):
                known.learn(pair, list(islice(number, len(known.groups), None)))
            which, sizes = np.array(which, np.int64), np.array(sizes, np.int64)
            owner = np.repeat(np.arange(len(texts)), sizes)
            bad = np.bincount(owner, ~known.good[which], len(texts)) > 0
            which, sizes = which[~bad[owner]], sizes * ~bad
            used, local = np.unique(which, return_inverse=True)
            times = np.bincount(local, minlength=len(used)).astype(np.int64)
            numbers = np.stack([summed(known.counts[which, k], sizes) for k in range(4)], 1)
            digests, at = [], 0
            for n in sizes.tolist():
                digests.append(hashlib.sha256(";".join([known.groups[k] for k in which[at:at + n].tolist()]).encode()).hexdigest() if n else "")
                at += n
            (pair_flat, pair_sizes), (same_flat, same_sizes) = known.pairs, known.same
            own = pair_flat[spread((np.cumsum(pair_sizes) - pair_sizes)[used], pair_sizes[used])]
            regular = same_flat[spread((np.cumsum(same_sizes) - same_sizes)[used], same_sizes[used])]
            codes, of = np.unique(own, return_inverse=True)
            weights = np.bincount(of, np.repeat(times, pair_sizes[used]), len(codes)).astype(np.int64)
            vector += np.bincount(regular, np.repeat(times, same_sizes[used]), pair.n_a).astype(np.int64)
            name = (part << 32) + nr
            nr += 1
            yield table([DOCUMENT] * len(texts), name, pa.concat_arrays(ids), numbers, digests, lists(local.astype(np.int32), sizes))
            one = np.ones(1, np.int64)
            yield table([BLOCK], name, pa.nulls(1, id_type), np.zeros((1, 4), np.int64), [""], None, *[lists(x.astype(np.int32), one * len(x)) for x in (
                pair_sizes[used], of, same_sizes[used], regular)], lists(codes, one * len(codes)), lists(weights, one * len(codes)))

        for batch in batches:
            if not batch.num_rows:
                continue
            part, id_type = batch.column(2)[0].as_py(), batch.column(0).type
            got = batch.column(1).to_pylist()
            lo, total = 0, 0
            for i, t in enumerate(got):
                chars += len(t or "")
                if chars >= BLOCK_CHARS:
                    ids.append(batch.column(0).slice(lo, i + 1 - lo))
                    texts += got[lo:i + 1]
                    yield from block()
                    ids, texts, chars, lo = [], [], 0, i + 1
            if lo < len(got):
                ids.append(batch.column(0).slice(lo))
                texts += got[lo:]
        if texts:
            yield from block()
        have = np.flatnonzero(vector)
        if len(have):
            one = np.ones(1, np.int64)
            yield table([VECTOR], part << 32, pa.nulls(1, id_type), np.zeros((1, 4), np.int64), [""], None, None, None, None, None,
                        lists(have * pair.n_b + pair.same[have], one * len(have)), lists(vector[have], one * len(have)))

    return stored(rows.mapInArrow(run, TABLE.format(id=f"doc_id {kind},")), "token-blocks"), n_b


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(code, n, best, regular): how often each pair of ids is linked, whether that is its B id's most, and whether groups of one token each had it."""
    pairs = (blocks.filter(F.col("kind") != DOCUMENT).select("kind", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
             .groupBy(F.col("p.pairs").alias("code")).agg(F.sum("p.times").alias("n"), F.max(F.col("kind") == VECTOR).alias("regular")))
    pairs = stored(pairs.withColumn("b", F.pmod("code", F.lit(n_b))), "pair-counts")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"), "regular")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Texts, led by a space, are encoded by the byte-level BPE file ``a_path``, special strings as plain text, and by the sentencepiece model
    ``b_path``, which leads with a space itself.  Groups lie between byte offsets where tokens of both end; tokens whose bytes overlap are linked.  A pair's count
    is over the whole corpus; ``n_best`` are links whose count is the highest of their B id (ties included), ``count_sum`` adds up all.  Texts null, empty, or
    not spelt back by either tokenizer's tokens have zeros and an empty digest.  Repeated rows count each time; null ids keep their rows; other columns are not read.

    Groups of one token each whose ids spell the same bytes are counted in a vector as long as A's vocabulary; only other links are shuffled, once
    a block and pair.  What comes back to a block is a row for each of its pairs, so no text and no pair gathers in one task.
    """
    spark = docs.sparkSession
    blocks, n_b = token_blocks(docs, a_path, b_path, id_col, text_col)
    counts = stored(pair_counts(blocks, n_b), "pair-totals")
    # at most one row for each id of A
    regular = counts.filter("regular").select("code", "n", "best").toPandas()
    top = int(regular["code"].max()) // n_b + 1 if len(regular) else 0
    vector = np.zeros((2, top), np.int64)
    vector[0, regular["code"].to_numpy(np.int64) // n_b] = regular["n"].to_numpy(np.int64)
    vector[1, regular["code"].to_numpy(np.int64) // n_b] = regular["best"].to_numpy(bool)
    shared = spark.sparkContext.broadcast(vector)
    wanted = blocks.filter(F.col("kind") == BLOCK).select(F.col("block").alias("home"), F.explode("pairs").alias("code"))
    values = wanted.join(counts, "code").select("home", "code", "n", "best")
    id_type = blocks.schema["doc_id"].dataType.simpleString()

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        kinds = own["kind"].to_numpy()
        rows = own.filter(pa.array(kinds == DOCUMENT))
        links = own.filter(pa.array(kinds == BLOCK))

        def flat(column: str) -> np.ndarray:
            return links[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)

        codes, pair_of, pair_sizes, same_of, same_sizes = flat("pairs"), flat("pair_of"), flat("pair_at"), flat("same_of"), flat("same_at")
        order = np.argsort(found["code"].to_numpy())
        at = order[np.searchsorted(found["code"].to_numpy(), codes, sorter=order)] if len(codes) else np.zeros(0, np.int64)
        n, best = found["n"].to_numpy()[at], found["best"].to_numpy(zero_copy_only=False).astype(np.int64)[at]
        per = [summed(one[pair_of], pair_sizes) + summed(vec[same_of], same_sizes) for one, vec in ((n, shared.value[0]), (best, shared.value[1]))]
        used = rows["stretches"].combine_chunks()
        sizes = np.array(used.value_lengths().fill_null(0), np.int64)
        which = used.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out = {c: rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table({**out, "n_best": summed(per[1][which], sizes), "count_sum": summed(per[0][which], sizes), "groups_sha256": rows["groups_sha256"]})

    own = blocks.filter(F.col("kind") != VECTOR).drop("times")
    return (own.groupBy("block").cogroup(values.groupBy("home"))
            .applyInArrow(score, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
