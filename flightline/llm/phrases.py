"""Collocations by partitioned mining (SON): shards are mined completely at lowered support, their finds are united, then counted over all rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.llm.common import BYTE_LOWER, ODD, SLOTS, chunks, grams, key_filter, listed, mixed, packed, powers, small_batches, spans, stored, text_bytes

SUPPORT, TOP, LONGEST = 30, 2000, 4
SHARDS = 2  # fixed and few, so that a shard's share of the support stays high however large the corpus is; a shard is counted by many tasks
UNKNOWN = "und"
LETTER, SPLIT = np.ones(256, bool), np.zeros(256, bool)
SPLIT[list(b".,;:!?\n\x0b\x0c\r")] = True
LETTER[list(b" \t.,;:!?\n\x0b\x0c\r")] = False
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, piece number, start and end of every word of the texts ``raw[at[i]:at[i+1]]``; pieces never reach over a text's end."""
    inside = LETTER[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(at, starts, side="right") - 1
    piece = np.cumsum(SPLIT[raw])[starts] + owner
    if not len(starts):
        return np.zeros(0, np.uint64), owner, piece, starts, stops
    lengths = stops - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    sums = np.add.reduceat(BYTE_LOWER[raw[inside]] * powers(int(lengths.max()) + 1)[within], first)
    return mixed(sums + lengths.astype(np.uint64) * ODD), owner, piece, starts, stops


def language_codes(langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each language for phrase keys, and its group number, which leaves room for the shard."""
    named = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big") for lang in set(langs)}
    wide = np.array([named[x] for x in langs], np.uint64)
    return mixed(wide + ODD), (wide >> np.uint64(8)).astype(np.int64) * SHARDS


def marked(marks: np.ndarray, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return (marks[(keys & np.uint64((1 << SLOTS) - 1)).astype(np.int64)] >> shard) & 1 == 1


def counted(docs: DataFrame, marks: np.ndarray | None, sizes: tuple[int, ...]) -> DataFrame:
    """(key, grp, n): occurrences of the phrases of ``sizes`` words by shard; ``marks`` keeps those all of whose parts, one word shorter than the first
    of ``sizes``, may be frequent in their shard."""
    shared = None if marks is None else docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, codes = language_codes(batch.column(0).to_pylist())
            shard_of = batch.column(2).to_numpy().astype(np.uint8)
            raw, at = text_bytes(batch.column(1))
            keys, groups = [], []
            for lo, hi in chunks(at):
                h, owner, piece, _, _ = words_of(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                owner = owner + lo
                part = sizes[0] - 1
                good = None
                if shared is not None:
                    g = grams(h, part) if part > 1 else h
                    good = spans(piece, part) & marked(shared.value, mixed(g ^ wide[owner[:len(g)]]), shard_of[owner[:len(g)]])
                for n in sizes:
                    ok = spans(piece, n)
                    if good is not None:
                        for j in range(n - part + 1):
                            ok &= good[j:j + len(ok)]
                    where = np.flatnonzero(ok)
                    g = (grams(h, n) if n > 1 else h)[where]
                    keys.append(mixed(g ^ wide[owner[where]]))
                    groups.append(codes[owner[where]] + shard_of[owner[where]])
            if not keys:
                continue
            keys, groups = np.concatenate(keys), np.concatenate(groups)
            order = np.argsort(keys ^ (groups.astype(np.uint64) * ODD))
            keys, groups = keys[order], groups[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1])])) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(groups[first]), pa.array(counts.astype(np.int64))],
                                             ["key", "grp", "n"])

    return docs.mapInArrow(run, "key long, grp long, n long").groupBy("key", "grp").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, marks: np.ndarray, longest: int) -> DataFrame:
    """(lang, words, phrase, f): all occurrences, over all shards, of the phrases that ``marks`` lists; of no words: how many words there are."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            wide, _ = language_codes(langs)
            raw, at = text_bytes(batch.column(1))
            for lo, hi in chunks(at):
                part = LOWERED[raw[at[lo]:at[hi]]]
                h, owner, piece, starts, stops = words_of(part, at[lo:hi + 1] - at[lo])
                whole = part.tobytes()
                words: dict[str, int] = {}
                for k, n in enumerate(np.bincount(owner, minlength=hi - lo).tolist(), lo):
                    words[langs[k]] = words.get(langs[k], 0) + n
                out_lang, out_size, out_phrase, out_n = list(words), [0] * len(words), [b""] * len(words), list(words.values())
                may = np.ones(len(h), bool)
                for n in range(1, longest + 1):
                    # with enough occurrences of its own, a phrase has both its parts that are one word shorter in the list
                    where = np.flatnonzero(may & spans(piece, n) if n == 1 else may[:-1] & may[1:] & spans(piece, n))
                    keys = mixed((grams(h, n) if n > 1 else h)[where] ^ wide[owner[where] + lo])
                    hit = listed(shared.value, keys)
                    may = np.zeros(max(0, len(h) - n + 1), bool)
                    may[where[hit]] = True
                    _, first, counts = np.unique(keys[hit], return_index=True, return_counts=True)
                    found = where[hit][first]
                    out_lang += [langs[k] for k in (owner[found] + lo).tolist()]
                    out_size += [n] * len(found)
                    out_phrase += [b" ".join([whole[starts[j]:stops[j]] for j in range(i, i + n)]) for i in found.tolist()]
                    out_n += counts.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out_size, pa.int32()), pa.array(out_phrase, pa.binary()).cast(pa.string()),
                                                  pa.array(out_n, pa.int64())], ["lang", "words", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases of up to ``longest`` words with at least ``support`` occurrences, (lang, n) of all words).

    A shard is half of the texts by hash.  A phrase with ``support`` occurrences has at least its share, ``ceil(support * shard's words /
    language's words)``, in some shard, so every such phrase is found there; counts of words, then of pairs, then of longer phrases only take what
    may still be frequent in its shard.  Local counting goes by hashes, which can only let more through; the last count goes by the phrases themselves.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text.alias("text"),
                       F.pmod(F.xxhash64(text), F.lit(SHARDS)).cast("int").alias("shard"))
    words = stored(counted(rows, None, (1,)), "shard-words")
    # a group is a language's shard: the language's number, which the shard is added to
    sizes = words.groupBy("grp").agg(F.sum("n").alias("part"))
    totals = sizes.groupBy((F.col("grp") - F.pmod("grp", F.lit(SHARDS))).alias("of")).agg(F.sum("part").alias("whole"))
    share = F.expr(f"cast({support} as decimal(20,0)) * cast(part as decimal(18,0)) / cast(whole as decimal(18,0))")
    least = (sizes.withColumn("of", F.col("grp") - F.pmod("grp", F.lit(SHARDS))).join(totals, "of")
             .select("grp", F.greatest(F.lit(1), F.ceil(share)).cast("long").alias("least")))
    least = stored(least, "shard-support")

    def locally(found: DataFrame) -> DataFrame:
        return found.join(least, "grp").filter("n >= least").select("key", F.pmod("grp", F.lit(SHARDS)).cast("int").alias("shard"))

    def mined(marks: np.ndarray, lengths: tuple[int, ...]) -> DataFrame:
        return stored(locally(counted(rows, marks, lengths)), f"local-{lengths[0]}")

    def in_shards(found: DataFrame) -> np.ndarray:
        return packed(found.select(F.col("key").bitwiseAND(F.lit((1 << SLOTS) - 1)).alias("place"), F.expr("shiftleft(1, shard)").alias("bit")))

    levels = [stored(locally(words), "local-1")]
    if longest > 1:
        levels.append(mined(in_shards(levels[-1]), (2,)))
    if longest > 2:
        levels.append(mined(in_shards(levels[-1]), tuple(range(3, longest + 1))))
    union = levels[0].select("key")
    for found in levels[1:]:
        union = union.unionAll(found.select("key"))
    candidates = key_filter(union)
    counts = stored(phrase_counts(rows, candidates, longest).filter((F.col("f") >= support) | (F.col("words") == 0)), "phrases")
    return counts.filter("words > 0"), counts.filter("words = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: int = SUPPORT, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """Each language's strongest phrases of 2 to ``longest`` words: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z only) and split at ``. , ; : ! ?`` and line ends; a phrase lies within one piece.  ``a`` is its count, at least
    ``support``; of all cuts into two parts the one with the smallest ``floor(2000000 a / (l + r))`` counts, the first of equal ones.  Phrases inside a
    longer one with 80 % of their count are left out.  Null texts are empty, a null language is ``und``; repeated rows count each time; ties of
    score and count go by the phrase's bytes.  Other columns are not read; without words there are no rows.
    """
    counts, totals = frequent_phrases(docs, lang_col, text_col, support, longest)
    word = F.split("phrase", " ")

    def joined(lo: Column, size: Column) -> Column:
        return F.array_join(F.slice(word, lo, size), " ")

    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": joined(F.lit(1), F.col("k")), "rest": joined(F.col("k") + 1, F.col("words") - F.col("k"))})
    lefts = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # decimals, since 2000000 a may pass 64 bits; div of decimals is exact and gives a long
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = (cuts.join(lefts, ["lang", "first"]).join(rights, ["lang", "rest"]).withColumn("score", score)
              .groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # parts of a longer phrase, with the count of the most frequent such phrase
    inner = (phrases.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
             .withColumn("lo", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
             .select("lang", joined(F.col("lo"), F.col("size")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    # 100 longer >= 80 a, without products
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.expr("longer is null or longer < a - a div 5"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, u.piece, u.nr
  FROM documents, LATERAL (SELECT unnest(p) AS piece, generate_subscripts(p, 1) AS nr
    FROM (SELECT regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p)) u),
words AS (
  SELECT doc_id, lang, nr, u.w, u.i
  FROM pieces, LATERAL (SELECT unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT regexp_extract_all(piece, '[^\x20\x09]+') AS x)) u),
ahead AS (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY doc_id, lang, nr ORDER BY i)),
seen AS (
  SELECT lang, 1 AS size, [w1] AS p FROM ahead
  UNION ALL SELECT lang, 2, [w1, w2] FROM ahead WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, [w1, w2, w3] FROM ahead WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, [w1, w2, w3, w4] FROM ahead WHERE w4 IS NOT NULL),
f AS (SELECT lang, size, p, count(*) AS f FROM seen GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cuts AS (
  SELECT c.lang, c.p, c.size, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, c.size)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, list_slice(p, lo, lo + s - 1) AS p, max(f) AS longer
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS lo FROM (SELECT *, unnest(range(2, size)) AS s FROM f WHERE size > 2)) GROUP BY ALL),
kept AS (SELECT b.* FROM lowest b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.p = b.p WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, score FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000
"""
