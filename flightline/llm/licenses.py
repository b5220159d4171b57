"""Licence scans: TF-IDF cosine of windows of words to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.llm.common import stored
from flightline.llm.licence_texts import PASSAGES

THRESHOLD = 0.8
WORD = "[a-z0-9](?:[a-z0-9.]*[a-z0-9])?"
#: Short statements by which texts name a licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
#: These statements with the headers and licence texts.
LICENCES = {n: ((TEMPLATES[n],) if n in TEMPLATES else ()) + PASSAGES.get(n, ()) for n in sorted({*TEMPLATES, *PASSAGES})}
SPAN = 512  # windows that start in one piece of a file


def weights(templates: Mapping[Hashable, str]) -> tuple[dict[str, float], float, dict[Hashable, dict[str, float]]]:
    """Inverse template frequency of each term, that of a term of no template, and each template's unit vector.

    No weight is below 1, so that among many templates a statement of few words does not hang on its rarest one.
    """
    bags = {n: Counter(words(t)) for n, t in templates.items()}
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: 1 + math.log((1 + len(bags)) / (1 + n)) for w, n in df.items()}
    units = {}
    for n, b in bags.items():
        v = {w: c * idf[w] for w, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        units[n] = {w: x / norm for w, x in v.items()}
    return idf, 1 + math.log(1 + len(bags)), units


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def stated(files: DataFrame, path_col: str, text_col: str, templates: Mapping[str, str | Sequence[str]], threshold: float) -> DataFrame:
    """(path, licence, score): the template of the highest cosine to any window of a file, where that reaches ``threshold``; ties to the name first in order.

    A file is one run of words; line ends and comment marks split nothing.  Windows are all runs of as many consecutive words as the template has; a file shorter
    than a template is scored whole.  Files are cut into pieces of ``SPAN`` windows.  Two bounds that hold for every template leave few windows to score: a cosine
    is at most the length of the template's part in the terms of the piece, and at most a window's inner product with the template over the root of its summed
    squared weights, both sums kept up word by word.  The terms of all templates travel in the plan, so their number is meant to stay in the thousands.
    """
    passages = {(n, i): p for n, t in templates.items() for i, p in enumerate([t] if isinstance(t, str) else t)}
    idf, other, units = weights(passages)
    keys, terms = sorted(passages), sorted(idf)
    if not terms:
        return files.select(F.col(path_col).alias("path"), F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("score")).filter("score > 0")
    sizes = [len(words(passages[k])) for k in keys]
    vocabulary = F.split(F.lit(" ".join(terms)), " ")
    weight, unit = numbers(idf[t] for t in terms), numbers(units[k].get(t, 0.0) for k in keys for t in terms)
    size = numbers(sizes).cast("array<int>")
    most = max(sizes)
    least = threshold * threshold - 1e-6

    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD})"))
    some = files.select(F.col(path_col).alias("path"), w.alias("w"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / SPAN).cast("int")),
                       lambda c: F.struct((F.size("w") - c * SPAN).alias("left"), (c == 0).alias("first"), F.slice("w", c * SPAN + 1, SPAN + most - 1).alias("w")))
    some = some.select("path", F.explode(F.when(F.size("w") > 0, cuts)).alias("_c")).select("path", "_c.*")

    # the terms met, their numbers, and the templates of which enough is there; arrays of one give a value a name, so that it is computed once
    met = F.transform(F.array(F.array_intersect("w", vocabulary)), lambda m: F.struct(m.alias("met"), F.transform(m, lambda x: F.array_position(vocabulary, x).cast("int") - 1).alias("ids")))
    mass = lambda ids, k: F.aggregate(ids, F.lit(0.0), lambda m, i: m + unit[k * len(terms) + i] * unit[k * len(terms) + i])
    able = lambda s: F.filter(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda k: mass(s["ids"], k) >= least)
    pairs = F.flatten(F.transform(met, lambda s: F.transform(able(s), lambda k: F.struct(k.alias("k"), size[k].alias("size"), s["met"].alias("met"), s["ids"].alias("ids")))))
    some = some.select("path", "left", "first", "w", F.explode(pairs).alias("_p")).select("path", "left", "first", "w", "_p.*")
    # a file shorter than the template has one window, which is the file; its later pieces, if any, none
    some = some.withColumn("size", F.when(F.col("first"), F.least("size", "left")).otherwise(F.col("size")))

    place = F.transform("w", lambda x: F.array_position("met", x).cast("int"))  # 0: no term of a template
    gain = F.concat(F.array(F.lit(0.0)), F.transform("ids", lambda i: weight[i] * unit[F.col("k") * len(terms) + i]))
    cost = F.concat(F.array(F.lit(other * other)), F.transform("ids", lambda i: weight[i] * weight[i]))
    named = F.transform(F.array(F.struct(place.alias("place"), gain.alias("gain"), cost.alias("cost"))), lambda z: F.struct(
        F.transform(z["place"], lambda p: z["gain"][p]).alias("gain"), F.transform(z["place"], lambda p: z["cost"][p]).alias("cost")))

    def starts(z: Column) -> Column:
        """Where windows start that can reach the threshold: ``gain`` and ``cost`` summed over the last ``size`` words."""
        def step(m: Column, e: Column) -> Column:
            moved = lambda c: m[c] + z[c][e] - F.when(e >= F.col("size"), z[c][e - F.col("size")]).otherwise(F.lit(0.0))
            at = e - F.col("size") + 1
            good = (at >= 0) & (moved("gain") >= (threshold - 1e-6) * F.sqrt(F.greatest(moved("cost"), F.lit(0.0))))
            return F.struct(moved("gain").alias("gain"), moved("cost").alias("cost"), F.when(good, F.concat(m["at"], F.array(at))).otherwise(m["at"]).alias("at"))
        ends = F.sequence(F.lit(0), F.least(F.size("w"), F.lit(SPAN - 1) + F.col("size")) - 1)
        zero = F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("at"))
        return F.aggregate(ends, zero, step, lambda m: m["at"])

    windows = F.flatten(F.transform(named, lambda z: F.transform(starts(z), lambda at: F.slice("w", at + 1, F.col("size")))))
    some = some.select("path", "k", "met", "ids", F.explode(windows).alias("s"))

    def entry(s: Column, x: Column) -> Column:
        i = F.try_element_at("ids", F.nullif(F.array_position("met", x).cast("int"), F.lit(0)))
        times = F.size(F.filter(s, lambda y: y == x))
        return F.struct((times * F.coalesce(weight[i], F.lit(other))).alias("x"), F.coalesce(unit[F.col("k") * len(terms) + i], F.lit(0.0)).alias("y"))

    total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda m, e: m + f(e))
    vector = F.transform(F.array(F.transform(F.array_distinct("s"), lambda x: entry(F.col("s"), x))),
                         lambda v: F.round(total(v, lambda e: e["x"] * e["y"]) / F.sqrt(total(v, lambda e: e["x"] * e["x"])), 9))
    name = F.split(F.lit("\n".join(k[0] for k in keys)), "\n")[F.col("k")]
    good = some.select("path", name.alias("licence"), vector[0].alias("score"))
    best = good.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score")).filter(F.col("score") >= threshold)


def numbers(values: Iterable[float]) -> Column:
    """A constant array from one string, which the optimizer folds."""
    return F.split(F.lit(" ".join(repr(v) for v in values)), " ").cast("array<double>")


def licences(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: Mapping[str, str | Sequence[str]] = LICENCES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: ``path, licence, score, inherited_from``.

    A file has the licence that one of its windows of words states.  Otherwise it takes that of the nearest directory above it (its own first) in which a file states one; of
    several there the one whose file comes first by name.  ``inherited_from`` is that directory, null for own licences; all three null where nothing is found.
    Null or empty texts state nothing; a null path has no directories; rows that repeat a path share what any of them states.  Other columns are not read.
    Each file is joined with the directories above it, whose number is the depth of its path; directories that state something are one row each.
    What files state is found once and stored.
    """
    own = stored(stated(files, path_col, text_col, templates, threshold), "stated")
    folder = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))
    above = own.filter("path IS NOT NULL").withColumn("dir", folder(F.col("path"))).groupBy("dir").agg(F.min_by("licence", "path").alias("_licence"), F.min_by("score", "path").alias("_score"))
    paths = files.select(F.col(path_col).alias("path")).distinct()
    named = paths.join(own.withColumnRenamed("path", "_own"), F.col("path").eqNullSafe(F.col("_own")), "left").select("path", "licence", "score")
    parts = F.split(folder(F.col("path")), "/")
    dirs = named.filter("licence IS NULL AND path IS NOT NULL").withColumn("_p", parts).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("_p"))))
    dirs = dirs.select("path", "depth", F.concat_ws("/", F.slice("_p", F.lit(1), F.col("depth"))).alias("dir")).distinct()
    found = dirs.join(above, "dir").groupBy("path").agg(F.max(F.struct("depth", "dir", "_licence", "_score")).alias("n")).select(F.col("path").alias("_path"), "n")
    told = named.join(found, F.col("path") == F.col("_path"), "left").select(
        F.col("path").alias("_k"), F.coalesce("licence", "n._licence").alias("licence"), F.coalesce("score", "n._score").alias("score"),
        F.when(F.col("licence").isNull(), F.col("n.dir")).alias("inherited_from"))
    return files.select(F.col(path_col).alias("path")).join(told, F.col("path").eqNullSafe(F.col("_k")), "left").drop("_k")
