"""Make/miss models: folds, fits, blends and what a prediction is worth."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.operators.grouped_fits import grouped_logistic, predicted
from flightline.operators.scoring import one, rank_auc
from flightline.runtime import cut


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns in sorted order as one vector."""
    return VectorAssembler(inputCols=sorted(features), outputCol=out).transform(df)


def logistic(n_rows: int, c: float = 0.5) -> Pipeline:
    """Standardised logistic regression; inverse strength ``c`` on a summed loss is 1 / (c n) on Spark's mean loss."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    model = LogisticRegression(featuresCol="scaled", labelCol="y", regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0,
                               standardization=False, maxIter=100)
    return Pipeline(stages=[scale, model])


def boosting(trees: int = 200, depth: int = 2, rate: float = 0.05) -> Pipeline:
    return Pipeline(stages=[GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=0)])


def pca_logistic(n_rows: int, k: int = 32, c: float = 0.5) -> Pipeline:
    pca = PCA(k=k, inputCol="features", outputCol="reduced")
    model = LogisticRegression(featuresCol="reduced", labelCol="y", regParam=1.0 / (c * max(n_rows, 1)), maxIter=100)
    return Pipeline(stages=[pca, model])


def with_probability(pred: DataFrame) -> DataFrame:
    return pred.withColumn("p", vector_to_array("probability")[1])


def folds(df: DataFrame, row_id: Sequence[str], k: int = 5, seed: int | Column = 0, label: str = "y", buckets: int = 1024,
          within: Sequence[str] = ()) -> DataFrame:
    """Stratified folds: rows of each class, in an order shuffled by a hash of their id, are dealt out in turn, so class sizes of folds differ by one at most.

    A row's place in its class is its place within a bucket of the shuffle plus the sizes of earlier buckets: no task ranks a whole class.
    Rows of each combination of the ``within`` columns are dealt out on their own.
    """
    rows = df.withColumn("_h", F.xxhash64(*row_id, F.lit(seed))).withColumn("_b", F.shiftright("_h", 64 - (buckets.bit_length() - 1)))
    before = Window.partitionBy(*within, label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy(*within, label, "_b").agg(F.count("*").alias("_n")).select(
        *[F.col(w).alias(f"_w{i}") for i, w in enumerate(within)], F.col(label).alias("_y"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    inside = F.row_number().over(Window.partitionBy(*within, label, "_b").orderBy("_h", *row_id)) - 1
    same = reduce(lambda a, b: a & b, [F.col(w).eqNullSafe(F.col(f"_w{i}")) for i, w in enumerate(within)], F.col(label).eqNullSafe(F.col("_y")))
    placed = rows.withColumn("_within", inside).join(earlier, same & (F.col("_b") == F.col("_c")))
    return placed.withColumn("fold", ((F.col("_earlier") + F.col("_within")) % k).cast("int")).select(*df.columns, "fold")


ROWS_PER_TASK = 20_000  # of a training set: a boosting step is a few jobs over all of it, and tasks of a few rows only wait for each other


def out_of_fold(df: DataFrame, make, k: int = 5) -> DataFrame:
    """Predict every fold with a model that has not seen it.  ``make(n)`` builds the pipeline for n training rows.  The models are fitted at the same time."""
    df = cut(df)
    sizes = {r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # one row a fold
    total = sum(sizes.values())
    df = df.coalesce(max(1, -(-total // ROWS_PER_TASK)))

    def fitted(i: int):
        return make(total - sizes.get(i, 0)).fit(df.filter(F.col("fold") != i))

    with ThreadPoolExecutor(k) as pool:
        models = list(pool.map(inheritable_thread_target(df.sparkSession)(fitted), range(k)))
    parts = [with_probability(model.transform(df.filter(F.col("fold") == i))).select(*[c for c in df.columns if c != "features"], "p") for i, model in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def held_out(df: DataFrame, group: str, make, min_test: int = 15, groups: Sequence | None = None) -> DataFrame:
    """Train on all other recordings; skip small tests and one-class training sets.  Logistic models are fitted together, others one by one."""
    df = cut(df)
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()  # one row per recording
    total, positive = sum(s["n"] for s in sizes), sum(s["pos"] for s in sizes)
    tested = [s for s in sizes if s["n"] >= min_test and positive - s["pos"] not in (0, total - s["n"]) and (groups is None or s[group] in groups)]
    if make is logistic and tested:
        return held_out_logistic(df, group, [s[group] for s in tested])
    parts = []
    for s in tested:
        rest = total - s["n"]
        model = make(rest).fit(df.filter(F.col(group) != F.lit(s[group])))
        parts.append(with_probability(model.transform(df.filter(F.col(group) == F.lit(s[group])))).select(group, "y", "p"))
    if not parts:
        return df.select(group, "y", F.lit(0.5).alias("p")).filter(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def held_out_logistic(df: DataFrame, group: str, tested: Sequence) -> DataFrame:
    """Rows of the ``tested`` recordings with ``p`` of a model trained on all other recordings; no recording's name counts as one recording."""
    field = df.select(group).schema[0]
    ids = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(tested)], f"_g {field.dataType.simpleString()}, _own int")
    every = F.sequence(F.lit(0), F.lit(len(tested) - 1))
    rows = cut(df.join(ids, F.col(group).eqNullSafe(F.col("_g")), "left").select(
        group, "y", "features", F.when(F.col("_own").isNull(), every).otherwise(F.array_remove(every, F.col("_own"))).alias("_trains"),
        F.when(F.col("_own").isNotNull(), F.array("_own")).alias("_asks")))
    return predicted(rows.drop("_trains"), "_asks", grouped_logistic(rows, "_trains", len(tested))).select(group, "y", "p")


def out_of_fold_logistic(df: DataFrame, k: int = 5, c: float = 0.5) -> DataFrame:
    """``out_of_fold`` with the models of all folds fitted together."""
    rows = cut(df.withColumns({"_trains": F.array_remove(F.sequence(F.lit(0), F.lit(k - 1)), F.col("fold")), "_asks": F.array("fold")}))
    return predicted(rows.drop("_trains"), "_asks", grouped_logistic(rows, "_trains", k, c)).drop("model")


def stacked(df: DataFrame, row_id: Sequence[str], views: Sequence[str], k: int = 5, c: float = 1.0) -> DataFrame:
    """Second-level model: a logistic one on the ``views``, which are out-of-fold probabilities of other models; ``p`` comes from folds it has not seen."""
    base = assemble(df.drop("p"), views) if "p" not in views else assemble(df, views).withColumnRenamed("p", "_p")
    out = out_of_fold_logistic(folds(base, row_id, k), k, c).withColumnRenamed("p", "stack")
    return out.withColumnRenamed("_p", "p") if "p" in views else out


def scores(pred: DataFrame, keys: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """Accuracy at one half, confusion counts, rank AUC, and what always guessing the commoner class would score."""
    hit, pos = F.col(p) >= 0.5, F.col(y) == 1
    k = list(keys) or ["_all"]
    base = pred if keys else pred.withColumn("_all", F.lit(1))
    agg = base.groupBy(*k).agg(
        F.count("*").alias("n"), F.avg(one(hit == pos)).alias("accuracy"), F.sum(one(hit & pos)).alias("tp"), F.sum(one(hit & ~pos)).alias("fp"),
        F.sum(one(~hit & pos)).alias("fn"), F.greatest(F.avg(one(pos)), F.avg(one(~pos))).alias("baseline"))
    auc = rank_auc(base, p, pos, 1 / 256, k).select(*k, "auc")
    out = agg.join(auc, k, "left")
    return out if keys else out.drop("_all")


def confident(pred: DataFrame, bands: Sequence[tuple[float, float]], p: str = "p", y: str = "y") -> DataFrame:
    """Answering only outside (lo, hi): share answered and accuracy there, for all bands in one pass."""
    sure = [(F.col(p) <= lo) | (F.col(p) >= hi) for lo, hi in bands]
    right = (F.col(p) >= 0.5) == (F.col(y) == 1)
    wide = pred.agg(F.count("*").alias("n"), *[F.count_if(s).alias(f"s{i}") for i, s in enumerate(sure)],
                    *[F.count_if(s & right).alias(f"r{i}") for i, s in enumerate(sure)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.col(f"s{i}").alias("answered"), F.col(f"r{i}").alias("right"))
                               for i, (lo, hi) in enumerate(bands)]))
    out = wide.select("n", rows.alias("_b")).select("n", "_b.*")
    return out.filter("answered > 0").select("lo", "hi", "answered", (F.col("answered") / F.col("n")).alias("share"), (F.col("right") / F.col("answered")).alias("accuracy"))


def vetoed(p: Column, seen: Column, in_zone: Column, net: Column) -> Column:
    """A make never seen in the zone, or over a still net, is pulled down; no sightings means no zone veto."""
    zone = (p >= 0.5) & seen & ~in_zone
    still = (p >= 0.5) & F.coalesce(net < 0.85, F.lit(False))
    return F.when(zone, F.least(p, F.lit(0.25))).when(still, F.least(p, F.lit(0.35))).otherwise(p)


def learning_curve(df: DataFrame, row_id: Sequence[str], make, fractions: Sequence[float], draws: int, k: int = 5) -> DataFrame:
    """Mean accuracy and AUC per training-set fraction over seeded draws (one draw for the whole set).

    Logistic models of all draws and folds are fitted together, others one by one; both deal out the same draws and folds.
    """
    settings = [(float(f), rep) for f in fractions for rep in range(draws if f < 1.0 else 1)]
    drawn = [F.pmod(F.xxhash64(*row_id, F.lit(1000 + rep)), F.lit(1_000_000)) / 1e6 < f for f, rep in settings]
    if make is logistic:
        per_draw = scores(cut(drawn_predictions(df, row_id, settings, drawn, k)), ["draw"])
        per_draw = per_draw.withColumn("fraction", F.element_at(F.array(*[F.lit(f) for f, _ in settings]), F.col("draw") + 1))
    else:
        per_draw = reduce(DataFrame.unionByName, [
            scores(out_of_fold(folds(df.filter(inside), row_id, k, rep), make, k)).select(F.lit(f).alias("fraction"), "n", "accuracy", "auc")
            for (f, rep), inside in zip(settings, drawn)])
    return per_draw.groupBy("fraction").agg(F.avg("n").alias("n"), F.avg("accuracy").alias("accuracy"), F.avg("auc").alias("auc"))


def drawn_predictions(df: DataFrame, row_id: Sequence[str], settings: Sequence[tuple[float, int]], drawn: Sequence[Column], k: int) -> DataFrame:
    """Out-of-fold predictions of every draw (``draw``, ``y``, ``p``); model draw * k + fold has not seen that fold of its draw.

    Folds are dealt out on narrow rows; a row's features are kept once, with the list of its draws and folds (one entry a draw at most).
    """
    df = cut(df)
    choices = F.array(*[F.when(c, F.struct(F.lit(i).alias("draw"), F.lit(rep).alias("rep"))) for i, ((_, rep), c) in enumerate(zip(settings, drawn))])
    narrow = df.select(*row_id, "y", F.explode(F.filter(choices, lambda s: s.isNotNull())).alias("_s")).select(*row_id, "y", "_s.*")
    used = folds(narrow, row_id, k, F.col("rep"), within=["draw"]).groupBy(*row_id).agg(F.collect_list(F.struct("draw", "fold")).alias("_used"))
    others = lambda u: F.transform(F.array_remove(F.sequence(F.lit(0), F.lit(k - 1)), u["fold"]), lambda j: u["draw"] * k + j)
    rows = cut(df.join(used, list(row_id)).select(
        "y", "features", F.flatten(F.transform("_used", others)).alias("_trains"), F.transform("_used", lambda u: u["draw"] * k + u["fold"]).alias("_asks")))
    pred = predicted(rows.drop("_trains"), "_asks", grouped_logistic(rows, "_trains", len(settings) * k))
    return pred.select("y", F.floor(F.col("model") / k).cast("int").alias("draw"), "p")
