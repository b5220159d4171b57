"""Logistic models of many overlapping training sets, fitted side by side: a Newton step of all of them is one pass over the rows.

Each row names the models it trains.  Tasks add up loss, gradient and Hessian of every model over their rows; these short sums are added by Spark,
and the driver solves one small system a model.  It never holds more than ``TOGETHER`` models' sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.runtime import cut

TOGETHER = 256  # models that share passes
STEPS = 60
SMALL_STEP = 1e-10
CONSTANT = 1e-12  # a column whose variance in a training set is less than this share of its mean square about the overall mean counts as constant


def bundled(rows: DataFrame) -> DataFrame:
    """Stored batches of the rows (``_x``, ``_y``, ``_models``): numbers as plain bytes and the batch's rows by model, so that a pass converts nothing.

    ``n`` and ``total`` are a batch's rows and the sum of their features.
    """
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, y = np.stack(b["_x"].to_numpy()).astype(np.float64), b["_y"].to_numpy(dtype=np.float64)
            row, model = np.repeat(np.arange(len(b), dtype=np.int32), b["_models"].map(len).to_numpy()), np.concatenate(b["_models"].to_numpy())
            order = np.argsort(model, kind="stable")
            found, starts = np.unique(model[order], return_index=True)
            yield pd.DataFrame({"n": [len(b)], "total": [x.sum(0).tolist()], "x": [x.tobytes()], "y": [y.tobytes()], "row": [row[order].tobytes()],
                                "model": [found.astype(np.int32).tobytes()], "start": [starts.astype(np.int32).tobytes()]})

    return cut(rows.mapInPandas(task, "n long, total array<double>, x binary, y binary, row binary, model binary, start binary"))


def sums(batches: DataFrame, active: set[int], part: Callable) -> dict[int, np.ndarray]:
    """The sum of ``part(model, x, y)`` over the rows of each active model; ``batches`` as :func:`bundled` makes them."""
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for b in frame.itertuples():
                y, row, model, start = np.frombuffer(b.y), *(np.frombuffer(v, np.int32) for v in (b.row, b.model, b.start))
                x = np.frombuffer(b.x).reshape(len(y), -1)
                for m, mine in zip(model.tolist(), np.split(row, start[1:])):
                    if m in active:
                        total[m] = total.get(m, 0.0) + part(m, x[mine], y[mine])
        if total:
            yield pd.DataFrame({"model": list(total), "v": [v.tolist() for v in total.values()]})

    parts = batches.drop("n", "total").mapInPandas(task, "model int, v array<double>")
    added = parts.groupBy("model").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()  # TOGETHER rows at most
    return {r["model"]: r["v"].toArray() for r in added}


def fit_together(batches: DataFrame, models: list[int], centre: np.ndarray, c: float) -> dict[int, np.ndarray]:
    """Intercept and raw-scale weights of each of ``models``; one without rows has none."""
    d = len(centre)

    def moments(m, x, y):
        away = x - centre
        return np.concatenate([[len(y), y.sum()], away.sum(0), (away ** 2).sum(0)])

    out, mean, inverse = {}, {}, {}
    for m, s in sums(batches, set(models), moments).items():
        n, pos, first, second = s[0], s[1], s[2:2 + d], s[2 + d:]
        if pos in (0, n):
            out[m] = np.concatenate([[np.inf if pos else -np.inf], np.zeros(d)])
            continue
        spread = np.maximum(second - first ** 2 / n, 0)
        varies = spread > CONSTANT * second
        mean[m] = centre + first / n
        inverse[m] = np.where(varies, np.sqrt((n - 1) / np.where(varies, spread, 1)), 0.0)

    ridge = np.concatenate([[0.0], np.full(d, 1.0 / c)])
    at = {m: np.zeros(d + 1) for m in mean}
    kept: dict[int, tuple[float, np.ndarray]] = {}  # the best loss of a model and where it was found

    def slopes(m, x, y):
        a = np.column_stack([np.ones(len(y)), (x - mean[m]) * inverse[m]])
        z = a @ at[m]
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], a.T @ (p - y), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])

    active = set(mean)
    for _ in range(STEPS):
        if not active:
            break
        for m, s in sums(batches, active, slopes).items():
            loss = s[0] + (ridge * at[m] ** 2).sum() / 2
            if m in kept and loss > kept[m][0] * (1 + 1e-12):
                at[m] = (at[m] + kept[m][1]) / 2  # too far: half the step
                continue
            kept[m] = (loss, at[m])
            step = np.linalg.solve(s[1 + d + 1:].reshape(d + 1, d + 1) + np.diag(ridge + 1e-12), s[1:2 + d] + ridge * at[m])
            at[m] = at[m] - step
            if np.abs(step).max() < SMALL_STEP * (1 + np.abs(at[m]).max()):
                active = active - {m}
    if active:
        raise RuntimeError(f"{len(active)} models had not settled after {STEPS} steps")
    for m, w in at.items():
        raw = w[1:] * inverse[m]
        out[m] = np.concatenate([[w[0] - raw @ mean[m]], raw])
    return out


def grouped_logistic(df: DataFrame, trains: str, models: int, c: float = 0.5, features: str = "features", y: str = "y") -> DataFrame:
    """``model``, ``intercept``, ``weights`` for models 0 to ``models`` - 1, each trained on the rows whose array ``trains`` holds it.

    As a standardised logistic regression with inverse strength ``c`` on the summed loss.  A training set of one class gives an intercept without
    bounds, one without rows no model.  ``df`` is read once.  Rows without a label train nothing; features must not be null.
    """
    spark = df.sparkSession
    rows = df.select(vector_to_array(features).alias("_x"), F.col(y).cast("double").alias("_y"), F.col(trains).cast("array<int>").alias("_models"))
    rows = rows.filter("_y IS NOT NULL AND size(_models) > 0")
    batches, fitted = bundled(rows), {}
    if not batches.isEmpty():
        seen = batches.agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("total")).first()
        centre = seen["total"].toArray() / seen["n"]
        for lo in range(0, models, TOGETHER):
            some = list(range(lo, min(models, lo + TOGETHER)))
            fitted |= fit_together(batches, some, centre, c)
    table = [(int(m), float(w[0]), [float(v) for v in w[1:]]) for m, w in sorted(fitted.items())]
    return spark.createDataFrame(table, "model int, intercept double, weights array<double>")


def predicted(df: DataFrame, asks: str, fitted: DataFrame, features: str = "features") -> DataFrame:
    """One row for each row and model in its array ``asks``: the columns but the features, ``model`` and the probability ``p`` (null: no such model)."""
    keep = [c for c in df.columns if c not in (features, asks)]
    rows = df.select(*keep, vector_to_array(features).alias("_x"), F.explode(asks).alias("model")).join(fitted, "model", "left")
    z = F.aggregate(F.zip_with("_x", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("intercept")
    return rows.select(*keep, "model", (1 / (1 + F.exp(-z))).alias("p"))
