"""Models fitted together against single fits of the same training sets."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from flightline.operators import grouped_fits as gf
from flightline.operators import models as md


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 50, 0.01] + [0, 1000, 5]
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - (x[:, 1] - 1000) / 40)))).astype(float)
    data = [(i, "abcd"[i % 4], float(y[i]), *map(float, x[i]), 7.0) for i in range(400)]
    df = spark.createDataFrame(data, "rid int, site string, y double, a double, b double, c double, d double")
    return md.assemble(df, ["a", "b", "c", "d"]).select("rid", "site", "y", "features").cache()


def tight(n, c=0.5):
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scale, LogisticRegression(featuresCol="scaled", labelCol="y", regParam=1 / (c * n), standardization=False, maxIter=1000, tol=1e-14)])


def test_coefficients_equal_single_fits(rows):
    sites = "abcd"
    marked = rows.withColumn("t", F.array_remove(F.sequence(F.lit(0), F.lit(3)), F.instr(F.lit(sites), F.col("site")) - 1))
    got = {r["model"]: r for r in gf.grouped_logistic(marked, "t", 5).collect()}
    assert sorted(got) == [0, 1, 2, 3]  # model 4 has no rows
    for m, site in enumerate(sites):
        train = rows.filter(F.col("site") != site)
        scaler, model = tight(train.count()).fit(train).stages
        std = scaler.std.toArray()
        single = np.where(std > 0, model.coefficients.toArray() / np.where(std > 0, std, 1), 0)
        assert np.allclose(np.array(got[m]["weights"]) * std, single * std, atol=1e-6)
        assert abs(got[m]["intercept"] - (model.intercept - single @ scaler.mean.toArray())) < 1e-5 * (1 + abs(got[m]["intercept"]))


def test_held_out_equals_single_fits(rows):
    got = sorted((r["site"], r["y"], round(r["p"], 5)) for r in md.held_out(rows, "site", md.logistic).collect())
    one_by_one = sorted((r["site"], r["y"], round(r["p"], 5)) for r in md.held_out(rows, "site", lambda n: tight(n)).collect())
    assert len(got) == 400 and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 3e-5 for a, b in zip(got, one_by_one))


def test_learning_curve_equals_single_fits(rows):
    args = (["rid"], (0.5, 1.0), 2, 3)
    got = {r["fraction"]: r for r in md.learning_curve(rows, args[0], md.logistic, *args[1:]).collect()}
    want = {r["fraction"]: r for r in md.learning_curve(rows, args[0], lambda n: tight(n), *args[1:]).collect()}
    for f, w in want.items():
        assert got[f]["n"] == w["n"]
        assert abs(got[f]["accuracy"] - w["accuracy"]) < 1e-9 and abs(got[f]["auc"] - w["auc"]) < 1e-4


def test_one_class_and_empty(spark, rows):
    ones = rows.filter("y = 1").withColumn("t", F.array(F.lit(0))).withColumn("q", F.array(F.lit(0), F.lit(1)))
    fitted = gf.grouped_logistic(ones, "t", 2)
    assert {(r["model"], r["p"]) for r in gf.predicted(ones.drop("t"), "q", fitted).collect()} == {(0, 1.0), (1, None)}
    assert gf.grouped_logistic(ones.limit(0), "t", 2).count() == 0


def test_more_models_than_share_a_pass(rows, monkeypatch):
    marked = rows.withColumn("t", F.array(F.pmod("rid", F.lit(3)))).cache()
    whole = gf.grouped_logistic(marked, "t", 3).collect()
    monkeypatch.setattr(gf, "TOGETHER", 2)
    assert gf.grouped_logistic(marked, "t", 3).collect() == whole


def test_stack_finds_a_planted_signal(spark):
    """Each view knows half of the truth; the stack beats both, and its fold's rows never train it."""
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=600), rng.normal(size=600)
    y = (u + v + 0.3 * rng.normal(size=600) > 0).astype(float)
    data = [(i, float(y[i]), float(1 / (1 + np.exp(-u[i]))), float(1 / (1 + np.exp(-v[i])))) for i in range(600)]
    df = spark.createDataFrame(data, "rid int, y double, p double, net double")
    got = md.stacked(df, ["rid"], ["p", "net"]).cache()
    auc = {c: md.scores(got, p=c).first()["auc"] for c in ("p", "net", "stack")}
    assert got.count() == 600 and auc["stack"] > max(auc["p"], auc["net"]) + 0.1
