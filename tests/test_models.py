"""The registered models run at the full settings."""

from flightline.operators import models as md
from flightline.plans import score_queries


def test_full_settings(monkeypatch):
    seen = {}
    monkeypatch.setattr(score_queries, "model_rows", lambda spark, sf: "rows")
    monkeypatch.setattr(md, "folds", lambda rows, ids, k: seen.update(dealt=k))
    monkeypatch.setattr(md, "boosting", lambda trees: seen.update(trees=trees))
    monkeypatch.setattr(md, "out_of_fold", lambda rows, make, k: (make(10), seen.update(folds=k)))
    monkeypatch.setattr(md, "scores", lambda pred: pred)
    monkeypatch.setattr(md, "learning_curve", lambda rows, ids, make, fractions, draws, k: seen.update(curve=(fractions, draws, k)))
    score_queries.e23(None, "")
    score_queries.e26(None, "")
    assert seen == {"dealt": 5, "trees": 200, "folds": 5, "curve": ((0.25, 0.5, 0.75, 1.0), 8, 5)}


def test_folds_are_fitted_at_the_same_time(spark):
    """Each fold's model waits until all have begun; predictions are those of single fits."""
    import threading

    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from flightline.operators import models as md
    df = spark.range(90).select("id", array_to_vector(F.array((F.col("id") % 7).cast("double"), F.rand(3))).alias("features"), (F.col("id") % 2).cast("double").alias("y"),
                                (F.col("id") % 3).cast("int").alias("fold")).localCheckpoint()
    all_begun = threading.Barrier(3, timeout=30)

    class Waiting:
        def __init__(self, n):
            self.n = n

        def fit(self, train):
            all_begun.wait()
            return md.logistic(self.n).fit(train)

    got = {r.id: r.p for r in md.out_of_fold(df, Waiting, 3).collect()}
    for i in range(3):
        want = md.with_probability(md.logistic(60).fit(df.filter(F.col("fold") != i)).transform(df.filter(F.col("fold") == i)))
        assert all(abs(got[r.id] - r.p) < 1e-6 for r in want.collect())
    assert len(got) == 90
