"""Label reconciliation: claims, migration, prefill, keyed updates and appends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.operators.joins import point_in_interval


def claim_labels(labels: DataFrame, clips: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """Each label claims the nearest clip of its hoop; differing claims blank the clip; only changed clips come out.

    On equal distance the later clip wins.  Clips nobody claims are cleared.
    """
    both = [*keys, "_hoop"]
    lab = labels.withColumnRenamed("mhoop", "_hoop").withColumns({"_lo": F.col("mt") - reach, "_hi": F.col("mt") + reach})
    near = point_in_interval(clips.withColumnRenamed("choop", "_hoop"), lab, both, "ct", "_lo", "_hi", reach)
    rank = F.struct(F.abs(F.col("ct") - F.col("mt")).alias("d"), (-F.col("ct")).alias("t"), (-F.col("call")).alias("c"))
    claim = near.groupBy("mark").agg(F.min_by(F.struct("call", "outcome", "mt"), rank).alias("_b")).select("mark", "_b.*")
    won = claim.groupBy("call").agg(
        F.min("outcome").alias("_a"), F.max("outcome").alias("_z"), F.min_by("mark", F.struct("mt", "mark")).alias("by_mark"))
    out = clips.join(won, "call", "left").select(
        "call", "old", F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise("").alias("label"), "by_mark")
    return out.filter(F.col("old") != F.col("label"))


def migrate_labels(labels: DataFrame, clips: DataFrame, keys: Sequence[str], slack: float, width: float) -> DataFrame:
    """Carry labels to re-cut clips: the first clip of the hoop whose shot holds it, else whose window does."""
    both = [*keys, "_hoop"]
    lab = labels.withColumnRenamed("mhoop", "_hoop").select(*both, "mark", "mt", "outcome")
    lo = F.least(F.col("ct") - slack, F.col("w0"))
    hi = F.greatest(F.col("c_end") + slack, F.col("w1"))
    spans = clips.withColumnRenamed("choop", "_hoop").select(*both, "call", "ct", "c_end", "w0", "w1", lo.alias("_lo"), hi.alias("_hi"))
    near = point_in_interval(lab, spans, both, "mt", "_lo", "_hi", width)
    tier = F.when(F.col("mt").between(F.col("ct") - slack, F.col("c_end") + slack), 1).when(F.col("mt").between(F.col("w0"), F.col("w1")), 2)
    near = near.withColumn("_tier", tier).filter("_tier is not null")
    to = near.groupBy("mark").agg(F.min_by("call", F.struct("_tier", "ct", "call")).alias("call"), F.first("outcome").alias("_o"))
    clash = to.groupBy("call").agg(F.min("_o").alias("_a"), F.max("_o").alias("_z"))
    out = labels.select("mark").join(to, "mark", "left").join(clash, "call", "left")
    label = F.when(F.col("call").isNotNull(), F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(""))
    return out.select("mark", "call", label.alias("label"), F.col("call").isNull().alias("dropped"))


def prefill(labels: DataFrame, clips: DataFrame, keys: Sequence[str], slack: float, width: float) -> DataFrame:
    """A clip starts with the first label lying in its interval, or blank."""
    both = [*keys, "_hoop"]
    lab = labels.withColumnRenamed("mhoop", "_hoop").select(*both, "mark", "mt", "outcome")
    spans = clips.withColumnRenamed("choop", "_hoop").select(
        *both, "call", (F.col("ct") - slack).alias("_lo"), (F.col("c_end") + slack).alias("_hi"))
    near = point_in_interval(lab, spans, both, "mt", "_lo", "_hi", width)
    first = near.groupBy("call").agg(F.min_by("outcome", F.struct("mt", "mark")).alias("_o"))
    return clips.select("call").join(first, "call", "left").select("call", F.coalesce("_o", F.lit("")).alias("label"))


def keyed_update(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str], confirmed: str) -> DataFrame:
    """Fill columns from updates by key, never where an answer was already given; adds ``status``."""
    new = updates.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_has"))
    j = target.join(new, list(keys), "left")
    open_ = F.col(confirmed).isNull() & F.coalesce("_has", F.lit(False))
    status = F.when(F.col(confirmed).isNotNull(), "kept").when(F.col("_has"), "updated").otherwise("no source")
    return j.withColumns({**{c: F.when(open_, F.coalesce(f"_n_{c}", c)).otherwise(F.col(c)) for c in columns}, "status": status}).drop(
        "_has", *[f"_n_{c}" for c in columns])


def missing_rows(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows an idempotent append still has to write."""
    return incoming.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("(none)")).alias("label")).agg(F.count("*").alias("n"))


def retire_answered(df: DataFrame, active: str, note: str) -> DataFrame:
    """Active rows whose note has text become inactive; waiting rows stay; adds ``status``."""
    answered = F.col(active) & (F.trim(F.coalesce(note, F.lit(""))) != "")
    status = F.when(answered, "retired").when(F.col(active), "waiting").otherwise("inactive")
    return df.withColumns({"status": status, active: F.col(active) & ~answered})


def reconcile_sizes(local: DataFrame, published: DataFrame, key: Column, size: str, slack: float) -> DataFrame:
    """Match two file listings by normalised name and say whether they agree in size."""
    a = local.select(key.alias("key"), F.col(size).alias("local_size"))
    b = published.select(key.alias("key"), F.col(size).alias("published_size"))
    state = (F.when(F.col("local_size").isNull(), "only published").when(F.col("published_size").isNull(), "only local")
             .when(F.abs(F.col("local_size") - F.col("published_size")) <= slack, "same").otherwise("differs"))
    return a.join(b, "key", "full").withColumn("state", state)


def model_labels(df: DataFrame, label: str, positive: str, negatives: Sequence[str]) -> DataFrame:
    """Keep the labels a model can learn from: ``y`` is 1, 0 or null, and ``skipped`` names the others."""
    y = F.when(F.col(label) == positive, 1).when(F.col(label).isin(*negatives), 0)
    return df.withColumns({"y": y, "skipped": F.when(y.isNull(), F.coalesce(F.col(label), F.lit("(none)")))})


def export_labelled(df: DataFrame, label: str, columns: Mapping[str, str]) -> DataFrame:
    """Rows with a label, projected and cast for export."""
    return df.filter(F.trim(F.coalesce(F.col(label).cast("string"), F.lit(""))) != "").select(
        *[F.col(c).cast(t).alias(c) for c, t in columns.items()])
