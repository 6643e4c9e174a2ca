"""Confusion counts and confusion-matrix statistics (one aggregate)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Two-way count (S30: orientation is (actual, predicted) by name)."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, actual: str, predicted: str, positive, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, kappa, sensitivity, specificity, PPV, NPV, prevalence,
    detection rate/prevalence, balanced accuracy and no-information rate of a
    two-class prediction; ``positive`` is the positive class (caret's default
    is the first factor level).  ``by``: one report per value of these columns."""
    a, p = F.col(actual), F.col(predicted)
    pos = F.lit(positive)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("double")

    agg = df.groupBy(*by).agg(
        cnt((a == pos) & (p == pos)).alias("tp"), cnt((a != pos) & (p == pos)).alias("fp"),
        cnt((a == pos) & (p != pos)).alias("fn"), cnt((a != pos) & (p != pos)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    div = F.try_divide  # a zero denominator gives null (ANSI division would fail)
    acc = div(tp + tn, n)
    pe = div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    sens, spec = div(tp, tp + fn), div(tn, tn + fp)
    return agg.select(
        *by, n.cast("long").alias("n"), acc.alias("accuracy"), div(acc - pe, 1 - pe).alias("kappa"),
        sens.alias("sensitivity"), spec.alias("specificity"),
        div(tp, tp + fp).alias("ppv"), div(tn, tn + fn).alias("npv"),
        div(tp + fn, n).alias("prevalence"), div(tp, n).alias("detection_rate"),
        div(tp + fp, n).alias("detection_prevalence"), ((sens + spec) / 2).alias("balanced_accuracy"),
        div(F.greatest(tp + fn, fp + tn), n).alias("no_information_rate"))
