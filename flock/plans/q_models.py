"""Registered model queries (rows-only checks: MLlib fits are not SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import models as md
from ..operators.report import classification_report
from ..operators.sampling import stratified_folds, stratified_splits
from ..operators.trees import gain_cover_frequency
from ..session import materialize
from . import sqltext as q
from .q_metrics import FEATURES_SQL, _people
from .q_profile import CLEAN_LITERAL_SQL, SIMPLE_COLUMNS, _clean, _people_shared
from .registry import register

LABEL = cl.LABEL


def _model_input(spark, sf_dir):
    """Cleaned person table (literal), numeric features as doubles, checkpointed."""
    return md.prepare(_clean(spark, sf_dir, shared=True), LABEL)


def _split(df, seed=987):
    return md.stored_split(df, LABEL, seed)


@register("tree_eval")
def tree_eval(spark, sf_dir):
    """One round (seed 987): split, tree, predict, confusion statistics."""
    return md.tree_rounds(_model_input(spark, sf_dir), LABEL, (987,))


@register("tree_predictions")
def tree_predictions(spark, sf_dir):
    """Predicted class of every held-out person (seed 987)."""
    return md.seeded_trees(_model_input(spark, sf_dir), LABEL, (987,))[0].select("id", "actual", "predicted")


@register("repeat_eval")
def repeat_eval(spark, sf_dir):
    """The ten seeds of the script, per-seed metrics plus mean and sd."""
    return md.round_summary(md.tree_rounds(_model_input(spark, sf_dir), LABEL))


@register("split_columns", sql=q.with_adapter(CLEAN_LITERAL_SQL, select="SELECT id, " + ", ".join(f"""
       row_number() OVER (PARTITION BY {LABEL} ORDER BY md5(concat('{s}:', CAST(id AS VARCHAR))), id)
         <= floor(0.8 * count(*) OVER (PARTITION BY {LABEL})) AS train_{s}""" for s in md.SEEDS) + """
FROM clean"""))
def split_columns(spark, sf_dir):
    """The training parts of the ten seeds, all in one pass."""
    out = stratified_splits(_clean(spark, sf_dir, shared=True).select("id", LABEL), LABEL, md.SEEDS)
    return out.select("id", *[F.col("in_train")[i].alias(f"train_{s}") for i, s in enumerate(md.SEEDS)])


@register("fold_column", sql=q.with_adapter(CLEAN_LITERAL_SQL, select=f"""
SELECT id, CAST((row_number() OVER (PARTITION BY {LABEL} ORDER BY md5(concat('987:', CAST(id AS VARCHAR))), id) - 1) % 10 AS INTEGER)
         AS fold
FROM clean"""))
def fold_column(spark, sf_dir):
    """The ten stratified folds of the cleaned table."""
    return stratified_folds(_clean(spark, sf_dir, shared=True).select("id", LABEL), LABEL).select("id", "fold")


def _model2_input(spark, sf_dir):
    """Boosted-tree input: numbers as doubles, missing values kept."""
    m2 = cl.model2_dataset(_clean(spark, sf_dir, shared=True))
    return materialize(m2.select("id", *[F.col(c).cast("double").alias(c) for c in m2.columns if c != "id"]))


@register("gbt_repeat_eval")
def gbt_repeat_eval(spark, sf_dir):
    """The ten boosted rounds of the script (one per seed): held-out
    report and last log losses per seed, plus mean and sd."""
    return md.round_summary(md.boosted_rounds(_model2_input(spark, sf_dir), LABEL))


@register("gbt_importance")
def gbt_importance(spark, sf_dir):
    """Boosted trees (depth 3, eta 0.3, 2 rounds) and each feature's share of gain, cover and splits."""
    booster = md.seeded_boosters(_model2_input(spark, sf_dir), LABEL, (987,))[1][987]
    return spark.createDataFrame(gain_cover_frequency(booster), "feature string, gain double, cover double, frequency double")


@register("gbt_eval")
def gbt_eval(spark, sf_dir):
    """Log loss per round on the train and test sets."""
    margins = md.seeded_boosters(_model2_input(spark, sf_dir), LABEL, (987,))[0]
    return md.watch_list(margins).drop("seed")


@register("forest_importance")
def forest_importance(spark, sf_dir):
    """500-tree random forest on the whole cleaned table; importances."""
    df = _model_input(spark, sf_dir)
    model = md.fit_forest(df, LABEL)
    return md.importance(model, md.feature_columns(df, LABEL))


@register("cv_forest")
def cv_forest(spark, sf_dir):
    """10-fold CV forest (mtry 8, node size 14, 14 leaves, 500 trees) on the
    training split, confusion statistics on the held-out split."""
    train, test = _split(_model_input(spark, sf_dir))
    cv = md.cv_forest(train, LABEL)
    return classification_report(cv.predict(test), "actual", "predicted", cv.levels[0])


def grid_search(spark, sf_dir, grid=None, folds=10, trees=md.FOREST_TREES):
    """The notebook's (commented-out) mtry search - 1..15, 10 folds, node
    size 14, 500 trees: mean and sd of the fold accuracy per setting.  Not in
    the driver registry: 150 forest fits; tested on a small grid."""
    train, _ = _split(_model_input(spark, sf_dir))
    grid = grid or {"mtry": list(md.MTRY_GRID)}
    return md.cv_summary(md.cv_forest(train, LABEL, grid=grid, folds=folds, trees=trees))


@register("kmeans_profile")
def kmeans_profile(spark, sf_dir):
    """K-means (k 4, 25 random starts) of the simplified table."""
    s = cl.simplify_people(_people_shared(spark, sf_dir))
    return md.kmeans_profile(s, [c for c in s.columns if c != "id"])


def _pca(spark, sf_dir):
    s = materialize(cl.simplify_people(_people(spark, sf_dir), keep_id=True))
    return s, md.varying_columns(s, SIMPLE_COLUMNS)


@register("pca_loadings")
def pca_loadings(spark, sf_dir):
    """Loadings of the scaled PCA (sign-flipped) over all numeric
    columns; a constant column takes no part and is reported with null loadings."""
    s, cols = _pca(spark, sf_dir)
    constant = [c for c in SIMPLE_COLUMNS if c not in cols]
    dropped = spark.createDataFrame([(c,) for c in constant], "variable string")
    return md.pca(s, cols)[0].unionByName(dropped, allowMissingColumns=True)


@register("pca_scores")
def pca_scores(spark, sf_dir):
    """Component scores of every person (sign-flipped) over all varying numeric columns."""
    s, cols = _pca(spark, sf_dir)
    return md.pca(s, cols)[1]


NORMS_SQL = f"""
w AS (SELECT id, {', '.join(f"CAST(coalesce({c}, {1000 if c == 'time_to_activate' else 0}) AS DOUBLE) AS {c}" for c in SIMPLE_COLUMNS)} FROM features),
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in SIMPLE_COLUMNS)} FROM w)"""


@register("pca_norms", sql=q.with_adapter(FEATURES_SQL, NORMS_SQL, select="SELECT id, round(" + " + ".join(
    f"coalesce(pow((w.{c} - m_{c}) / NULLIF(s_{c}, 0), 2), 0)" for c in SIMPLE_COLUMNS) + ", 6) AS norm FROM w, st"))
def pca_norms(spark, sf_dir):
    """L20 check: loadings are a rotation, so a person's squared scores add up to the squares of the
    standardised columns."""
    s, cols = _pca(spark, sf_dir)
    scores = md.pca(s, cols)[1]
    return scores.select("id", F.round(sum((F.col(c) * F.col(c) for c in scores.columns if c != "id"), F.lit(0.0)), 6).alias("norm"))
