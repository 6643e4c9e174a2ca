"""Churn models on histogram trees, forests of full trees and ``pyspark.ml`` (distributed trainers).

R's generator and single-machine trainers cannot be reproduced bit for bit
(S38, S39): splits come from the keyed-hash stratified split, trees from
MLlib; results are reported as held-out metrics.  Model inputs are
checkpointed once (``materialize``) so repeated fits over seeds or folds do
not replay the feature pipeline, and a lost executor only re-reads the
checkpoint.
"""

from __future__ import annotations

import itertools
import math
import statistics
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..session import materialize
from . import fold_forest as ff
from . import forest as fo
from . import moments as mo
from . import trees
from .report import classification_report
from .sampling import stratified_folds, stratified_split, stratified_splits
from .trees import fit_bins

# Fixed values (reference): the ten split seeds and the model settings.
SEEDS = (987, 887, 787, 687, 587, 487, 387, 287, 187, 87)
TREE = {"min_split": 10, "min_bucket": 3, "cp": 0.01}
GBT = {"max_depth": 3, "eta": 0.3, "rounds": 2}
FOREST_TREES = 500
CV = {"folds": 10, "mtry": 8, "node_size": 14, "max_nodes": 14}
MTRY_GRID = tuple(range(1, 16))
MAXNODES_GRID = tuple(range(5, 16))
NTREE_GRID = (250, 300, 350, 400, 450, 500, 550, 600, 800, 1000, 2000)
KMEANS = {"k": 4, "starts": 25, "seed": 123}


def _spark() -> SparkSession:
    return SparkSession.getActiveSession()


def feature_columns(df: DataFrame, label: str, exclude=("id", "split")) -> list[str]:
    """Every column but the label and row keys, by name (never by position, S28)."""
    return [c for c in df.columns if c != label and c not in exclude]


def feature_stages(df: DataFrame, features: list[str], out: str = "features"):
    """String columns -> alphabetical level index (R factor codes, H18);
    everything assembled into one vector (L11)."""
    stages, cols = [], []
    for f in df.schema.fields:
        if f.name not in features:
            continue
        if isinstance(f.dataType, StringType):
            stages.append(StringIndexer(inputCol=f.name, outputCol=f"{f.name}__idx",
                                        stringOrderType="alphabetAsc", handleInvalid="keep"))
            cols.append(f"{f.name}__idx")
        else:
            cols.append(f.name)
    stages.append(VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep"))
    return stages


def prepare(df: DataFrame, label: str, features: list[str] | None = None) -> DataFrame:
    """Numeric features as doubles with nulls as 0 (MLlib trees take no NaN;
    a column that is missing everywhere then never splits)."""
    features = features or feature_columns(df, label)
    num = [f.name for f in df.schema.fields if f.name in features and isinstance(f.dataType, NumericType)]
    df = df.select(*[F.col(c).cast("double").alias(c) if c in num else F.col(c) for c in df.columns])
    return df.fillna(0.0, subset=num)


def max_bins(df: DataFrame, features: list[str], least: int = 64) -> int:
    """Bins for every level of the text columns and the one for unseen levels
    (MLlib rejects a categorical column with more levels than bins)."""
    text = [f.name for f in df.schema.fields if f.name in features and isinstance(f.dataType, StringType)]
    if not text:
        return least
    return max(least, max(df.agg(*[F.count_distinct(c).alias(c) for c in text]).first()) + 1)


def stored_split(df: DataFrame, label: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """The stratified 80/20 split, written once: indexers and trees read it many times."""
    split = materialize(stratified_split(df, label, 0.8, seed))
    return split.where(F.col("split") == "train").drop("split"), split.where(F.col("split") == "test").drop("split")


def _label_stages(label: str):
    return [StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")]


def fit_tree(train: DataFrame, label: str, features: list[str] | None = None, seed: int = 987,
             min_bucket: int = TREE["min_bucket"], max_depth: int = 30):
    """Classification tree, Gini, leaves of at least ``min_bucket`` rows."""
    features = features or feature_columns(train, label)
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="label", impurity="gini",
                                  maxDepth=max_depth, minInstancesPerNode=min_bucket, seed=seed,
                                  maxBins=max_bins(train, features))
    return Pipeline(stages=_label_stages(label) + feature_stages(train, features) + [tree]).fit(train)


def predict(model, df: DataFrame, label: str) -> DataFrame:
    """Class prediction mapped back to the label text."""
    labels = model.stages[0].labels
    out = model.transform(df)
    return IndexToString(inputCol="prediction", outputCol="predicted", labels=labels).transform(out) \
        .withColumnRenamed(label, "actual")


def tree_round(df: DataFrame, label: str, seed: int, positive=None) -> DataFrame:
    """One round of the script: stratified 80/20 split, fit, predict, report."""
    train, test = stored_split(df, label, seed)
    model = fit_tree(train, label, seed=seed)
    pred = predict(model, test, label)
    pos = positive if positive is not None else model.stages[0].labels[0]
    return classification_report(pred, "actual", "predicted", pos).withColumn("seed", F.lit(seed))


def repeat_eval(df: DataFrame, label: str, seeds=SEEDS, parallelism: int = 4, one_round=None) -> DataFrame:
    """The rounds of all seeds (``tree_round`` unless ``one_round`` is
    given), reports unioned, plus mean and standard deviation rows (S31).
    ``df`` is read once per seed: pass a stored table."""
    one_round = one_round or tree_round
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        reports = list(pool.map(lambda s: one_round(df, label, s), seeds))
    rounds = reports[0]
    for r in reports[1:]:
        rounds = rounds.unionByName(r)
    return round_summary(materialize(rounds))


def round_summary(rounds: DataFrame) -> DataFrame:
    """The reports of all seeds (``rounds``, written) with mean and standard deviation rows."""
    metrics = [c for c in rounds.columns if c not in ("seed", "n")]
    summary = rounds.agg(*[F.avg(c).alias(c) for c in metrics]).withColumn("stat", F.lit("mean")).unionByName(
        rounds.agg(*[F.stddev_samp(c).alias(c) for c in metrics]).withColumn("stat", F.lit("sd")))
    return rounds.select(F.col("seed").cast("string").alias("stat"), *metrics).unionByName(summary.select("stat", *metrics))


def _seeded(df: DataFrame, label: str, seeds, target) -> tuple[DataFrame, list[trees.Feature]]:
    """(id, label, target 0/1, bins, in_train) of all rows, written once for all seeds, and the features.
    Cuts lie between neighbouring values of the whole table."""
    features = trees.fit_bins(df, feature_columns(df, label))
    rows = trees.binned(stratified_splits(df, label, tuple(seeds)), features)
    return materialize(rows.select("id", F.col(label).alias("label"), target.cast("double").alias("target"), "bins", "in_train")), features


def _training(rows: DataFrame, seeds, *columns) -> dict[int, DataFrame]:
    """The training rows of each seed."""
    return {s: rows.where(F.col("in_train")[i]).select("bins", *columns) for i, s in enumerate(seeds)}


def seeded_trees(df: DataFrame, label: str, seeds=SEEDS, min_split: int = TREE["min_split"], min_bucket: int = TREE["min_bucket"],
                 cp: float = TREE["cp"], max_leaves: int | None = None) -> tuple[DataFrame, dict[int, trees.Tree]]:
    """L5-L7 for all seeds together: exact stratified splits, one classification tree a seed (Gini, ``min_split`` and
    ``min_bucket``, cost-complexity ``cp``), and the class predicted for every held-out row: (seed, id, actual,
    predicted) and the trees.  All trees grow in the same rounds over one stored table."""
    low, high = two_levels(df, label)
    rows, features = _seeded(df, label, seeds, F.col(label) == F.lit(high))
    grown = trees.grow(_training(rows, seeds, F.lit(1.0).alias("a"), F.col("target").alias("b")), features,
                       trees.class_rules(min_split, min_bucket, max_leaves, cp=cp))
    grown = {s: trees.prune(t, cp) for s, t in grown.items()}
    first = F.lit(low)
    each = [rows.where(~F.col("in_train")[i]).select(
        F.lit(s).alias("seed"), "id", F.col("label").alias("actual"),
        (F.when(grown[s].route(F.col("bins"), trees.majority) > 0, F.lit(high)).otherwise(first) if s in grown else first).alias("predicted"))
        for i, s in enumerate(seeds)]
    return reduce(DataFrame.unionAll, each), grown


def two_levels(df: DataFrame, label: str) -> tuple:
    """The two classes of a label in alphabetical order (twice the one, if there is but one)."""
    levels = sorted(r[0] for r in df.select(label).distinct().limit(3).collect()) or [None]
    if len(levels) > 2:
        raise ValueError(f"{label} has more than two classes")
    return levels[0], levels[-1]


def tree_rounds(df: DataFrame, label: str, seeds=SEEDS, positive=None) -> DataFrame:
    """The report of every seed's tree (positive class: the first level), written."""
    pred, _ = seeded_trees(df, label, seeds)
    pos = positive if positive is not None else two_levels(df, label)[0]
    return materialize(classification_report(pred, "actual", "predicted", pos, by=("seed",)))


def seeded_boosters(df: DataFrame, label: str, seeds=SEEDS, rounds: int = GBT["rounds"], eta: float = GBT["eta"],
                    max_depth: int = GBT["max_depth"]) -> tuple[DataFrame, dict[int, trees.Booster]]:
    """L12 for all seeds together on a 0/1 label, missing values kept: (seed, id, actual, in_train, margin1 ..
    margin<rounds>), the margin after each round for training and held-out rows, and the boosters."""
    rows, features = _seeded(df, label, seeds, F.col(label))
    found = trees.boost(_training(rows, seeds, F.col("target").alias("label")), features, rounds, eta, max_depth)
    each = [rows.select(F.lit(s).alias("seed"), "id", F.col("target").alias("actual"), F.col("in_train")[i].alias("in_train"),
                        *[found[s].margin(F.col("bins"), k + 1).alias(f"margin{k + 1}") for k in range(rounds)])
            for i, s in enumerate(seeds)]
    return reduce(DataFrame.unionAll, each), found


def watch_list(margins: DataFrame, rounds: int = GBT["rounds"]) -> DataFrame:
    """Log loss after each round on the training and the held-out rows of each seed: (seed, round, dataset, loss)."""
    loss = [F.avg(trees.log_loss(F.col(f"margin{k + 1}"), F.col("actual"))).alias(f"_{k + 1}") for k in range(rounds)]
    per = margins.groupBy("seed", F.when(F.col("in_train"), "train").otherwise("test").alias("dataset")).agg(*loss)
    return per.unpivot(["seed", "dataset"], [f"_{k + 1}" for k in range(rounds)], "round", "loss").select(
        "seed", F.substring("round", 2, 9).cast("int").alias("round"), "dataset", "loss")


def boosted_rounds(df: DataFrame, label: str, seeds=SEEDS) -> DataFrame:
    """L12/L13 of every seed, written: held-out report (positive class 1) and the last log loss of both parts."""
    margins = seeded_boosters(df, label, seeds)[0]
    held = margins.where("NOT in_train").withColumn("predicted", F.when(F.col(f"margin{GBT['rounds']}") > 0, 1.0).otherwise(0.0))
    report = classification_report(held, "actual", "predicted", 1.0, by=("seed",))
    last = watch_list(margins).where(F.col("round") == GBT["rounds"]).groupBy("seed").agg(
        *[F.max(F.when(F.col("dataset") == d, F.col("loss"))).alias(f"{d}_log_loss") for d in ("train", "test")])
    return materialize(report.join(last, "seed"))


def fit_gbt(train: DataFrame, label: str, features: list[str] | None = None, seed: int = 987,
            max_depth: int = GBT["max_depth"], step: float = GBT["eta"], rounds: int = GBT["rounds"]):
    """Gradient-boosted trees with logistic loss on a 0/1 numeric label."""
    features = features or feature_columns(train, label)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=max_depth, stepSize=step,
                        maxIter=rounds, lossType="logistic", seed=seed, maxBins=max_bins(train, features))
    return Pipeline(stages=feature_stages(train, features) + [gbt]).fit(train)


def gbt_eval(model, train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Log loss after each boosting round on the train and test sets (watch
    list).  MLlib reports 2 log(1 + exp(-2 y F)); half of it is the log loss of
    its own probability 1 / (1 + exp(-2 F))."""
    rows = [(i + 1, name, loss) for name, df in (("train", train), ("test", test))
            for i, loss in enumerate(log_losses(model, df, label))]
    return train.sparkSession.createDataFrame(rows, "round int, dataset string, loss double")


def log_losses(model, df: DataFrame, label: str) -> list[float]:
    """Log loss of ``df`` after each boosting round."""
    feats = model.transform(df).select("features", label)
    return [float(loss) / 2 for loss in model.stages[-1].evaluateEachIteration(feats)]


def gbt_round(df: DataFrame, label: str, seed: int) -> DataFrame:
    """One boosted round of the script on a 0/1 label: split, fit, held-out
    report (positive class 1) and the last log loss of both sets."""
    train, test = stored_split(df, label, seed)
    model = fit_gbt(train, label, seed=seed)
    pred = model.transform(test).select(F.col(label).alias("actual"), F.col("prediction").alias("predicted"))
    report = classification_report(pred, "actual", "predicted", 1.0).withColumn("seed", F.lit(seed))
    return (report.withColumn("train_log_loss", F.lit(log_losses(model, train, label)[-1]))
            .withColumn("test_log_loss", F.lit(log_losses(model, test, label)[-1])))


def importance(model, features: list[str]) -> DataFrame:
    """Feature importances as (feature, importance), largest first."""
    if isinstance(model, fo.Forest):
        table = model.importance()
    else:
        assembler = [s for s in model.stages if isinstance(s, VectorAssembler)][-1]
        names = [c[:-5] if c.endswith("__idx") else c for c in assembler.getInputCols()]
        table = list(zip(names, [float(x) for x in model.stages[-1].featureImportances.toArray().tolist()]))
    return _spark().createDataFrame(table, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def fit_forest(df: DataFrame, label: str, features: list[str] | None = None, trees: int = FOREST_TREES,
               seed: int = 987, mtry: int | None = None, node_size: int = 1, max_depth: int = 30) -> fo.Forest:
    """Random forest of ``trees`` trees (sqrt(p) features per split unless ``mtry``) for a label of two classes."""
    features = features or feature_columns(df, label)
    high = two_levels(df, label)[1]
    bins = fit_bins(df, features, max_bins(df, features))
    rows = materialize(fo.rows_to_draw(df, F.col(label) == F.lit(high), bins))
    mtry = min(mtry or math.ceil(math.sqrt(len(features))), len(features))
    return fo.fit(rows, bins, fo.Settings(trees, mtry, node_size, max_depth, seed))


def depth_for_leaves(max_nodes: int) -> int:
    """The smallest depth whose full binary tree has ``max_nodes`` leaves or more
    (MLlib limits depth, not leaves; a limit is never rounded down)."""
    return max(1, (max_nodes - 1).bit_length())


@dataclass
class CvForest:
    """``settings`` searched, the accuracy of every fold for each (``accuracy``), and the forests of the best one, of
    which the last is fitted on all rows."""

    label: str
    levels: tuple
    settings: list[dict]
    accuracy: list[list[float]]
    best: ff.FoldForests

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the predicted class, the label column as ``actual``."""
        low, high = self.levels
        out = self.best.second_class(df, "_second")
        return out.withColumn("predicted", F.when(F.col("_second"), F.lit(high)).otherwise(F.lit(low))).drop("_second") \
            .withColumnRenamed(self.label, "actual")


def cv_forest(train: DataFrame, label: str, folds: int = CV["folds"], mtry: int = CV["mtry"],
              node_size: int = CV["node_size"], max_nodes: int = CV["max_nodes"], trees: int = FOREST_TREES,
              seed: int = 987, grid: dict | None = None) -> CvForest:
    """K-fold cross-validated forest for a label of two classes; ``grid`` maps a parameter name
    ('mtry', 'max_nodes', 'trees') to the values to search.  Folds are stratified by the label and dealt by
    hash rank of the id: they do not change with the partitioning.  The forests of all folds and of the whole table
    grow together (``fold_forest``); cuts lie between values of the whole table."""
    features = feature_columns(train, label)
    low, high = two_levels(train, label)
    train = materialize(stratified_folds(train, label, folds, seed))
    bins = fit_bins(train, features, max_bins(train, features))
    rows = materialize(fo.rows_to_draw(train, F.col(label) == F.lit(high), bins, keep=("fold",)))
    sizes = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    if len(sizes) < max(2, folds):
        raise ValueError("a fold is empty")
    grid = grid or {"mtry": [mtry]}
    values = {"featureSubsetStrategy": list(grid.get("mtry", [mtry])),
              "maxDepth": [depth_for_leaves(v) for v in grid.get("max_nodes", [max_nodes])],
              "numTrees": list(grid.get("trees", [trees]))}
    searched = [name for name, key in (("featureSubsetStrategy", "mtry"), ("maxDepth", "max_nodes"), ("numTrees", "trees")) if key in grid]
    settings, accuracy, best = [], [], None
    for m, depth, n in itertools.product(*values.values()):
        forests = ff.fit(rows, bins, fo.Settings(n, min(m, len(features)), node_size, depth, seed), folds)
        right = forests.right_in_folds(rows)
        accuracy.append([right[f][1] / right[f][0] for f in range(folds)])
        settings.append({k: v for k, v in zip(values, (m, depth, n)) if k in searched})
        if best is None or math.fsum(accuracy[-1]) > best[0]:
            best = math.fsum(accuracy[-1]), forests
    return CvForest(label, (low, high), settings, accuracy, best[1])


def cv_summary(cv: CvForest) -> DataFrame:
    """Mean and standard deviation of the fold accuracy per parameter setting."""
    rows = [(", ".join(f"{k}={v}" for k, v in sorted(s.items())), math.fsum(a) / len(a), statistics.pstdev(a))
            for s, a in zip(cv.settings, cv.accuracy)]
    return _spark().createDataFrame(rows, "setting string, accuracy double, accuracy_sd double")


def kmeans_profile(df: DataFrame, cols: list[str], k: int = KMEANS["k"], starts: int = KMEANS["starts"],
                   seed: int = KMEANS["seed"], max_iter: int = 10) -> DataFrame:
    """``kmeans(nstart=25)``: the start of least within-cluster sum of squares after at most ``max_iter``
    rounds (R's default of ten): cluster sizes and centres, one row per cluster.  All starts share each reading
    of the table."""
    data = materialize(mo.doubles(df, cols))
    centres, sizes, costs = mo.kmeans(data, cols, mo.start_centres(data, cols, k, starts, seed), max_iter)
    best = int(costs.argmin())
    rows = [(i, int(sizes[best, i]), *map(float, centres[best, i]), float(costs[best])) for i in range(k)]
    schema = ", ".join(["cluster int", "size long", *[f"{c} double" for c in cols], "total_within_ss double"])
    return df.sparkSession.createDataFrame(rows, schema)


def varying_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """The columns with more than one value (nulls as 0): the others cannot be scaled."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    row = df.agg(*[(F.min(v) < F.max(v)).alias(c) for c, v in value.items()]).first()
    return [c for c in cols if row[c]]


def pca(df: DataFrame, cols: list[str], k: int | None = None, flip: bool = True):
    """PCA of standardised columns (``prcomp(scale=TRUE)``) from one moment matrix; loadings and
    scores negated as the notebook does (H25).  Returns loadings, scores and the shares of variance."""
    k = k or len(cols)
    m = mo.moments(df, cols)
    loadings, variance = mo.principal_components(m)
    loadings = (-loadings if flip else loadings)[:, :k]
    table = df.sparkSession.createDataFrame([(c, *map(float, loadings[i])) for i, c in enumerate(cols)],
                                            ", ".join(["variable string"] + [f"pc{j + 1} double" for j in range(k)]))
    return table, mo.project(df, cols, m, loadings), (variance / variance.sum()).tolist()[:k]
