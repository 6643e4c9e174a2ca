"""Sources/sinks round trips, model operators and the streaming sink."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flock import schema as S
from flock.operators import models as md
from flock.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="flock-io-")


def test_csv_extract_round_trip_with_sentinel(spark):
    path = os.path.join(_tmp(), "unpivot.csv")
    with open(path, "w") as f:
        f.write("mo,type,number\n2020-01-01,total_accounts,5\n2020-02-01,NULL,NULL\n")
    df = io.read_extract(spark, path, S.UNPIVOT_EXTRACT)
    rows = df.orderBy("mo").collect()
    assert rows[0].number == 5 and rows[1].type is None and rows[1].number is None
    out = os.path.join(_tmp(), "out")
    io.write_extract(df, out)
    back = io.read_extract(spark, out, S.UNPIVOT_EXTRACT)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows))


def test_jdbc_options():
    o = io.jdbc_options("jdbc:x://h/db", table="Attendance", partition_column="Id", lower_bound=1,
                        upper_bound=1000, num_partitions=8)
    assert o["dbtable"] == "Attendance" and o["numPartitions"] == "8" and o["partitionColumn"] == "Id"
    with pytest.raises(ValueError):
        io.jdbc_options("jdbc:x://h/db", query="select 1", partition_column="Id", lower_bound=1,
                        upper_bound=2, num_partitions=2)
    with pytest.raises(ValueError):
        io.jdbc_options("jdbc:x://h/db")


def test_save_stage_and_top_rows(spark):
    df = spark.range(20).withColumn("mo", F.lit("2020-01-01").cast("date"))
    path = os.path.join(_tmp(), "t")
    io.save_table(df, path, partition_by=["mo"])
    assert spark.read.parquet(path).count() == 20
    io.stage(df, "staged_t")
    assert spark.table("staged_t").count() == 20
    io.unstage(spark, "staged_t")
    assert not spark.catalog.tableExists("staged_t")
    assert [r.id for r in io.top_rows(df, 6, ["id"]).collect()] == list(range(6))


def test_tree_learns_separable_rule(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    pdf = pd.DataFrame({"id": np.arange(400), "x": x, "noise": rng.normal(size=400),
                        "y": np.where(x > 0.2, "LeaveTheChurch", "StayAtChurch")})
    df = md.prepare(spark.createDataFrame(pdf), "y")
    rep = md.tree_round(df, "y", 987).collect()[0]
    assert rep.accuracy > 0.95 and rep.n == 400 - int(np.floor(0.8 * (pdf.y == "LeaveTheChurch").sum())) \
        - int(np.floor(0.8 * (pdf.y == "StayAtChurch").sum()))


def test_gbt_eval_and_importance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"a": x, "b": rng.normal(size=300), "label": (x > 0).astype(float)})
    df = spark.createDataFrame(pdf)
    model = md.fit_gbt(df, "label")
    ev = md.gbt_eval(model, df, df, "label").toPandas()
    assert list(ev["round"].unique()) == [1, 2]
    tr = ev[ev.dataset == "train"].sort_values("round").loss.to_numpy()
    assert tr[1] <= tr[0]
    imp = md.importance(model, ["a", "b"]).collect()
    assert imp[0].feature == "a"


def test_kmeans_best_of_starts(spark):
    rng = np.random.default_rng(5)
    centers = np.array([[0, 0], [10, 10], [0, 10], [10, 0]])
    pts = np.vstack([c + rng.normal(scale=0.3, size=(50, 2)) for c in centers])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["u", "v"]))
    prof = md.kmeans_profile(df, ["u", "v"], starts=4).toPandas()
    assert sorted(prof["size"]) == [50, 50, 50, 50]


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(200, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.5, 0.2]])
    pdf = pd.DataFrame(a, columns=["p", "q", "r"])
    loadings, scores, var = md.pca(spark.createDataFrame(pdf), ["p", "q", "r"])
    z = (a - a.mean(0)) / a.std(0, ddof=1)
    w, v = np.linalg.eigh(np.cov(z.T))
    v = v[:, np.argsort(w)[::-1]]
    got = loadings.toPandas().set_index("variable").loc[["p", "q", "r"]].to_numpy()
    for j in range(3):
        assert np.allclose(np.abs(got[:, j]), np.abs(v[:, j]), atol=1e-6)
    assert scores.count() == 200


def test_grid_search_small_grid(spark):
    from flock.plans.q_models import grid_search
    out = grid_search(spark, SF_SMALL, grid={"mtry": [2, 4]}, folds=2, trees=5).collect()
    assert len(out) == 2 and all(0 <= r.accuracy <= 1 for r in out)


def test_streaming_sink_appends_by_month(spark):
    import shutil

    from flock.streaming import append_events, read_events
    src = _tmp()  # a file stream reads a directory: stage the small table in one
    shutil.copy(f"{SF_SMALL}/orders.parquet", src)
    orders = spark.readStream.schema(spark.read.parquet(f"{SF_SMALL}/orders.parquet").schema).parquet(src)
    path = os.path.join(_tmp(), "attendance")
    q = append_events(orders.select("o_orderkey", "o_custkey", "o_orderdate"), path, "o_orderdate",
                      name="orders-test-" + os.path.basename(path.rstrip("/")) + str(os.getpid()))
    q.awaitTermination(120)
    total = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    assert read_events(spark, path).count() == total
    assert read_events(spark, path, since="2000-01-01").count() < total


def test_boosted_rounds_report_log_loss_per_seed(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=200)
    pdf = pd.DataFrame({"id": np.arange(200), "a": x, "y": (x > 0).astype(float)})
    df = spark.createDataFrame(pdf)
    out = md.repeat_eval(df, "y", seeds=(987, 887), one_round=md.gbt_round).toPandas().set_index("stat")
    assert set(out.index) == {"987", "887", "mean", "sd"}
    assert out.loc["mean", "accuracy"] > 0.9
    assert (out.loc[["987", "887"], "train_log_loss"] < np.log(2)).all()
    assert np.isclose(out.loc["mean", "test_log_loss"], out.loc[["987", "887"], "test_log_loss"].mean())


def test_log_loss_is_that_of_the_probability(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=150)
    df = spark.createDataFrame(pd.DataFrame({"a": x, "y": ((x + rng.normal(size=150)) > 0).astype(float)}))
    model = md.fit_gbt(df, "y")
    rows = model.transform(df).select("y", "probability").collect()
    want = -np.mean([np.log(r.probability[int(r.y)]) for r in rows])
    assert np.isclose(md.log_losses(model, df, "y")[-1], want)


def test_more_levels_than_default_bins(spark):
    rows = [(i, f"level{i % 90}", "L" if i % 90 < 45 else "S") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, kind string, y string")
    assert md.max_bins(df, ["kind"]) == 91
    assert md.predict(md.fit_tree(df, "y"), df, "y").where("actual <> predicted").count() == 0


def test_constant_columns_take_no_part(spark):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, 5, 0)], "a double, b int, c int")
    assert md.varying_columns(df, ["a", "b", "c"]) == ["a"]


def test_loess_of_short_and_tied_series():
    from flock.operators.smooth import loess_fit
    for n in range(1, 8):
        x = np.arange(n, dtype=float)
        y = x ** 2 if n > 2 else 3 * x + 1
        assert np.allclose(loess_fit(x, y)["fit"], y)
    tied = loess_fit(np.array([0.0, 0, 0, 0, 1, 2]), np.array([1.0, 1, 1, 1, 2, 5]))
    assert np.allclose(tied["fit"], tied["y"])
    two = loess_fit(np.array([0.0, 0, 1]), np.array([1.0, 3, 4]))
    assert np.allclose(two["fit"], [2, 2, 4])
    one = loess_fit(np.array([4.0, 4]), np.array([1.0, 3]))
    assert np.allclose(one["fit"], 2)


def test_leaf_limits_are_not_rounded_down():
    from flock.operators.models import MAXNODES_GRID, depth_for_leaves

    assert depth_for_leaves(14) == 4 and depth_for_leaves(8) == 3 and depth_for_leaves(9) == 4
    assert len([depth_for_leaves(v) for v in MAXNODES_GRID]) == len(MAXNODES_GRID) == 11
    assert all(2 ** depth_for_leaves(v) >= v for v in MAXNODES_GRID)
