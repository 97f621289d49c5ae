import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tabwright.operators import features as fe
from tabwright.operators import neighbours as nb
from tabwright.operators import training as tr
from tabwright.plans import learning as le
from tabwright.plans.lineage import scratch_path
from tabwright.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 600
    frame = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.normal(size=n)})
    frame["y"] = 3 * frame["a"] - 2 * frame["b"] + rng.normal(size=n) * 0.1
    frame["yes"] = (frame["a"] + frame["b"] > 0).astype(int)
    frame["colour"] = np.select([frame["a"] > 0.5, frame["a"] < -0.5], ["red", "blue"], "green")
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("pivots, block", [(1, 10_000), (8, 40), (20, 7)])
def test_nearest_is_exact(spark, exclude_self, pivots, block):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 6)).round(2)
    points[100:200] = points[0]  # a third of the rows are copies
    frame = pd.DataFrame({"id": np.arange(300), "label": np.arange(300) % 3, "features": list(points)})
    df = spark.createDataFrame(frame)
    got = nb.nearest(df, df, 4, exclude_self=exclude_self, pivots=pivots, block_rows=block).toPandas()
    got = got.sort_values(["query_id", "rank"])
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    for q in range(300):
        best = np.lexsort((np.arange(300), d[q]))[:4]
        assert got.loc[got["query_id"] == q, "neighbour_id"].tolist() == best.tolist()


def clustered(spark, n=3000, clusters=24, seed=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 8)) * 10
    points = centres[np.arange(n) % clusters] + rng.normal(size=(n, 8))
    frame = pd.DataFrame({"id": np.arange(n), "label": np.arange(n) % clusters, "features": list(points)})
    return points, spark.createDataFrame(frame).repartition(4)


def test_clustered_queries_visit_few_cells(spark):
    points, df = clustered(spark)
    visits = []
    got = nb.nearest(df, df, 5, exclude_self=True, pivots=48, count_visits=lambda v: visits.append(v.count()))
    assert visits[0] <= 3000 * 48 / 3 - 3000, "with the own cell at most a third of all cells"
    near = got.toPandas().sort_values(["query_id", "rank"])["neighbour_id"].to_numpy().reshape(-1, 5)
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert (near == np.argsort(d, axis=1, kind="stable")[:, :5]).all()


def test_balls_hold_their_rows_and_are_skipped():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(900, 3)) + 20 * i for i in range(3)] + [np.zeros((300, 3))])
    balls, centres, radii = nb.ball_tree(points, 64)
    assert sorted(np.concatenate(balls)) == list(range(len(points))) and max(map(len, balls)) <= 64
    assert all((np.sqrt(((points[b] - c) ** 2).sum(1)) <= r + 1e-9).all() for b, c, r in zip(balls, centres, radii))
    asked, ids = points[::37], np.arange(len(points))[::-1].copy()
    query, row, far = nb.block_neighbours(points, ids, asked, None, np.full(len(asked), np.inf), 4)
    d = np.sqrt(((asked[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    for q in range(len(asked)):
        assert sorted(zip(far[query == q], ids[row[query == q]])) == sorted(zip(d[q], ids))[:4]


def test_projection_buckets_find_most_neighbours(spark):
    _, df = clustered(spark)
    exact = nb.nearest(df, df, 5, exclude_self=True).select("query_id", "neighbour_id")
    found = nb.nearest_by_projection(df, df, 5, exclude_self=True).select("query_id", "neighbour_id")
    assert found.groupBy("query_id").count().filter("count > 5").isEmpty() and found.distinct().count() == found.count()
    assert found.intersect(exact).count() >= 0.9 * exact.count()


def test_rows_without_clusters_are_copied_per_block_not_per_cell(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(3000, 24)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "label": 0, "features": list(points)}))
    visits = []
    got = nb.nearest(df, df, 5, exclude_self=True, pivots=40, block_rows=600, count_visits=lambda v: visits.append((v.count(), v.schema["_v"].dataType.simpleString())))
    assert visits[0][0] <= 3000 * 12 and visits[0][1] == "array<float>"
    near = got.toPandas().sort_values(["query_id", "rank"])["neighbour_id"].to_numpy().reshape(-1, 5)
    wide = points.astype(float)
    d = np.sqrt(((wide[:, None, :] - wide[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert (near == np.argsort(d, axis=1, kind="stable")[:, :5]).all()


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-22, 0.0), (1e25, 0.0), (1e-3, 1e4)])
def test_blocks_are_exact_for_any_size_of_numbers_and_with_codes(scale, offset):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(700, 5)) * scale + offset
    codes, ids = rng.integers(0, 4, size=(700, 2)), rng.permutation(700)
    query, row, far = nb.block_neighbours(points, ids, points[:90], ids[:90], np.full(90, np.inf), 3, codes, codes[:90])
    d = np.sqrt(((points[:90, None, :] - points[None, :, :]) ** 2).sum(-1))
    d[~(codes[:90, None, :] == codes[None, :, :]).any(-1) | (ids[:90, None] == ids[None, :])] = np.inf
    for q in range(90):
        assert sorted(zip(far[query == q], ids[row[query == q]])) == sorted(zip(d[q], ids))[:3]


def test_wide_projection_buckets_hold_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(400, 12))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "label": 0, "features": list(points)}))
    visits, inner = [], nb._in_blocks
    monkeypatch.setattr(nb, "_in_blocks", lambda rows, asked, *rest: (visits.append(asked.count()), inner(rows, asked, *rest))[1])
    got = nb.nearest_by_projection(df, df, 4, exclude_self=True, bucket_length=1e6, tables=6).toPandas().sort_values(["query_id", "rank"])
    assert sum(visits) <= 2 * 400, "not once for each of six tables"
    monkeypatch.undo()
    exact = nb.nearest(df, df, 4, exclude_self=True).toPandas().sort_values(["query_id", "rank"])
    assert len(got) == 1600 and (got["neighbour_id"].to_numpy() == exact["neighbour_id"].to_numpy()).mean() >= 0.9


def test_vote_by_distance(spark):
    near = spark.createDataFrame(
        [(1, 0, 0.5), (1, 1, 1.0), (1, 1, 1.0), (2, 0, 0.0), (2, 1, 0.1), (2, 1, 0.1)],
        "query_id int, label int, distance double",
    )
    votes = lambda w: {r["query_id"]: r["prediction"] for r in nb.vote(near, w).collect()}
    assert votes("uniform") == {1: 1, 2: 1}
    assert votes("distance") == {1: 0, 2: 0}


def test_penalised_lines_match_closed_forms(table):
    frame, df = table
    x, y = frame[["a", "b", "c"]].to_numpy(), frame["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (1.0, 500.0):
        fitted = le.fit(df, ["a", "b", "c"], "y", "Ridge", {"alpha": alpha}).model.stages[-1].coefficients.toArray()
        expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        np.testing.assert_allclose(fitted, expected, rtol=1e-4)
    plain = le.fit(df, ["a", "b", "c"], "y", "LinearRegression").model.stages[-1].coefficients.toArray()
    np.testing.assert_allclose(plain, np.linalg.lstsq(xc, yc, rcond=None)[0], rtol=1e-6)


def test_logistic_penalty(table):
    frame, df = table
    c = 0.05
    trained = le.fit(df, ["a", "b"], "yes", "LogisticRegression", {"C": c})
    found = trained.model.stages[-1]
    x = frame[["a", "b"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    y = frame["yes"].to_numpy()
    w = np.zeros(3)
    design = np.c_[x, np.ones(len(x))]
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):  # Newton steps on C * loss + |w|² / 2
        p = 1 / (1 + np.exp(-design @ w))
        gradient = c * design.T @ (p - y) + penalty @ w
        hessian = c * (design * (p * (1 - p))[:, None]).T @ design + penalty
        w -= np.linalg.solve(hessian, gradient)
    np.testing.assert_allclose([*found.coefficients, found.intercept], w, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize(
    "algorithm, target, params, floor",
    [
        ("RandomForestClassifier", "yes", {"n_estimators": 10, "max_depth": 6}, 0.85),
        ("LogisticRegression", "colour", {}, 0.8),
        ("SVC", "yes", {}, 0.9),
        ("DecisionTreeClassifier", "colour", {"max_depth": 3}, 0.97),
        ("GradientBoostingClassifier", "yes", {"n_estimators": 10}, 0.85),
        ("XGBoostClassifier", "yes", {"n_estimators": 10}, 0.85),
        ("NeuralNetwork", "colour", {"nn_hidden_layers": [6]}, 0.8),
        ("KNeighborsClassifier", "colour", {"weights": "distance"}, 0.75),
    ],
)
def test_classifiers_learn(table, algorithm, target, params, floor):
    _, df = table
    trained = le.train(df, target, algorithm, ["id"], params, ["a", "b"])
    assert trained.metrics.first()["accuracy"] >= floor


@pytest.mark.parametrize(
    "algorithm, params",
    [
        ("RandomForestRegressor", {"n_estimators": 10, "max_depth": 8, "max_features": None}),
        ("GradientBoostingRegressor", {"n_estimators": 20}),
        ("XGBoostRegressor", {"n_estimators": 20}),
        ("Lasso", {"alpha": 0.01}),
    ],
)
def test_regressors_learn(table, algorithm, params):
    _, df = table
    assert le.train(df, "y", algorithm, ["id"], params, ["a", "b"]).metrics.first()["r_squared"] > 0.7


def test_prediction_without_target_and_after_reload(spark, table):
    _, df = table
    trained = le.fit(df, ["a", "b"], "colour", "DecisionTreeClassifier", {"max_depth": 3})
    bare = df.select("id", "a", "b")
    direct = le.predict(trained, bare)
    path = save_model(trained, spark, scratch_path(spark, "model"))
    again = le.predict(load_model(spark, path), bare)
    assert direct.columns == ["id", "a", "b", "prediction"]
    assert direct.exceptAll(again).count() == 0
    assert {r["prediction"] for r in direct.select("prediction").distinct().collect()} == {"red", "green", "blue"}


def test_neighbours_keep_text_labels_without_a_list_of_them(spark):
    rows = spark.range(3000).selectExpr("id", "CAST(id AS DOUBLE) AS x", "concat('k', id) AS name")
    trained = le.fit(rows, ["x"], "name", "KNeighborsClassifier", {"n_neighbors": 1})
    assert not any(isinstance(s, StringIndexerModel) for s in trained.model.stages)
    again = load_model(spark, save_model(trained, spark, scratch_path(spark, "model")))
    for model in (trained, again):
        said = le.predict(model, rows.select("id", "x"), "id")
        assert said.columns == ["id", "x", "prediction"]
        assert said.filter("prediction = concat('k', id)").count() == said.count() == 3000


def test_imputation_learns_from_training_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    test = spark.createDataFrame([(None,), (100.0,)], "x double")
    assert [r["x"] for r in tr.impute_mean(train, test, ["x"]).collect()] == [2.0, 100.0]


def test_flags_of_many_categories_stay_sparse(spark):
    rows = spark.range(20_000).selectExpr("concat('v', id % 10000) AS kind", "CAST(id AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS y")
    stages = le.preparation(rows, ["kind", "x"], "LogisticRegression")
    vector = le.Pipeline(stages=stages).fit(rows).transform(rows).select("_features").first()[0]
    assert isinstance(vector, SparseVector) and vector.size >= 10_001 and len(vector.indices) <= 2


def test_checked_params():
    checked = tr.checked_params(
        "RandomForestClassifier",
        {"n_estimators": [0, 5], "max_depth": "None", "min_samples_split": "1", "zzz": 3, "min_samples_leaf": "x"},
    )
    assert checked == {
        "n_estimators": 1, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt",
    }
    assert tr.checked_params("GradientBoostingRegressor", {"learning_rate": 7})["learning_rate"] == 1.0
    assert tr.checked_params("LogisticRegression", {"C": -1})["C"] == 0.001
    with pytest.raises(ValueError):
        tr.checked_params("zzz")
    with pytest.raises(ValueError, match="linear kernel"):
        tr.estimator("SVC", {"C": 1.0, "kernel": "rbf"}, 10, 2)


def test_tune_and_train_until(table):
    _, df = table
    best, scores = le.tune(df, "colour", "DecisionTreeClassifier", ["a", "b"], {"max_depth": [1, 4]}, folds=2)
    assert best["max_depth"] == 4 and scores.count() == 2
    near, scores = le.tune(df, "colour", "KNeighborsClassifier", ["a", "b"], {"n_neighbors": [1, 7], "weights": ["uniform", "distance"]}, folds=2)
    assert scores.count() == 4 and scores.agg({"score": "min"}).first()[0] > 0.8 and near["n_neighbors"] in (1, 7)
    trained, history = le.train_until(df, "colour", "DecisionTreeClassifier", ["id"], ["a"], {"max_depth": [1, 4, 5]})
    assert history.count() == 2 and trained.params["max_depth"] == 4


def test_expansion_keeps_what_correlates(spark):
    df = spark.range(1, 200).select(
        (F.col("id") / 10).alias("x"), (F.rand(3) * 10 + 1).alias("noise"), (1 / (F.col("id") / 10)).alias("y")
    )
    kept = fe.keep_useful(df, ["x", "noise"], "y", 0.9).columns
    assert "inv_x" in kept and "inv_noise" not in kept
    undefined = fe.expand_features(spark.createDataFrame([(0.0,), (-1.0,)], "x double"), ["x"])
    assert [(r["inv_x"], r["log_x"], r["sqrt_x"]) for r in undefined.collect()] == [(None, None, 0.0), (-1.0, None, None)]
