"""Training, scoring and tuning as whole plans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import islice, product
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (
    Imputer, IndexToString, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators import evaluate as ev
from tabwright.operators import neighbours, training
from tabwright.operators.edit import generated_features, quoted, split_features_target
from tabwright.operators.split import train_test_split
from tabwright.plans.lineage import cut_lineage, spread

GOOD_SCORE = 7.0


@dataclass
class Trained:
    """A fitted model with what is needed to score other tables."""

    algorithm: str
    params: dict[str, Any]
    kind: str
    features: list[str]
    target: str
    model: PipelineModel
    generated: list[Any] = field(default_factory=list)
    metrics: DataFrame | None = None
    examples: DataFrame | None = None  # training rows, for nearest neighbours only


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def preparation(df: DataFrame, features: Sequence[str], algorithm: str) -> list:
    """Stages that turn feature columns into the vector ``_features``.

    Trees get the codes of text features as categories; for every other
    learner, which would read codes as quantities, each value is a dimension of its own.
    """
    scale = algorithm in training.SCALED
    texts = [c for c in features if _is_text(df, c)]
    numbers = [c for c in features if c not in texts]
    stages = []
    if texts:
        stages.append(
            StringIndexer(
                inputCols=texts, outputCols=[f"_code_{c}" for c in texts], stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"_full_{c}" for c in numbers], strategy="mean"))
    one_hot = bool(texts) and algorithm not in training.TREES
    if one_hot:
        stages.append(
            OneHotEncoder(
                inputCols=[f"_code_{c}" for c in texts], outputCols=[f"_flags_{c}" for c in texts], handleInvalid="keep",
                dropLast=True,
            )
        )
    parts = [(f"_flags_{c}" if one_hot else f"_code_{c}") if c in texts else f"_full_{c}" for c in features]
    if scale and numbers:
        # only the numbers are centred and scaled: a vector of flags stays as sparse as it is, whatever the number of values
        stages.append(VectorAssembler(inputCols=[f"_full_{c}" for c in numbers], outputCol="_raw"))
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True))
        parts = ["_scaled", *[p for p in parts if p.startswith(("_flags_", "_code_"))]]
    stages.append(VectorAssembler(inputCols=parts, outputCol="_features"))
    return stages


def _text_bins(model: PipelineModel) -> int:
    """Bins that trees need: one per value of the widest text feature and one for unseen values."""
    widths = [len(labels) for s in model.stages if isinstance(s, StringIndexerModel) for labels in s.labelsArray]
    return max(training.SPLIT_BINS, *(w + 1 for w in widths)) if widths else training.SPLIT_BINS


def _typed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    numeric = [c for c in features if not _is_text(df, c)]
    return df.withColumns({c: quoted(c).cast("double") for c in numeric})


def _labelled(df: DataFrame, target: str, kind: str) -> DataFrame:
    if kind == "regression":
        return df.withColumn("_label", quoted(target).try_cast("double")).filter(F.col("_label").isNotNull())
    if _is_text(df, target):
        return df.filter(quoted(target).isNotNull())
    return df.withColumn("_label", quoted(target).cast("double")).filter(F.col("_label").isNotNull())


def fit(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    algorithm: str,
    params: Mapping[str, Any] | None = None,
    seed: int = 42,
) -> Trained:
    """Fit on the given rows; imputation and scaling learn from these rows only."""
    kind = training.problem_kind(algorithm)
    checked = training.checked_params(algorithm, params)
    labelled = _labelled(_typed(train, features), target, kind)
    text_target = kind == "classification" and _is_text(train, target)
    if text_target and algorithm == "KNeighborsClassifier":
        # votes count labels of any type, so classes need no codes and there can be as many as rows
        text_target, labelled = False, labelled.withColumn("_label", quoted(target))
    kept = [*features, target] if text_target else [*features, "_label"]
    stages = preparation(train, features, algorithm)
    if text_target:
        # no class for unseen labels: rows without a label are gone, and the learner counts the classes
        stages = [StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc"), *stages]
    # the statistics of every stage and the learner itself pass over these rows
    rows = spread(labelled.select(*[quoted(c) for c in kept])).persist()
    try:
        prepared_model = Pipeline(stages=stages).fit(rows)
        prepared = prepared_model.transform(rows)
        if algorithm == "KNeighborsClassifier":
            # row ids must not change between passes, and copies of a row need ids of their own
            examples = prepared.select(
                F.monotonically_increasing_id().alias("_id"), "_label", vector_to_array("_features").alias("_v")
            )
            return Trained(
                algorithm, checked, kind, list(features), target, prepared_model, examples=cut_lineage(examples)
            )
        facts = prepared.agg(
            F.count(F.lit(1)).alias("rows"), F.max("_label").alias("top"), F.stddev_pop("_label").alias("spread")
        ).first()
        classes = int(facts["top"]) + 1 if kind == "classification" and facts["top"] is not None else 0
        first = prepared.select("_features").first()
        width = first["_features"].size if first else len(features)
        learner = training.estimator(
            algorithm, checked, facts["rows"], width, classes, facts["spread"] or 1.0, seed, _text_bins(prepared_model)
        )
        fitted = learner.fit(prepared.select("_label", "_features"))
    finally:
        rows.unpersist()
    decode = []
    if text_target:
        labels = prepared_model.stages[0].labels
        decode = [IndexToString(inputCol="prediction", outputCol="_decoded", labels=labels)]
    whole = PipelineModel(stages=[*prepared_model.stages, fitted, *decode])
    return Trained(algorithm, checked, kind, list(features), target, whole)


def predict(trained: Trained, df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Append ``prediction`` to any table or stream that has the feature columns."""
    for_features, _ = generated_features(df, trained.generated)
    rows = _typed(for_features, trained.features)
    if trained.algorithm == "KNeighborsClassifier":
        return _predict_by_neighbours(trained, rows, row_id)
    return score_with(trained.model, rows, df.columns)


def score_with(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    stages = [s for s in model.stages if not _reads_missing_target(s, df)]
    scored = PipelineModel(stages=stages).transform(df)
    answer = F.col("_decoded") if "_decoded" in scored.columns else F.col("prediction")
    return scored.select(*[quoted(c) for c in keep if c != "prediction"], answer.alias("prediction"))


def _reads_missing_target(stage: Any, df: DataFrame) -> bool:
    """The target's indexer has nothing to read in a table without a target."""
    return (
        stage.hasParam("outputCol") and stage.isDefined("outputCol") and stage.getOutputCol() == "_label"
        and stage.hasParam("inputCol") and stage.getInputCol() not in df.columns
    )


def _predict_by_neighbours(trained: Trained, df: DataFrame, row_id: str | None) -> DataFrame:
    if row_id is None:
        raise ValueError("nearest neighbours need the column that identifies a row")
    stages = [s for s in trained.model.stages if not _reads_missing_target(s, df)]
    vectors = PipelineModel(stages=stages).transform(df).withColumn("_v", vector_to_array("_features"))
    near = neighbours.nearest(
        trained.examples, vectors, trained.params["n_neighbors"], "_v", "_id", row_id, "_label"
    )
    votes = neighbours.vote(near, trained.params["weights"])
    scored = df.join(votes, df[row_id].cast("long") == votes["query_id"], "left").drop("query_id")
    first = trained.model.stages[0]  # models stored with codes for labels
    if isinstance(first, StringIndexerModel) and first.isSet("outputCol") and first.getOutputCol() == "_label":
        names = F.array(*[F.lit(x) for x in first.labels])
        scored = scored.withColumn("prediction", F.get(names, F.col("prediction").cast("int")))
    return scored


def evaluate(trained: Trained, test: DataFrame, row_id: str | None = None) -> DataFrame:
    """Metrics, score and grade on rows that have the target."""
    scored = predict(trained, test, row_id).filter(quoted(trained.target).isNotNull())
    if trained.kind == "regression":
        pairs = scored.select(quoted(trained.target).try_cast("double").alias("label"), "prediction")
        return ev.overall_score(ev.regression_metrics(pairs), "regression")
    cast = "string" if _is_text(test, trained.target) else "double"
    pairs = scored.select(quoted(trained.target).cast(cast).alias("label"), F.col("prediction").cast(cast))
    return ev.overall_score(ev.classification_metrics(pairs), "classification")


def train(
    df: DataFrame,
    target: str | None,
    algorithm: str,
    keys: Sequence[str],
    params: Mapping[str, Any] | None = None,
    features: Sequence[str] | None = None,
    generated: Sequence[Any] = (),
    test_share: float = 0.2,
    seed: int = 42,
) -> Trained:
    """Derive features, split, impute and encode, fit, and evaluate on the test rows."""
    wide, report = generated_features(df, list(generated))
    added = [r["name"] for r in report if r["status"] == "added"]
    candidates = [*(features or [c for c in df.columns if c not in keys]), *added]
    _, names, target = split_features_target(wide, target, candidates)
    training_rows, test_rows = train_test_split(wide, keys, test_share, seed)
    result = fit(training_rows, names, target, algorithm, params, seed)
    result.generated = list(generated)
    result.metrics = evaluate(result, test_rows, keys[0] if len(keys) == 1 else None)
    return result


# ranges offered for tuning, as grids (fixed values: lowest, usual and higher settings)
DEFAULT_GRIDS: dict[str, dict[str, list]] = {
    "RandomForestClassifier": {"n_estimators": [10, 50], "max_depth": [5, 10]},
    "RandomForestRegressor": {"n_estimators": [10, 50], "max_depth": [5, 10]},
    "LogisticRegression": {"C": [0.01, 1.0, 100.0]},
    "SVC": {"C": [0.01, 1.0, 100.0]},
    "GradientBoostingClassifier": {"n_estimators": [10, 50], "learning_rate": [0.1, 0.3]},
    "GradientBoostingRegressor": {"n_estimators": [10, 50], "learning_rate": [0.1, 0.3]},
    "XGBoostClassifier": {"n_estimators": [10, 50], "learning_rate": [0.1, 0.3]},
    "XGBoostRegressor": {"n_estimators": [10, 50], "learning_rate": [0.1, 0.3]},
    "DecisionTreeClassifier": {"max_depth": [3, 5, 10]},
    "Ridge": {"alpha": [0.1, 1.0, 10.0]},
    "Lasso": {"alpha": [0.1, 1.0, 10.0]},
    "LinearRegression": {},
    "NeuralNetwork": {"num_epochs": [5, 10]},
    "KNeighborsClassifier": {"n_neighbors": [3, 5, 9]},
}


def candidates(grid: Mapping[str, Sequence[Any]]) -> Iterable[dict[str, Any]]:
    names = list(grid)
    return (dict(zip(names, values)) for values in product(*[grid[n] for n in names]))


def _score_table(df: DataFrame, points: Sequence[Mapping[str, Any]], scores: Sequence[float]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, str(p), float(s)) for i, (p, s) in enumerate(zip(points, scores))], "candidate int, params string, score double"
    )


def _folded(rows: DataFrame, kept: Sequence[str], folds: int, fold: str | None) -> DataFrame:
    """Append ``_fold``; made from a row's values, so that equal rows are never on both sides."""
    made = F.pmod(F.xxhash64(*[quoted(c) for c in kept]), F.lit(folds))
    return rows.withColumn("_fold", (quoted(fold) if fold else made).cast("int"))


def _neighbour_scores(
    df: DataFrame, target: str, features: Sequence[str], points: Sequence[Mapping[str, Any]], folds: int, fold: str | None
) -> list[float]:
    """Weighted F1 of every grid point, averaged over the folds."""
    most = max(p["n_neighbors"] for p in points)
    rows = _typed(df, features).filter(quoted(target).isNotNull()).withColumn("_truth", quoted(target).cast("string"))
    rows = _folded(rows.select(*[quoted(c) for c in features], "_truth", *([quoted(fold)] if fold else [])), [*features, "_truth"], folds, fold)
    # row ids must not change between passes
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    total = [0.0] * len(points)
    for held in range(folds):
        learnt = Pipeline(stages=preparation(df, features, "KNeighborsClassifier")).fit(rows.filter(F.col("_fold") != held))
        vectors = learnt.transform(rows).select("_row", "_fold", "_truth", vector_to_array("_features").alias("_v"))
        test = vectors.filter(F.col("_fold") == held)
        near = neighbours.nearest(vectors.filter(F.col("_fold") != held), test, most, "_v", "_row", "_row", "_truth")
        near = near.persist()
        try:
            for i, p in enumerate(points):
                votes = neighbours.vote(near.filter(F.col("rank") <= p["n_neighbors"]), p["weights"])
                pairs = test.join(votes, F.col("_row") == F.col("query_id")).select(F.col("_truth").alias("label"), "prediction")
                total[i] += ev.weighted_f1(pairs).first()["f1"] or 0.0
        finally:
            near.unpersist()
    return [t / folds for t in total]


def tune(
    df: DataFrame,
    target: str,
    algorithm: str,
    features: Sequence[str],
    grid: Mapping[str, Sequence[Any]] | None = None,
    folds: int = 3,
    parallelism: int = 4,
    seed: int = 42,
    fold: str | None = None,
) -> tuple[dict[str, Any], DataFrame]:
    """Cross-validate every grid point; the best parameters and a table of scores.

    Each grid point is its own estimator, run by one ``CrossValidator`` whose
    parameter is the pipeline itself, so candidates are fitted in parallel.  Nearest neighbours are
    looked up once per fold for the largest number of them, and every grid point reads its own from their ranks.
    ``fold`` names a column with the fold of each row, from 0; else it follows from the row's values.
    """
    kind = training.problem_kind(algorithm)
    points = [training.checked_params(algorithm, p) for p in candidates(grid or DEFAULT_GRIDS[algorithm])]
    if algorithm == "KNeighborsClassifier":
        scores = _neighbour_scores(df, target, features, points, folds, fold)
        return points[max(range(len(points)), key=lambda i: scores[i])], _score_table(df, points, scores)
    rows = _labelled(_typed(df, features), target, kind)
    text_target = kind == "classification" and _is_text(df, target)
    kept = [*features, target] if text_target else [*features, "_label"]
    rows = _folded(spread(rows.select(*[quoted(c) for c in kept], *([quoted(fold)] if fold else []))), kept, folds, fold)
    stages = preparation(df, features, algorithm)
    if text_target:
        stages = [StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc"), *stages]
    # names of categories are known beforehand; means and deviations are learnt inside each fold
    named = Pipeline(stages=[s for s in stages if isinstance(s, (StringIndexer, OneHotEncoder))]).fit(rows)
    learnt = [s for s in stages if not isinstance(s, (StringIndexer, OneHotEncoder))]
    prepared = named.transform(rows).persist()
    try:
        first = Pipeline(stages=learnt).fit(prepared).transform(prepared).select("_features").first()
        width = first["_features"].size if first else len(features)
        facts = prepared.agg(
            F.count(F.lit(1)).alias("rows"), F.max("_label").alias("top"), F.stddev_pop("_label").alias("spread")
        ).first()
        classes = int(facts["top"]) + 1 if kind == "classification" else 0
        judge = (
            RegressionEvaluator(labelCol="_label", metricName="r2")
            if kind == "regression"
            else MulticlassClassificationEvaluator(labelCol="_label", metricName="f1")
        )
        learners = [
            training.estimator(
                algorithm, p, facts["rows"], width, classes, facts["spread"] or 1.0, seed, _text_bins(named)
            )
            for p in points
        ]
        pipeline = Pipeline(stages=[])
        builder = ParamGridBuilder().addGrid(pipeline.stages, [[*learnt, learner] for learner in learners]).build()
        found = CrossValidator(
            estimator=pipeline, estimatorParamMaps=builder, evaluator=judge, numFolds=folds,
            parallelism=parallelism, seed=seed, foldCol="_fold",
        ).fit(prepared)
    finally:
        prepared.unpersist()
    best = max(range(len(points)), key=lambda i: found.avgMetrics[i])
    return points[best], _score_table(df, points, found.avgMetrics)


def train_until(
    df: DataFrame,
    target: str,
    algorithm: str,
    keys: Sequence[str],
    features: Sequence[str] | None = None,
    grid: Mapping[str, Sequence[Any]] | None = None,
    max_iterations: int = 3,
    good: float = GOOD_SCORE,
    report: Callable[[dict], None] | None = None,
) -> tuple[Trained, DataFrame]:
    """Try candidates in turn until one scores well enough or the limit is reached."""
    history, best = [], None
    for i, params in enumerate(islice(candidates(grid or DEFAULT_GRIDS[algorithm]), max_iterations), start=1):
        trained = train(df, target, algorithm, keys, params, features)
        row = trained.metrics.select("score", "grade").first()
        history.append((i, str(params), float(row["score"]), row["grade"]))
        if report:
            report({"iteration": i, "params": params, "score": row["score"]})
        if best is None or row["score"] > best[0]:
            best = (row["score"], trained)
        if row["score"] >= good:
            break
    table = df.sparkSession.createDataFrame(
        history, "iteration int, params string, score double, grade string"
    )
    return best[1], table
