"""Model training, prediction and feature expansion queries."""

from pyspark.sql import functions as F

from tabwright.operators import features as fe
from tabwright.operators import neighbours as nb
from tabwright.operators import split as sp
from tabwright.operators import training as tr
from tabwright.plans import learning as le
from tabwright.plans.lineage import scratch_path
from tabwright.queries import fixtures as fx
from tabwright.queries.registry import query
from tabwright.sources import models as ms

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def model_table(t):
    """Numeric features with gaps and a rule-made target."""
    qty = F.col("l_quantity")
    return t.lineitem.select(
        *fx.LINEITEM_KEY,
        qty,
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount")).alias("l_discount"),
        "l_tax",
        (qty * (1 - F.col("l_discount")) > 25).cast("int").alias("target"),
        F.when(qty > 34, "bulk").when(qty > 17, "normal").otherwise("small").alias("size"),
        (F.col("l_extendedprice") / 1000).alias("price"),
    )


@query("ml_encode_target", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label FROM orders""")
def encode_target(t):
    coded, _ = tr.encode_target(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "classification")
    return coded.select("o_orderkey", "label")


@query("ml_target_codes", """
SELECT DISTINCT o_orderpriority AS value, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code
FROM orders""")
def target_codes(t):
    return tr.encode_target(t.orders, "o_orderpriority", "classification")[1]


@query("ml_coerce_target", """
SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS label
FROM part WHERE p_partkey % 3 <> 0""")
def coerce_target(t):
    mixed = t.part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("y"),
    )
    return tr.encode_target(mixed, "y", "regression")[0].drop("y")


_SPLIT_SQL = """split AS (
  SELECT *, row_number() OVER (ORDER BY md5(o_orderkey || '|42')) <= ceil(0.2 * count(*) OVER ()) AS in_test FROM orders)"""


@query("ml_split_exact", f"WITH {_SPLIT_SQL} SELECT o_orderkey, in_test FROM split")
def split_exact(t):
    return sp.mark_split(t.orders.select("o_orderkey"), ["o_orderkey"]).withColumnRenamed("_test", "in_test")


@query("ml_impute_mean", f"""
WITH {_SPLIT_SQL},
gaps AS (SELECT o_orderkey, in_test, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price FROM split)
SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM gaps WHERE NOT in_test)), 4) AS price FROM gaps""")
def impute_mean(t):
    gaps = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price")
    )
    train, _ = sp.train_test_split(gaps, ["o_orderkey"])
    return fx.rounded(tr.impute_mean(train, gaps, ["price"]), ["price"])


@query("ml_standardize", """
SELECT s_suppkey, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier))
                        / (SELECT stddev_samp(s_acctbal) FROM supplier), 6) AS s_acctbal FROM supplier""")
def standardize(t):
    return fx.rounded(tr.standardize(t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal"]), ["s_acctbal"], 6)


@query("ml_knn_exact", """
WITH pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, b.label,
         list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id)
SELECT query_id, neighbour_id, label, round(distance, 6) AS distance,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INT) AS rank
FROM pairs QUALIFY rank <= 5""")
def knn(t):
    near = nb.nearest(t.embeddings, t.embeddings, 5, "embedding", "vec_id", "vec_id", "label", exclude_self=True)
    return fx.rounded(near, ["distance"], 6)


@query("ml_knn_classify", """
WITH pairs AS (
  SELECT q.vec_id AS query_id, b.label,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY
           list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id),
votes AS (SELECT query_id, label, count(*) AS n FROM pairs WHERE rank <= 5 GROUP BY ALL)
SELECT query_id, arg_min(label, (-n, label)) AS prediction FROM votes GROUP BY query_id""")
def knn_classify(t):
    near = nb.nearest(t.embeddings, t.embeddings, 5, "embedding", "vec_id", "vec_id", "label", exclude_self=True)
    return nb.vote(near)


@query("ml_knn_projection_recall", "SELECT count(*) AS queries, true AS nine_in_ten FROM embeddings")
def knn_projection_recall(t):
    """The approximate mode finds at least nine in ten of the exact neighbours."""
    sides = (t.embeddings, t.embeddings, 5, "embedding", "vec_id", "vec_id", "label", True)
    exact = nb.nearest(*sides).select("query_id", "neighbour_id")
    found = nb.nearest_by_projection(*sides).select("query_id", "neighbour_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "neighbour_id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("nine_in_ten")
    )


_KNN_FIELDS = [f"e{i}" for i in range(6)]


@query("ml_tune_knn", f"""
WITH v AS (
  SELECT vec_id, vec_id % 3 AS fold, label, {", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(_KNN_FIELDS))}
  FROM embeddings),
s AS (
  SELECT f.fold, {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _KNN_FIELDS)}
  FROM (VALUES (0), (1), (2)) f(fold) JOIN v ON v.fold <> f.fold GROUP BY f.fold),
near AS (
  SELECT q.fold, q.vec_id, q.label AS truth, b.label,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {" + ".join(f"((q.{c} - b.{c}) / s_{c}) ** 2" for c in _KNN_FIELDS)}) AS rank
  FROM v q JOIN s USING (fold) JOIN v b ON q.fold <> b.fold),
votes AS (
  SELECT k, fold, vec_id, truth, CAST(label AS VARCHAR) AS label, count(*) AS n
  FROM near, (VALUES (1), (5), (9)) p(k) WHERE rank <= k GROUP BY ALL),
said AS (SELECT k, fold, vec_id, CAST(truth AS VARCHAR) AS truth, arg_min(label, (-n, label)) AS label FROM votes GROUP BY ALL),
classes AS (
  SELECT k, fold, class, sum(hit) AS hit, sum(actual) AS actual, sum(predicted) AS predicted FROM (
    SELECT k, fold, truth AS class, (truth = label)::INT AS hit, 1 AS actual, 0 AS predicted FROM said
    UNION ALL SELECT k, fold, label, 0, 0, 1 FROM said) GROUP BY ALL),
f1 AS (SELECT k, fold, sum(2.0::DOUBLE * hit / (actual + predicted) * actual) / sum(actual) AS f1 FROM classes GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS candidate, round(avg(f1), 6) AS score FROM f1 GROUP BY k""")
def tune_knn(t):
    fields = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_KNN_FIELDS)]
    rows = t.embeddings.select(*fields, "label", (F.col("vec_id") % 3).alias("fold"))
    _, scores = le.tune(rows, "label", "KNeighborsClassifier", _KNN_FIELDS, {"n_neighbors": [1, 5, 9]}, fold="fold")
    return fx.rounded(scores.select("candidate", "score"), ["score"], 6)


def _classifier(name, algorithm, params, target="target"):
    @query(name)
    def run(t):
        trained = le.train(model_table(t), target, algorithm, fx.LINEITEM_KEY, params, FEATURES)
        return trained.metrics.withColumn("algorithm", F.lit(algorithm))


_classifier("ml_rf_classifier", "RandomForestClassifier", {"n_estimators": 20, "max_depth": 6})
_classifier("ml_logreg", "LogisticRegression", {})
_classifier("ml_linear_svc", "SVC", {})
_classifier("ml_linear_svc_multiclass", "SVC", {"C": 0.01}, "size")
_classifier("ml_gbt_classifier", "GradientBoostingClassifier", {"n_estimators": 10})
_classifier("ml_dtree", "DecisionTreeClassifier", {"max_depth": 8}, "size")
_classifier("ml_xgb_like", "XGBoostClassifier", {"n_estimators": 10, "subsample": 0.8})
_classifier("ml_mlp", "NeuralNetwork", {"nn_hidden_layers": [8, 4], "num_epochs": 5}, "size")
_classifier("ml_rf_regressor", "RandomForestRegressor", {"n_estimators": 20, "max_depth": 6}, "price")
_classifier("ml_gbt_regressor", "GradientBoostingRegressor", {"n_estimators": 10}, "price")
_classifier("ml_xgb_like_regressor", "XGBoostRegressor", {"n_estimators": 10, "colsample_bytree": 0.7}, "price")


def _line(name, algorithm, slope_sql, params=None):
    """One feature, where the fitted line has a closed form."""
    sql = f"""
WITH xy AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
s AS (SELECT count(*) AS n, covar_pop(x, y) AS sxy, var_pop(x) AS sxx, avg(x) AS mx, avg(y) AS my FROM xy),
w AS (SELECT *, {slope_sql} AS slope FROM s)
SELECT round(slope, 4) AS slope, round(my - slope * mx, 4) AS intercept FROM w"""

    @query(name, sql)
    def run(t):
        table = t.lineitem.select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
        line = le.fit(table, ["l_quantity"], "y", algorithm, params).model.stages[-1]
        found = t.spark.createDataFrame(
            [(float(line.coefficients[0]), float(line.intercept))], "slope double, intercept double"
        )
        return fx.rounded(found, ["slope", "intercept"])


_line("ml_linreg", "LinearRegression", "sxy / sxx")
_line("ml_ridge", "Ridge", "sxy / (sxx + 100000.0 / n)", {"alpha": 100000.0})
_line("ml_lasso", "Lasso", "sign(sxy) * greatest(abs(sxy) - 1.0, 0) / sxx", {"alpha": 1.0})


@query("ml_train_end_to_end")
def end_to_end(t):
    trained = le.train(
        model_table(t), "target", "LogisticRegression", fx.LINEITEM_KEY, {"C": 10, "max_iter": 50, "unknown": 1},
        FEATURES, generated=[{"name": "net_qty", "formula": "data['l_quantity'] * (1 - data['l_discount'])"}],
    )
    return trained.metrics


# a tree of this depth finds the rule behind the target exactly
_SIZE_SQL = f"""
SELECT {fx.KEY_SQL}, l_quantity, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END AS l_discount, l_tax,
       CASE WHEN l_quantity > 34 THEN 'bulk' WHEN l_quantity > 17 THEN 'normal' ELSE 'small' END AS prediction
FROM lineitem"""


@query("ml_batch_predict", _SIZE_SQL)
def batch_predict(t):
    table = model_table(t)
    trained = le.train(table, "size", "DecisionTreeClassifier", fx.LINEITEM_KEY, {"max_depth": 4}, FEATURES)
    return le.predict(trained, table.select(*fx.LINEITEM_KEY, *FEATURES))


@query("ml_save_load_predict", _SIZE_SQL)
def save_load(t):
    table = model_table(t)
    trained = le.fit(table, FEATURES, "size", "DecisionTreeClassifier", {"max_depth": 4})
    path = ms.save_model(trained, t.spark, scratch_path(t.spark, "model"))
    return le.predict(ms.load_model(t.spark, path), table.select(*fx.LINEITEM_KEY, *FEATURES))


def _size_rule(name, algorithm, params):
    """Trees whose splits are the rule itself."""

    @query(name, _SIZE_SQL)
    def run(t):
        table = model_table(t)
        trained = le.train(table, "size", algorithm, fx.LINEITEM_KEY, params, FEATURES)
        return le.predict(trained, table.select(*fx.LINEITEM_KEY, *FEATURES))


_size_rule("ml_rf_classifier_rule", "RandomForestClassifier", {"n_estimators": 5, "max_depth": 4, "max_features": None})
_size_rule("ml_gbt_classifier_rule", "GradientBoostingClassifier", {"n_estimators": 3, "max_depth": 3})
_size_rule("ml_xgb_like_rule", "XGBoostClassifier", {"n_estimators": 3, "max_depth": 3})


_STEP_SQL = f"""
SELECT {fx.KEY_SQL}, CASE WHEN l_quantity > 34 THEN 30.0::DOUBLE WHEN l_quantity > 17 THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS prediction
FROM lineitem"""


def _step_rule(name, algorithm, params):
    """A step function, which trees with constant leaves reproduce."""

    @query(name, _STEP_SQL)
    def run(t):
        table = model_table(t)
        steps = F.when(F.col("size") == "bulk", 30.0).when(F.col("size") == "normal", 20.0).otherwise(10.0)
        table = table.withColumn("step", steps)
        trained = le.train(table, "step", algorithm, fx.LINEITEM_KEY, params, FEATURES)
        scored = le.predict(trained, table.select(*fx.LINEITEM_KEY, *FEATURES))
        return fx.rounded(scored.select(*fx.LINEITEM_KEY, "prediction"), ["prediction"], 4)


_step_rule("ml_rf_regressor_rule", "RandomForestRegressor", {"n_estimators": 5, "max_depth": 4, "max_features": None})
_step_rule("ml_gbt_regressor_rule", "GradientBoostingRegressor", {"n_estimators": 3, "max_depth": 3})
_step_rule("ml_xgb_like_regressor_rule", "XGBoostRegressor", {"n_estimators": 3, "max_depth": 3})


@query("ml_svc_text_rule", f"""
SELECT {fx.KEY_SQL}, l_quantity, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS prediction
FROM lineitem WHERE l_quantity <= 15 OR l_quantity > 35""")
def svc_text(t):
    """Two text labels apart by a margin."""
    rows = t.lineitem.filter("l_quantity <= 15 OR l_quantity > 35").select(
        *fx.LINEITEM_KEY, "l_quantity", F.when(F.col("l_quantity") > 25, "many").otherwise("few").alias("amount")
    )
    trained = le.fit(rows, ["l_quantity"], "amount", "SVC", {})
    return le.predict(trained, rows.drop("amount"))


@query("ml_many_categories", """
SELECT o_orderkey, 'c' || (o_orderkey % 400) AS kind, CAST(o_orderkey % 400 % 2 AS DOUBLE) AS prediction FROM orders""")
def many_categories(t):
    """A text feature with hundreds of values."""
    code = F.col("o_orderkey") % 400
    rows = t.orders.select("o_orderkey", F.concat(F.lit("c"), code.cast("string")).alias("kind"), (code % 2).alias("odd"))
    trained = le.fit(rows, ["kind"], "odd", "DecisionTreeClassifier", {"max_depth": 2})
    return le.predict(trained, rows.drop("odd"))


@query("ml_linear_many_categories", """
SELECT o_orderkey, 'c' || (o_orderkey % 1000) AS kind, CAST(o_orderkey % 1000 % 2 AS DOUBLE) AS prediction FROM orders""")
def linear_many_categories(t):
    """A linear model over a thousand sparse flags and a number that says nothing."""
    code = F.col("o_orderkey") % 1000
    rows = t.orders.select(
        "o_orderkey", F.concat(F.lit("c"), code.cast("string")).alias("kind"), "o_totalprice", (code % 2).alias("odd")
    )
    trained = le.fit(rows, ["kind", "o_totalprice"], "odd", "LogisticRegression", {"C": 1000.0})
    return le.predict(trained, rows.drop("odd")).drop("o_totalprice")


@query("ml_many_classes", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, 'k' || c_custkey AS prediction FROM customer")
def many_classes(t):
    """As many classes as rows."""
    rows = t.customer.select("c_custkey", F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("name"))
    trained = le.fit(rows, ["c_custkey"], "name", "KNeighborsClassifier", {"n_neighbors": 1})
    return le.predict(trained, rows.select("c_custkey"), "c_custkey")


@query("ml_tune_grid")
def tune(t):
    _, table = le.tune(
        model_table(t), "target", "DecisionTreeClassifier", FEATURES, {"max_depth": [2, 6]}, folds=2
    )
    return table


@query("ml_train_until")
def train_until(t):
    _, history = le.train_until(
        model_table(t), "size", "DecisionTreeClassifier", fx.LINEITEM_KEY, FEATURES, {"max_depth": [1, 2, 8]}
    )
    return history


@query("feat_expand", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, """ + ", ".join(
    f"""round(CASE WHEN {c} <> 0 THEN 1 / {c} END, 6) AS inv_{c}, round(sqrt({c}), 6) AS sqrt_{c},
    round(CASE WHEN {c} > 0 THEN ln({c}) END, 6) AS log_{c}, round(exp({c}), 6) AS exp_{c}, abs({c}) AS abs_{c},
    {c} * {c} AS sq_{c}, {c} * {c} * {c} AS cube_{c}""" for c in ("l_discount", "l_tax"))
    + ", l_discount * l_tax AS l_discount_x_l_tax FROM lineitem")
def expand(t):
    wide = fe.expand_features(t.lineitem.select(*fx.LINEITEM_KEY, "l_discount", "l_tax"), ["l_discount", "l_tax"])
    names = [f"{f}_{c}" for f in ("inv", "sqrt", "log", "exp") for c in ("l_discount", "l_tax")]
    return fx.rounded(wide, names, 6).drop("l_discount", "l_tax")


_TERMS = {
    "inv": "CASE WHEN l_quantity <> 0 THEN 1 / l_quantity END", "sqrt": "sqrt(l_quantity)", "log": "ln(l_quantity)",
    "exp": "exp(l_quantity)", "abs": "abs(l_quantity)", "sq": "l_quantity * l_quantity",
    "cube": "l_quantity * l_quantity * l_quantity",
}


@query("feat_expand_correlation", " UNION ALL ".join(
    f"SELECT '{n}_l_quantity' AS feature, round(corr({e}, l_extendedprice), 4) AS correlation FROM lineitem"
    for n, e in _TERMS.items()))
def expand_correlation(t):
    wide = fe.expand_features(t.lineitem.select("l_quantity", "l_extendedprice"), ["l_quantity"])
    return fx.rounded(
        fe.feature_correlations(wide, list(fe.expansions(["l_quantity"])), "l_extendedprice"), ["correlation"]
    )


@query("feat_expand_selected")
def expand_selected(t):
    return fe.keep_useful(
        t.lineitem.select(*fx.LINEITEM_KEY, "l_quantity", "l_discount", "l_extendedprice"),
        ["l_quantity", "l_discount"], "l_extendedprice", 0.2,
    )


@query("feat_expand_lasso")
def expand_lasso(t):
    names = fe.lasso_useful(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice", alpha=100.0)
    return t.spark.createDataFrame([(n,) for n in names], "feature string")
