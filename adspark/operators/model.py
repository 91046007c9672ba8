"""Conversion models on Spark (M1-M4).

M1 is a linear ("wide") model kept as a weight table ``(feature, code,
weight)`` plus a bias; scoring is one broadcast lookup per feature and a
sigmoid. ``fit_log_odds`` fits that table in one grouped pass (smoothed
per-category log odds, a naive-Bayes style wide model). M2 and M3 use Spark
ML (weighted logistic regression; factorization machine as the scalable
stand-in for embedding interactions - not the same function as the
reference's network). M4 runs any pandas predictor over Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000


def fit_log_odds(processed: DataFrame, n_cat: int = 9, label: str = "conversion_flag",
                 alpha: float = 1.0) -> tuple[DataFrame, float]:
    """Weight per (feature, code): ln((pos+a)/(neg+a)) - prior log odds; bias = prior log odds."""
    tot = processed.agg(F.sum(F.col(label).cast("double")).alias("P"), F.count(F.lit(1)).alias("n")).first()
    p, n = tot["P"] or 0.0, tot["n"]
    bias = math.log((p + alpha) / (n - p + alpha))
    long = processed.select(F.col(label).cast("double").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(f"cat_{i}").alias("code")) for i in range(n_cat)])).alias("kv"))
    g = long.groupBy("kv.feature", "kv.code").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("cnt"))
    w = F.log((F.col("pos") + alpha) / (F.col("cnt") - F.col("pos") + alpha)) - F.lit(bias)
    return g.select("feature", "code", w.alias("weight")), bias


def join_weights(df: DataFrame, weights: DataFrame, features, prefix: str = "w_") -> DataFrame:
    """``df`` with a column ``w_<i>`` for each feature index: the weight of its code, 0 for an unseen one.

    Each feature's weights are broadcast if that feature has at most
    ``MAX_BROADCAST_ROWS`` of them, else joined by shuffle: one large
    dictionary does not make the small ones move the facts.
    """
    size = {r["feature"]: r["count"] for r in weights.groupBy("feature").count().collect()}  # one row per feature
    for i in features:
        wi = weights.where(F.col("feature") == i).select(F.col("code").alias(f"cat_{i}"), F.col("weight").alias("_w"))
        if size.get(i, 0) <= MAX_BROADCAST_ROWS:
            wi = F.broadcast(wi)
        df = df.join(wi, f"cat_{i}", "left").withColumn(f"{prefix}{i}", F.coalesce(F.col("_w"), F.lit(0.0))).drop("_w")
    return df


def linear_logit(df: DataFrame, weights: DataFrame, bias: float, features, out: str = "logit") -> DataFrame:
    """bias + sum over ``features`` (indices) of weight[feature][cat_i]; unseen codes weigh 0."""
    features = list(features)
    logit = F.lit(float(bias))
    for i in features:
        logit = logit + F.col(f"_w{i}")
    return join_weights(df, weights, features, "_w").withColumn(out, logit).drop(*[f"_w{i}" for i in features])


def campaign_weights(encoder: DataFrame, weights: DataFrame, campaign_ids: list[int],
                     feature_name: str = "campaign_id", feature_index: int = 0) -> dict[int, float]:
    """Weight of each candidate campaign's code (unseen id -> code 0, unseen code -> 0.0).

    Reads the dictionary entries of the named campaigns and the weights of
    their codes: as many rows as campaigns, whatever the dictionary's size.
    """
    codes = encoder.where((F.col("feature") == feature_name) & F.col("category").isin([str(c) for c in campaign_ids]))
    code_of = {r["category"]: r["code"] for r in codes.collect()}
    wanted = sorted({*code_of.values(), 0})
    ws = weights.where((F.col("feature") == feature_index) & F.col("code").isin(wanted))
    w_of = {r["code"]: r["weight"] for r in ws.collect()}
    return {cid: float(w_of.get(code_of.get(str(cid), 0), 0.0)) for cid in campaign_ids}


def score_linear(processed: DataFrame, weights: DataFrame, bias: float, n_cat: int = 9,
                 keep: list[str] | None = None) -> DataFrame:
    """p = sigmoid(bias + sum of per-feature weights); unseen codes weigh 0 (M1)."""
    out = linear_logit(processed, weights, bias, range(n_cat))
    out = out.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))))
    return out.select(*keep, "logit", "score") if keep else out


def score_plugin(processed: DataFrame, predict, out_schema: str) -> DataFrame:
    """Run a pandas function ``predict(pdf) -> pdf`` over Arrow batches."""
    def run(it):
        for pdf in it:
            yield predict(pdf)
    return processed.mapInPandas(run, out_schema)


def _assembled(processed: DataFrame, n_cat: int, n_num: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    ohe = OneHotEncoder(inputCols=[f"cat_{i}" for i in range(n_cat)],
                        outputCols=[f"oh_{i}" for i in range(n_cat)], handleInvalid="keep")
    va = VectorAssembler(inputCols=[f"oh_{i}" for i in range(n_cat)] + [f"num_{i}" for i in range(n_num)],
                         outputCol="features")
    return Pipeline(stages=[ohe, va])


def fit_score_logistic(train: DataFrame, apply_to: DataFrame, n_cat: int = 9, n_num: int = 8,
                       label: str = "conversion_flag", max_iter: int = 50) -> DataFrame:
    """Class-weighted logistic regression (weight neg/pos on positives) on one-hot + numeric (M2)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    c = train.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()
    pw = (c["n"] / c["p"]) if c["p"] else 1.0
    tr = train.withColumn("w", F.when(F.col(label) == 1, F.lit(float(pw))).otherwise(F.lit(1.0)))
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="w", maxIter=max_iter)
    model = Pipeline(stages=[_assembled(train, n_cat, n_num), lr]).fit(tr)
    return model.transform(apply_to).withColumn("score", vector_to_array("probability")[1])


@dataclass
class Factors:
    """A fitted factorization machine: bias, and per feature level a weight and a factor vector; the numbers follow the levels."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    starts: list[int]
    sizes: list[int]

    def level(self, feature: int, code: int) -> tuple[float, list[float]]:
        """Weight and vector of a code; an unseen one has zeros."""
        if not 0 <= code < self.sizes[feature]:
            return 0.0, [0.0] * self.vectors.shape[1]
        at = self.starts[feature] + code
        return float(self.weights[at]), self.vectors[at].tolist()


def fit_factors(train: DataFrame, n_cat: int = 9, n_num: int = 8, label: str = "conversion_flag", factor_size: int = 16, max_iter: int = 50) -> Factors:
    """Fit M3's model and keep its parameters (features x factors numbers, which Spark ML holds on the driver as well)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import FMClassifier
    fm = FMClassifier(featuresCol="features", labelCol=label, factorSize=factor_size, maxIter=max_iter, seed=7)
    fit = Pipeline(stages=[_assembled(train, n_cat, n_num), fm]).fit(train)
    sizes = [int(n) for n in fit.stages[0].stages[0].categorySizes]
    model = fit.stages[1]
    return Factors(float(model.intercept), model.linear.toArray(), model.factors.toArray(), np.cumsum([0, *sizes]).tolist(), sizes)


def factor_side(df: DataFrame, model: Factors, features, n_num: int = 8, logit: str = "imp_logit", vector: str = "imp_vector") -> DataFrame:
    """Everything but one feature of a factorization machine: ``imp_logit`` and the summed factors ``imp_vector``.

    With the missing feature at level c, the logit is imp_logit + weight(c) +
    <imp_vector, vector(c)>: pairs among the given features and numbers are in
    imp_logit, pairs with the missing one come from the product. ``df`` has the
    processed layout; the levels' parameters are joined by code, as
    ``join_weights`` does.
    """
    k, spark = model.vectors.shape[1], df.sparkSession
    zero = F.array(*[F.lit(0.0)] * k)
    linear, total, square = F.lit(model.bias), zero, F.lit(0.0)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    norm = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    for i in features:
        rows = [(c, *model.level(i, c)) for c in range(model.sizes[i])]
        levels = spark.createDataFrame(rows, "code long, w double, v array<double>").select(F.col("code").alias(f"cat_{i}"), F.col("w").alias(f"_w{i}"), F.col("v").alias(f"_v{i}"))
        df = df.join(F.broadcast(levels) if len(rows) <= MAX_BROADCAST_ROWS else levels, f"cat_{i}", "left")
        linear, own = linear + F.coalesce(F.col(f"_w{i}"), F.lit(0.0)), F.coalesce(F.col(f"_v{i}"), zero)
        total, square = plus(total, own), square + norm(own)
    for j in range(n_num):
        at, x = model.starts[-1] + j, F.col(f"num_{j}").cast("double")
        linear = linear + x * float(model.weights[at])
        total = plus(total, F.array(*[x * float(f) for f in model.vectors[at]]))
        square = square + x * x * float((model.vectors[at] ** 2).sum())
    df = df.withColumn(vector, total).withColumn("_linear", linear).withColumn("_square", square)
    pairs = (norm(F.col(vector)) - F.col("_square")) / 2
    return df.withColumn(logit, F.col("_linear") + pairs).drop("_linear", "_square", *[f"_{a}{i}" for a in "wv" for i in features])


def fit_score_fm(train: DataFrame, apply_to: DataFrame, n_cat: int = 9, n_num: int = 8,
                 label: str = "conversion_flag", factor_size: int = 16, max_iter: int = 50) -> DataFrame:
    """Factorization machine with 16 factors (M3): pairwise category interactions."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.functions import vector_to_array
    fm = FMClassifier(featuresCol="features", labelCol=label, factorSize=factor_size, maxIter=max_iter, seed=7)
    model = Pipeline(stages=[_assembled(train, n_cat, n_num), fm]).fit(train)
    return model.transform(apply_to).withColumn("score", vector_to_array("probability")[1])
