"""Next-set suggestions (O1-O9, I14): training pairs, a boosted-tree
regressor in Spark ML, predictions, and the rule-based fallback."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.functions.exprs import as_of_date, days_between, null_strict_greatest, reps_rule
from liftlake.operators.latest import latest_by_window
from liftlake.operators.trend import session_pairs
from liftlake.operators.upsert import stored

FEATURES = ["prev_weight_kg", "prev_reps", "prev_rpe", "prev_volume", "set_number", "days_since_last"]
LABEL = "next_weight_kg"
MODEL_VERSION = "boosted_tree_v1"
SERIES = ["user_id", "exercise_id", "set_number"]


def training_pairs(fct: DataFrame, keep_keys: bool = False) -> DataFrame:
    """O1: each set with the previous set of the same (user, exercise, set
    number) series; rows without a previous set are dropped. Ties on the
    date are ordered by creation time and log id (total order)."""
    order = [F.col("training_date").asc(), F.col("created_at").asc(), F.col("log_id").asc()]
    p = session_pairs(fct, SERIES, order, ["weight_kg", "reps", "rpe", "volume"])
    p = p.withColumn(LABEL, F.col("weight_kg"))
    p = p.where(F.col("prev_weight_kg").isNotNull() & F.col("days_since_last").isNotNull())
    cols = ([*SERIES, "training_date"] if keep_keys else []) + FEATURES + [LABEL]
    return p.select(*dict.fromkeys(cols))


def pair_counts(fct: DataFrame) -> DataFrame:
    """O2: all rows and rows usable as training pairs (>= 30 wanted)."""
    order = [F.col("training_date").asc(), F.col("created_at").asc(), F.col("log_id").asc()]
    p = session_pairs(fct, SERIES, order, ["weight_kg"])
    return p.agg(F.count(F.lit(1)).alias("total_rows"),
                 F.count_if(F.col("prev_weight_kg").isNotNull() & F.col("days_since_last").isNotNull())
                 .alias("valid_pairs"))


def _validation_flag(df: DataFrame, fraction_pct: int = 20) -> F.Column:
    """Deterministic split: a hash of the feature values, not a random draw,
    so a recomputed partition gets the same split."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in FEATURES + [LABEL]]), F.lit(100)) < fraction_pct


def train_predictor(pairs: DataFrame, trials: int = 5, max_iter: int = 50, seed: int = 7,
                    path: str | None = None):
    """O3: Imputer(prev_rpe) -> VectorAssembler -> GBTRegressor with early
    stopping on a held-out indicator column; ``trials`` candidate depths are
    compared with TrainValidationSplit and the best model is kept (and saved
    to ``path``, replacing the old one)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    data = pairs.select(*[F.col(c).cast("double").alias(c) for c in FEATURES + [LABEL]])
    data = data.withColumn("is_validation", _validation_flag(data))
    # tuning and boosting pass over the pairs many times: materialise them once
    # in the shared checkpoint folder instead of re-deriving them from the log
    data = stored(data, "pairs")
    imputer = Imputer(inputCols=["prev_rpe"], outputCols=["prev_rpe_filled"], strategy="median")
    feats = [c if c != "prev_rpe" else "prev_rpe_filled" for c in FEATURES]
    assembler = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=LABEL, predictionCol="predicted_next_weight_kg",
                       maxIter=max_iter, seed=seed, validationIndicatorCol="is_validation",
                       validationTol=0.01)
    pipe = Pipeline(stages=[imputer, assembler, gbt])
    depths = [2, 3, 4, 5, 6][:max(1, trials)]
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, depths).build()
    ev = RegressionEvaluator(labelCol=LABEL, predictionCol="predicted_next_weight_kg", metricName="mae")
    tvs = TrainValidationSplit(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, trainRatio=0.8,
                               seed=seed, parallelism=min(len(grid), 4))
    model = tvs.fit(data).bestModel
    if path:
        model.write().overwrite().save(path)
    return model


def evaluate(predicted: DataFrame, label: str = LABEL, prediction: str = "predicted_next_weight_kg") -> DataFrame:
    """MAE, MSE and R2 (against the labels' mean) of a prediction column as
    one row, in one aggregate; rows without a label or a prediction are left
    out, and R2 is NULL where the labels do not vary."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    return (predicted.where(y.isNotNull() & F.col(prediction).isNotNull())
            .agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("_v"))
            .select("mae", "mse", F.when(F.col("_v") != 0, 1 - F.col("mse") / F.col("_v")).alias("r2")))


def evaluate_predictor(model, pairs: DataFrame) -> DataFrame:
    """MAE, MSE and R2 of the model on ``pairs`` as one row."""
    data = pairs.select(*[F.col(c).cast("double").alias(c) for c in FEATURES + [LABEL]])
    return evaluate(model.transform(data))


def latest_per_set(fct: DataFrame, as_of=None) -> DataFrame:
    """The most recent row per (user, exercise, set number) with its age
    in days (ties: newest creation, then highest log id)."""
    order = [F.col("training_date").desc(), F.col("created_at").desc(), F.col("log_id").desc()]
    latest = latest_by_window(fct, SERIES, order, n=1)
    return latest.select("user_id", "exercise_id", "exercise_name", "set_number", "weight_kg", "reps", "rpe",
                         "volume", "training_date",
                         days_between(as_of_date(as_of), "training_date").alias("days_since_last"))


def latest_per_set_number(fct: DataFrame, user_id: str, exercise_id: str) -> DataFrame:
    """The latest row of every set number of one user and exercise."""
    one = fct.where((F.col("user_id") == user_id) & (F.col("exercise_id") == exercise_id))
    order = [F.col("training_date").desc(), F.col("created_at").desc(), F.col("log_id").desc()]
    return latest_by_window(one, ["set_number"], order, n=1).select(
        "set_number", "weight_kg", "reps", "rpe", "training_date")


def predict_next(model, latest: DataFrame) -> DataFrame:
    """Model output for each latest set (inputs renamed to prev_*); the
    original joins predictions back on the series key, so a NULL key gets no
    prediction."""
    feats = latest.select("*", F.col("weight_kg").cast("double").alias("prev_weight_kg"),
                          F.col("reps").cast("double").alias("prev_reps"),
                          F.col("rpe").cast("double").alias("prev_rpe"),
                          F.col("volume").cast("double").alias("prev_volume"),
                          F.col("days_since_last").cast("double").alias("_dsl"))
    feats = feats.withColumn("set_number_d", F.col("set_number").cast("double"))
    x = (feats.drop("days_since_last").withColumnRenamed("_dsl", "days_since_last")
              .withColumnRenamed("set_number", "_set_number").withColumnRenamed("set_number_d", "set_number"))
    out = model.transform(x)
    keyed = F.col("user_id").isNotNull() & F.col("exercise_id").isNotNull() & F.col("_set_number").isNotNull()
    return (out.withColumn("predicted_next_weight_kg", F.when(keyed, F.col("predicted_next_weight_kg")))
               .drop("set_number").withColumnRenamed("_set_number", "set_number")
               .select(*latest.columns, "predicted_next_weight_kg"))


def suggest(predicted: DataFrame, as_of=None, model_version: str = MODEL_VERSION) -> DataFrame:
    """weight = greatest(prediction, current) rounded to 1 (NULL
    when either is NULL), reps by the RPE rule, volume from the unrounded
    weight."""
    g = null_strict_greatest("predicted_next_weight_kg", "weight_kg")
    reps = reps_rule("rpe", "reps")
    return predicted.select(
        "user_id", "exercise_id", "exercise_name", "set_number",
        F.col("weight_kg").alias("current_weight_kg"), F.col("reps").alias("current_reps"),
        F.col("rpe").alias("current_rpe"), F.round(g, 1).alias("suggested_weight_kg"),
        reps.alias("suggested_reps"), F.round(g * reps, 1).alias("suggested_volume"),
        as_of_date(as_of).alias("suggested_date"), F.lit(model_version).alias("model_version"))


def m_ml_suggestion(fct: DataFrame, model, as_of=None) -> DataFrame:
    """Latest sets -> predictions -> suggestions."""
    return suggest(predict_next(model, latest_per_set(fct, as_of)), as_of)


def fallback_suggest(fct: DataFrame, flat: bool = False) -> DataFrame:
    """Rule-based next set from each series' latest set. RPE >= 9.5:
    same weight, reps + 1; RPE <= 7.0: weight x 1.05; otherwise (or no RPE,
    RPE 0 counts as none): weight x 1.025. Weight rounded half-even to one
    digit, volume from the unrounded weight. ``flat``: +2.5 % for every set
    of the latest date only."""
    order = [F.col("training_date").desc(), F.col("created_at").desc(), F.col("log_id").desc()]
    if flat:
        # latest date per series from an aggregate, joined back (no window over set rows)
        ld = fct.groupBy("user_id", "exercise_id").agg(F.max("training_date").alias("_ld")) \
            .withColumnRenamed("user_id", "_u").withColumnRenamed("exercise_id", "_e")
        rows = fct.join(ld, fct.user_id.eqNullSafe(ld._u) & fct.exercise_id.eqNullSafe(ld._e)
                        & (fct.training_date == ld._ld))
        w = F.col("weight_kg") * 1.025
        sw = F.bround(w, 1)
        return rows.select("user_id", "exercise_id", "set_number", sw.alias("suggested_weight_kg"),
                           F.col("reps").alias("suggested_reps"),
                           F.bround(sw * F.col("reps"), 1).alias("suggested_volume"))
    latest = latest_by_window(fct, SERIES, order, n=1)
    rpe = F.when(F.col("rpe") != 0, F.col("rpe"))
    w = (F.when(rpe >= 9.5, F.col("weight_kg")).when(rpe <= 7.0, F.col("weight_kg") * 1.05)
          .otherwise(F.col("weight_kg") * 1.025))
    reps = F.when(rpe >= 9.5, F.col("reps") + 1).otherwise(F.col("reps")).cast("bigint")
    return latest.select("user_id", "exercise_id", "set_number", F.bround(w, 1).alias("suggested_weight_kg"),
                         reps.alias("suggested_reps"), F.bround(w * reps, 1).alias("suggested_volume"))


def suggest_with_fallback(ml: DataFrame, fallback: DataFrame) -> DataFrame:
    """Model rows where the (user, exercise) has any, else the fallback;
    tagged with the source."""
    cols = ["user_id", "exercise_id", "set_number", "suggested_weight_kg", "suggested_reps", "suggested_volume"]
    m = ml.select(*cols).withColumn("source", F.lit("ml"))
    have = m.select("user_id", "exercise_id").distinct()
    fb = fallback.join(have, ["user_id", "exercise_id"], "left_anti").select(*cols).withColumn("source", F.lit("fallback"))
    return m.unionByName(fb)


def retrain_schedule(run_date: _dt.date) -> bool:
    """Retrain (and refresh suggestions) only on Mondays."""
    return run_date.weekday() == 0
