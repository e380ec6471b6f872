"""Three-day-ahead severity forecasts with Spark ML trees."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrorisk.functions.forest import forest_classes, read_trees, tables
from hydrorisk.functions.scalars import drop_missing, severity_name, severity_ordinal
from hydrorisk.operators.metrics import (
    accuracy,
    confusion,
    evaluate_predictions,
    exact_match,
    f1_scores,
)
from hydrorisk.operators.panel import (
    balanced_weights,
    encode_division,
    fit_division_encoder,
    panel_features,
    with_class_weight,
)
from hydrorisk.operators.splits import split_fraction, stratified_folds
from hydrorisk.operators.windows import lead_rows, over_rows
from hydrorisk.schemas import FEATURES, HORIZONS, KEY, PREDICTIONS, SEVERITIES, TARGETS
from hydrorisk.session import settle

# Share of the rows, one in so many, that tells boosting when to stop, and the least gain of a
# round on them, relative to their error.
VALIDATION_ROWS = 5
VALIDATION_GAIN = 0.01

# Trees get missing inputs as a value below every measurement, so that a split
# can send them either way.
MISSING_INPUT = -9999.0


@dataclass(frozen=True)
class TreeParams:
    """Settings of one classifier; the boosted kind uses all, the forest ignores the rate."""

    kind: str = "forest"
    trees: int = 100
    depth: int = 6
    learning_rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42


def horizon_targets(df: DataFrame, label: str, rows_per_task: int | None = None) -> DataFrame:
    """Label 1, 2 and 3 rows ahead."""
    return over_rows(
        df,
        lambda w: lead_rows(w, label, HORIZONS),
        ahead=max(HORIZONS),
        rows_per_task=rows_per_task,
    )


def prepare_features(
    df: DataFrame, encoder: DataFrame | None = None, rows_per_task: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """All columns and the twelve inputs of every row with a previous day, and the encoder used.

    Needs no targets, so the newest days can be scored: pass rows with the index against a
    stored baseline, and the stored encoder; rows of divisions it does not know are
    left out. Without an encoder one is fitted, for which the features are stored in the
    shared folder (a job).
    """
    featured = drop_missing(panel_features(df, rows_per_task), ["rain_lag_1"])
    if encoder is None:
        featured = settle(featured, "features")
        encoder = fit_division_encoder(featured)
    return encode_division(featured, encoder), encoder


def newest_features(
    df: DataFrame, encoder: DataFrame, rows: int = 3, rows_per_task: int | None = None
) -> DataFrame:
    """Keys and the twelve inputs of the last ``rows`` rows of every known division."""
    coded, _ = prepare_features(df, encoder, rows_per_task)
    followed = over_rows(
        coded,
        lambda w: {"_followed": F.lead(F.lit(1), rows).over(w)},
        ahead=rows,
        rows_per_task=rows_per_task,
    )
    return followed.filter(F.col("_followed").isNull()).select(*KEY, *FEATURES)


def horizon_rows(df: DataFrame, labels: list[str], rows_per_task: int | None = None) -> DataFrame:
    """Inputs but the division's code, the ordinals of ``labels`` and what they are 1, 2 and 3 rows ahead.

    Rows without a previous day go first; labels are looked up ahead among the rows left. One
    shuffle for all windows and labels.
    """
    featured = drop_missing(panel_features(df, rows_per_task), ["rain_lag_1"])
    coded = featured.withColumns({c: severity_ordinal(F.col(c)) for c in labels})

    def ahead(window) -> dict[str, Column]:
        leads = {c: lead_rows(window, c, HORIZONS) for c in labels}
        return {f"{c}_{t}": value for c, found in leads.items() for t, value in found.items()}

    rows = over_rows(coded, ahead, ahead=max(HORIZONS), rows_per_task=rows_per_task)
    targets = [f"{c}_{t}" for c in labels for t in TARGETS]
    return rows.select(*KEY, *[c for c in FEATURES if c in rows.columns], *labels, *targets)


def encode_horizon(rows: DataFrame, label: str, encoder: DataFrame) -> DataFrame:
    """Keys, the twelve features and the targets of one label of :func:`horizon_rows`.

    The encoder leaves out whole divisions, so no label looked up ahead changes.
    """
    known = drop_missing(encode_division(rows, encoder), [*[f"{label}_{t}" for t in TARGETS], label])
    targets = [F.col(f"{label}_{t}").cast("int").alias(t) for t in TARGETS]
    return known.select(*KEY, *FEATURES, *targets)


def prepare_horizon(
    df: DataFrame,
    label: str,
    encoder: DataFrame | None = None,
    rows_per_task: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Keys, the twelve features and the three targets, with the encoder used.

    Rows without a previous day go first, then divisions the encoder does not know; labels
    are looked up ahead among the rows left. Without an encoder one is fitted, for which the
    rows are stored in the shared folder (a job).
    """
    rows = horizon_rows(df, [label], rows_per_task)
    if encoder is None:
        rows = settle(rows, "features")
        encoder = fit_division_encoder(rows)
    return encode_horizon(rows, label, encoder), encoder


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows for fitting, drawn by a hash of their keys; all of a smaller input."""
    return df.orderBy(F.xxhash64(*KEY), *KEY).limit(rows)


def _vector_stages() -> list:
    filled = ", ".join(
        f"coalesce(cast({c} as double), {MISSING_INPUT}D) AS _in_{c}" for c in FEATURES
    )
    return [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_in_{c}" for c in FEATURES], outputCol="_features"),
    ]


def _suffix(target: str) -> str:
    return target.removeprefix("target_")


def _classifier(params: TreeParams, target: str, output: str, weighted: bool) -> Estimator:
    """A forest for one horizon."""
    if params.kind != "forest":
        raise ValueError(f"unknown kind of trees: {params.kind}")
    model = RandomForestClassifier(
        numTrees=params.trees,
        maxDepth=params.depth,
        subsamplingRate=params.row_share,
        featureSubsetStrategy=str(params.column_share),
        seed=params.seed,
        probabilityCol=f"_probability_{_suffix(target)}",
    )
    model.setFeaturesCol("_features").setLabelCol(target).setPredictionCol(output)
    model.setRawPredictionCol(f"_raw_{_suffix(target)}")
    return model.setWeightCol("class_weight") if weighted else model


def _booster(params: TreeParams, target: str, level: int, weighted: bool) -> Estimator:
    """One class against the rest, for one horizon.

    Spark's boosted trees are binary. Rounds end early, and the best round counts, once a
    round no longer lowers the error of the rows marked ``_validation``.
    """
    name = f"{_suffix(target)}_{level}"
    model = GBTClassifier(
        maxIter=params.trees,
        maxDepth=params.depth,
        stepSize=params.learning_rate,
        subsamplingRate=params.row_share,
        featureSubsetStrategy=str(params.column_share),
        seed=params.seed,
        validationTol=VALIDATION_GAIN,
        validationIndicatorCol="_validation",
    )
    model.setFeaturesCol("_features").setLabelCol(f"_is_{name}").setPredictionCol(f"_hit_{name}")
    model.setRawPredictionCol(f"_raw_{name}").setProbabilityCol(f"_share_{name}")
    return model.setWeightCol("class_weight") if weighted else model


def fit_hazard(
    df: DataFrame, weights: DataFrame | None = None, params: TreeParams = TreeParams()
) -> PipelineModel:
    """One model with three outputs: a classifier per horizon over the same inputs.

    The class weights belong to the day-1 class of each row and serve all three. ``boosted``
    fits a booster per horizon and class; every fifth row, by a hash of the keys, decides when
    its rounds end. Horizons and classes are independent Spark jobs, submitted side by side.
    """
    weighted = weights is not None
    if weighted:
        df = with_class_weight(df, weights, TARGETS[0])
    stages = _vector_stages()
    vectors = reduce(lambda d, stage: stage.transform(d), stages, df)
    kept = ["_features", *TARGETS] + (["class_weight"] if weighted else [])
    levels = range(len(SEVERITIES))
    if params.kind == "boosted":
        held_out = F.pmod(F.xxhash64(*KEY), F.lit(VALIDATION_ROWS)) == 0
        flags = [
            (F.col(t) == level).cast("double").alias(f"_is_{_suffix(t)}_{level}")
            for t in TARGETS
            for level in levels
        ]
        vectors = vectors.select(*kept, held_out.alias("_validation"), *flags)
        estimators = [_booster(params, t, level, weighted) for t in TARGETS for level in levels]
    else:
        vectors = vectors.select(kept)
        pairs = zip(TARGETS, PREDICTIONS, strict=True)
        estimators = [_classifier(params, t, p, weighted) for t, p in pairs]
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)

    @inheritable_thread_target(df.sparkSession)
    def fit(estimator: Estimator):
        return estimator.fit(vectors)

    try:
        with ThreadPool(len(TARGETS)) as pool:
            models = pool.map(fit, estimators, chunksize=1)
    finally:
        vectors.unpersist()
    return PipelineModel([*stages, *models])


def _likeliest(scored: DataFrame, target: str) -> Column:
    """The class whose booster gives the greatest share; the mildest of equals."""
    shares = F.array(
        *[
            F.element_at(vector_to_array(f"_share_{_suffix(target)}_{level}"), 2)
            for level in range(len(SEVERITIES))
        ]
    )
    return F.array_position(shares, F.array_max(shares)) - 1


def _trees(spark: SparkSession, forests: list) -> list[list[dict]]:
    """The trees of each forest, stored and read side by side."""

    @inheritable_thread_target(spark)
    def trees(forest):
        return read_trees(spark, forest)

    with ThreadPool(len(forests)) as pool:
        return pool.map(trees, forests, chunksize=1)


def _asked(df: DataFrame, inputs: list[str], trees: list[list[dict]], outputs: list[str]) -> DataFrame | None:
    """The rows with the predictions of forests, or None where a tree is too large for a batch's tables."""
    known = tables(trees, len(inputs))
    if known is None:
        return None
    asked = df.withColumn("_classes", forest_classes(known, inputs, outputs))
    return asked.withColumns({c: F.col(f"_classes.{c}") for c in outputs}).drop("_classes")


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """The input rows with three predicted ordinals.

    Forests are stored once and asked in batches (jobs over the trees, none over the rows);
    boosters, and forests with larger trees than that holds, go through Spark ML's ``transform``.
    """
    filled, assembler, *forests = model.stages
    scored = None
    if all(isinstance(f, RandomForestClassificationModel) for f in forests):
        outputs = [forest.getPredictionCol() for forest in forests]
        trees = _trees(df.sparkSession, forests)
        scored = _asked(filled.transform(df), assembler.getInputCols(), trees, outputs)
    if scored is None:
        scored = model.transform(df)
    if PREDICTIONS[0] not in scored.columns:
        likeliest = zip(PREDICTIONS, TARGETS, strict=True)
        scored = scored.withColumns({p: _likeliest(scored, t) for p, t in likeliest})
    return scored.select(
        *df.columns, *[F.col(p).cast("int").alias(p) for p in PREDICTIONS]
    )


def predict_each(df: DataFrame, models: list[PipelineModel]) -> DataFrame:
    """The input rows with the predictions of several models over the same inputs, as ``<prediction>_<n>``.

    The rows pass Python once for all forests whose trees a batch's tables hold; each other model is
    asked by :func:`predict`.
    """
    names = [{p: f"{p}_{n}" for p in PREDICTIONS} for n in range(len(models))]
    together, outputs, alone = [], [], []
    for model, named in zip(models, names, strict=True):
        filled, assembler, *forests = model.stages
        trees = None
        if all(isinstance(f, RandomForestClassificationModel) for f in forests):
            trees = _trees(df.sparkSession, forests)
            if tables(trees, len(FEATURES)) is None:
                trees = None
        if trees is None:
            alone.append((model, named))
        else:
            together += trees
            outputs += [named[f.getPredictionCol()] for f in forests]
    scored = df
    if together:
        asked = _asked(filled.transform(df), assembler.getInputCols(), together, outputs)
        scored = asked.select(*df.columns, *outputs)
    for model, named in alone:
        scored = predict(scored, model).withColumnsRenamed(named)
    return scored.select(*df.columns, *[name for named in names for name in named.values()])


def boosting_rounds(model: PipelineModel) -> dict[tuple[str, int], int]:
    """Rounds kept of each booster, by target and class."""
    rounds = {}
    for stage in model.stages:
        if hasattr(stage, "getMaxIter"):
            suffix, level = stage.getLabelCol().removeprefix("_is_").rsplit("_", 1)
            rounds[f"target_{suffix}", int(level)] = stage.getNumTrees
    return rounds


def predicted_names(df: DataFrame) -> DataFrame:
    """Predicted ordinals as severity names."""
    return df.withColumns({p: severity_name(F.col(p)) for p in PREDICTIONS})


def draw_params(seed: int, trial: int, kind: str) -> TreeParams:
    """Random settings within the search ranges, which are fixed values."""
    rng = random.Random(f"{seed}-{trial}")
    return TreeParams(
        kind=kind,
        trees=rng.randint(50, 150),
        depth=rng.randint(3, 8),
        learning_rate=math.exp(rng.uniform(math.log(0.01), math.log(0.2))),
        row_share=rng.uniform(0.6, 1.0),
        column_share=rng.uniform(0.6, 1.0),
        seed=seed,
    )


def tune_hazard(
    train: DataFrame,
    trials: int = 5,
    seed: int = 42,
    kind: str = "forest",
    candidates: list[TreeParams] | None = None,
    fit_rows: int | None = None,
    parts: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[TreeParams, list[tuple[TreeParams, float]]]:
    """Settings with the best exact match on a held-out tail of the training rows.

    The class weights come from all training rows, before the hold-out. ``fit_rows`` bounds
    the rows that are fitted on; the whole hold-out is scored, read once for all settings, whose
    predictions are stored. ``parts`` are the rows to fit on and the hold-out, if already split.
    """
    weights = settle(balanced_weights(train, TARGETS[0]), "weights")
    fitting, holdout = parts or split_fraction(train, 0.8)
    if fit_rows is not None:
        fitting = settle(bounded_sample(fitting, fit_rows), "fit-rows")
    tried = candidates or [draw_params(seed, t, kind) for t in range(trials)]
    models = [fit_hazard(fitting, weights, params) for params in tried]
    guesses = predict_each(holdout.select(*FEATURES, *TARGETS), models).drop(*FEATURES)
    guesses = settle(guesses, "guesses")
    scores = []
    for n, params in enumerate(tried):
        predicted = guesses.select(*TARGETS, *[F.col(f"{p}_{n}").alias(p) for p in PREDICTIONS])
        score = exact_match(predicted).first()["exact_match"]
        scores.append((params, score if score is not None else 0.0))
    return max(scores, key=lambda s: s[1])[0], scores


def train_hazard(
    prepared: DataFrame, trials: int = 5, seed: int = 42, kind: str = "forest"
) -> tuple[PipelineModel, TreeParams, dict[str, float]]:
    """Tune on the first 80 % of the rows, fit on them, score both parts."""
    train, test = split_fraction(prepared, 0.8)
    best, _ = tune_hazard(train, trials, seed, kind)
    model = fit_hazard(train, balanced_weights(train, TARGETS[0]), best)
    scores = {
        name: exact_match(predict(part, model)).first()["exact_match"]
        for name, part in (("train", train), ("test", test))
    }
    return model, best, scores


def save_model(model: PipelineModel, encoder: DataFrame, path: str) -> None:
    """Store the model and its division encoder side by side."""
    model.write().overwrite().save(f"{path}/model")
    encoder.write.mode("overwrite").parquet(f"{path}/encoder")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/encoder")


def evaluate_hazard(test: DataFrame, model: PipelineModel, hazard: str) -> DataFrame:
    """Metric table of one hazard over prepared test rows."""
    return evaluate_predictions(predict(test, model), hazard)


def cross_validation_counts(
    df: DataFrame,
    params: TreeParams = TreeParams(),
    folds: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Confusion counts per fold of unweighted day-1 classifiers over stratified folds.

    Each classifier is fitted on all rows of the other folds; every row is scored once.
    """
    filled, assembler = _vector_stages()
    dealt = stratified_folds(df, TARGETS[0], folds, seed)
    dealt = settle(dealt.select(*KEY, "fold", *FEATURES, TARGETS[0]), "folds")
    training = [dealt.filter(F.col("fold") != k) for k in range(folds)]
    estimator = _classifier(replace(params, seed=seed), TARGETS[0], PREDICTIONS[0], False)

    @inheritable_thread_target(df.sparkSession)
    def fit(fold: int):
        vectors = assembler.transform(filled.transform(training[fold])).select("_features", TARGETS[0])
        vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return estimator.copy().fit(vectors)
        finally:
            vectors.unpersist()

    with ThreadPool(folds) as pool:
        models = pool.map(fit, range(folds))
    scored = []
    for k, model in enumerate(models):
        rows = filled.transform(dealt.filter(F.col("fold") == k))
        trees = _trees(df.sparkSession, [model])
        asked = _asked(rows, assembler.getInputCols(), trees, [PREDICTIONS[0]])
        if asked is None:
            asked = model.transform(assembler.transform(rows))
        scored.append(asked.select("fold", TARGETS[0], F.col(PREDICTIONS[0]).cast("int").alias(PREDICTIONS[0])))
    predicted = reduce(DataFrame.unionByName, scored)
    return settle(confusion(predicted, TARGETS[0], PREDICTIONS[0], by=["fold"]), "confusion")


def cross_validate_day1(
    df: DataFrame,
    params: TreeParams = TreeParams(),
    folds: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Mean accuracy and F1 of unweighted day-1 classifiers over stratified folds."""
    counts = cross_validation_counts(df, params, folds, seed)
    return (
        accuracy(counts, ["fold"])
        .join(f1_scores(counts, ["fold"]), "fold")
        .agg(*[F.avg(m).alias(m) for m in ("accuracy", "f1_macro", "f1_weighted")])
    )
