"""Tree specialists and the stacked meta-ensemble on Spark ML, trained on the pooled table."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from barloom.config import RESEARCH
from barloom.functions.text import keyed_draw, keyed_uniform


def _holdout(df: DataFrame, share: float, seed: int, label: str = "label") -> DataFrame:
    """Keyed random hold-out rows, the same on every run, stratified: ``share`` of each label, by the quantile of its draws."""
    drawn = df.selectExpr("*", f"{keyed_uniform(f'{chr(39)}{seed}{chr(39)}', 'symbol', 'date')} AS _draw")
    cuts = drawn.groupBy(F.col(label).alias("_label")).agg(F.expr(f"percentile_approx(_draw, {share}, 10000) AS _cut"))
    return drawn.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_label"))).selectExpr(*df.columns, "_draw <= _cut AS is_validation")


def fit_gbt(
    train: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 6, rate: float = 0.1, subsample: float = 0.8,
    tolerance: float = 0.01, validation: float = 0.2, seed: int = RESEARCH.seed,
) -> PipelineModel:
    """Boosted trees that stop early on a hold-out; ``label`` is 0 or 1."""
    df = _holdout(train.selectExpr("symbol", "date", *features, f"CAST({label} AS DOUBLE) AS label"), validation, seed)
    gbt = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
        validationIndicatorCol="is_validation", validationTol=tolerance, seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(df)


def fit_forest(train: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 5, seed: int = RESEARCH.seed) -> PipelineModel:
    """Random forest, used for the three regime classifiers and for the meta-ensemble."""
    df = train.selectExpr(*features, f"CAST({label} AS DOUBLE) AS label")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), forest]).fit(df)


def score(model: PipelineModel, df: DataFrame, name: str, min_confidence: float = RESEARCH.min_confidence) -> DataFrame:
    """Batch scores as ``(signal, prob_up, confidence)`` rows of a named model."""
    out = model.transform(df).withColumn("prob_up", vector_to_array("probability")[1])
    keep = [c for c in df.columns if c not in ("signal", "prob_up", "confidence", "model")]
    return out.selectExpr(*keep, f"'{name}' AS model", "prob_up", "2 * abs(prob_up - 0.5D) AS confidence").selectExpr(
        "*", f"CASE WHEN confidence < {min_confidence} THEN 0 WHEN prob_up > 0.5D THEN 1 WHEN prob_up < 0.5D THEN -1 ELSE 0 END AS signal"
    )


def importances(model: PipelineModel, features: list[str], df: DataFrame) -> DataFrame:
    """Feature importance of a fitted tree model as a table; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    )


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], label: str, seed: int = RESEARCH.seed) -> DataFrame:
    """(feature, n_rows, accuracy, drop): how much accuracy falls when a feature's values are dealt to other dates of the symbol.

    Each row emits one copy per feature, with that column replaced, and one as it is; all copies are scored by one transform. A
    symbol's values of all features, bounded by the calendar, are dealt in one aggregate, in a keyed order per feature.
    """
    rows = rows.selectExpr("symbol", "date", *features, f"CAST({label} AS DOUBLE) AS _truth")
    dealt = [f"transform(array_sort(collect_list(struct({keyed_draw(chr(39) + str(seed) + chr(39), chr(39) + c + chr(39), 'symbol', 'date')} AS d, date, {c} AS x))), v -> v.x) AS {c}" for c in features]
    other = rows.groupBy("symbol").agg(*map(F.expr, dealt)).selectExpr("symbol", f"posexplode(arrays_zip({', '.join(features)})) AS (_at, _other)")
    met = rows.selectExpr("*", "row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS _at").join(other, ["symbol", "_at"])
    copies = [f"struct({n} AS _feature, " + ", ".join(f"{'_other.' if c == own else ''}{c} AS {c}" for c in features) + ")"
              for n, own in [("'none'", None), *((f"'{c}'", c) for c in features)]]
    scored = model.transform(met.selectExpr("_truth", f"inline(array({', '.join(copies)}))"))
    rated = scored.groupBy("_feature").agg(F.expr("count(*) AS n_rows"), F.expr("avg(IF(prediction = _truth, 1D, 0D)) AS accuracy"))
    plain = rated.where("_feature = 'none'").selectExpr("accuracy AS _plain")
    return rated.where("_feature <> 'none'").crossJoin(F.broadcast(plain)).selectExpr("_feature AS feature", "n_rows", "accuracy", "_plain - accuracy AS drop")


def stack(preds: DataFrame, models: list[str], context: DataFrame | None = None) -> DataFrame:
    """One row per symbol and date with each model's probability and confidence, and the market context."""
    aggs = []
    for m in models:
        for c, short in (("prob_up", "prob"), ("confidence", "conf")):
            aggs.append(F.expr(f"coalesce(max(IF(model = '{m}', {c}, NULL)), {0.5 if short == 'prob' else 0.0}D) AS {m}_{short}"))
    wide = preds.groupBy("symbol", "date").agg(*aggs, F.expr("avg(confidence) AS avg_confidence"))
    return wide if context is None else wide.join(context, ["symbol", "date"], "left").na.fill(0.0)


def meta_features(models: list[str], context: list[str]) -> list[str]:
    return [f"{m}_{s}" for m in models for s in ("prob", "conf")] + context


def fit_meta(stacked: DataFrame, features: list[str], label: str, trees: int = 50, depth: int = 5, seed: int = RESEARCH.seed) -> PipelineModel:
    """Forest over the stacked predictions, fitted on a keyed four fifths of the rows."""
    train = _holdout(stacked.selectExpr("symbol", "date", *features, f"CAST({label} AS DOUBLE) AS label"), 0.2, seed).where("NOT is_validation")
    return fit_forest(train, features, "label", trees, depth, seed)


def score_meta(model: PipelineModel, stacked: DataFrame, min_confidence: float = RESEARCH.min_confidence) -> DataFrame:
    """Signal of the meta-ensemble, silent when the specialists' mean confidence is too low."""
    out = model.transform(stacked).withColumn("prob_up", vector_to_array("probability")[1])
    return out.selectExpr(
        *stacked.columns, "'meta' AS model", "prob_up", "avg_confidence AS confidence",
        f"CASE WHEN avg_confidence < {min_confidence} THEN 0 WHEN prob_up > 0.5D THEN 1 ELSE -1 END AS signal",
    )
