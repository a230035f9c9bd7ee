"""Train on synthetic, test on real: classifiers by F1, regression by R2."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.synth.simple import as_number

MISSING = "__nan__"


def prepared(df: DataFrame, numbers: list[str], texts: list[str], target: str, numeric_target: bool) -> DataFrame:
    label = F.col(target).cast("double" if numeric_target else "string").alias("_target")
    return df.where(F.col(target).isNotNull()).select(
        *[as_number(df.schema, c).cast("double").alias(c) for c in numbers],
        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in texts],
        label,
    )


def feature_stages(numbers: list[str], texts: list[str]) -> list:
    """Impute and scale numbers, one-hot texts; unseen texts get their own slot."""
    filled = [f"{c}|filled" for c in numbers]
    coded, hot = [f"{c}|code" for c in texts], [f"{c}|hot" for c in texts]
    stages = []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=filled))
    if texts:
        stages.append(StringIndexer(inputCols=texts, outputCols=coded, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=coded, outputCols=hot, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*filled, *hot], outputCol="raw"))
    stages.append(StandardScaler(inputCol="raw", outputCol="features"))
    return stages


def classifier(kind: str, n_features: int, n_classes: int):
    if kind == "decision_tree":
        return DecisionTreeClassifier(seed=17)
    if kind == "boosted_trees":
        # Stands in for adaptive boosting; two classes only.
        return GBTClassifier(seed=17, maxIter=20)
    if kind == "logistic_regression":
        return LogisticRegression(maxIter=50)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 32, n_classes], seed=17, maxIter=50)
    raise ValueError(f"Unknown classifier: {kind}")


def classifier_efficacy(
    real: DataFrame, synthetic: DataFrame, numbers: list[str], texts: list[str], target: str, kinds: list[str]
) -> list[tuple[str, float]]:
    """(classifier, F1 on real rows) for models trained on synthetic rows."""
    train = prepared(synthetic, numbers, texts, target, numeric_target=False)
    test = prepared(real, numbers, texts, target, numeric_target=False)
    indexer = StringIndexer(inputCol="_target", outputCol="label", handleInvalid="keep").fit(train)
    features = Pipeline(stages=feature_stages(numbers, texts)).fit(train)
    seen = features.transform(indexer.transform(train)).select("features", "label").persist()
    scored = features.transform(indexer.transform(test)).select("features", "label").persist()
    size = len(seen.first()["features"])
    judge = MulticlassClassificationEvaluator(metricName="f1")
    out = []
    for kind in kinds:
        model = classifier(kind, size, len(indexer.labels)).fit(seen)
        # A class the training side lacks can never be predicted: its rows stay, as misses.
        out.append((kind, float(judge.evaluate(model.transform(scored)))))
    seen.unpersist()
    scored.unpersist()
    return out


def regression_efficacy(
    real: DataFrame, synthetic: DataFrame, numbers: list[str], texts: list[str], target: str
) -> float:
    """R2 on real rows of a linear regression fitted to synthetic rows."""
    train = prepared(synthetic, numbers, texts, target, numeric_target=True).withColumnRenamed("_target", "label")
    test = prepared(real, numbers, texts, target, numeric_target=True).withColumnRenamed("_target", "label")
    stages = [*feature_stages(numbers, texts), LinearRegression(regParam=1e-6)]
    model = Pipeline(stages=stages).fit(train)
    return float(RegressionEvaluator(metricName="r2").evaluate(model.transform(test)))
