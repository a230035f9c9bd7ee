"""Named metrics: which exist per modality, how they are chosen, and their normalized scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.metrics import efficacy, likelihood, privacy, sequences, shapes, validity
from mirrorframe.metrics.report import modelled
from mirrorframe.sources.metadata import Metadata, TableSpec

# The metric names chosen by default.
PROBLEM_TYPE_METRICS = {
    "binary_classification": [
        "BinaryDecisionTreeClassifier", "BinaryAdaBoostClassifier", "BinaryLogisticRegression", "BinaryMLPClassifier",
    ],
    "multiclass_classification": ["MulticlassDecisionTreeClassifier", "MulticlassMLPClassifier"],
    "regression": ["LinearRegression"],
    "bayesian_likelihood": ["BNLogLikelihood"],
    "gaussian_likelihood": ["GMLogLikelihood(10)", "GMLogLikelihood(30)"],
}
DATA_MODALITY_METRICS = {
    "single_table": ["CSTest", "KSComplement"],
    "multi_table": ["CSTest", "KSComplement"],
    "sequential": ["TSFClassifierEfficacy", "TSFCDetection"],
}


@dataclass(frozen=True)
class Metric:
    """`compute(real, synthetic, table, **kwargs)` gives a number within [low, high]."""

    name: str
    compute: Callable[..., float | None]
    low: float = 0.0
    high: float = 1.0

    def normalize(self, score: float | None) -> float | None:
        if score is None or math.isnan(score):
            return None
        if math.isinf(self.low) and math.isinf(self.high):
            return 1.0 / (1.0 + math.exp(-score)) if score > -700 else 0.0
        if math.isinf(self.low):
            return math.exp(score - self.high)
        return (score - self.low) / (self.high - self.low)


def _mean(scores: DataFrame) -> float | None:
    return scores.agg(F.avg("score")).first()[0]


def _ks(real, synthetic, table: TableSpec):
    numbers, _ = modelled(table)
    return _mean(shapes.ks_complement(real, synthetic, numbers)) if numbers else None


def _chi_square(real, synthetic, table: TableSpec):
    _, texts = modelled(table)
    return _mean(shapes.chi_square(real, synthetic, texts)) if texts else None


def _new_rows(real, synthetic, table: TableSpec, synthetic_sample_size: int | None = None,
              numerical_match_tolerance: float = 0.01):
    numbers, texts = modelled(table)
    share = min(1.0, synthetic_sample_size / max(synthetic.count(), 1)) if synthetic_sample_size else None
    found = validity.new_row_synthesis(real, synthetic, texts, numbers, numerical_match_tolerance, share)
    return found.first()["score"]


def _protection(real, synthetic, table: TableSpec, share: float = privacy.SUBSAMPLE, iterations: int = privacy.ITERATIONS):
    return _mean(privacy.baseline_protection(real, synthetic, *modelled(table), share, iterations))


def _classifier(kind):
    def compute(real, synthetic, table: TableSpec, target: str):
        numbers, texts = modelled(table)
        found = efficacy.classifier_efficacy(
            real, synthetic, [c for c in numbers if c != target], [c for c in texts if c != target], target, [kind])
        return found[0][1]

    return compute


def _regression(real, synthetic, table: TableSpec, target: str):
    numbers, texts = modelled(table)
    return efficacy.regression_efficacy(real, synthetic, [c for c in numbers if c != target], texts, target)


def _mixture(components):
    def compute(real, synthetic, table: TableSpec, iterations: int = 10, n_components: int = components):
        numbers, _ = modelled(table)
        found = likelihood.gm_log_likelihood(real, synthetic, numbers, n_components, iterations)
        return sum(found) / len(found)

    return compute


def _network(real, synthetic, table: TableSpec):
    numbers, texts = modelled(table)
    return likelihood.bn_log_likelihood(real, synthetic, texts, numbers).first()["score"]


def _sequence_detection(real, synthetic, table: TableSpec, value: str):
    return sequences.detection(real, synthetic, table.sequence_key, table.sequence_index, value)


def _sequence_efficacy(real, synthetic, table: TableSpec, value: str, target: str):
    labels = tuple(df.groupBy(table.sequence_key).agg(F.max(target).alias("label")) for df in (real, synthetic))
    return sequences.classifier_efficacy(real, synthetic, labels, table.sequence_key, table.sequence_index, value)


_SINGLE = [
    Metric("KSComplement", _ks), Metric("CSTest", _chi_square), Metric("NewRowSynthesis", _new_rows),
    Metric("DCRBaselineProtection", _protection),
    Metric("BinaryDecisionTreeClassifier", _classifier("decision_tree")),
    Metric("BinaryAdaBoostClassifier", _classifier("boosted_trees")),
    Metric("BinaryLogisticRegression", _classifier("logistic_regression")),
    Metric("BinaryMLPClassifier", _classifier("mlp")),
    Metric("MulticlassDecisionTreeClassifier", _classifier("decision_tree")),
    Metric("MulticlassMLPClassifier", _classifier("mlp")),
    Metric("LinearRegression", _regression, low=-math.inf),
    Metric("GMLogLikelihood", _mixture(10), low=-math.inf, high=math.inf),
    Metric("GMLogLikelihood(10)", _mixture(10), low=-math.inf, high=math.inf),
    Metric("GMLogLikelihood(30)", _mixture(30), low=-math.inf, high=math.inf),
    Metric("BNLogLikelihood", _network, low=-math.inf, high=0.0),
]


def _per_table(metric: Metric) -> Metric:
    """The single-table metric averaged over the tables it applies to."""

    def compute(real: dict, synthetic: dict, metadata: Metadata, **kwargs):
        found = [metric.compute(real[n], synthetic[n], t, **kwargs) for n, t in metadata.tables.items()]
        found = [f for f in found if f is not None]
        return sum(found) / len(found) if found else None

    return Metric(metric.name, compute, metric.low, metric.high)


METRICS = {
    "single_table": {m.name: m for m in _SINGLE},
    "multi_table": {m.name: _per_table(m) for m in _SINGLE if m.name in ("KSComplement", "CSTest")},
    "sequential": {
        "TSFCDetection": Metric("TSFCDetection", _sequence_detection),
        "TSFClassifierEfficacy": Metric("TSFClassifierEfficacy", _sequence_efficacy),
    },
}


def select_metrics(metrics: Sequence, modality: str) -> list[tuple[Metric, dict]]:
    """Metrics from names, `Metric` objects, or (either, kwargs) pairs; the modality's own where none is given."""
    chosen = []
    for entry in metrics or DATA_MODALITY_METRICS[modality]:
        metric, kwargs = entry if isinstance(entry, tuple) else (entry, {})
        if isinstance(metric, str):
            if metric not in METRICS[modality]:
                raise ValueError(f"Unknown {modality} metric: {metric}")
            metric = METRICS[modality][metric]
        chosen.append((metric, dict(kwargs)))
    return chosen
