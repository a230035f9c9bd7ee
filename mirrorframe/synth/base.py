"""What a synthesizer is: `fit` turns tables into a model, `sample` turns a model into tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame

from mirrorframe.sources.metadata import Metadata, TableSpec


class SingleTableSynthesizer(Protocol):
    name: str
    modality: str

    def fit(self, data: DataFrame, table: TableSpec) -> Any: ...

    def sample(self, model: Any, n_rows: int) -> DataFrame: ...


class MultiTableSynthesizer(Protocol):
    name: str
    modality: str

    def fit(self, data: dict[str, DataFrame], metadata: Metadata) -> Any: ...

    def sample(self, model: Any, scale: float = 1.0) -> dict[str, DataFrame]: ...


class _Custom:
    def __init__(self, name: str, modality: str, fit: Callable, sample: Callable):
        self.name, self.modality, self._fit, self._sample = name, modality, fit, sample

    def fit(self, data, metadata):
        return self._fit(data, metadata)

    def sample(self, model, size):
        return self._sample(model, size)


def create_single_table_synthesizer(name: str, fit: Callable, sample: Callable) -> SingleTableSynthesizer:
    """A synthesizer from `fit(DataFrame, TableSpec)` and `sample(model, n_rows)`."""
    return _Custom(f"Custom:{name}", "single_table", fit, sample)


def create_multi_table_synthesizer(name: str, fit: Callable, sample: Callable) -> MultiTableSynthesizer:
    """A synthesizer from `fit(tables, Metadata)` and `sample(model, scale)`."""
    return _Custom(f"Custom:{name}", "multi_table", fit, sample)


def create_synthesizer_variant(name: str, synthesizer_class: type, **parameters):
    """A named variant of a synthesizer with other parameters."""
    variant = synthesizer_class(**parameters)
    variant.name = f"Variant:{name}"
    return variant
